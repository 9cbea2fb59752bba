"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import shuffle_partitions, stored


def assign_shards(
    rows: DataFrame,
    order: list[str],
    size: str = "size",
    shards: int = 8,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``; shards are contiguous in ``order`` and near equal in bytes.

    The rows are range-partitioned by ``order`` and written. Each range's total
    size and count (one row a range) give the offset at which its running sum
    starts, and a row goes to the shard in whose equal share of all bytes its
    middle byte lies. ``slot`` counts a shard's rows from 0 without gaps.

    Nulls in ``order`` come first. Repeated rows are interchangeable and are
    spread by a final arbitrary key, so no range holds more than its share.
    Sizes must be positive. An empty input gives an empty result. A row larger
    than a whole share can leave a shard without rows.

    Pass whatever is to be kept as narrow columns: all of ``rows`` is shuffled.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = rows.sparkSession
    n = partitions or shuffle_partitions(spark)
    keys = [F.col(c).asc_nulls_first() for c in order]
    tie = "__tie"
    ranged = (
        rows.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, F.col(tie).asc())
        .sortWithinPartitions(*keys, F.col(tie).asc())
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(tie)
    )
    ranged = stored(ranged, "shard-ranges")
    totals = sorted(
        ranged.groupBy("__part").agg(F.sum(size), F.count(F.lit(1))).collect()
    )  # one row a range, so no more than n
    before = [0, *accumulate(t[1] for t in totals)]
    rows_before = [0, *accumulate(t[2] for t in totals)]
    total = before[-1]
    offsets = spark.createDataFrame(
        [(t[0], before[i], rows_before[i]) for i, t in enumerate(totals)],
        "__part int, __bytes long, __rows long",
    )
    running = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("__bytes") + F.col("__sum") - F.col(size)
    placed = (
        ranged.withColumn("__sum", F.sum(size).over(running))
        .join(F.broadcast(offsets), "__part")
        .withColumn("shard", _share(start, F.col(size), total, shards))
        .withColumn("__at", F.col("__rows") + F.col("__row"))
    )
    firsts = placed.groupBy("shard").agg(F.min("__at").alias("__first"))  # as many rows as shards
    return (
        placed.join(F.broadcast(firsts), "shard")
        .withColumn("slot", F.col("__at") - F.col("__first"))
        .select(*rows.columns, "shard", "slot")
    )


def _share(start: Column, size: Column, total: int, shards: int) -> Column:
    """Which of the equal shares of ``total`` the middle of [start, start + size) lies in."""
    twice = (start * 2 + size) * F.lit(shards)
    return F.least(F.floor(twice / F.lit(max(1, 2 * total))), F.lit(shards - 1)).cast("int")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1) and the text's CRC-32; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The sharding contract: law ``bytes``, so ``grown_shard`` is null."""
    placed = assign_shards(sized_documents(docs), ["doc_id", "text_crc32", "size"], shards=shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 by half bytes: sixteen steps of the polynomial as a list, then a fold over each text's hexadecimal digits, low half first.
ORACLE = """WITH t AS MATERIALIZED (SELECT list_transform(range(16), lambda i: list_reduce(range(4), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i)) AS t),
  b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
  n AS (SELECT doc_id, size, CASE WHEN size = 1 THEN []::BIGINT[] ELSE list_transform(range(len(h)), lambda i: instr('0123456789ABCDEF', h[(i // 2) * 2 + 2 - (i % 2)]) - 1) END AS n FROM b),
  c AS (SELECT doc_id, size, xor(list_reduce(n, lambda r, x: xor(r >> 4, t[(xor(r, x) & 15) + 1]), 4294967295), 4294967295) AS text_crc32 FROM n, t),
  p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM c),
  s AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::INT AS shard FROM p)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM s"""
