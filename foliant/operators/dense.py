"""Exact vector search: blocks of queries against all vectors, the k best kept in the tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from ..tables import shuffle_partitions, stacked, stored

QUERIES_PER_BLOCK = 2048
#: What is broadcast as one block has no more than so many numbers (32 MB).
BLOCK_NUMBERS = 1 << 22
#: So that a few blocks of queries already keep all cores busy.
ITEMS_PER_CELL = 16_384
#: Cells of a query whose best are merged at a time.
FAN_IN = 64


def check_sizes(candidate_k: int, top_k: int) -> None:
    if top_k <= 0 or candidate_k < top_k:
        raise ValueError("candidate_k must be at least top_k, and top_k positive")


def candidates(queries: DataFrame, items: DataFrame, top_k: int, candidate_k: int | None = None, metric: str = "cosine") -> DataFrame:
    """nearest() with as many candidates as a choice of ``top_k`` of them needs: three times as many, if not said."""
    candidate_k = 3 * top_k if candidate_k is None else candidate_k
    check_sizes(candidate_k, top_k)
    return nearest(queries, items, candidate_k, metric)


def nearest(
    queries: DataFrame, items: DataFrame, k: int = 30, metric: str = "cosine", places: int = 9, keep_self: bool = False
) -> DataFrame:
    """(query_id, item_id, distance, dense_rank): the k nearest items of each query, exactly.

    ``queries`` is (query_id, embedding), ``items`` (item_id, embedding).
    Queries that fit one block (QUERIES_PER_BLOCK rows of BLOCK_NUMBERS numbers
    together) are broadcast, and no item is shuffled. More are dealt into
    blocks, items into cells of about ITEMS_PER_CELL, and every block meets
    every cell in a task of its own: one job, however many queries. Either way
    a task holds one block, one batch or cell, their distances a slice at a
    time, and k items a query. Distances are rounded before they are compared;
    ties go to the smaller id. A vector without length is at cosine distance 1.
    As in SQL, what has no distance comes last: first, with NaN, where a vector
    has a component that is not finite, then, with null, where one is missing.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    queries, items = queries.select("query_id", "embedding"), items.select("item_id", "embedding")
    count, numbers = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    best = Best(k, metric, places, keep_self)
    if count <= QUERIES_PER_BLOCK and numbers <= BLOCK_NUMBERS:
        block = queries.toArrow()
        known = queries.sparkSession.sparkContext.broadcast((_ids(block["query_id"]), *_vectors(block["embedding"])))

        def scan(batches):
            yield best.of(*known.value, ((_ids(b["item_id"]), *_vectors(b["embedding"])) for b in batches))

        found = items.mapInArrow(scan, Best.SCHEMA)
    else:
        found = _grid(queries, items, max(-(-count // QUERIES_PER_BLOCK), -(-numbers // BLOCK_NUMBERS)), best)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int, *within: str) -> DataFrame:
    order = Window.partitionBy("query_id", *within).orderBy(F.asc_nulls_last("distance"), "item_id")
    return found.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def _grid(queries: DataFrame, items: DataFrame, blocks: int, best: Best) -> DataFrame:
    """Every block of queries with every cell of items; the best of many cells are merged in two steps."""
    cells = max(1, -(-items.count() // ITEMS_PER_CELL))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    # Both sides may be the same table: no column of one is also one of the other, or Spark hands out the wrong ones.
    left = queries.select(F.col("query_id").alias("q"), F.transform("embedding", lambda x: x).alias("asked"), dealt("query_id", blocks).alias("block"), every(cells).alias("cell")).groupBy("block", "cell")
    right = items.select(F.col("item_id").alias("item"), F.transform("embedding", lambda x: x).alias("vector"), dealt("item_id", cells).alias("cell"), every(blocks).alias("block")).groupBy("block", "cell")

    def meet(key, block: pa.Table, cell: pa.Table) -> pa.Table:
        groups = pa.scalar(key[1].as_py() // FAN_IN, pa.int32())
        if not block.num_rows or not cell.num_rows:  # a side without rows may come without columns
            return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "group": pa.array([], pa.int32())})
        found = best.of(_ids(block["q"]), *_vectors(block["asked"]), [(_ids(cell["item"]), *_vectors(cell["vector"]))])
        return pa.Table.from_batches([found]).append_column("group", pa.repeat(groups, found.num_rows))

    found = left.cogroup(right).applyInArrow(meet, f"{Best.SCHEMA}, group int")
    return (_ranked(found, best.k, "group").drop("dense_rank") if cells > FAN_IN else found).drop("group")


#: In place of a distance, larger than any: a component is not finite, or the vector is missing.
NOT_FINITE, MISSING = 1e300, 1e305


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy()


def _vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, lacks) of a column of lists: ``lacks`` is 0, NOT_FINITE or MISSING, and where it isn't 0 the matrix has zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.unique(pc.list_value_length(column.drop_null())).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different sizes: {sorted(sizes)[:9]}")
    matrix = np.zeros((len(column), *(sizes or [0])))
    matrix[known] = column.flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1) if sizes else 0
    finite = np.isfinite(matrix).all(1)
    matrix[~finite] = 0
    return matrix, np.where(known, np.where(finite, 0, NOT_FINITE), MISSING)


@dataclass(frozen=True)
class Best:
    """The k nearest items of each query among batches of (ids, matrix, lacks).

    A product of matrices says which items may be among the k; of those the
    distances are then taken from the vectors' differences, as the product
    loses the last digits: by it, copies of a vector would be 1e-8 apart.
    """

    k: int
    metric: str
    places: int
    keep_self: bool
    SCHEMA = "query_id long, item_id long, distance double"
    SLICE = 1024  # items whose estimates are held at a time
    PAIRS = 1 << 16  # pairs whose components are held at a time

    def of(self, ids: np.ndarray, queries: np.ndarray, lacks: np.ndarray, batches) -> pa.RecordBatch:
        row, item, key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # what is kept, by row, key and item
        limit = np.full(len(ids), np.inf)  # the key of the k-th
        for whole in map(self._few_copies, batches):
            for at in range(0, len(whole[0]) if len(ids) else 0, self.SLICE):
                own, vectors, lack = (x[at : at + self.SLICE] for x in whole)
                r, c = self._near(limit, ids, queries, lacks, own, vectors, lack)
                new = np.maximum(lacks[r], lack[c])
                new[new == 0] = self._exact(queries, vectors, r[new == 0], c[new == 0])
                row, item, key = np.concatenate([row, r]), np.concatenate([item, own[c]]), np.concatenate([key, new])
                order = np.lexsort((item, key, row))
                row, item, key = row[order], item[order], key[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                limit[row[place == self.k - 1]] = key[place == self.k - 1]
                row, item, key = (x[place < self.k] for x in (row, item, key))
        distance = pa.array(np.where(key >= NOT_FINITE, np.nan, key), mask=key >= MISSING)
        return pa.record_batch({"query_id": pa.array(ids[row]), "item_id": pa.array(item), "distance": distance})

    def _few_copies(self, whole: tuple) -> tuple:
        """The items without those of which k + 1 with the same vector have smaller ids: no query takes them."""
        own, vectors, lack = whole
        alike = np.column_stack([vectors, lack])
        kind = np.unique(alike.view(f"V{alike.strides[0]}").ravel(), return_inverse=True)[1]
        order = np.lexsort((own, kind))
        kind = kind[order]
        kept = order[np.arange(len(kind)) - np.searchsorted(kind, kind) <= self.k]
        return own[kept], vectors[kept], lack[kept]

    def _near(self, limit, ids, queries, lacks, own, items, lack) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all pairs that may be as near as ``limit`` or the k-th of these items, whichever is nearer."""
        q, v = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", items, items)
        error = 1e-15 * max(queries.shape[1], 64)
        rough = queries @ items.T if queries.shape[1] and items.shape[1] else np.zeros((len(ids), len(own)))  # a side may have no vector at all
        if self.metric == "cosine":
            norms = np.sqrt(np.outer(q, v))
            with np.errstate(divide="ignore", invalid="ignore"):
                rough = np.where(norms > 0, 1 - rough / norms, 1.0)
            slack = np.full(len(ids), error)
        else:
            rough = q[:, None] + v[None] - 2 * rough  # a square
            slack = error * (q + v.max(initial=0))
        if lacks.any() or lack.any():
            worst = np.maximum(lacks[:, None], lack[None])
            rough = np.where(worst > 0, worst, rough)
        if not self.keep_self:
            rough[ids[:, None] == own[None]] = np.inf
        near = rough <= self._reach(limit, slack)[:, None]
        if len(own) > self.k and near.sum() > 4 * self.k * len(ids):
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            far = np.maximum(kth + slack, 0)
            kth = np.where(kth < NOT_FINITE, np.sqrt(far) if self.metric == "l2" else far, kth)
            near &= rough <= self._reach(kth, slack)[:, None]
        return np.nonzero(near & (rough < np.inf))

    def _reach(self, key: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """The largest estimate of a pair whose rounded distance may be ``key``."""
        far = np.where(key < NOT_FINITE, key * (1 + 1e-12) + 2 * 10.0**-self.places, 0)
        return np.where(key < NOT_FINITE, (far * far if self.metric == "l2" else far) + slack, key)

    def _exact(self, queries: np.ndarray, items: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for at in range(0, len(rows), self.PAIRS):
            a, b = queries[rows[at : at + self.PAIRS]], items[columns[at : at + self.PAIRS]]
            if self.metric == "l2":
                out[at : at + len(a)] = np.sqrt(((a - b) ** 2).sum(1))
                continue
            norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at : at + len(a)] = np.where(norms > 0, 1 - np.clip((a * b).sum(1) / norms, -1, 1), 1.0)
        return np.round(out, self.places)


def with_similarity(ranked: DataFrame, metric: str) -> DataFrame:
    return ranked.withColumn("similarity", vectors.similarity(F.col("distance"), metric))


def norm_statistics(items: DataFrame) -> DataFrame:
    norm = vectors.norm(F.col("embedding"))
    return items.select(norm.alias("n")).agg(
        F.count("n").alias("vectors"), F.round(F.min("n"), 6).alias("min_norm"), F.round(F.max("n"), 6).alias("max_norm"),
        F.round(F.avg("n"), 6).alias("mean_norm"), F.round(F.stddev_pop("n"), 6).alias("sd_norm"),
    )


def calibrate_threshold(scores: DataFrame, unscored: bool = False) -> DataFrame:
    """(threshold, accuracy): how often ``score >= threshold`` says what ``relevant`` says, for every distinct score, 0 and 1.

    Scores are counted, dealt into ranges and summed up there; the totals of
    the ranges, a row each, say where a range's sums begin. So no task orders
    more than a range, however many different scores there are. Rows without a score
    are left out; with ``unscored`` they are one more threshold above all others,
    as null sorts last in SQL.
    """
    spark = scores.sparkSession
    step = scores.select(F.col("score").cast("double").alias("threshold"), F.col("relevant").cast("int").alias("r"))
    step = step if unscored else step.filter("threshold is not null")
    step = step.groupBy("threshold").agg(F.sum("r").alias("good"), F.sum(1 - F.col("r")).alias("bad"))
    ends = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, good long, bad long")
    step = stacked(step, ends).groupBy("threshold").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ranged = step.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("threshold")).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "thresholds")  # a range must keep its rows
    totals = ranged.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))  # as many rows as partitions
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_before") for c in ("good", "bad")]
    starts = totals.select("range", *sums, F.sum("good").over(Window.partitionBy()).alias("all_good"), F.sum(F.col("good") + F.col("bad")).over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_last("threshold")).rowsBetween(Window.unboundedPreceding, -1)
    below = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_before") for c in ("good", "bad")}
    rows = ranged.join(F.broadcast(starts), "range")
    right = below["bad"] + F.col("all_good") - below["good"]
    return rows.select("threshold", F.round(F.try_divide(right, F.col("all")), 6).alias("accuracy"))


def embedding_problems(items: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(item_id, problem) where a batch of vectors (item_id, embedding) doesn't answer its items one for one; empty if it does."""
    asked = items.select("item_id").withColumn("asked", F.lit(True))
    got = vectors.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.size("embedding"), F.lit(0)) != size).alias("wrong"))
    rows = asked.join(got, "item_id", "full")
    problem = F.when(F.col("n").isNull(), "no vector").when(F.col("asked").isNull(), "no item").when(F.col("n") > 1, "several vectors").when(F.col("wrong"), "wrong size")
    return rows.select("item_id", problem.alias("problem")).filter(F.col("problem").isNotNull())
