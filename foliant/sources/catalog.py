"""The versioned document catalog: snapshots of (filename, content_hash, status, updated_at) and the chunks they own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stacked

STATES = ["processing", "ready", "failed", "superseded"]
ERROR_LENGTH = 2000
FAILED_NOTICE = "Indexing failed; see the logs and upload the file again."


def document_id(filename, content_hash):
    """A stable id: the same file with the same bytes is the same document."""
    return F.sha2(F.concat_ws("|", filename, content_hash), 256)


def newest_ready(catalog: DataFrame) -> DataFrame:
    """The ready document of each file with the latest (updated_at, document_id)."""
    ready = catalog.filter("status = 'ready'").groupBy("filename")
    return ready.agg(F.max(F.struct("updated_at", "document_id")).alias("m")).select("filename", F.col("m.document_id").alias("document_id"))


def supersede(catalog: DataFrame) -> DataFrame:
    """At most one ready document of each file: older ready ones become superseded."""
    current = newest_ready(catalog).select(F.col("document_id").alias("__current"))
    rows = catalog.join(current, F.col("document_id") == F.col("__current"), "left")
    status = F.when((F.col("status") == "ready") & F.col("__current").isNull(), "superseded").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("__current")


def mark_failed(catalog: DataFrame, failures: DataFrame) -> DataFrame:
    """Documents still processing fail with the error's first 2000 characters; others keep their state."""
    rows = catalog.join(failures.select("document_id", "error"), "document_id", "left")
    fails = (F.col("status") == "processing") & F.col("error").isNotNull()
    return rows.withColumns({
        "status": F.when(fails, "failed").otherwise(F.col("status")),
        "processing_error": F.when(fails, F.substring("error", 1, ERROR_LENGTH)).otherwise(F.col("processing_error")),
    }).drop("error")


def delete(catalog: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the documents named; those that are processing stay."""
    gone = catalog.join(ids, "document_id", "left_semi").filter("status <> 'processing'").select("document_id")
    return catalog.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def listing(catalog: DataFrame) -> DataFrame:
    """What a client sees, newest first: documents that aren't superseded, with a fixed sentence in place of a stored error."""
    shown = catalog.filter("status <> 'superseded'")
    rows = shown.select(*[c for c in catalog.columns if c != "processing_error"], F.when(F.col("status") == "failed", FAILED_NOTICE).alias("processing_error"))
    return rows.orderBy(F.desc("updated_at"), F.desc("document_id"))


def found(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, found, ...) for every id asked for; a superseded document is not found."""
    known = catalog.filter("status <> 'superseded'").withColumn("found", F.lit(True))
    return ids.select("document_id").distinct().join(known, "document_id", "left").fillna(False, ["found"])


def is_current(catalog: DataFrame, expected: dict) -> DataFrame:
    """Add ``current``: ready, with chunks, and made by the versions and settings expected (structs compare as wholes)."""
    good = (F.col("status") == "ready") & (F.col("chunk_count") > 0)
    for name, value in expected.items():
        good &= F.coalesce(F.col(name) == value, F.lit(False))
    return catalog.withColumn("current", good)


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks with those of every document in ``new`` replaced."""
    return stacked(chunks.join(new.select("document_id").distinct(), "document_id", "left_anti"), new)


def migration_status(known: DataFrame, applied: DataFrame) -> DataFrame:
    """(version, state): applied, pending, changed (other checksum) or unknown (applied, but not known here)."""
    rows = known.select("version", F.col("checksum").alias("k")).join(applied.select("version", F.col("checksum").alias("a")), "version", "full_outer")
    state = F.when(F.col("a").isNull(), "pending").when(F.col("k").isNull(), "unknown").when(F.col("k") != F.col("a"), "changed").otherwise("applied")
    return rows.select("version", state.alias("state"))
