"""The catalog over documents (file: source, version: document) and usage over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, rerank
from ..sources import catalog, snapshots
from ..tables import scratch_path, stacked
from .registry import documents, register, table


def _catalog(spark, d: str) -> DataFrame:
    """Documents labelled good are ready, bad ones failed, others still processing; the id stands for the time."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("processing")
    return rows.select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), status.alias("status"), F.col("doc_id").alias("updated_at"), F.lit(None).cast("string").alias("processing_error"))


def deleted(spark, d: str) -> DataFrame:
    """What is left, by file, when every document with a toxic label is deleted."""
    rows = _catalog(spark, d)
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    left, kept = catalog.delete(rows, chunks, toxic)
    both = left.join(kept, "document_id").groupBy("filename")
    return both.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))


def failed(spark, d: str) -> DataFrame:
    """Documents with fewer than 300 visible characters fail, and those whose text another document had before."""
    docs = documents(spark, d)
    short = docs.filter(F.length(F.regexp_replace("text", r"\s", "")) < 300).select(F.col("doc_id").alias("document_id"), F.lit("too little text").alias("error"))
    key = F.sha2("text", 256)
    firsts = docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("first"))
    again = docs.select(F.col("doc_id").alias("document_id"), key.alias("key")).join(firsts, "key").filter("document_id <> first").select("document_id", F.lit("repeated text").alias("error"))
    errors = stacked(short, again).groupBy("document_id").agg(F.min("error").alias("error"))
    out = catalog.mark_failed(_catalog(spark, d), errors)
    return out.groupBy("status", "processing_error").agg(F.count(F.lit(1)).alias("n"))


def listed(spark, d: str) -> DataFrame:
    return catalog.listing(catalog.supersede(_catalog(spark, d)))


def looked_up(spark, d: str) -> DataFrame:
    """The documents of all labels, looked up in the catalog as it is after superseding."""
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return catalog.found(catalog.supersede(_catalog(spark, d)), ids).select("document_id", "found", "filename", "status")


def embedding_gaps(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return dense.embedding_problems(docs, vectors, 64)


def usage_cost(spark, d: str) -> DataFrame:
    """Events as model calls: the value is input tokens, a tenth of it output tokens."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor("value")).alias("input_tokens"), F.sum(F.floor(F.col("value") / 10)).alias("output_tokens"))
    return rows.withColumn("cost", F.round(rerank.cost(F.col("input_tokens"), F.col("output_tokens")), 6))


CATALOG = "catalog AS (SELECT d.doc_id, source AS filename, n_chars, toxic, CASE quality WHEN 1 THEN 'ready' WHEN 0 THEN 'failed' ELSE 'processing' END AS status FROM documents d LEFT JOIN labels USING (doc_id))"

register("catalog_current", lambda s, d: catalog.newest_ready(_catalog(s, d)), f"WITH {CATALOG} SELECT filename, max(doc_id) AS document_id FROM catalog WHERE status = 'ready' GROUP BY filename")
register("catalog_superseded", lambda s, d: catalog.supersede(_catalog(s, d)).groupBy("filename", "status").agg(F.count(F.lit(1)).alias("n")),
         f"WITH {CATALOG}, m AS (SELECT filename, max(doc_id) AS top FROM catalog WHERE status = 'ready' GROUP BY filename) SELECT filename, CASE WHEN status = 'ready' AND doc_id <> top THEN 'superseded' ELSE status END AS status, count(*) AS n FROM catalog LEFT JOIN m USING (filename) GROUP BY ALL")
register("catalog_deleted", deleted, f"WITH {CATALOG} SELECT filename, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM catalog WHERE NOT (coalesce(toxic, 0) = 1 AND status <> 'processing') GROUP BY filename")
register("catalog_failed", failed, f"""WITH {CATALOG}, e AS (SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'repeated text' WHEN length(regexp_replace(text, '\\s', '', 'g')) < 300 THEN 'too little text' END AS error FROM documents),
  f AS (SELECT *, status = 'processing' AND error IS NOT NULL AS fails FROM catalog LEFT JOIN e USING (doc_id))
  SELECT CASE WHEN fails THEN 'failed' ELSE status END AS status, CASE WHEN fails THEN error END AS processing_error, count(*) AS n FROM f GROUP BY ALL""")
SUPERSEDED = f"{CATALOG}, m AS (SELECT filename, max(doc_id) AS top FROM catalog WHERE status = 'ready' GROUP BY filename), c AS (SELECT doc_id, filename, CASE WHEN status = 'ready' AND doc_id <> top THEN 'superseded' ELSE status END AS status FROM catalog LEFT JOIN m USING (filename))"
register("catalog_listing", listed, f"WITH {SUPERSEDED} SELECT doc_id AS document_id, filename, status, doc_id AS updated_at, CASE WHEN status = 'failed' THEN '{catalog.FAILED_NOTICE}' END AS processing_error FROM c WHERE status <> 'superseded'")
register("catalog_lookup", looked_up, f"WITH {SUPERSEDED} SELECT l.doc_id AS document_id, c.doc_id IS NOT NULL AS found, c.filename, c.status FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT * FROM c WHERE status <> 'superseded') c USING (doc_id)")
register("embedding_gaps", embedding_gaps, """SELECT coalesce(d.doc_id, v.vec_id) AS item_id, CASE WHEN v.vec_id IS NULL THEN 'no vector' WHEN d.doc_id IS NULL THEN 'no item' ELSE 'wrong size' END AS problem
  FROM documents d FULL JOIN embeddings v ON v.vec_id = d.doc_id WHERE v.vec_id IS NULL OR d.doc_id IS NULL OR coalesce(len(v.embedding), 0) <> 64""")
register("usage_cost", usage_cost, """SELECT event_type, count(*) AS calls, sum(floor(value))::BIGINT AS input_tokens, sum(floor(value / 10))::BIGINT AS output_tokens,
  round((sum(floor(value)) * 0.15 + sum(floor(value / 10)) * 0.6) / 1000000.0, 6) AS cost FROM events GROUP BY event_type""")


def history(spark, d: str) -> DataFrame:
    """Every version of a catalog whose files are sources: their first documents, their last, and the first again.

    A document with fewer than 300 visible characters fails, but not when its
    file's first one is tried again. Two writers finish from one snapshot: the second loses.
    """
    docs = documents(spark, d).select(F.col("source").alias("filename"), "doc_id", "text", F.sha2("text", 256).alias("content_hash"))
    firsts = docs.groupBy("filename").agg(F.min(F.struct("doc_id", "content_hash", "text")).alias("f")).select("filename", "f.*")
    others = docs.join(firsts.select("filename", F.col("content_hash").alias("first")), "filename").filter("content_hash <> first")
    lasts = others.groupBy("filename").agg(F.max(F.struct("doc_id", "content_hash", "text")).alias("f")).select("filename", "f.*")
    store = snapshots.Snapshots(spark, scratch_path(spark, "catalog"))

    def process(rows: DataFrame, failing: bool, base=None):
        own = rows.withColumn("document_id", catalog.document_id(F.col("filename"), F.col("content_hash")))
        chunks = own.select("document_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("chunk_index", "text"))
        short = F.length(F.regexp_replace("text", r"\s", "")) < 300
        errors = own.filter(short if failing else F.lit(False)).select("document_id", F.lit("too little text").alias("error"))
        return store.finish(chunks.withColumn("chunk_index", F.col("chunk_index").cast("long")), errors, base)

    at = lambda rows, time: rows.select("filename", "content_hash", F.lit(time).cast("long").alias("updated_at"))
    base = store.ingest(at(firsts, 1))
    process(firsts, True, base)
    try:
        process(firsts, False, base)  # from the same snapshot, too late
    except snapshots.Conflict:
        pass
    store.ingest(at(firsts.join(store.read().documents.filter("status = 'ready'"), ["filename", "content_hash"], "left_semi"), 9))  # known and ready: no version
    store.ingest(at(lasts, 2))
    process(lasts, True)
    store.ingest(at(firsts, 3))
    process(firsts, False)
    rows = [s.documents.join(s.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("held")), "document_id", "left").withColumn("version", F.lit(v)) for v in store.versions() for s in [store.read(v)]]
    return stacked(*rows).select("version", "filename", "content_hash", "status", "updated_at", "chunk_count", F.coalesce("held", F.lit(0)).alias("held"), "processing_error")


register("catalog_history", history, """WITH n AS (SELECT source AS filename, doc_id, text, sha256(text) AS h, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS c, length(regexp_replace(text, '\\s', '', 'g')) < 300 AS short FROM documents),
  a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY filename ORDER BY doc_id) = 1), b AS (SELECT n.* FROM n JOIN a ON a.filename = n.filename AND a.h <> n.h QUALIFY row_number() OVER (PARTITION BY n.filename ORDER BY n.doc_id DESC) = 1),
  s AS (SELECT a.filename, a.h, 'a' AS w, a.c, a.short, NOT coalesce(b.short, true) AS followed FROM a LEFT JOIN b USING (filename) UNION ALL SELECT filename, h, 'b', c, short, true FROM b),
  v AS (SELECT *, CASE WHEN w = 'a' THEN CASE version WHEN 1 THEN 'processing' WHEN 2 THEN CASE WHEN short THEN 'failed' ELSE 'ready' END WHEN 3 THEN CASE WHEN short THEN 'failed' ELSE 'ready' END
      WHEN 4 THEN CASE WHEN short THEN 'failed' WHEN followed THEN 'superseded' ELSE 'ready' END WHEN 5 THEN CASE WHEN short OR followed THEN 'processing' ELSE 'ready' END ELSE 'ready' END
    ELSE CASE WHEN version = 3 THEN 'processing' WHEN short THEN 'failed' WHEN version < 6 THEN 'ready' ELSE 'superseded' END END AS status FROM s, (SELECT unnest(range(1, 7)) AS version) WHERE w = 'a' OR version >= 3)
  SELECT version::INT AS version, filename, h AS content_hash, status, CASE WHEN w = 'b' THEN 2 WHEN version >= 5 AND (short OR followed) THEN 3 ELSE 1 END::BIGINT AS updated_at,
    CASE WHEN w = 'a' AND (version = 1 OR (short AND version < 6)) OR w = 'b' AND (version = 3 OR short) THEN 0 ELSE c END AS chunk_count, CASE WHEN w = 'a' AND (version = 1 OR (short AND version < 6)) OR w = 'b' AND (version = 3 OR short) THEN 0 ELSE c END AS held, CASE WHEN status = 'failed' THEN 'too little text' END AS processing_error FROM v""")
