"""Dense, lexical and fused retrieval over whole tables, and their metrics.

Vector queries are the rows of ``embeddings`` whose id is divisible by 20,
against all others; text queries are all rows of ``benchmark``. Where a text
query needs a vector, it is that of the same id (a convention of the test data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense, evaluation, evidence, fusion, lexical, rerank
from .registry import documents, register, table

K = 10


def _vectors(spark, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return items.filter(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id"), items


def _nearest(spark, d: str, metric: str, k: int = K) -> DataFrame:
    queries, items = _vectors(spark, d)
    return dense.nearest(queries, items, k, metric)


def _run(spark, d: str) -> tuple[DataFrame, DataFrame, tuple[int, ...], DataFrame]:
    """Arguments of case_metrics() for vector search, where items with the query's label are relevant.

    Only retrieved items are judged one by one; of the others a label's count is enough.
    """
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("l"))
    run = _nearest(spark, d, "cosine").select(F.col("query_id").alias("case_id"), F.col("dense_rank").alias("rank"), F.col("item_id").alias("label"))
    queries = labels.filter(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("case_id"), "l")
    judged = run.join(queries, "case_id").join(labels.select(F.col("item_id").alias("label"), F.col("l").alias("m")), "label").filter("l = m")
    counts = queries.join(labels.groupBy("l").agg((F.count(F.lit(1)) - 1).alias("relevant")), "l")
    return run, judged.select("case_id", "label", F.lit(1).alias("grade")), evaluation.CUTOFFS, counts.select("case_id", "relevant")


def _terms(spark, d: str) -> DataFrame:
    return lexical.query_terms(table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id"))


def _documents(spark, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "text")


def lexical_topk(spark, d: str) -> DataFrame:
    return lexical.search(_terms(spark, d), _documents(spark, d), 20)


def exact_matches(spark, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.exact_matches(queries, _documents(spark, d))


def lexical_supplemented(spark, d: str) -> DataFrame:
    scores = lexical.lexical_scores(_terms(spark, d), _documents(spark, d))
    out = lexical.supplemented(scores, exact_matches(spark, d), 20)
    return out.select("query_id", "doc_id", "fts_score", F.col("exact_match_count").cast("long").alias("exact_match_count"), "lexical_score", F.col("lexical_rank").cast("long").alias("lexical_rank"))


def _dense_of_items(spark, d: str, metric: str = "cosine") -> DataFrame:
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    items = items.join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = asked.join(items.withColumnRenamed("item_id", "query_id"), "query_id")
    found = dense.nearest(queries, items, 20, metric, keep_self=True)
    return found.select("query_id", F.col("item_id").alias("doc_id"), F.col("dense_rank").alias("rank"))


def _lexical_list(spark, d: str) -> DataFrame:
    return lexical_topk(spark, d).select("query_id", "doc_id", F.col("lexical_rank").alias("rank"))


def hybrid_retrieval(spark, d: str) -> DataFrame:
    fused = fusion.fuse({"dense": _dense_of_items(spark, d), "lexical": _lexical_list(spark, d)}, 60, K)
    return fused.select("query_id", "doc_id", "dense_rank", "lexical_rank", "rrf_score", "source_count", "fused_rank")


def four_way_fusion(spark, d: str) -> DataFrame:
    exact = lexical_supplemented(spark, d).filter("exact_match_count > 0").select("query_id", "doc_id", F.col("lexical_rank").alias("rank"))
    lists = {"cosine": _dense_of_items(spark, d), "l2": _dense_of_items(spark, d, "l2"), "lexical": _lexical_list(spark, d), "exact": exact}
    return fusion.fuse(lists, 10, K).select("query_id", "doc_id", "cosine_rank", "l2_rank", "lexical_rank", "exact_rank", "rrf_score", "source_count", "fused_rank")


def reranked(spark, d: str) -> DataFrame:
    """Fused candidates reranked by the overlap scorer, which has no score for passages of fewer than 400 characters."""
    fused = hybrid_retrieval(spark, d).select("query_id", "doc_id", "fused_rank")
    texts = fused.join(_documents(spark, d), "doc_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    usable = texts.filter(F.length("text") >= 400).select("query_id", "doc_id", rerank.overlap_score(F.col("question"), F.col("text")).alias("score"))
    out = rerank.rerank(fused, usable, 10, 5, 1)
    return out.select("query_id", "doc_id", "fused_rank", "score", "fallback", "reranked_rank", "selected")


def cutoff_sweep(spark, d: str) -> DataFrame:
    relevant = exact_matches(spark, d)
    return rerank.cutoff_sweep(reranked(spark, d).filter("not fallback"), relevant)


def selected_evidence(spark, d: str) -> DataFrame:
    """Greedy choice among each text query's lexical candidates, near copies left out."""
    found = lexical_topk(spark, d).select("query_id", F.col("doc_id").alias("item_id"), F.col("lexical_rank").alias("rank"), F.col("fts_score").alias("score"))
    rows = evidence.with_words(found, _documents(spark, d).withColumnRenamed("doc_id", "item_id"))
    return evidence.greedy_select(rows, 5, 0.3, 0.5)


def rank_changes(spark, d: str) -> DataFrame:
    hybrid = hybrid_retrieval(spark, d).select("query_id", "doc_id", F.col("fused_rank").alias("rank"))
    return fusion.rank_changes(_lexical_list(spark, d), hybrid, exact_matches(spark, d))


def union_statistics(spark, d: str) -> DataFrame:
    return fusion.union_statistics(_dense_of_items(spark, d), _lexical_list(spark, d))


def calibration(spark, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("l"))
    found = _nearest(spark, d, "cosine").join(labels, "item_id")
    found = found.join(labels.select(F.col("item_id").alias("query_id"), F.col("l").alias("m")), "query_id")
    return dense.calibrate_threshold(found.select(F.round(1 - F.col("distance"), 9).alias("score"), (F.col("l") == F.col("m")).alias("relevant")), unscored=True)


def metrics_by_label(spark, d: str) -> DataFrame:
    metrics = evaluation.case_metrics(*_run(spark, d))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("case_id"), "label")
    return evaluation.macro_average(metrics.join(labels, "case_id"), "label")


# ---- oracle SQL, in parts that build on each other ----

DIST = {
    "cosine": "round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9)",
    "l2": "round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9)",
}


def _near_sql(metric: str, k: int = K) -> str:
    return f"""near AS (SELECT query_id, item_id, distance, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS dense_rank
      FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {DIST[metric]} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id))
      WHERE dense_rank <= {k})"""


STOP = ", ".join(f"'{w}'" for w in lexical.T.QUESTION_STOP_WORDS)
LEX = f"""terms AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM benchmark),
  wanted AS (SELECT * FROM terms WHERE term NOT IN ({STOP})),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
  scores AS (SELECT query_id, doc_id, round(sum(tf) * 0.4::DOUBLE / (sum(tf) * 0.4::DOUBLE + 1), 9) AS fts_score FROM tf JOIN wanted USING (term) GROUP BY ALL),
  lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, doc_id) AS lexical_rank FROM scores) WHERE lexical_rank <= 20)"""
EXACT = "exact AS (SELECT item_id AS query_id, doc_id FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text)))"
SUPP = """cnt AS (SELECT query_id, doc_id, count(*) AS n FROM exact GROUP BY ALL),
  ex AS (SELECT * FROM (SELECT c.query_id, c.doc_id, coalesce(s.fts_score, 0) AS fts_score, row_number() OVER (PARTITION BY c.query_id ORDER BY n DESC, coalesce(s.fts_score, 0) DESC, c.doc_id) AS r
    FROM cnt c LEFT JOIN scores s USING (query_id, doc_id)) WHERE r <= 20),
  uni AS (SELECT query_id, doc_id, fts_score FROM lex UNION SELECT query_id, doc_id, fts_score FROM ex),
  supp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, fts_score DESC, doc_id) AS lexical_rank FROM
    (SELECT u.query_id, u.doc_id, u.fts_score, coalesce(n, 0) AS exact_match_count, round(u.fts_score + 0.25 * coalesce(n, 0), 9) AS lexical_score FROM uni u LEFT JOIN cnt USING (query_id, doc_id))) WHERE lexical_rank <= 20)"""


def _dense_items_sql(name: str, metric: str) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM
      (SELECT b.item_id AS query_id, v.vec_id AS doc_id, {DIST[metric]} AS distance FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v
       WHERE q.vec_id IN (SELECT doc_id FROM documents) AND v.vec_id IN (SELECT doc_id FROM documents))) WHERE rank <= 20)"""


def _fuse_sql(lists: dict[str, str], k: int) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, doc_id, rank, '{n}' AS l FROM ({q})" for n, q in lists.items())
    ranks = ", ".join(f"min(CASE WHEN l = '{n}' THEN rank END) AS {n}_rank" for n in lists)
    score = " + ".join(f"coalesce(1.0::DOUBLE / ({k} + {n}_rank), 0)" for n in lists)
    count = " + ".join(f"CAST({n}_rank IS NOT NULL AS INT)" for n in lists)
    cols = ", ".join(f"{n}_rank" for n in lists)
    return f"""fused AS (SELECT query_id, doc_id, {cols}, rrf_score, source_count, fused_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, source_count DESC, best, doc_id) AS fused_rank
      FROM (SELECT *, round({score}, 9) AS rrf_score, {count} AS source_count FROM (SELECT query_id, doc_id, {ranks}, min(rank) AS best FROM ({rows}) GROUP BY query_id, doc_id))) WHERE fused_rank <= {K})"""


LEX_LIST = "SELECT query_id, doc_id, lexical_rank AS rank FROM lex"
HYBRID = f"{LEX}, {_dense_items_sql('dense', 'cosine')}, " + _fuse_sql({"dense": "SELECT * FROM dense", "lexical": LEX_LIST}, 60)

METRICS = f"""{_near_sql("cosine")},
  judged AS (SELECT q.vec_id AS case_id, v.vec_id AS label FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
  gains AS (SELECT query_id AS case_id, dense_rank AS rank FROM near JOIN judged ON case_id = query_id AND label = item_id),
  ideal AS (SELECT case_id, count(*) AS relevant FROM judged GROUP BY case_id),
  got AS (SELECT case_id, min(rank) AS first_rank, {", ".join(f"count(*) FILTER (rank <= {k}) AS n_{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg_{k}" for k in evaluation.CUTOFFS)} FROM gains GROUP BY case_id),
  metrics AS (SELECT case_id, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS rr, {", ".join(f"CASE WHEN coalesce(n_{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}, round(coalesce(n_{k}, 0)::DOUBLE / relevant, 6) AS recall_{k}, round(coalesce(dcg_{k}, 0) / list_sum(list_transform(range(1, least({k}, relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in evaluation.CUTOFFS)}
    FROM ideal LEFT JOIN got USING (case_id))"""
_NAMES = ["rr", *[f"{m}_{k}" for k in evaluation.CUTOFFS for m in ("hit", "recall", "ndcg")]]
_MEANS = ", ".join(f"round(coalesce(avg({n}), 0), 6) AS {n}" for n in _NAMES)
CALIBRATION = f"""WITH {_near_sql("cosine")}, s AS (SELECT round(1 - distance, 9) AS score, (a.label = b.label)::INT AS r FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id),
  t AS (SELECT threshold, sum(good) AS good, sum(bad) AS bad FROM (SELECT score AS threshold, r AS good, 1 - r AS bad FROM s UNION ALL SELECT 0.0::DOUBLE, 0, 0 UNION ALL SELECT 1.0::DOUBLE, 0, 0) GROUP BY threshold)
  SELECT threshold, round((coalesce(sum(bad) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(good) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE / sum(good + bad) OVER (), 6) AS accuracy FROM t"""
FIRST = "min(rank) FILTER ((query_id, doc_id) IN (SELECT (query_id, doc_id) FROM exact)) AS first_rank"

register("dense_topk_cosine", lambda s, d: dense.with_similarity(_nearest(s, d, "cosine"), "cosine").withColumn("similarity", F.round("similarity", 9)), f"WITH {_near_sql('cosine')} SELECT *, round(1 - distance, 9) AS similarity FROM near")
register("dense_topk_l2", lambda s, d: dense.with_similarity(_nearest(s, d, "l2"), "l2").withColumn("similarity", F.round("similarity", 9)), f"WITH {_near_sql('l2')} SELECT *, round(1 / (1 + distance), 9) AS similarity FROM near")
register("embedding_norm_statistics", lambda s, d: dense.norm_statistics(table(s, d, "embeddings")), """SELECT count(*) AS vectors, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS sd_norm
  FROM (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
register("dense_threshold_calibration", calibration, CALIBRATION)
register("ir_metrics_per_query", lambda s, d: evaluation.case_metrics(*_run(s, d)), f"WITH {METRICS} SELECT * FROM metrics")
register("ir_metrics_macro", lambda s, d: evaluation.macro_average(evaluation.case_metrics(*_run(s, d))), f"WITH {METRICS} SELECT count(*) AS cases, {_MEANS} FROM metrics")
register("ir_metrics_by_label", metrics_by_label, f"WITH {METRICS} SELECT label, count(*) AS cases, {_MEANS} FROM metrics JOIN embeddings ON vec_id = case_id GROUP BY label")
register("lexical_topk", lexical_topk, f"WITH {LEX} SELECT query_id, doc_id, fts_score, lexical_rank FROM lex")
register("exact_matches", exact_matches, f"WITH {EXACT} SELECT * FROM exact")
register("lexical_supplemented", lexical_supplemented, f"WITH {LEX}, {EXACT}, {SUPP} SELECT query_id, doc_id, fts_score, exact_match_count, lexical_score, lexical_rank FROM supp")
register("hybrid_retrieval", hybrid_retrieval, f"WITH {HYBRID} SELECT * FROM fused")
register("four_way_fusion", four_way_fusion, f"WITH {LEX}, {EXACT}, {SUPP}, {_dense_items_sql('dc', 'cosine')}, {_dense_items_sql('dl', 'l2')}, " + _fuse_sql({"cosine": "SELECT * FROM dc", "l2": "SELECT * FROM dl", "lexical": LEX_LIST, "exact": "SELECT query_id, doc_id, lexical_rank AS rank FROM supp WHERE exact_match_count > 0"}, 10) + " SELECT * FROM fused")
register("candidate_union_statistics", union_statistics, f"""WITH {LEX}, {_dense_items_sql("dense", "cosine")}, e AS (SELECT query_id, doc_id, max(x) AS x, max(y) AS y FROM (SELECT query_id, doc_id, 1 AS x, 0 AS y FROM dense UNION ALL SELECT query_id, doc_id, 0, 1 FROM lex) GROUP BY ALL)
  SELECT query_id, sum(x)::BIGINT AS first_size, sum(y)::BIGINT AS second_size, count(*) AS union_size, sum(x * y)::BIGINT AS overlap FROM e GROUP BY query_id""")
register("rank_changes", rank_changes, f"""WITH {HYBRID}, {EXACT}, a AS (SELECT query_id, min(lexical_rank) AS before_rank FROM lex JOIN exact USING (query_id, doc_id) GROUP BY 1), b AS (SELECT query_id, min(fused_rank) AS after_rank FROM fused JOIN exact USING (query_id, doc_id) GROUP BY 1)
  SELECT query_id, before_rank, after_rank, CASE WHEN coalesce(after_rank, 1000000000) < coalesce(before_rank, 1000000000) THEN 'helped' WHEN coalesce(after_rank, 1000000000) > coalesce(before_rank, 1000000000) THEN 'harmed' ELSE 'unchanged' END AS change
  FROM (SELECT DISTINCT query_id FROM exact) LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")
_QT = "regexp_extract_all(lower(question), '[a-z0-9]+(?:[+./,''’-][a-z0-9]+|\\([a-z0-9]+\\))*\\+?')"
RERANK = f"""{HYBRID}, q AS (SELECT f.query_id, f.doc_id, fused_rank, b.text AS question, d.text AS passage FROM fused f JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id)),
  t AS (SELECT *, list_filter(list_distinct({_QT}), lambda x: length(x) >= 3 AND x NOT IN ({STOP})) AS terms FROM q),
  sh AS (SELECT *, len(list_intersect(terms, list_distinct(regexp_extract_all(lower(passage), '[\\p{{L}}\\p{{N}}_]+'))))::DOUBLE / nullif(len(terms), 0) AS share FROM t),
  fb AS (SELECT *, bool_or(length(passage) < 400) OVER (PARTITION BY query_id) AS fallback FROM sh),
  sc AS (SELECT query_id, doc_id, fused_rank, fallback, CASE WHEN fallback THEN NULL WHEN share >= 0.75 THEN 3 WHEN share >= 0.5 THEN 2 WHEN share >= 0.25 THEN 1 ELSE 0 END AS score FROM fb),
  rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, fused_rank) AS reranked_rank FROM sc),
  rk AS (SELECT *, (fallback OR score >= 1) AND sum((fallback OR score >= 1)::INT) OVER (PARTITION BY query_id ORDER BY reranked_rank) <= 5 AS selected FROM rr)"""
register("reranked", reranked, f"WITH {RERANK} SELECT query_id, doc_id, fused_rank, score, fallback, reranked_rank, selected FROM rk")
register("rerank_cutoff_sweep", cutoff_sweep, f"""WITH {RERANK}, {EXACT}, c AS (SELECT r.query_id, cutoff, (e.doc_id IS NOT NULL)::INT AS good, row_number() OVER (PARTITION BY r.query_id, cutoff ORDER BY reranked_rank) AS place
    FROM rk r LEFT JOIN exact e USING (query_id, doc_id), (SELECT unnest(range(4)) AS cutoff) WHERE NOT fallback AND score >= cutoff)
  SELECT cutoff, count(*) AS nonempty, sum(hit)::BIGINT AS hits FROM (SELECT query_id, cutoff, max(good) AS hit FROM c WHERE place <= 5 GROUP BY ALL) GROUP BY cutoff""")
register("selected_evidence", selected_evidence, f"""WITH RECURSIVE {LEX}, c AS (SELECT query_id, doc_id AS item_id, lexical_rank AS rank, fts_score AS score, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS words FROM lex JOIN documents USING (doc_id)),
  f AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS item_id, NULL::VARCHAR AS decision, NULL::BIGINT AS duplicate_of, []::STRUCT(item_id BIGINT, words VARCHAR[])[] AS kept FROM (SELECT DISTINCT query_id FROM c)
    UNION ALL
    SELECT query_id, rank, item_id, CASE WHEN low THEN 'below_threshold' WHEN dup IS NOT NULL THEN 'near_duplicate' ELSE 'kept' END, CASE WHEN NOT low THEN dup END,
      CASE WHEN NOT low AND dup IS NULL THEN list_append(kept, {{'item_id': item_id, 'words': words}}) ELSE kept END
    FROM (SELECT c.query_id, c.rank, c.item_id, c.words, f.kept, c.score < 0.5 AS low,
        list_filter(f.kept, lambda k: len(list_intersect(k.words, c.words))::DOUBLE / len(list_distinct(list_concat(k.words, c.words))) >= 0.3)[1].item_id AS dup
      FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1 WHERE len(f.kept) < 5))
  SELECT query_id, item_id, rank, decision, duplicate_of FROM f WHERE rank > 0""")


def union_metrics(spark, d: str) -> DataFrame:
    return fusion.union_metrics([_dense_of_items(spark, d), _lexical_list(spark, d)], exact_matches(spark, d))


def cutoff_metrics(spark, d: str) -> DataFrame:
    exact = exact_matches(spark, d).select("query_id", "doc_id").distinct()
    some = exact.select("query_id").distinct().withColumn("answerable", F.lit(True))
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(some, "query_id", "left").fillna(False, ["answerable"])
    return rerank.cutoff_metrics(reranked(spark, d), exact, cases)


def metrics_by_tag(spark, d: str) -> DataFrame:
    """Vector queries that are documents too, by language and by source."""
    tags = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.array("lang", "source").alias("tags"))
    return evaluation.by_tag(evaluation.case_metrics(*_run(spark, d)), tags)


def ready_dense(spark, d: str) -> DataFrame:
    """Vector search among the documents that the labels call good."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.lit("f").alias("filename"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"))
    queries, items = _vectors(spark, d)
    ready = lexical.of_ready_documents(items.withColumnRenamed("item_id", "doc_id"), rows).withColumnRenamed("doc_id", "item_id")
    return dense.candidates(queries, ready, 3)


_CUT = (1, 3, 5)
_AT = ", ".join(f"CASE WHEN coalesce(n_{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}, round(coalesce(n_{k}, 0)::DOUBLE / relevant, 6) AS recall_{k}, round(coalesce(dcg_{k}, 0) / list_sum(list_transform(range(1, least({k}, relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in _CUT)
register("candidate_union_metrics", union_metrics, f"""WITH {LEX}, {_dense_items_sql("dense", "cosine")}, {EXACT}, u AS (SELECT query_id, doc_id FROM dense UNION SELECT query_id, doc_id FROM lex), r AS (SELECT DISTINCT query_id, doc_id FROM exact)
  SELECT query_id, (SELECT count(*) FROM u WHERE u.query_id = r.query_id) AS candidates, count(u.doc_id) > 0 AS hit, round(count(u.doc_id)::DOUBLE / count(*), 6) AS recall FROM r LEFT JOIN u USING (query_id, doc_id) GROUP BY r.query_id""")
register("rerank_cutoff_metrics", cutoff_metrics, f"""WITH {RERANK}, {EXACT}, rel AS (SELECT query_id, count(DISTINCT doc_id) AS relevant FROM exact GROUP BY 1), cs AS (SELECT item_id AS query_id, relevant, cutoff FROM benchmark LEFT JOIN rel ON query_id = item_id, (SELECT unnest(range(4)) AS cutoff)),
  run AS (SELECT query_id, doc_id, cutoff, row_number() OVER (PARTITION BY query_id, cutoff ORDER BY reranked_rank) AS rank FROM rk, (SELECT unnest(range(4)) AS cutoff) WHERE fallback OR score >= cutoff QUALIFY rank <= 5),
  got AS (SELECT query_id, cutoff, min(rank) AS first_rank, {", ".join(f"count(*) FILTER (rank <= {k}) AS n_{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg_{k}" for k in _CUT)} FROM run WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM exact) GROUP BY ALL),
  kept AS (SELECT query_id, cutoff, count(*) AS kept FROM run GROUP BY ALL),
  m AS (SELECT c.*, coalesce(kept, 0) AS kept, round(coalesce(1.0 / first_rank, 0), 6) AS rr, {_AT} FROM cs c LEFT JOIN got USING (query_id, cutoff) LEFT JOIN kept USING (query_id, cutoff))
  SELECT cutoff::INT AS cutoff, round(avg(CASE WHEN relevant IS NULL THEN (kept = 0)::INT::DOUBLE END), 6) AS unanswerable_empty, round(avg(kept), 6) AS mean_kept, {", ".join(f"round(avg(CASE WHEN relevant IS NOT NULL THEN {c} END), 6) AS {c}" for c in ["rr", *[f"{n}_{k}" for k in _CUT for n in ("hit", "recall", "ndcg")]])} FROM m GROUP BY 1""")
register("ir_metrics_by_tag", metrics_by_tag, f"WITH {METRICS} SELECT tag, count(*) AS cases, {_MEANS} FROM metrics JOIN (SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents) ON doc_id = case_id WHERE tag IS NOT NULL GROUP BY tag")
register("ready_dense_topk", ready_dense, f"""SELECT query_id, item_id, distance, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS dense_rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {DIST["cosine"]} AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1))) WHERE dense_rank <= 9""")
