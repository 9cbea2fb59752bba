"""From questions to checked answers: four signals of a question and its rewrite, evidence in reading order, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, dense, embedding, lexical, numbering
from ..tables import stacked, stored
from . import text_queries
from .evaluation_queries import _rules_sql
from .registry import documents, register, table
from .retrieval_queries import _QT, LEX_LIST, STOP, _fuse_sql

#: A first attempt quotes so many words of each sentence; longer sentences are then covered too little.
QUOTE_WORDS = 8


def _dense(items: DataFrame, asked: DataFrame) -> DataFrame:
    """The dense list of questions (query_id, text); ``items`` are the documents' vectors."""
    near = dense.nearest(embedding.hashed_ngrams(asked).drop("text"), items, 20, "cosine", keep_self=True)
    return near.select("query_id", F.col("item_id").alias("doc_id"), F.col("dense_rank").alias("rank"))


def _lexical(docs: DataFrame, own: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexical lists of two sets of questions (query_id, text), searched as one, so that texts are split into words and counted once."""
    terms = [lexical.query_terms(asked).withColumn("query_id", F.struct(F.lit(k).alias("set"), "query_id")) for k, asked in enumerate((own, again))]
    found = stored(lexical.search(stacked(*terms), docs, 20), "lexical")
    first, second = (found.filter(F.col("query_id.set") == k).select("query_id.query_id", "doc_id", F.col("lexical_rank").alias("rank")) for k in range(2))
    return first, second


def four_signals(spark, d: str) -> DataFrame:
    """Original and rewritten questions, by vectors and by words, as one list; a rejected rewrite has no part in it."""
    rows = stored(text_queries.expanded_questions(spark, d), "questions")
    docs = documents(spark, d).select("doc_id", "text")
    items = stored(embedding.hashed_ngrams(docs.select(F.col("doc_id").alias("item_id"), "text")).drop("text"), "vectors")
    own = rows.select("query_id", F.col("question").alias("text"))
    again = rows.filter("used_expansion").select("query_id", F.col("alternative").alias("text"))
    lists = [{"dense": _dense(items, asked), "lexical": words} for asked, words in zip((own, again), _lexical(docs, own, again), strict=True)]
    out = answering.expanded_fusion(*lists, rows.select("query_id", F.col("used_expansion").alias("accepted")))
    return out.select("query_id", "doc_id", *_RANKS, "rrf_score", "source_count", "fused_rank", "used_expansion")


_RANKS = ["dense_rank", "lexical_rank", "expanded_dense_rank", "expanded_lexical_rank"]


def answers(spark, d: str) -> DataFrame:
    """Each item as a question, answered from the four signals; a source is a file, its documents the pages."""
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    fused = stored(four_signals(spark, d).select("query_id", "doc_id", "fused_rank"), "fused")
    pages = numbering.number_rows(documents(spark, d).select(F.col("source").alias("file"), "doc_id", "text"), "file", "doc_id", "page_number")
    terse = lambda context, asked: answering.extractive_answers(context, asked, QUOTE_WORDS)
    return answering.grounded_answers(questions, fused, pages, generate=terse)


def _nearest_sql(name: str, queries: str) -> str:
    dot = lambda a, b: f"list_dot_product({a}.e, {b}.e)"
    size = f"(sqrt({dot('q', 'q')}) * sqrt({dot('v', 'v')}))"
    return f"""{name} AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM
    (SELECT query_id, doc_id, CASE WHEN {size} > 0 THEN round(1 - {dot("q", "v")} / {size}, 9) ELSE 1.0::DOUBLE END AS distance FROM {queries} q, de v)) WHERE rank <= 20)"""


_USED = "alternative IS NOT NULL AND problem IS NULL"
FOUR = f"""{text_queries.ASKED}, {text_queries.verdict_sql("v", "both_of")}, {text_queries.OWN}, {text_queries.REWRITTEN},
  {embedding.embedding_sql("de", "documents", "doc_id", "text")}, {embedding.embedding_sql("qe", "v", "query_id", "question")}, {embedding.embedding_sql("xe", f"(SELECT * FROM v WHERE {_USED})", "query_id", "alternative")},
  {_nearest_sql("dn", "qe")}, {_nearest_sql("xn", "xe")},
  {_fuse_sql({"dense": "SELECT * FROM dn", "lexical": LEX_LIST, "expanded_dense": "SELECT * FROM xn", "expanded_lexical": "SELECT query_id, doc_id, lexical_rank AS rank FROM lex2"}, 10)}"""

_CUT = "regexp_replace(passage, '([.!?])\\s+([A-Z0-9\"''“‘(])', '\\1' || chr(1) || '\\2', 'g')"
_QUOTE = f"array_to_string(regexp_split_to_array(text, '\\s+')[:{QUOTE_WORDS}], ' ')"
_GROUND = text_queries._terms("s")
CONTEXT = f"""pages AS (SELECT doc_id, text AS passage, source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents),
  pair AS (SELECT query_id, doc_id, fused_rank, question, passage, file, page_number FROM fused JOIN asked USING (query_id) JOIN pages USING (doc_id)),
  term AS (SELECT *, list_filter(list_distinct({_QT}), lambda x: length(x) >= 3 AND x NOT IN ({STOP})) AS terms, list_distinct(regexp_extract_all(lower(passage), '{T.TOKEN}')) AS words FROM pair),
  share AS (SELECT *, coalesce(len(list_intersect(terms, words))::DOUBLE / nullif(len(terms), 0), 0) AS share FROM term),
  scored AS (SELECT *, CASE WHEN share >= 0.75 THEN 3 WHEN share >= 0.5 THEN 2 WHEN share >= 0.25 THEN 1 ELSE 0 END AS score FROM share),
  rated AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM scored QUALIFY score >= 2),
  cand AS (SELECT * FROM rated WHERE rank <= 5),
  fold AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, []::STRUCT(doc_id BIGINT, file VARCHAR, passage VARCHAR, words VARCHAR[])[] AS kept FROM (SELECT DISTINCT query_id FROM cand)
    UNION ALL SELECT query_id, rank, CASE WHEN copy THEN NULL ELSE doc_id END, CASE WHEN copy THEN kept ELSE list_append(kept, {{'doc_id': doc_id, 'file': file, 'passage': passage, 'words': words}}) END
    FROM (SELECT c.*, f.kept, len(list_filter(f.kept, lambda k: k.file = c.file AND (k.passage = c.passage OR len(list_intersect(k.words, c.words))::DOUBLE / len(list_distinct(list_concat(k.words, c.words))) >= 0.82))) > 0 AS copy FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.rank = f.rank + 1)),
  gap AS (SELECT *, page_number - lag(page_number) OVER (PARTITION BY query_id, file ORDER BY page_number) AS step FROM cand WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM fold WHERE doc_id IS NOT NULL)),
  isle AS (SELECT *, sum(CASE WHEN step <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, file ORDER BY page_number) AS island FROM gap),
  best AS (SELECT *, min(rank) OVER (PARTITION BY query_id, file, island) AS first FROM isle),
  context AS MATERIALIZED (SELECT query_id, question, passage, terms, row_number() OVER (PARTITION BY query_id ORDER BY first, file, page_number) AS position FROM best)"""
ANSWERS = f"""WITH RECURSIVE {FOUR}, {CONTEXT},
  sent AS (SELECT query_id, position, terms, unnest(list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: trim(x)), lambda x: x <> ''), 1) AS i FROM context),
  said AS (SELECT query_id, position, s AS text FROM (SELECT *, len(list_intersect({_GROUND}, terms)) AS shared, i FROM sent) QUALIFY shared > 0 AND row_number() OVER (PARTITION BY query_id, position ORDER BY shared DESC, i) = 1),
  maps AS (SELECT query_id, map_from_entries(list(struct_pack(k := 'S' || position, v := passage))) AS m FROM context GROUP BY query_id),
  c1 AS (SELECT query_id, position, text, [struct_pack(s := 'S' || position, q := {_QUOTE})] AS supports, m FROM said JOIN maps USING (query_id)),
  {_rules_sql("one", "c1")},
  bad AS (SELECT DISTINCT query_id FROM one WHERE problem IS NOT NULL),
  c2 AS (SELECT query_id, position, text, CASE WHEN problem IS NULL THEN supports ELSE [struct_pack(s := 'S' || position, q := text)] END AS supports, m FROM one WHERE query_id IN (SELECT query_id FROM bad) AND (problem IS NULL OR problem IN ('low claim coverage', 'low clause coverage'))),
  {_rules_sql("two", "c2")},
  held AS (SELECT query_id, 1 AS attempt, position, text FROM one WHERE query_id NOT IN (SELECT query_id FROM bad) UNION ALL SELECT query_id, 2, position, text FROM two WHERE query_id NOT IN (SELECT query_id FROM two WHERE problem IS NOT NULL)),
  told AS (SELECT query_id, attempt, count(*) AS n_claims, string_agg('S' || position, ',' ORDER BY position) AS sources, string_agg(text || ' [S' || position || ']', ' ' ORDER BY position) AS answer FROM held GROUP BY ALL)
  SELECT a.query_id, CASE WHEN n_claims IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE WHEN n_claims IS NOT NULL THEN attempt WHEN a.query_id IN (SELECT query_id FROM context) AND a.query_id NOT IN (SELECT query_id FROM bad) THEN 1 END AS attempt,
    a.query_id IN (SELECT query_id FROM bad) AND n_claims IS NULL AS used_fallback, coalesce(n_claims, 0) AS n_claims, sources, answer FROM asked a LEFT JOIN told t ON t.query_id = a.query_id"""

register("four_signal_fusion", four_signals, f"WITH {FOUR} SELECT query_id, doc_id, {', '.join(_RANKS)}, rrf_score, source_count, fused_rank, {_USED} AS used_expansion FROM fused JOIN v USING (query_id)")
register("grounded_answers", answers, ANSWERS)
