"""Clauses, phrases and exact terms of questions; graded answers; traces, summaries and choices of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, evaluation, evidence, fusion, grounding, lexical
from ..sources import files
from ..tables import scratch_path, stacked
from . import page_queries, retrieval_queries, text_queries
from .registry import documents, register, table
from .retrieval_queries import EXACT, HYBRID, LEX

# ---- questions with a quoted phrase, an acronym and a word, made of a benchmark text ----


def _questions(spark, d: str) -> DataFrame:
    """Items whose words 4, 5, 7 and 9 are plain: "w4 w5" W7 w9."""
    w = T.tokens(F.col("text"))
    used = [F.try_element_at(w, F.lit(k)) for k in (4, 5, 7, 9)]
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), *[c.alias(f"w{k}") for c, k in zip(used, (4, 5, 7, 9), strict=True)])
    plain = rows.filter(" and ".join(f"w{k} rlike '^[a-z0-9]+$'" for k in (4, 5, 7, 9)))
    question = F.concat(F.lit('"'), "w4", F.lit(" "), "w5", F.lit('" '), F.upper("w7"), F.lit(" "), "w9")
    return lexical.parse_questions(plain.select("query_id", question.alias("question")))


def _documents(spark, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "text")


def phrases(spark, d: str) -> DataFrame:
    """Every five words in a row of an item, from its first on, and the documents that have them side by side."""
    words = T.tokens(F.col("text"))
    rows = table(spark, d, "benchmark").filter(F.size(words) >= 5)
    each = rows.select(F.col("item_id").alias("query_id"), F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 4, F.lit(5)), lambda i: F.array_join(F.slice(words, i, 5), " "))).alias("phrase"))
    return lexical.phrase_matches(each, _documents(spark, d))


def exact_terms(spark, d: str) -> DataFrame:
    return lexical.exact_term_counts(_questions(spark, d), _documents(spark, d))


def clauses(spark, d: str) -> DataFrame:
    out = lexical.clause_search(_questions(spark, d), _documents(spark, d), 20)
    return out.select("query_id", "doc_id", "fts_score", "exact_match_count", "lexical_score", F.array_join("matched_terms", "|").alias("matched_terms"), "lexical_rank")


def of_ready(spark, d: str) -> DataFrame:
    """Text search over documents that are ready and belong to a file with a thousandth of all documents or more."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = documents(spark, d).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.when(F.col("quality") == 1, "ready").otherwise("processing").alias("status")
    )
    files = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("filename")
    return lexical.search(retrieval_queries._terms(spark, d), lexical.of_ready_documents(_documents(spark, d), rows, files), 10)


WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
ASKED = f"""qw AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
  asked AS (SELECT query_id, w[4] AS w4, w[5] AS w5, w[7] AS w7, w[9] AS w9 FROM qw WHERE len(w) >= 9 AND {" AND ".join(f"regexp_full_match(w[{k}], '[a-z0-9]+')" for k in (4, 5, 7, 9))}),
  xt AS (SELECT query_id, w4 || ' ' || w5 AS term FROM asked UNION SELECT query_id, w7 FROM asked WHERE length(w7) >= 3 AND regexp_matches(w7, '[a-z]')),
  xc AS (SELECT query_id, doc_id, count(*) AS exact_match_count FROM xt JOIN documents ON contains(lower(text), term) GROUP BY ALL)"""
CLAUSES = f"""{ASKED}, dw AS (SELECT doc_id, {WORDS} AS ws FROM documents),
  pos AS (SELECT doc_id, unnest(ws) AS a, unnest(list_concat(ws[2:], [''])) AS b FROM dw WHERE len(ws) > 0),
  loose AS (SELECT query_id, w7 AS term FROM asked UNION SELECT query_id, w9 FROM asked),
  hits AS (SELECT query_id, doc_id, term, count(*) AS tf FROM pos JOIN loose ON a = term WHERE term NOT IN ({retrieval_queries.STOP}) GROUP BY ALL
    UNION ALL SELECT query_id, doc_id, w4 || ' ' || w5, count(*) FROM pos JOIN asked ON a = w4 AND b = w5 GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, round(sum(tf) * 0.4::DOUBLE / (sum(tf) * 0.4::DOUBLE + 1), 9) AS fts_score, array_to_string(list_sort(list(term)), '|') AS matched_terms FROM hits GROUP BY ALL),
  al AS (SELECT query_id, doc_id, coalesce(fts_score, 0.0::DOUBLE) AS fts_score, coalesce(exact_match_count, 0) AS exact_match_count, coalesce(matched_terms, '') AS matched_terms FROM sc FULL JOIN xc USING (query_id, doc_id)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, fts_score DESC, doc_id) AS lexical_rank FROM (SELECT *, round(fts_score + 0.25 * exact_match_count, 9) AS lexical_score FROM al))
  SELECT query_id, doc_id, fts_score, exact_match_count, lexical_score, matched_terms, lexical_rank FROM rk WHERE lexical_rank <= 20"""
READY_LEX = LEX.replace(
    "FROM documents)",
    "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 10))",
).replace("lexical_rank <= 20", "lexical_rank <= 10")

register("lexical_phrases", phrases, f"""WITH q AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark), p AS (SELECT DISTINCT query_id, w[i:i + 4] AS ws FROM (SELECT query_id, w, unnest(range(1, len(w) - 3, 5)) AS i FROM q WHERE len(w) >= 5)),
  d AS (SELECT doc_id, {WORDS} AS w FROM documents), pos AS (SELECT doc_id, w[i:i + 4] AS ws FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))
  SELECT query_id, array_to_string(ws, ' ') AS phrase, doc_id, count(*) AS tf FROM p JOIN pos USING (ws) GROUP BY ALL""")
register("exact_term_counts", exact_terms, f"WITH {ASKED} SELECT query_id, doc_id, exact_match_count FROM xc")
register("clause_search", clauses, f"WITH {CLAUSES}")
register("ready_lexical_topk", of_ready, f"WITH {READY_LEX} SELECT query_id, doc_id, fts_score, lexical_rank FROM lex")

# ---- what stages lose, what neighbours gain, which configuration is best ----


def losses(spark, d: str) -> DataFrame:
    gold = retrieval_queries.exact_matches(spark, d).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("label"))
    named = lambda df: df.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("label"))
    lists = [retrieval_queries._dense_of_items(spark, d), retrieval_queries._lexical_list(spark, d)]
    union = stacked(named(lists[0]), named(lists[1]))
    fused = fusion.fuse({"dense": lists[0], "lexical": lists[1]}, 60, retrieval_queries.K)
    return answering.stage_trace(gold, {"candidates": union, "fusion": named(fused), "first_three": named(fused.filter("fused_rank <= 3"))})


def gain(spark, d: str) -> DataFrame:
    anchors = page_queries._anchors(spark, d, 5)
    numbered = page_queries._numbered(spark, d)
    relevant = retrieval_queries.exact_matches(spark, d).join(numbered.drop("text"), "doc_id")
    return answering.adjacency_gain(anchors, evidence.with_neighbours(anchors, numbered, 1), relevant)


def best_threshold(spark, d: str) -> DataFrame:
    return evaluation.best_configuration(retrieval_queries.calibration(spark, d), ["accuracy"], "threshold", "threshold")


def _judged_nearby(spark, d: str) -> DataFrame:
    """Items of the query's label within 200 ids of it, with grades 1 to 3 by their distance."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("label"), F.col("label").alias("l"))
    queries = labels.filter("label % 20 = 0").select(F.col("label").alias("case_id"), F.col("l").alias("m"))
    near = queries.withColumn("step", F.explode(F.sequence(F.lit(-200), F.lit(200)))).filter("step <> 0")
    near = near.select("case_id", "m", (F.col("case_id") + F.col("step")).alias("label"), (F.abs("step") % 3 + 1).alias("grade"))
    return near.join(labels, "label").filter("l = m").select("case_id", "label", "grade")


def graded(spark, d: str) -> DataFrame:
    run = retrieval_queries._run(spark, d)[0]
    return evaluation.case_metrics(run, _judged_nearby(spark, d))


def summary(spark, d: str) -> DataFrame:
    """Text queries: those that some document holds whole are answerable; results are candidates with a score of 0.95 or more."""
    exact = retrieval_queries.exact_matches(spark, d).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("label"), F.lit(1).alias("grade"))
    run = retrieval_queries.lexical_topk(spark, d).filter("fts_score >= 0.95").select(F.col("query_id").alias("case_id"), F.col("lexical_rank").alias("rank"), F.col("doc_id").alias("label"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"))
    cases = items.join(exact.select("case_id").distinct().withColumn("answerable", F.lit(True)), "case_id", "left").fillna(False, ["answerable"])
    return evaluation.run_summary(evaluation.case_metrics(run, exact), cases, run)


_PAGES = "numbered AS (SELECT source AS file, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents)"
_GRADED = f"""{retrieval_queries._near_sql("cosine")},
  judged AS (SELECT q.vec_id AS case_id, v.vec_id AS label, abs(q.vec_id - v.vec_id) % 3 + 1 AS grade FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id AND abs(q.vec_id - v.vec_id) <= 200 WHERE q.vec_id % 20 = 0),
  gains AS (SELECT query_id AS case_id, dense_rank AS rank, pow(2, grade) - 1 AS g FROM near JOIN judged ON case_id = query_id AND label = item_id),
  placed AS (SELECT case_id, pow(2, grade) - 1 AS g, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, label) AS place FROM judged),
  ideal AS (SELECT case_id, count(*) AS relevant, {", ".join(f"sum(CASE WHEN place <= {k} THEN g / log2(place + 1) END) AS ideal_{k}" for k in evaluation.CUTOFFS)} FROM placed GROUP BY case_id),
  got AS (SELECT case_id, min(rank) AS first_rank, {", ".join(f"count(*) FILTER (rank <= {k}) AS n_{k}, sum(CASE WHEN rank <= {k} THEN g / log2(rank + 1) END) AS dcg_{k}" for k in evaluation.CUTOFFS)} FROM gains GROUP BY case_id)
  SELECT case_id, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS rr, {", ".join(f"CASE WHEN coalesce(n_{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}, round(coalesce(n_{k}, 0)::DOUBLE / relevant, 6) AS recall_{k}, round(coalesce(dcg_{k}, 0) / ideal_{k}, 6) AS ndcg_{k}" for k in evaluation.CUTOFFS)} FROM ideal LEFT JOIN got USING (case_id)"""
_SUMMARY = f"""{LEX}, {EXACT}, run AS (SELECT query_id AS case_id, lexical_rank AS rank, doc_id FROM lex WHERE fts_score >= 0.95),
  rel AS (SELECT query_id AS case_id, count(*) AS relevant FROM exact GROUP BY 1),
  got AS (SELECT r.case_id, min(rank) AS first_rank, {", ".join(f"count(*) FILTER (rank <= {k}) AS n_{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END) AS dcg_{k}" for k in evaluation.CUTOFFS)} FROM run r JOIN exact e ON e.query_id = r.case_id AND e.doc_id = r.doc_id GROUP BY 1),
  m AS (SELECT case_id, relevant, round(coalesce(1.0 / first_rank, 0), 6) AS rr, {", ".join(f"CASE WHEN coalesce(n_{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}, round(coalesce(n_{k}, 0)::DOUBLE / relevant, 6) AS recall_{k}, round(coalesce(dcg_{k}, 0) / list_sum(list_transform(range(1, least({k}, relevant) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}" for k in evaluation.CUTOFFS)} FROM rel LEFT JOIN got USING (case_id))
  SELECT count(m.case_id) AS answerable_cases, count(*) - count(m.case_id) AS unanswerable_cases, round(avg(CASE WHEN m.case_id IS NULL THEN (b.item_id NOT IN (SELECT case_id FROM run))::INT::DOUBLE END), 6) AS unanswerable_correct,
    {", ".join(f"round(coalesce(avg({n}), 0), 6) AS {n}" for n in retrieval_queries._NAMES)} FROM benchmark b LEFT JOIN m ON m.case_id = b.item_id"""

register("stage_losses", losses, f"""WITH {HYBRID}, {EXACT}, c AS (SELECT query_id, doc_id FROM dense UNION SELECT query_id, doc_id FROM lex),
  x AS (SELECT e.query_id, bool_or(c.doc_id IS NOT NULL) AS a, bool_or(f.doc_id IS NOT NULL) AS b, bool_or(coalesce(f.fused_rank <= 3, false)) AS t FROM exact e LEFT JOIN c ON c.query_id = e.query_id AND c.doc_id = e.doc_id LEFT JOIN fused f ON f.query_id = e.query_id AND f.doc_id = e.doc_id GROUP BY 1)
  SELECT query_id AS case_id, CASE WHEN NOT a THEN 'candidates' WHEN NOT b THEN 'fusion' WHEN NOT t THEN 'first_three' END AS first_lost FROM x""")
register("adjacency_gain", gain, f"""WITH {LEX}, {_PAGES}, {EXACT}, a AS (SELECT DISTINCT query_id, file, page_number FROM lex JOIN numbered USING (doc_id) WHERE lexical_rank <= 5),
  e AS (SELECT DISTINCT a.query_id, a.file, p.page_number FROM a JOIN numbered p ON p.file = a.file AND p.page_number BETWEEN a.page_number - 1 AND a.page_number + 1),
  r AS (SELECT DISTINCT query_id, file, page_number FROM exact JOIN numbered USING (doc_id)),
  x AS (SELECT query_id, count(*) AS n, max((r.file IS NOT NULL)::INT) AS hit FROM a LEFT JOIN r USING (query_id, file, page_number) GROUP BY 1),
  y AS (SELECT query_id, count(*) AS n, max((r.file IS NOT NULL)::INT) AS hit FROM e LEFT JOIN r USING (query_id, file, page_number) GROUP BY 1)
  SELECT count(*) AS questions, sum(x.hit)::BIGINT AS anchor_hits, sum(y.hit)::BIGINT AS expanded_hits, round(sum(y.n)::DOUBLE / sum(x.n), 6) AS growth FROM x JOIN y USING (query_id)""")
register("best_threshold", best_threshold, f"SELECT threshold FROM ({retrieval_queries.CALIBRATION}) ORDER BY accuracy DESC, threshold LIMIT 1")
register("ir_metrics_graded", graded, f"WITH {_GRADED}")
register("run_summary", summary, f"WITH {_SUMMARY}")

# ---- answers: a case is a benchmark text, its claims the text itself and the beginning of the best document ----


def _best(spark, d: str, least: float = 0.95) -> DataFrame:
    found = retrieval_queries.lexical_topk(spark, d).filter("lexical_rank = 1").join(_documents(spark, d), "doc_id")
    exact = retrieval_queries.exact_matches(spark, d).withColumn("held", F.lit(True))
    best = found.join(exact, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "fts_score", F.col("text").alias("passage"), F.coalesce("held", F.lit(False)).alias("held"))
    some = exact.select("query_id").distinct().withColumn("answerable", F.lit(True))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(best, "query_id", "left").join(some, "query_id", "left").fillna(False, ["answerable", "held"]).withColumn("answered", F.coalesce(F.col("fts_score") >= least, F.lit(False)))


def grades(spark, d: str, least: float = 0.95) -> DataFrame:
    """Graded cases; a case is answered if its best document has a score of ``least`` or more."""
    rows = _best(spark, d, least).withColumnRenamed("query_id", "case_id")
    status = F.when(F.col("answered"), "answered").otherwise("insufficient_evidence")
    kind = F.when(F.col("answerable"), "answerable").otherwise("unanswerable")
    answers = rows.select("case_id", kind.alias("case_type"), status.alias("status"), F.array(F.when(F.col("answerable"), "answered").otherwise("insufficient_evidence")).alias("expected_statuses"),
                          F.when(~F.col("answered"), "no evidence").otherwise("").alias("refusal_reason"), F.lit(False).alias("used_fallback"))
    said = rows.filter("answered")
    own = said.select("case_id", F.lit(0).alias("claim_idx"), "text", F.col("held").alias("faithful"), F.array(F.struct(F.col("held").alias("accurate"))).alias("citations"))
    other = said.select("case_id", F.lit(1).alias("claim_idx"), F.substring("passage", 1, 200).alias("text"), F.lit(True).alias("faithful"), F.array(F.struct(F.lit(True).alias("accurate"))).alias("citations"))
    w = T.tokens(F.col("text"))
    groups = F.array(F.slice(w, 1, 1), F.slice(w, 2, 2))
    needed = rows.filter(F.size(w) >= 5).select("case_id", F.lit("first").alias("expectation_id"), F.lit(True).alias("required"), groups.alias("term_groups"))
    more = rows.filter(F.size(w) >= 5).select("case_id", F.lit("more").alias("expectation_id"), F.lit(False).alias("required"), F.array(F.slice(w, 5, 1)).alias("term_groups"))
    return evaluation.grade_answers(answers, stacked(own, other), stacked(needed, more))


def failures(spark, d: str) -> DataFrame:
    """The first stage at which an answerable case fails, counted."""
    rows = _best(spark, d).filter("answerable").join(grades(spark, d).withColumnRenamed("case_id", "query_id"), "query_id")
    exact = retrieval_queries.exact_matches(spark, d)
    found = retrieval_queries._lexical_list(spark, d).join(exact, ["query_id", "doc_id"]).select("query_id").distinct().withColumn("listed", F.lit(True))
    rows = rows.join(found, "query_id", "left")
    stage = evaluation.failure_stage({"retrieval": F.coalesce("listed", F.lit(False)), "ranking": F.col("held"), "generation": F.col("answered"), "grading": F.col("answer_success")})
    return evaluation.failure_histogram(rows.select(stage.alias("failure_stage")))


def _has(text: str, word: str) -> str:
    """Whether the words of a text hold those of a word side by side."""
    return f"contains(' ' || {text_queries._graded(f'lower({text})')} || ' ', ' ' || {text_queries._graded(word)} || ' ')"


def _matched(text: str) -> str:
    """Whether a claim meets the required expectation, and the other one."""
    return f"({_has(text, 'w[1]')} AND ({_has(text, 'w[2]')} OR {_has(text, 'w[3]')})), {_has(text, 'w[5]')}"


def _grades_sql(least: float = 0.95) -> str:
    return f"""{LEX}, {EXACT}, best AS (SELECT query_id, doc_id, fts_score, text AS passage, (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM exact) AS held FROM lex JOIN documents USING (doc_id) WHERE lexical_rank = 1),
  cs AS (SELECT b.item_id AS case_id, b.text, {WORDS.replace("text", "b.text")} AS w, coalesce(passage, '') AS passage, coalesce(held, false) AS held, b.item_id IN (SELECT query_id FROM exact) AS answerable, coalesce(fts_score >= {least}, false) AS answered FROM benchmark b LEFT JOIN best ON query_id = item_id),
  c0 AS (SELECT case_id, held AS faithful, len(w) >= 5 AS has, [{_matched("text")}] AS m FROM cs WHERE answered UNION ALL SELECT case_id, true, len(w) >= 5, [{_matched("substr(passage, 1, 200)")}] FROM cs WHERE answered),
  ag AS (SELECT case_id, count(*) AS n, sum((has AND (m[1] OR m[2]))::INT) AS matched, sum(faithful::INT) AS faithful, max((has AND m[1])::INT) AS met FROM c0 GROUP BY case_id),
  g AS (SELECT cs.case_id, answerable, answered, held, CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END AS case_type, false AS used_fallback, coalesce(n, 0) AS n, coalesce(met, 0) AS met, len(w) >= 5 AS required,
    round(CASE WHEN NOT answerable THEN (n IS NULL)::INT::DOUBLE ELSE coalesce(matched::DOUBLE / n, 0) END, 6) AS correctness,
    round(coalesce(faithful::DOUBLE / n, CASE WHEN answerable THEN 0.0 ELSE 1.0 END), 6) AS faithfulness, round(coalesce(faithful::DOUBLE / n, CASE WHEN answerable THEN 0.0 ELSE 1.0 END), 6) AS citation_accuracy,
    CASE WHEN answerable AND len(w) >= 5 THEN round(coalesce(met, 0)::DOUBLE, 6) END AS completeness, (answerable = answered)::INT::DOUBLE AS refusal_accuracy, round(coalesce(1 - faithful::DOUBLE / n, 0), 6) AS unsupported_claim_rate
    FROM cs LEFT JOIN ag USING (case_id)),
  gr AS (SELECT *, correctness = 1 AND faithfulness = 1 AND citation_accuracy = 1 AND refusal_accuracy = 1 AND coalesce(completeness, 1) = 1 AND unsupported_claim_rate = 0 AS answer_success FROM g)"""


GRADES = _grades_sql()
SCORES = ["correctness", "faithfulness", "citation_accuracy", "completeness", "refusal_accuracy", "unsupported_claim_rate"]
register("answer_grades", grades, f"WITH {GRADES} SELECT case_id, case_type, used_fallback, {', '.join(SCORES)}, answer_success FROM gr")
register("answer_summary", lambda s, d: evaluation.answer_summary(grades(s, d)), f"WITH {GRADES} SELECT count(*) AS cases, round(avg(answer_success::INT), 6) AS success_rate, 0::BIGINT AS fallbacks, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SCORES)} FROM gr")
register("answer_failures", failures, f"""WITH {GRADES}, st AS (SELECT CASE WHEN case_id NOT IN (SELECT query_id FROM lex JOIN exact USING (query_id, doc_id)) THEN 'retrieval' WHEN NOT held THEN 'ranking' WHEN NOT answered THEN 'generation' WHEN NOT answer_success THEN 'grading' ELSE 'none' END AS failure_stage FROM gr WHERE answerable)
  SELECT failure_stage, count(*) AS cases FROM st GROUP BY 1""")


CASE = "case_id long, case_type string, used_fallback boolean, correctness double, faithfulness double, citation_accuracy double, completeness double, refusal_accuracy double, unsupported_claim_rate double, answer_success boolean"


def _report(spark, d: str, cases: DataFrame) -> DataFrame:
    sections = {"summary": evaluation.answer_summary(cases), "failures": failures(spark, d), "cases": cases}
    return files.report_rows(files.run_id("answers"), sections)


def regraded(spark, d: str) -> DataFrame:
    """A saved report of the labelled cases, against a stricter rule for answering, over the cases of at least 36 words."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"))
    place = scratch_path(spark, "report")
    files.save_report(_report(spark, d, evaluation.of_cases(grades(spark, d), labelled)), place, dataset=d)
    saved = files.section(files.saved_report(spark, place, dataset=d), "cases", CASE)
    return evaluation.regraded(saved, evaluation.of_cases(grades(spark, d, 0.98), items.filter(F.size(T.tokens(F.col("text"))) >= 36)))


def report(spark, d: str) -> DataFrame:
    return _report(spark, d, grades(spark, d))


# ---- claims that keep or break each rule: a quote is the first twelve words of the best document ----


def _rule_claims(spark, d: str) -> tuple[DataFrame, DataFrame]:
    rows = text_queries._claims(spark, d)
    evidence = rows.select("query_id", F.concat(F.lit("S"), F.col("lexical_rank").cast("string")).alias("source_id"), F.col("lexical_rank").alias("position"), F.col("text").alias("passage"))
    words = F.split(F.col("text"), r"\s+")
    part = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    quote = part(1, 12)
    other = lambda n: F.array_join(F.slice(F.split(F.col("claim"), r"\s+"), 13, n), " ")
    none = F.array().cast("array<struct<source_id:string,quote:string>>")
    one = lambda q, source="S1": F.array(F.struct(F.lit(source).alias("source_id"), q.alias("quote")))
    said = quote
    cases = [
        (said, one(quote)), (F.lit("  "), one(quote)), (said, none), (said, F.concat(one(quote), one(quote))), (said, one(quote, "S9")), (said, one(F.lit(" "))),
        (said, F.concat(one(quote), one(F.concat(F.col("claim"), F.lit(" zzzz")), "S2"))), (F.lit("qqqq xxxx"), one(quote)), (F.concat(said, F.lit(" "), other(40)), one(quote)),
        (F.concat(said, F.lit("; "), other(6)), one(quote)), (said, one(F.concat(part(1, 6), F.lit(" ... "), part(8, 5)))),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("claim_idx"), t.alias("text"), s.alias("supports")) for i, (t, s) in enumerate(cases)])
    claims = rows.filter("lexical_rank = 1").select("query_id", F.explode(made).alias("c")).select("query_id", "c.*")
    return claims, evidence


def claim_rules(spark, d: str) -> DataFrame:
    claims, evidence = _rule_claims(spark, d)
    return grounding.claim_problems(claims, evidence).select("query_id", "claim_idx", "problem")


def feedback(spark, d: str) -> DataFrame:
    claims, evidence = _rule_claims(spark, d)
    return grounding.repair_feedback(claims, evidence)


def cited(spark, d: str) -> DataFrame:
    claims, evidence = _rule_claims(spark, d)
    return grounding.cited_evidence(claims, evidence)


def _part(col: str, first: int, n: int) -> str:
    return f"array_to_string(regexp_split_to_array({col}, '\\s+')[{first}:{first + n - 1}], ' ')"


_Q = _SAID = _part("text", 1, 12)
_OTHER = {n: _part("claim", 13, n) for n in (6, 40)}
_CASES = [
    (_SAID, [("S1", _Q)]), ("'  '", [("S1", _Q)]), (_SAID, []), (_SAID, [("S1", _Q), ("S1", _Q)]), (_SAID, [("S9", _Q)]), (_SAID, [("S1", "' '")]),
    (_SAID, [("S1", _Q), ("S2", "claim || ' zzzz'")]), ("'qqqq xxxx'", [("S1", _Q)]), (f"{_SAID} || ' ' || {_OTHER[40]}", [("S1", _Q)]),
    (f"{_SAID} || '; ' || {_OTHER[6]}", [("S1", _Q)]), (_SAID, [("S1", f"{_part('text', 1, 6)} || ' ... ' || {_part('text', 8, 5)}")]),
]


def _made(at: int, text: str, pairs: list[tuple[str, str]]) -> str:
    supports = ", ".join(f"struct_pack(s := '{s}', q := {q})" for s, q in pairs)
    return f"SELECT query_id, {at} AS claim_idx, {text} AS text, CAST([{supports}] AS STRUCT(s VARCHAR, q VARCHAR)[]) AS supports FROM claims WHERE lexical_rank = 1"


def clauses_sql(col: str) -> str:
    """A claim's clauses. RE2 can't look ahead: an ``and`` is marked with all that must follow, and again, as that may hold another."""
    verb = T.CLAUSE_AND.removeprefix("(?i)").replace("'", "''").replace("(?=", "(")
    marked = "c"
    for _ in range(8):
        marked = f"regexp_replace({marked}, '(?i){verb}', chr(1) || '\1', 'g')"
    return f"flatten(list_transform(regexp_split_to_array({col}, '{T.CONTRAST}'), lambda c: CASE WHEN length(c) - length(replace(c, ',', '')) >= 2 THEN [c] ELSE string_split({marked}, chr(1)) END))"


def _rules_sql(name: str, rows: str) -> str:
    """Steps that add ``problem`` to ``rows`` with text, supports and the map m of passages."""
    norm = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+'), ' ')"
    terms = text_queries._terms
    parts = f"list_filter(list_transform(regexp_split_to_array(s.q, '\\.{{3,}}|…'), lambda y: {norm('y')}), lambda y: y <> '')"
    inside = norm("m[s.s]")
    held = f"(len({parts}) > 0 AND contains({inside}, {parts}[1]) AND (len({parts}) = 1 OR contains(substr({inside}, strpos({inside}, {parts}[1]) + length({parts}[1])), {parts}[2])))"
    least = f"CASE WHEN length(text) - length(replace(text, ',', '')) >= 2 THEN {grounding.SERIAL_SUPPORT} ELSE {grounding.CLAIM_SUPPORT} END"
    some = lambda x, bad: f"len(list_filter({x}, lambda s: {bad})) > 0"
    return f"""{name}_t AS (SELECT *, {terms("text")} AS tt, list_distinct(flatten(list_transform(supports, lambda s: {terms("s.q")}))) AS qt, list_transform(supports, lambda s: s.s) AS ids FROM {rows}),
  {name} AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty claim' WHEN len(supports) = 0 THEN 'no citation' WHEN len(ids) <> len(list_distinct(ids)) THEN 'repeated citation' WHEN {some("supports", "m[s.s] IS NULL")} THEN 'unknown source'
    WHEN {some("supports", "trim(s.q) = ''")} THEN 'empty quote' WHEN {some("supports", f"NOT {held}")} THEN 'quote not found' WHEN {some("supports", f"len(list_intersect(tt, {terms('s.q')})) = 0")} THEN 'no overlap'
    WHEN len(list_intersect(tt, qt))::DOUBLE / nullif(len(tt), 0) < {least} THEN 'low claim coverage'
    WHEN len(list_filter(list_transform({clauses_sql("text")}, lambda c: {terms("c")}), lambda t: len(t) > 0 AND len(list_intersect(t, qt))::DOUBLE / nullif(len(t), 0) < {least})) > 0 THEN 'low clause coverage' END AS problem FROM {name}_t)"""


RULES = f"""{text_queries.CLAIMS}, made AS ({" UNION ALL ".join(_made(i, t, p) for i, (t, p) in enumerate(_CASES))}),
  passages AS (SELECT query_id, map_from_entries(list(struct_pack(k := 'S' || lexical_rank, v := text))) AS m FROM claims GROUP BY query_id), each AS (SELECT * FROM made JOIN passages USING (query_id)), {_rules_sql("whole", "each")}"""
register("claim_rules", claim_rules, f"WITH {RULES} SELECT query_id, claim_idx, problem FROM whole")
register("repair_feedback", feedback, f"""WITH {RULES}, apart AS (SELECT query_id, claim_idx, text, m, unnest(supports) AS one, generate_subscripts(supports, 1) - 1 AS support FROM each),
  singles AS (SELECT query_id, claim_idx, text, m, support, [one] AS supports, one.s AS source_id FROM apart), {_rules_sql("alone", "singles")}
  SELECT query_id, claim_idx, NULL::INT AS support, NULL::VARCHAR AS source_id, problem FROM whole WHERE problem IS NOT NULL UNION ALL SELECT query_id, claim_idx, support::INT, source_id, problem FROM alone WHERE problem IS NOT NULL""")
register("cited_evidence", cited, f"""WITH {RULES}, named AS (SELECT DISTINCT query_id, unnest(list_transform(supports, lambda s: s.s)) AS source_id FROM made),
  flat AS (SELECT query_id, 'S' || lexical_rank AS source_id, lexical_rank AS position, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM claims)
  SELECT query_id, source_id, position, CASE WHEN length(f) > 240 THEN rtrim(substr(f, 1, 240)) || '...' ELSE f END AS preview FROM flat JOIN named USING (query_id, source_id)""")
_FIELDS = ["case_type", "used_fallback", *SCORES, "answer_success"]
register("answer_regrade", regraded, f"""WITH saved AS (SELECT case_id, {", ".join(_FIELDS)} FROM (WITH {GRADES} SELECT * FROM gr) WHERE case_id IN (SELECT doc_id FROM labels)),
  made AS (SELECT case_id, {", ".join(_FIELDS)} FROM (WITH {_grades_sql(0.98)} SELECT * FROM gr) WHERE case_id IN (SELECT item_id FROM benchmark WHERE len({WORDS}) >= 36)),
  b AS (SELECT coalesce(a.case_id, m.case_id) AS case_id, a.case_id IS NULL AS fresh, m.case_id IS NULL AS gone, array_to_string(list_filter([{", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM m.{c} THEN '{c}' END" for c in _FIELDS)}], lambda x: x IS NOT NULL), ',') AS fields FROM saved a FULL JOIN made m ON a.case_id = m.case_id)
  SELECT case_id, CASE WHEN gone THEN 'lost' WHEN fresh THEN 'new' WHEN fields = '' THEN 'same' ELSE 'changed' END AS state, CASE WHEN NOT gone AND NOT fresh AND fields <> '' THEN fields END AS fields FROM b""")
_RUN = f"'{files.run_id('answers')}' AS run_id"
register("answer_report", report, f"""WITH {GRADES}, st AS (SELECT CASE WHEN case_id NOT IN (SELECT query_id FROM lex JOIN exact USING (query_id, doc_id)) THEN 'retrieval' WHEN NOT held THEN 'ranking' WHEN NOT answered THEN 'generation' WHEN NOT answer_success THEN 'grading' ELSE 'none' END AS failure_stage FROM gr WHERE answerable)
  SELECT {_RUN}, 'cases' AS section, to_json(struct_pack(case_id, {", ".join(_FIELDS)}))::VARCHAR AS json FROM gr
  UNION ALL SELECT {_RUN}, 'failures', to_json(struct_pack(failure_stage, cases))::VARCHAR FROM (SELECT failure_stage, count(*) AS cases FROM st GROUP BY 1)
  UNION ALL SELECT {_RUN}, 'summary', to_json(struct_pack(cases, success_rate, fallbacks, {", ".join(SCORES)}))::VARCHAR FROM (SELECT count(*) AS cases, round(avg(answer_success::INT), 6) AS success_rate, 0::BIGINT AS fallbacks, {", ".join(f"round(avg({c}), 6) AS {c}" for c in SCORES)} FROM gr)""")
