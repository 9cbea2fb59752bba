"""Validating generated answers against their evidence, claim by claim and quote by quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import stacked

# Shares of the words of a claim, of a clause, and of a serial list that quotes must have.
CLAIM_SUPPORT = 0.4
CLAUSE_SUPPORT = 0.4
SERIAL_SUPPORT = 0.3
LIMITATION = "Not answered: "


def _coverage(terms: Column, support: Column) -> Column:
    return F.size(F.array_intersect(terms, support)) / F.when(F.size(terms) > 0, F.size(terms))


def claim_problems(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add ``problem`` to claims (query_id, claim_idx, text, supports array<struct<source_id, quote>>): the first rule broken, or null.

    ``evidence`` is (query_id, source_id, passage). The rules, in order: text;
    citations that are known, single and quoted; quotes found in their
    passage, each with a word of the claim; enough of the claim's words in
    its quotes, and of every clause's (less for serial lists).
    """
    known = evidence.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "passage"))).alias("passages"))
    rows = claims.join(known, "query_id", "left")
    passages = F.coalesce("passages", F.create_map().cast("map<string,string>"))
    terms = T.grounding_terms(F.col("text"))
    ids = F.transform("supports", lambda s: s["source_id"])
    quoted = F.array_distinct(F.flatten(F.transform("supports", lambda s: T.grounding_terms(s["quote"]))))
    serial = F.regexp_count("text", F.lit(",")) >= 2
    clause_terms = F.filter(F.transform(T.clauses(F.col("text")), T.grounding_terms), lambda t: F.size(t) > 0)
    least = F.when(serial, SERIAL_SUPPORT)
    any_support = lambda bad: F.exists("supports", bad)
    problem = (
        F.when(F.trim("text") == "", "empty claim")
        .when(F.size("supports") == 0, "no citation")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated citation")
        .when(F.exists(ids, lambda i: ~F.map_contains_key(passages, i)), "unknown source")
        .when(any_support(lambda s: F.trim(F.coalesce(s["quote"], F.lit(""))) == ""), "empty quote")
        .when(any_support(lambda s: ~T.quote_supported(s["quote"], F.try_element_at(passages, s["source_id"]))), "quote not found")
        .when(any_support(lambda s: F.size(F.array_intersect(terms, T.grounding_terms(s["quote"]))) == 0), "no overlap")
        .when(_coverage(terms, quoted) < F.coalesce(least, F.lit(CLAIM_SUPPORT)), "low claim coverage")
        .when(F.exists(clause_terms, lambda t: _coverage(t, quoted) < F.coalesce(least, F.lit(CLAUSE_SUPPORT))), "low clause coverage")
    )
    return rows.withColumn("problem", problem).drop("passages")


def answer_problems(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """Add ``problem`` to answers (query_id, status, insufficient_reason), from their claims with problems."""
    first = checked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("claim_idx"))).alias("claim_problem")
    )
    rows = answers.join(first, "query_id", "left").fillna(0, ["n_claims"])
    reason = F.coalesce(F.trim("insufficient_reason") != "", F.lit(False))
    refused = F.col("status") == "insufficient_evidence"
    problem = (
        F.when(refused & (F.col("n_claims") > 0), "refusal with claims")
        .when(refused & ~reason, "refusal without reason")
        .when(~refused & (F.col("n_claims") == 0), "answer without claims")
        .when((F.col("status") == "answered") & reason, "full answer with a gap")
        .when((F.col("status") == "partially_answered") & ~reason, "partial answer without a gap")
        .otherwise(F.col("claim_problem"))
    )
    return rows.withColumn("problem", problem).drop("claim_problem")


def repaired(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first attempt if valid, else the repair if valid, else a refusal: (query_id, status, attempt, used_fallback)."""
    a = first.select("query_id", F.col("status").alias("s1"), F.col("problem").alias("p1"))
    b = second.select("query_id", F.col("status").alias("s2"), F.col("problem").alias("p2"), F.lit(True).alias("tried"))
    rows = a.join(b, "query_id", "left")
    ok1, ok2 = F.col("p1").isNull(), F.col("tried") & F.col("p2").isNull()
    return rows.select(
        "query_id", F.when(ok1, F.col("s1")).when(ok2, F.col("s2")).otherwise("insufficient_evidence").alias("status"),
        F.when(ok1, 1).when(ok2, 2).alias("attempt"), F.coalesce(~ok1 & ~F.coalesce(ok2, F.lit(False)), F.lit(False)).alias("used_fallback"),
    )


def repair_feedback(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_idx, support, source_id, problem): what is wrong with each claim (support null) and with each support by itself.

    A support is checked as if it were the claim's only one, so a claim that
    fails says which of its quotes are to blame.
    """
    whole = claim_problems(claims, evidence).select("query_id", "claim_idx", F.lit(None).cast("int").alias("support"), F.lit(None).cast("string").alias("source_id"), "problem")
    each = claims.select("query_id", "claim_idx", "text", F.posexplode("supports").alias("support", "s"))
    alone = claim_problems(each.withColumn("supports", F.array("s")), evidence).select("query_id", "claim_idx", "support", F.col("s.source_id").alias("source_id"), "problem")
    return stacked(whole, alone).filter("problem is not null")


def rendered(claims: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): claims in order, each followed by its sources in brackets; a partial answer of ``answers``
    (query_id, status, insufficient_reason) ends with what it lacks."""
    marks = F.array_join(F.transform("supports", lambda s: F.concat(F.lit("["), s["source_id"], F.lit("]"))), "")
    line = F.concat_ws(" ", "text", marks)
    rows = claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_idx", line.alias("line")))), lambda x: x["line"]), " ").alias("answer"))
    if answers is None:
        return rows
    known = rows.join(answers.select("query_id", "status", "insufficient_reason"), "query_id")
    lacks = F.when(F.col("status") == "partially_answered", F.concat(F.lit(LIMITATION), F.trim("insufficient_reason")))
    return known.select("query_id", F.concat_ws(" ", "answer", lacks).alias("answer"))


def cited_evidence(claims: DataFrame, evidence: DataFrame, preview: int = 240) -> DataFrame:
    """The evidence (query_id, source_id, position, passage) that some claim cites, with a preview; ``position`` is its order."""
    named = claims.select("query_id", F.explode("supports").alias("s")).select("query_id", F.col("s.source_id").alias("source_id"))
    flat = F.trim(F.regexp_replace("passage", r"\s+", " "))
    cut = F.when(F.length(flat) > preview, F.concat(F.rtrim(F.substring(flat, 1, preview)), F.lit("..."))).otherwise(flat)
    return evidence.join(named, ["query_id", "source_id"], "left_semi").select("query_id", "source_id", "position", cut.alias("preview"))


def citations(claims: DataFrame) -> DataFrame:
    """(query_id, source_id, claims, quotes): what each source is cited for, in order."""
    each = claims.select("query_id", "claim_idx", "text", F.posexplode("supports").alias("at", "s"))
    item = F.struct("claim_idx", "at", "text", F.col("s.quote").alias("quote"))
    rows = each.groupBy("query_id", F.col("s.source_id").alias("source_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("query_id", "source_id", F.array_distinct(F.transform("items", lambda x: x["text"])).alias("claims"), F.transform("items", lambda x: x["quote"]).alias("quotes"))
