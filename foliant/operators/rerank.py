"""Reranking by scored pairs: order, cutoffs, and a whole query's fallback if any of its scores is unusable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import evaluation

# US dollars for a million tokens.
INPUT_PRICE = 0.15
OUTPUT_PRICE = 0.60
TOP_SCORE = 3


def pair_passage(section: Column, passage: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section, F.lit("\n"), passage)).otherwise(passage)


def rerank(fused: DataFrame, scores: DataFrame, rerank_k: int = 10, final_k: int = 5, cutoff: int = 0) -> DataFrame:
    """Order the first ``rerank_k`` of (query_id, doc_id, fused_rank) by ``scores`` (query_id, doc_id, score).

    Of a query whose scores lack a pair, have one twice or one too many, or
    lie outside 0 to 3, none is used: its fused order stays, scores are null,
    and the cutoff is not applied. ``selected`` marks the first ``final_k``.
    """
    pairs = fused.filter(F.col("fused_rank") <= rerank_k).select("query_id", "doc_id", "fused_rank")
    counted = scores.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    both = pairs.join(counted, ["query_id", "doc_id"], "full_outer")
    bad = F.col("fused_rank").isNull() | F.coalesce(F.col("n") != 1, F.lit(True)) | ~F.coalesce(F.col("score").between(0, TOP_SCORE), F.lit(False))
    of_query = Window.partitionBy("query_id")
    both = both.withColumn("fallback", F.max(bad).over(of_query)).filter(F.col("fused_rank").isNotNull())
    both = both.withColumn("score", F.when(~F.col("fallback"), F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0))), "fused_rank")
    ranked = both.withColumn("reranked_rank", F.row_number().over(order))
    passes = F.col("fallback") | (F.col("score") >= cutoff)
    place = F.sum(passes.cast("int")).over(order)
    return ranked.withColumn("selected", passes & (place <= final_k)).drop("n")


def cutoff_sweep(ranked: DataFrame, relevant: DataFrame, final_k: int = 5) -> DataFrame:
    """For each cutoff 0 to 3: how many queries keep something, and how many a relevant document, in their first ``final_k``."""
    rows = ranked.join(relevant.withColumn("good", F.lit(1)), ["query_id", "doc_id"], "left")
    each = rows.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.lit(TOP_SCORE)))).filter(F.col("score") >= F.col("cutoff"))
    inside = Window.partitionBy("query_id", "cutoff").orderBy("reranked_rank")
    kept = each.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= final_k)
    of = kept.groupBy("query_id", "cutoff").agg(F.max(F.coalesce("good", F.lit(0))).alias("hit"))
    return of.groupBy("cutoff").agg(F.count(F.lit(1)).alias("nonempty"), F.sum("hit").alias("hits"))


def cutoff_metrics(ranked: DataFrame, judgments: DataFrame, cases: DataFrame, final_k: int = 5) -> DataFrame:
    """By cutoff 0 to 3: the mean metrics of answerable cases, how many of the unanswerable ones keep nothing, and how much is kept.

    ``ranked`` is rerank()'s; a query that fell back keeps its order whatever
    the cutoff. ``judgments`` is (query_id, doc_id), ``cases`` (query_id, answerable).
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(TOP_SCORE))).alias("cutoff")
    rows = ranked.select("query_id", "doc_id", "score", "fallback", "reranked_rank", every).filter(F.col("fallback") | (F.col("score") >= F.col("cutoff")))
    place = F.row_number().over(Window.partitionBy("query_id", "cutoff").orderBy("reranked_rank"))
    case = F.concat_ws(":", F.col("query_id").cast("string"), F.col("cutoff").cast("string")).alias("case_id")
    run = rows.withColumn("rank", place).filter(F.col("rank") <= final_k).select("cutoff", case, "rank", F.col("doc_id").alias("label"))
    asked = cases.select("query_id", "answerable", every).select("cutoff", "answerable", case)
    judged = judgments.select("query_id", "doc_id", every).select(case, F.col("doc_id").alias("label"), F.lit(1).alias("grade"))
    kept = run.groupBy("case_id").agg(F.count(F.lit(1)).alias("kept"))
    metrics = evaluation.case_metrics(run.drop("cutoff"), judged, (1, 3, 5)).drop("first_rank")
    each = asked.join(kept, "case_id", "left").join(metrics, "case_id", "left").fillna(0, ["kept"])
    means = [F.round(F.avg(F.when(F.col("answerable"), F.coalesce(c, F.lit(0.0)))), 6).alias(c) for c in metrics.columns if c != "case_id"]
    empty = F.round(F.avg(F.when(~F.col("answerable"), (F.col("kept") == 0).cast("double"))), 6)
    return each.groupBy("cutoff").agg(empty.alias("unanswerable_empty"), F.round(F.avg("kept"), 6).alias("mean_kept"), *means)


def overlap_score(question: Column, passage: Column) -> Column:
    """The default scorer: shared content words of the question's, in four steps."""
    from ..functions import text as T

    terms = T.content_terms(question)
    share = F.size(F.array_intersect(terms, T.tokens(passage))) / F.when(F.size(terms) > 0, F.size(terms))
    return F.when(share >= 0.75, 3).when(share >= 0.5, 2).when(share >= 0.25, 1).otherwise(0)


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return (input_tokens * F.lit(INPUT_PRICE) + output_tokens * F.lit(OUTPUT_PRICE)) / F.lit(1_000_000.0)
