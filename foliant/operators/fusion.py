"""Reciprocal-rank fusion of ranked lists, and comparisons between lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import stacked


def contribution(rank: Column, k: int) -> Column:
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


def fuse(lists: dict[str, DataFrame], rrf_k: int = 60, top_k: int | None = None, identity: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fuse lists (query_id, doc_id, rank) by name into (query_id, doc_id, <name>_rank..., rrf_score, source_count, best_rank, fused_rank).

    ``identity`` are the columns that tell candidates apart: a chunk's is its
    document and its hash, as equal passages of two documents have one hash. A
    candidate that a list has twice counts with its better rank.

    One union and one grouping, however many lists; a list that lacks a
    candidate adds nothing. Order: score, number of lists, best rank, identity.
    """
    rows = stacked(*[df.select("query_id", *identity, F.col("rank").cast("int").alias("rank"), F.lit(name).alias("list")) for name, df in lists.items()])
    of = {name: F.min(F.when(F.col("list") == name, F.col("rank"))) for name in lists}
    fused = rows.groupBy("query_id", *identity).agg(
        *[c.alias(f"{name}_rank") for name, c in of.items()], F.min("rank").alias("best_rank")
    )
    score = reduce(lambda a, b: a + b, [contribution(F.col(f"{name}_rank"), rrf_k) for name in lists])
    count = reduce(lambda a, b: a + b, [F.col(f"{name}_rank").isNotNull().cast("int") for name in lists])
    fused = fused.withColumns({"rrf_score": F.round(score, 9), "source_count": count})
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.desc("source_count"), "best_rank", *identity)
    fused = fused.withColumn("fused_rank", F.row_number().over(order))
    return fused if top_k is None else fused.filter(F.col("fused_rank") <= top_k)


def union_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two lists (query_id, doc_id): sizes, union and overlap by query."""
    rows = stacked(*[df.select("query_id", "doc_id", F.lit(x).alias("x"), F.lit(1 - x).alias("y")) for df, x in ((a, 1), (b, 0))])
    each = rows.groupBy("query_id", "doc_id").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.groupBy("query_id").agg(
        F.sum("x").alias("first_size"), F.sum("y").alias("second_size"), F.count(F.lit(1)).alias("union_size"),
        F.sum(F.col("x") * F.col("y")).alias("overlap"),
    )


def union_metrics(lists: list[DataFrame], relevant: DataFrame) -> DataFrame:
    """(query_id, candidates, hit, recall) for every query with relevant pairs: what the lists (query_id, doc_id) together could still find."""
    every = stacked(*[df.select("query_id", "doc_id") for df in lists]).distinct().withColumn("listed", F.lit(1))
    wanted = relevant.select("query_id", "doc_id").distinct().withColumn("good", F.lit(1))
    rows = every.join(wanted, ["query_id", "doc_id"], "full").groupBy("query_id")
    counts = rows.agg(F.count("listed").alias("candidates"), F.count("good").alias("good"), F.count(F.when(F.col("listed") + F.col("good") == 2, 1)).alias("both"))
    return counts.filter("good > 0").select("query_id", "candidates", (F.col("both") > 0).alias("hit"), F.round(F.col("both") / F.col("good"), 6).alias("recall"))


def first_relevant(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, first_rank) of a run (query_id, doc_id, rank) with relevant pairs (query_id, doc_id)."""
    return run.join(relevant, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))


def rank_changes(before: DataFrame, after: DataFrame, relevant: DataFrame) -> DataFrame:
    """Whether the first relevant rank was helped, unchanged or harmed; a missing one is behind all others."""
    queries = relevant.select("query_id").distinct()
    both = queries.join(first_relevant(before, relevant).withColumnRenamed("first_rank", "before_rank"), "query_id", "left")
    both = both.join(first_relevant(after, relevant).withColumnRenamed("first_rank", "after_rank"), "query_id", "left")
    far = 1_000_000_000
    x, y = F.coalesce("before_rank", F.lit(far)), F.coalesce("after_rank", F.lit(far))
    return both.withColumn("change", F.when(y < x, "helped").when(y > x, "harmed").otherwise("unchanged"))
