"""Choosing evidence: greedy selection without near copies, neighbours, islands, source ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..tables import stored


DECISIONS = "query_id {query_id}, item_id long, rank int, decision string, duplicate_of long"


def word_hashes(text: Column) -> Column:
    """A text's distinct words as sorted 64-bit hashes: what similarities are counted on."""
    return F.sort_array(F.transform(T.word_set(text), lambda w: F.xxhash64(w)))


def with_words(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``candidates`` with ``words``, the word_hashes() of their texts (item_id, text).

    Each text that is a candidate at all is hashed once, by itself, for
    however many queries, and no text is shuffled beside a query.
    """
    found = stored(candidates, "candidates")
    words = texts.join(found.select("item_id").distinct(), "item_id", "left_semi").select("item_id", word_hashes(F.col("text")).alias("words"))
    return found.join(words, "item_id")


def greedy_select(
    candidates: DataFrame, top_k: int = 8, duplicate: float = 0.8, threshold: float | None = None, same_document: str | None = None, identity: str | None = None
) -> DataFrame:
    """(query_id, item_id, rank, decision, duplicate_of) of the candidates (query_id, item_id, rank, score, and text or its ``words``) that are decided.

    In rank order: ``below_threshold`` if the score is null or too low,
    ``duplicate`` of a kept one with the same ``identity`` (in the same
    document), ``near_duplicate`` of the first kept one whose words are similar
    enough (in the same document, if a column says which), else ``kept``;
    candidates after the last that fits are not decided. Only hashes of the
    words are shuffled, and a query's short list is one group.
    """
    text_of = lambda name: (F.lit("") if name is None else F.coalesce(F.col(name).cast("string"), F.lit("")))
    rows = candidates.select(
        "query_id", F.col("item_id").cast("long").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"),
        text_of(same_document).alias("document"), (F.lit(None).cast("string") if identity is None else F.col(identity).cast("string")).alias("identity"),
        (F.col("words") if "words" in candidates.columns else word_hashes(F.col("text"))).alias("words"),
    )

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        out = []
        for r in group.sort_values(["rank", "item_id"]).itertuples(index=False):
            if len(kept) >= top_k:
                break
            if threshold is not None and not r.score >= threshold:
                out.append((r.query_id, r.item_id, r.rank, "below_threshold", None))
                continue
            own = [k for k in kept if k.document == r.document]
            copy = next((k for k in own if r.identity is not None and k.identity == r.identity), None)
            near = copy or next((k for k in own if _alike(k.words, r.words) >= duplicate), None)
            out.append((r.query_id, r.item_id, r.rank, "duplicate" if copy else "near_duplicate" if near else "kept", near.item_id if near else None))
            if near is None:
                kept.append(r)
        made = pd.DataFrame(out, columns=["query_id", "item_id", "rank", "decision", "duplicate_of"])
        return made.astype({"duplicate_of": "Int64"})

    return rows.groupBy("query_id").applyInPandas(choose, DECISIONS.format(query_id=candidates.schema["query_id"].dataType.simpleString()))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Shared by all distinct hashes; two empty lists are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def with_neighbours(anchors: DataFrame, pages: DataFrame, window: int = 1) -> DataFrame:
    """(query_id, file, page_number, anchor_page, anchor_rank, origin): anchors and the pages within ``window`` of them.

    A page that several anchors reach belongs to the best-ranked one; ``origin``
    is ``anchor`` for that one's own page, else ``adjacent``. The window is
    exploded on the anchors' side, so the join is on equal keys.
    """
    near = anchors.withColumn("step", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    near = near.select("query_id", "file", (F.col("page_number") + F.col("step")).alias("page_number"), F.col("page_number").alias("anchor_page"), F.col("rank").alias("anchor_rank"))
    found = near.join(pages.select("file", "page_number"), ["file", "page_number"])
    first = Window.partitionBy("query_id", "file", "page_number").orderBy("anchor_rank", "anchor_page")
    best = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    origin = F.when(F.col("page_number") == F.col("anchor_page"), "anchor").otherwise("adjacent")
    return best.select("query_id", "file", "page_number", "anchor_page", "anchor_rank", origin.alias("origin"))


def reading_order(evidence: DataFrame) -> DataFrame:
    """Add ``island`` and ``position``: runs of neighbouring pages stay together, ordered by their best rank, then by page."""
    by_page = Window.partitionBy("query_id", "file").orderBy("page_number")
    gap = F.col("page_number") - F.lag("page_number").over(by_page)
    marked = evidence.withColumn("island", F.sum(F.when(gap <= 1, 0).otherwise(1)).over(by_page))
    inside = Window.partitionBy("query_id", "file", "island")
    ranked = marked.withColumn("__best", F.min("rank").over(inside))
    order = Window.partitionBy("query_id").orderBy("__best", "file", "page_number")
    return ranked.withColumn("position", F.row_number().over(order)).drop("__best")


def with_source_ids(evidence: DataFrame, position: str = "position") -> DataFrame:
    return evidence.withColumn("source_id", F.concat(F.lit("S"), F.col(position).cast("string")))


def payload(evidence: DataFrame, *fields: str) -> DataFrame:
    """(query_id, context): the evidence of a query as JSON, in reading order."""
    item = F.struct("position", "source_id", *fields)
    rows = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    bare = F.transform("items", lambda x: F.struct(x["source_id"].alias("source_id"), *[x[f].alias(f) for f in fields]))
    return rows.select("query_id", F.to_json(bare, {"ignoreNullFields": "false"}).alias("context"))
