"""Tables of the corpus operators: what the library has for them, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop_scratch, lookup, scratch_path, shared_dir, shuffle_partitions, stacked, stored, table

__all__ = ["components", "drop_scratch", "lookup", "scratch_path", "shared_dir", "shuffle_partitions", "stacked", "stored", "table", "unused"]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names after ``names`` that ``df`` doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the undirected ``edges`` (a, b): comp is the smallest node that can be reached.

    Every round takes the neighbours' smallest label and then the label's own
    label, so long chains shrink by half; each round's labels are written.
    """
    both = stacked(edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        step = stored(step.join(jump, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") < F.col("comp")).alias("moved")), "labels")
        labels = step.select("node", "comp")
        if step.filter("moved").isEmpty():
            return labels
