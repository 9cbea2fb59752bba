"""Numbers, sums and values that go on from row to row, within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried(rows: DataFrame, group: str, block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the last value of ``value`` in the group up to a row, and ``<name>_before``: the last before it; nulls are no values.

    ``block`` rises with ``order`` within a group. Rows are ordered within a
    block; of a block, one row goes on to those behind it. So a group that
    holds much of the table is spread over tasks.
    """
    at, found, last = f"{name}#block", f"{name}#value", f"{name}#last"
    cut = rows.withColumns({at: block, found: value})
    inside = Window.partitionBy(group, at).orderBy(*order)
    seen = cut.withColumns({
        name: F.last(found, ignorenulls=True).over(inside),
        f"{name}_before": F.last(found, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
    })
    place = F.when(F.col(found).isNotNull(), F.struct(*order))
    every = cut.groupBy(F.col(group).alias(f"{at}g"), F.col(at).alias(f"{at}n")).agg(F.max_by(found, place).alias(last))
    over = Window.partitionBy(f"{at}g").orderBy(f"{at}n").rowsBetween(Window.unboundedPreceding, -1)
    handed = every.select(f"{at}g", f"{at}n", F.last(last, ignorenulls=True).over(over).alias(last))
    same = F.col(group).eqNullSafe(F.col(f"{at}g")) & F.col(at).eqNullSafe(F.col(f"{at}n"))
    both = seen.join(handed, same, "left")
    return both.select(*rows.columns, *[F.coalesce(n, last).alias(n) for n in (name, f"{name}_before")])


def sums_before(rows: DataFrame, group: str, block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows before a row; as carried(), of a block one row goes on."""
    at = f"{name}#block"
    cut = rows.withColumn(at, block)
    inside = Window.partitionBy(group, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col(group).alias(f"{at}g"), F.col(at).alias(f"{at}n")).agg(F.sum(value).alias("total"))
    over = Window.partitionBy(f"{at}g").orderBy(f"{at}n").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select(f"{at}g", f"{at}n", F.coalesce(F.sum("total").over(over), F.lit(0)).alias(f"{at}s"))
    same = F.col(group).eqNullSafe(F.col(f"{at}g")) & F.col(at).eqNullSafe(F.col(f"{at}n"))
    own = cut.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(handed, same).select(*rows.columns, (F.col(name) + F.col(f"{at}s")).alias(name))


def number_rows(rows: DataFrame, group: str, order: str, name: str, step: int = 100_000) -> DataFrame:
    """Add ``name``: 1, 2, ... within each group, by the integer column ``order``, which is unique there.

    Rows are ranked in runs of ``step`` values of ``order``, and a run begins
    where the counts of those before it end. So a group that holds much of
    the table is spread over tasks, and only a row a run is ordered as a whole.
    """
    if step < 1:
        raise ValueError("step must be positive")
    cut = rows.withColumn("__run", F.floor(F.col(order) / step))
    counts = cut.groupBy(group, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("__group"), F.col("__run").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__run").orderBy(order)
    ranked = cut.withColumn("__rank", F.row_number().over(inside))
    same = F.col(group).eqNullSafe(F.col("__group")) & F.col("__run").eqNullSafe(F.col("__at"))
    return ranked.join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__rank")).cast("int").alias(name))
