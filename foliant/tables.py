"""Intermediate tables in the folder that driver and executors share, and a join that gathers no hot key.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the
one folder that the driver and all executors share. A written table cuts the
lineage, so losing an executor never recomputes more than the current step.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local master (tests) gets one of its own; a cluster has to name it."""
    place = spark.conf.get(_OWN_SETTING, None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_OWN_SETTING} to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set(_OWN_SETTING, place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this package; results not yet read can't be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliant")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of a scan, dealt over all cores by ``keys`` where the scan keeps at most half of them busy; else as they are.

    A row group is read by one task, so all work on a small table's texts would
    be that task's. Spark gives each core a split as soon as there are
    ``spark.sql.files.openCostInBytes`` for each, so what is shuffled here is
    less than that (4 MB) a core, and a larger table never is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if 2 * rows.rdd.getNumPartitions() > cores else rows.repartition(cores, *keys)


def stacked(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, columns by name; every union of this package is made here.

    Spark 4.1 may keep a union's rows where they are if its parts are dealt by
    the same keys. Parts that reuse each other's exchange under other column
    names are then planned as if equal keys were together, and are not, so a
    grouping above gives several rows a key. The optimisation is turned off in
    the session where such a plan is made.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, parts)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` with the columns of ``right`` (a row a key) where the keys match, else nulls.

    ``weight`` says how many rows of ``left`` have the key. Keys that would
    fill a quarter of an average partition or more are looked up by broadcast:
    there are four times as many as partitions at most. No task gathers a hot key.
    """
    parts = shuffle_partitions(left.sparkSession)
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(weight) * 4 * parts > total))
    values = [c for c in right.columns if c != key]
    by_hot = left.join(hot, key, "left")
    found = by_hot.filter(F.col(weight).isNotNull())
    rest = by_hot.filter(F.col(weight).isNull()).drop(*values).join(right, key, "left")
    columns = [*left.columns, *values]
    return stacked(found.select(*columns), rest.select(*columns))
