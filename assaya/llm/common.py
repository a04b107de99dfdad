"""Helpers that the operators of this subpackage share.

Lineage is cut with Parquet tables in the folder that ``spark.checkpoint.dir``
names; a folder of our own is used only in local sessions where it is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaya.sources.scratch import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Paths of this session's tables in the shared folder.
_SCRATCH: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's own reader (the path may be in any store); one that is small is dealt over all cores."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Lets Python workers take rows in small batches, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="assaya-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far, which results that are still to be computed would read: for long sessions, between jobs."""
    while _SCRATCH:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages start from these files.

    Losing an executor then costs only the tasks it ran.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left", small: Column | None = None, parts: int = 10_000) -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each key), although a few keys may hold most rows.

    A group of over ``total / parts`` rows is hot. There are fewer than ``parts``
    such groups, whatever the data, so their rows are broadcast and the rows of
    hot keys are never dealt out by key. All others meet in a shuffled join. Where a
    row of ``groups`` may be long, ``small`` says which may be broadcast.
    """
    edge = max(100, total // parts)
    if total <= edge:
        return rows.join(groups, keys, how)
    is_hot = F.col(size) > edge if small is None else (F.col(size) > edge) & small
    hot = F.broadcast(groups.filter(is_hot))
    cold = groups.filter(~is_hot)
    on_hot = rows.join(hot, keys, "inner")
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return on_hot.unionByName(rest)
