"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralane.session import checkpoint_root

#: The separators of words: blank and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: a cut that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does so for plans that nothing refers to any more, when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the table of a ``stored`` frame. What was computed from it must itself be written by then."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """The words of a text as an array; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def prefix_sums(values: Column) -> Column:
    """For each position of an array of longs the sum of all before it.

    Blocks of about the root of the length are summed first, so the work is
    the length to the power 1.5, also for one very long text. ``values`` must
    be a column of its own, not a costly expression: lambdas evaluate it again.
    """
    n = F.size(values)
    block = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))

    def total(part):
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0))),
                         lambda b: total(F.slice(values, b * block + 1, block)))
    before = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda b: total(F.slice(blocks, F.lit(1), b)))
    inside = F.flatten(F.transform(
        before, lambda start, b: F.transform(
            F.sequence(F.lit(0), F.greatest(F.least(block, n - b * block) - 1, F.lit(0))),
            lambda i: start + total(F.slice(values, b * block + 1, i)))))
    return F.when(n > 0, inside).otherwise(F.array().cast("array<long>"))
