"""Reading and writing database tables over JDBC, and SQL over registered layers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$")
_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def _checked(table: str) -> str:
    if not _NAME.match(table):
        raise ValueError(f"not a table name: {table!r}")
    return table


def jdbc_read(spark: SparkSession, url: str, table: str, where: str | None = None,
              partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 64,
              **options: str) -> DataFrame:
    """A database table; ``where`` and later filters run in the database.

    With ``partition_column`` and ``bounds`` the read is split into ``partitions`` ranges.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", _checked(table)).options(**options)
    if partition_column:
        lo, hi = bounds
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lo)
                  .option("upperBound", hi).option("numPartitions", partitions))
    df = reader.load()
    return df.where(where) if where else df


def jdbc_write(df: DataFrame, url: str, table: str, if_exists: str = "fail", **options: str) -> None:
    """Write to a database table; ``if_exists`` is fail, replace or append."""
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {list(_MODES)}")
    (df.write.format("jdbc").option("url", url).option("dbtable", _checked(table)).options(**options)
     .mode(_MODES[if_exists]).save())


def sql_query(spark: SparkSession, text: str, limit: int | None = None, order_by: tuple[str, ...] = (),
              **layers: DataFrame) -> DataFrame:
    """SQL over the given layers, named in braces in the text; a ``limit`` takes the first rows of an order."""
    if limit is not None and not order_by:
        raise ValueError("a limit needs order_by")
    out = spark.sql(text, **layers)
    return out.orderBy(*order_by).limit(limit) if limit is not None else out
