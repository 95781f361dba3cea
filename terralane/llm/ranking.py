"""Global positions of rows in an order, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terralane.llm.common import fresh, stored


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the column ``name``: 1 for the first row by the columns ``order``, 2 for the next, and so on.

    ``order`` must tell rows apart, or rows that it does not must be alike. Rows are dealt out by ranges and
    counted within each; the only thing gathered is one count for each range.
    """
    place, task = fresh(df, "place_in_range"), fresh(df, "number_of_range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, own, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64))],
                [*batch.schema.names, task, place])
            at += n

    columns = [F.col(f"`{c}`") for c in order]
    schema = StructType([*df.schema.fields, StructField(task, LongType()), StructField(place, LongType())])
    dealt = stored(df.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, schema), "ranges")
    before, at = [], 0
    for r in dealt.groupBy(task).count().orderBy(task).collect():     # one row a range
        before.append((r[task], at + 1))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(before, f"{task} long, start_of_range long")
    joined = dealt.join(F.broadcast(starts), task)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(place) + F.col("start_of_range")).alias(name))
