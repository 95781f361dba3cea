"""Running the stateless layer operators over a stream of files.

Attribute and box filters, coordinate and datum conversions and reclassification are plain
projections, so they work on streaming input as they are. Nothing here keeps state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_layer_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str,
                     transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                     continuous: bool = False) -> StreamingQuery:
    """Apply a stateless ``transform`` to files arriving in ``source``.

    By default the query handles what is there and stops; ``continuous`` keeps it running.
    """
    stream = transform(spark.readStream.schema(schema).format(fmt).load(source))
    plan = stream._jdf.queryExecution().analyzed().toString()
    if any(word in plan for word in ("Aggregate", "Join", "Window ", "Deduplicate")):
        raise ValueError("only stateless transforms are supported on streams")
    writer = stream.writeStream.format(fmt).option("path", target).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()
