"""Sums of a kernel over all points for a bounded set of targets.

Every task adds its points up into one array over the targets, so the work grows linearly
with the points, no pair of point and target becomes a row, and only partial sums travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TARGET_LIMIT = 4_000_000     # most targets one task keeps sums for
BLOCK = 2_000_000            # point-target products evaluated at once


def partial_sums(points: DataFrame, columns: list[str], targets: np.ndarray, n_sums: int,
                 kernel: Callable) -> DataFrame:
    """``t, s0, s1, …`` with s = sum over points of ``kernel(points, targets)``.

    ``kernel(p, t)`` gets a block of points (rows x columns) and of targets and returns an
    array of shape (n_sums, rows of p, rows of t).
    """
    if len(targets) > TARGET_LIMIT:
        raise ValueError(f"more than {TARGET_LIMIT} targets; use a coarser grid or a neighbour limit")
    names = [f"s{i}" for i in range(n_sums)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_sums, len(targets)))
        seen = False
        for pdf in batches:
            p = pdf.to_numpy(dtype=float)
            if not len(p):
                continue
            seen = True
            step = max(1, BLOCK // max(1, len(targets)))
            width = min(len(targets), BLOCK)
            for i in range(0, len(p), step):
                for j in range(0, len(targets), width):
                    total[:, j:j + width] += kernel(p[i:i + step], targets[j:j + width]).sum(axis=1)
        if seen:
            yield pd.DataFrame({"t": np.arange(len(targets)), **dict(zip(names, total))})

    schema = "t long, " + ", ".join(f"{n} double" for n in names)
    parts = points.select(*[F.col(c).cast("double") for c in columns]).dropna().mapInPandas(run, schema)
    return parts.groupBy("t").agg(*[F.sum(n).alias(n) for n in names])


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))
