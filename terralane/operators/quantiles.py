"""Exact percentiles without gathering a group: histograms narrow each rank down.

A first pass counts values in equal-width bins per group, a second pass does the same
inside the bins that hold the wanted ranks, and only the distinct values left in those
narrow bins are ordered. Every pass is a map-side combined aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, Window as W

from terralane.session import cut

BINS = 65_536
WHOLE_BINS = 1024


def _narrow(df: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One histogram pass; targets hold keys, rank, lo, hi and before."""
    ranges = targets.select(*keys, "lo", "hi", "before").distinct()
    width = F.col("hi") - F.col("lo")
    bin_no = F.when(width > 0, F.least(
        F.floor((F.col("_v") - F.col("lo")) / F.when(width > 0, width).otherwise(1.0) * BINS),
        F.lit(BINS - 1))).otherwise(F.lit(0))
    hist = (df.join(ranges, keys).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
            .groupBy(*keys, "lo", "hi", "before", bin_no.alias("bin"))
            .agg(F.count("*").alias("cnt"), F.min("_v").alias("vlo"), F.max("_v").alias("vhi")))
    w = W.partitionBy(*keys, "lo", "hi").orderBy("bin")
    hist = (hist.withColumn("upto", F.sum("cnt").over(w) + F.col("before"))
            .withColumn("start", F.col("upto") - F.col("cnt"))
            .withColumnsRenamed({"lo": "_lo", "hi": "_hi", "before": "_before"}))
    t = targets.alias("t")
    cond = [F.col("t." + k).eqNullSafe(hist[k]) for k in keys]
    cond += [F.col("t.lo") == hist._lo, F.col("t.hi") == hist._hi,
             F.col("t.rank") >= hist.start, F.col("t.rank") < hist.upto]
    return t.join(hist, cond).select(*[F.col("t." + k) for k in keys], F.col("t.rank").alias("rank"),
                                     F.col("vlo").alias("lo"), F.col("vhi").alias("hi"),
                                     F.col("start").alias("before"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    prefix: str = "q") -> DataFrame:
    """One row per group with linearly interpolated percentiles ``q0, q1, …``.

    Nulls and NaN are skipped. ``by=None`` gives one row for the whole input. Grouping keys
    must not be null.
    """
    if by is None:
        return _whole_quantiles(df, value, probs, prefix)
    keys = by
    base = (df.select(*keys, F.col(value).cast("double").alias("_v"))
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    stats = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"),
                                    F.max("_v").alias("hi"))
    positions = F.array(*[F.struct(F.lit(i).alias("i"),
                                   ((F.col("n") - 1) * F.lit(float(p))).alias("pos"))
                          for i, p in enumerate(probs)])
    wanted = stats.withColumn("t", F.explode(positions)).select(
        *keys, "lo", "hi", F.col("t.i").alias("i"), F.col("t.pos").alias("pos"),
        F.floor("t.pos").alias("below"), F.ceil("t.pos").alias("above"))
    targets = (wanted.select(*keys, "lo", "hi", F.explode(F.array("below", "above")).alias("rank"))
               .distinct().withColumn("before", F.lit(0).cast("long")))
    # the rank table is small (groups x ranks); cutting it keeps the passes independent
    targets = cut(_narrow(base, targets, keys))
    targets = cut(_narrow(base, targets, keys))
    ranges = targets.select(*keys, "lo", "hi", "before").distinct()
    counts = (base.join(ranges, keys).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
              .groupBy(*keys, "lo", "hi", "before", "_v").agg(F.count("*").alias("cnt")))
    w = W.partitionBy(*keys, "lo", "hi").orderBy("_v")
    counts = (counts.withColumn("upto", F.sum("cnt").over(w) + F.col("before"))
              .withColumnsRenamed({"lo": "_lo", "hi": "_hi"}))
    t = targets.alias("t")
    cond = [F.col("t." + k) == counts[k] for k in keys]
    cond += [F.col("t.lo") == counts._lo, F.col("t.hi") == counts._hi,
             F.col("t.rank") >= counts.upto - counts.cnt, F.col("t.rank") < counts.upto]
    at_rank = t.join(counts, cond).select(*[F.col("t." + k).alias(k) for k in keys],
                                          F.col("t.rank").alias("rank"), F.col("_v").alias("v"))
    lo = at_rank.withColumnsRenamed({"rank": "below", "v": "v_below"})
    hi = at_rank.withColumnsRenamed({"rank": "above", "v": "v_above"})
    full = wanted.join(lo, keys + ["below"]).join(hi, keys + ["above"])
    full = full.withColumn("q", F.col("v_below") + (F.col("pos") - F.col("below"))
                           * (F.col("v_above") - F.col("v_below")))
    return full.groupBy(*keys).agg(*[
        F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"{prefix}{i}") for i in range(len(probs))])


def _whole_quantiles(df: DataFrame, value: str, probs: list[float], prefix: str) -> DataFrame:
    """Percentiles of one ungrouped column; each pass returns at most ``WHOLE_BINS`` rows
    per wanted rank to the driver."""
    v = F.col(value).cast("double")
    base = df.select(v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n, lo, hi = base.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    schema = ", ".join(f"{prefix}{i} double" for i in range(len(probs)))
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([(None,) * len(probs)], schema)
    ranks = {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    found: dict[int, float] = {}
    open_ranges = {(lo, hi, 0): sorted(ranks)}
    while open_ranges:
        todo = [(key, rs) for key, rs in open_ranges.items() if key[0] < key[1]]
        for key, rs in open_ranges.items():
            if key[0] == key[1]:
                found.update({r: key[0] for r in rs})
        open_ranges = {}
        if not todo:
            break
        slot = F.lit(None).cast("long")
        for i, ((a, b, _), _) in enumerate(todo):
            # a subnormal width would divide to infinity, hence the clamp on both ends
            place = F.floor(F.least((F.col("_v") - a) / max((b - a) / WHOLE_BINS, 5e-324),
                                    F.lit(WHOLE_BINS - 1.0)))
            slot = F.when(F.col("_v").between(a, b), F.lit(i * WHOLE_BINS) + place).otherwise(slot)
        rows = (base.select("_v", slot.alias("slot")).filter(F.col("slot").isNotNull())
                .groupBy("slot").agg(F.count("*"), F.min("_v"), F.max("_v")).orderBy("slot").collect())
        for i, ((_, _, before), rs) in enumerate(todo):
            for s, cnt, vlo, vhi in rows:
                if s // WHOLE_BINS != i:
                    continue
                here = [r for r in rs if before <= r < before + cnt]
                if here:
                    open_ranges[(vlo, vhi, before)] = here
                before += cnt
    out = []
    for p in probs:
        pos = (n - 1) * p
        a, b = found[math.floor(pos)], found[math.ceil(pos)]
        out.append(a + (pos - math.floor(pos)) * (b - a))
    return spark.createDataFrame([tuple(out)], schema)
