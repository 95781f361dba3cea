"""Importance resampling against plain Python, and the cutoff search on ties and hot scores."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralane.llm import resample
from terralane.llm.ranking import numbered


def features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, longest, buckets, share, least):
    own = [features(t, longest) for _, t in rows]
    count = lambda lists: np.bincount([zlib.crc32(f.encode()) % buckets for fs in lists for f in fs] or [0], minlength=buckets) * (sum(map(len, lists)) > 0)
    s, t = count([f for _, f in own]), count([features(x, longest)[1] for x in target])
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + buckets) / ((float(s[b]) + 1) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for (key, _), (words, fs) in zip(rows, own):
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:share[0] * len(able) // share[1]]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("longest,share", [(1, (10, 100)), (2, (1, 3)), (3, (1, 1)), (1, (0, 1))])
def test_report(spark, longest, share):
    rng = random.Random(longest)
    words = ["the", "Of", "and", "é1", "漢字", "x-y", "A"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, ".,; -"), (1003, "word " * 300_000), (1004, "w" * 400_000), (None, "the of and " * 20)]
    target = ["the the é1 of", None, "漢字 and and"]
    got = resample.resample_report(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, share=share)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, target, longest, resample.BUCKETS, share, 20), key=str)


def test_repeated_rows(spark):
    rows = [(7, "same words " * 20)] * 50 + [(8, "other words " * 20)] * 10
    got = resample.resample_report(frame(spark, rows), frame(spark, []), share=(1, 2)).collect()
    assert len(got) == 60 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 31))
    best = max(got, key=lambda r: r["score"])["doc_id"]
    assert sum(r["rank"] is not None for r in got if r["doc_id"] == best) == min(30, 50 if best == 7 else 10)


def test_cutoff_bracket(spark):
    """Ties on one score, brackets that miss, and every share of a table; the found row is the one that sorting finds."""
    rng = random.Random(3)
    scores = [5] * 400 + [rng.randint(-9, 20) for _ in range(600)]
    df = spark.createDataFrame([(i, s, i) for i, s in enumerate(scores)], "key long, score long, row long").repartition(7).cache()
    order = sorted(range(1000), key=lambda i: (-scores[i], i))
    for wanted in (1, 137, 500, 999, 1000):
        cut = resample.find_cutoff(df, (wanted, 1000), bracket=1e-9)
        assert (cut.key, cut.drawn) == (order[wanted - 1], wanted)
    wide = spark.range(100_000).select(F.col("id").alias("key"), F.xxhash64("id").alias("score"), F.col("id").alias("row"))
    cut = resample.find_cutoff(wide, (1, 10))
    assert cut.bracket < 2000 and wide.filter((F.col("score") > cut.score) | (F.col("score") == cut.score) & (F.col("key") <= cut.key)).count() == 10_000


def test_numbered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("a").alias("place_in_range"))
    got = numbered(df, ["x"], "n").collect()
    assert {(r["x"], r["n"]) for r in got} == {(i, i + 1) for i in range(5000)} and got[0]["place_in_range"] == "a"
    assert numbered(df.limit(0), ["x"], "n").count() == 0


def test_clashing_columns(spark):
    docs = frame(spark, [(i, "some words here " * 10) for i in range(20)]).withColumn("rank", F.lit("r")).withColumn("score", F.lit(1)).withColumn("ROW", F.lit(2))
    out = resample.resampled(docs, frame(spark, []))
    assert out.columns == [*docs.columns, "rank_"] and out.count() == 2
    assert resample.resample_report(docs.limit(0), frame(spark, [])).count() == 0
