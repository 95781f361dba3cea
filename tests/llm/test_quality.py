"""Quality rules against plain Python, the ratio included."""

import math
import random
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from terralane.llm import quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
    pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(h, h[1:])]
    return [signed(x) % buckets for x in h + pairs]


def verdicts(rows, good, buckets):
    raw, tgt = [0] * buckets, [0] * buckets
    for i, t in rows:
        for g in grams(t, buckets):
            raw[g] += 1
            tgt[g] += i in good
    share = lambda c, n: (c + quality.SMOOTHING) / (n + quality.SMOOTHING * buckets)
    weights = [math.log(share(g, sum(tgt)) / share(r, sum(raw))) for g, r in zip(tgt, raw)]
    mean = sum(g * w for g, w in zip(tgt, weights)) / sum(tgt)
    within = sum(g * (w - mean) ** 2 for g, w in zip(tgt, weights)) / sum(tgt)
    score = [(sum(weights[g] for g in gs) / len(gs), len(gs)) if (gs := grams(t, buckets)) else (None, 0) for _, t in rows]
    seen = [s for (i, _), s in zip(rows, score) if i in good and s[1]]
    centre = sum(s for s, _ in seen) / len(seen)
    between = max(0.0, sum(s * s for s, _ in seen) / len(seen) - centre ** 2 - sum(within / n for _, n in seen) / len(seen))
    return [s is not None and s >= centre - quality.DEVIATIONS * math.sqrt(between + within / n) for s, n in score], [s for s, _ in score]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_base_columns(spark):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "a " * 30), (4, "\n".join(["x y", "x y", "", " ", "z", "x y"])), (None, "n u l l"), (5, "é\x0b漢#*|<> \x85b"),
            (6, " ".join(map(str, range(200_000)))), (7, "w" * 300_000), (8, "same words here again " * 5000)]
    rows += [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))) for i in range(10, 150)] * 2
    got = quality.quality_report(frame(spark, rows), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert all(r["kept"] is (not r["base_failed"]) for r in got)   # no trusted n-grams: all weights are 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_verdicts(spark, folder):
    rows = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    good = {r[0] for r in duckdb.sql(f"select doc_id from '{folder}/labels.parquet' where quality = 1").fetchall()}
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    want, scores = verdicts(rows, good, quality.BUCKETS)
    got = {r["doc_id"]: r for r in quality.quality_report(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for (i, t), kept, s in zip(rows, want, scores):
        assert got[i]["kept"] == (kept and not base(t)[-1])
        assert s is None or abs(got[i]["score"] - s) < 1e-5


def test_empty_and_clashing(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, [(1, "some words " * 5), (2, None)]).withColumn("hashes_tmp", F.lit(1)).withColumn("KEPT_tmp", F.lit(2))
    assert quality.keep_good(docs.limit(0), labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == 0
    assert quality.quality_report(docs.limit(0), labels.limit(0)).count() == 0


def test_all_trusted_documents_count(spark):
    # raw and target counts are the same when every document is trusted, however many there are
    docs = spark.range(50_400).selectExpr("id as doc_id", "concat('w', id % 9973, ' x', id % 7) as text").repartition(8)
    ratio = quality.fit(docs, docs.select("doc_id"))
    assert not any(ratio.weights)


def test_trusted_keys_listed_or_joined(spark, monkeypatch):
    docs = spark.range(300).selectExpr("if(id % 50 = 0, null, id) as doc_id", "concat('w', id % 17, ' x', id % 7) as text").repartition(8)
    trusted = docs.filter("doc_id % 3 = 0").select("doc_id")
    listed = quality.fit(docs, trusted)
    monkeypatch.setattr(quality, "LISTED", 0)
    assert quality.fit(docs, trusted) == listed
