"""The pipeline's stages on small tables, near copies against all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralane.llm import decontaminate, near_copies, quality, secrets
from terralane.llm.simhash_dedup import Forest


def words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


def shingle_set(t):
    w = words(t)
    k = max(1, min(5, len(w)))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_pairs(texts):
    """All pairs of similarity 0.8 or more (equal word sequences included)."""
    sets = [shingle_set(t) for t in texts]
    seqs = [tuple(words(t)) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for own in by.values() if len(own) < 400 for a in own for b in own if a < b}
    out = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    first = {}
    return out + [(first.setdefault(s, i), i) for i, s in enumerate(seqs) if first.setdefault(s, i) != i]


def test_near_copies(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rng = random.Random(7)
    base = [t.split() for _, t in rows if 60 <= len(t.split()) <= 400][:60]
    for w in base:          # near copies of similarity 0.8 and up
        for _ in range(4):
            new = list(w)
            for _ in range(max(1, len(w) // 60)):
                new[rng.randrange(len(new))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows) + 5000, " ".join(new)))
    rows += [(None, rows[0][1]), (None, None), (9001, ""), (9002, None), (9003, "a b"), (9004, "A  B"), (9003, "a b")]
    rows += rows[:20]
    distinct = list(dict.fromkeys(rows))
    forest, missed = Forest(), 0
    pairs = near_pairs([t for _, t in distinct])
    for a, b in pairs:
        forest.join(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("row", F.lit("x")).withColumn("ROW_hash", F.lit(0))
    kept = near_copies.first_of_each(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {}
    for i, r in enumerate(distinct):
        groups.setdefault(forest.root(i), []).append(r)
    least = {min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in groups.values()}
    assert len(got) == len(set(got))
    assert {k for k, _ in least} <= {k for k, _ in got}
    extra = len(got) - len(groups)
    print("groups", len(groups), "kept", len(got), "pairs", len(pairs))
    assert 0 <= extra <= 0.03 * (len(distinct) - len(groups))


def test_near_copies_behind_reordered_texts(spark):
    """Texts with the same words in another order stand between near copies in the tree, but do not part them."""
    rng = random.Random(12)
    rows = []
    for i in range(20):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        orders = [rng.sample(a, len(a)) for _ in range(3)]
        copy = list(orders[0])
        copy[100] = "edited"
        rows += [(10 * i + k, " ".join(w)) for k, w in enumerate([*orders, copy])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r["doc_id"] for r in near_copies.first_of_each(df).select("doc_id").collect())
    assert kept == [10 * i + k for i in range(20) for k in range(3)]


def edited(w, kind, rng):
    """A near copy of similarity 0.80 to 0.85; None where the text allows none."""
    for _ in range(100):
        n, new = len(w), list(w)
        size = max(1, round(n * rng.uniform(0.02, 0.25)))
        at = rng.randrange(n - size + 1)
        fresh = [f"new{rng.randrange(10**7)}" for _ in range(size)]
        if kind == "tail cut":
            new = new[:n - size]
        elif kind == "block replaced":
            new[at:at + size] = fresh
        elif kind == "block inserted":
            new[at:at] = fresh
        else:
            for i in rng.sample(range(n), max(1, n // rng.randint(40, 60))):
                new[i] = f"new{rng.randrange(10**7)}"
        a, b = shingle_set(" ".join(w)), shingle_set(" ".join(new))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            return " ".join(new)


def test_recall_by_kind_of_edit(spark):
    rows = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    base = [t for t in dict.fromkeys(t for t, in rows if t) if 100 <= len(t.split()) <= 1500][:170]
    rng, texts, kinds = random.Random(8), [], ("tail cut", "block replaced", "block inserted", "scattered words")
    for kind in kinds:
        found = [(b, new) for b in base if (new := edited(b.split(), kind, rng))][:150]
        assert len(found) == 150
        texts += [t for pair in found for t in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(8)
    prints = df.mapInArrow(near_copies._prints, "row long, name long, one long, two long, three long").collect()
    of = {r["row"]: r for r in prints}
    for k, kind in enumerate(kinds):
        rows = [of[i] for i in range(300 * k, 300 * k + 300)]
        one, two, three = (np.array([r[c] for r in rows], np.int64) for c in ("one", "two", "three"))
        met = shared_key(one, two, three)
        near = near_copies.apart(three[::2], three[1::2]) <= near_copies.RADIUS
        print(kind, "keys", met.mean(), "radius", near.mean(), "both", (met & near).mean())
        assert (met & near).mean() >= 0.95


def shared_key(*prints):
    """Does a text (even places) share any key with the next one?"""
    keys = np.stack(list(near_copies.pair_keys(*prints)), axis=1)
    return np.array([len(set(a[a >= 0]) & set(b[b >= 0])) > 0 for a, b in zip(keys[::2], keys[1::2])])


def test_spanning_trees():
    rng = np.random.default_rng(1)
    three = rng.integers(-2**63, 2**63 - 1, 60, dtype=np.int64)
    three[30:] = three[:30] ^ 5
    edges = list(near_copies.spanning_tree(three, 8))
    assert sorted(edges) == [(i, i + 30, 2) for i in range(30)]
    assert list(near_copies.spanning_tree(three, 8, without={e[:2] for e in edges})) == []
    near = three[0] ^ (np.int64(1) << np.arange(8))
    both = near_copies.two_trees(near)
    assert len(both) == len(set(both)) == 13 and both[:7] == list(near_copies.spanning_tree(near))


def rows_of(groups, size):
    import pyarrow as pa
    rows = [(k, *r) for k, g in enumerate(groups) for r in g]
    return (pa.RecordBatch.from_pylist([dict(zip(("key", "name", "three"), r)) for r in rows[i:i + size]]) for i in range(0, len(rows), size))


def linked(groups, size):
    forest = Forest()
    n = 0
    for b in near_copies._links(rows_of(groups, size)):
        for r in b.to_pylist():
            forest.join(r["a"], r["b"])
            n += 1
    return forest, n


def test_hot_groups_stay_linear(monkeypatch):
    """A key with thousands of near copies among strangers: linked whole, by fewer than two pairs a text, whatever the batches."""
    monkeypatch.setattr(near_copies, "WHOLE", 64)
    rng = np.random.default_rng(3)
    flips = lambda n: np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, (n, 3)), axis=1)
    base = rng.integers(-2**62, 2**62, 4, dtype=np.int64)
    # strangers that are far from all bases and from each other
    outsiders: list[int] = []
    while len(outsiders) < 40:
        far = int(rng.integers(-2**62, 2**62))
        if min(int(near_copies.apart(np.array([far]), x)[0]) for x in [*base, *outsiders]) > near_copies.RADIUS + 3:
            outsiders.append(far)
    groups, name = [], 0
    for n, strangers in ((3, 0), (3000, 40), (2, 5), (64, 0), (65, 3), (500, 0)):
        g = [(name + i, int(x)) for i, x in enumerate(base[name % 4] ^ flips(n))]
        g += [(name + n + i, far) for i, far in enumerate(outsiders[:strangers])]
        groups.append(g)
        name += n + strangers
    for size in (7, 100, 5000):
        forest, pairs = linked(groups, size)
        at = 0
        for n, strangers in ((3, 0), (3000, 40), (2, 5), (64, 0), (65, 3), (500, 0)):
            roots = [forest.root(at + i) for i in range(n + strangers)]
            assert len(set(roots[:n])) == 1 and len(set(roots[n:])) == strangers and not set(roots[n:]) & set(roots[:n])
            at += n + strangers
        assert pairs <= 2 * name


def test_very_long_and_empty_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "w" * 500_000), (4, None), (5, ""), (6, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.first_of_each(df).select("doc_id").collect()) == [1, 3, 4]


def test_stages_and_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    seen, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        seen.append(now)
        if len(seen) < 5:
            assert now.columns == docs.columns
    kept = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4]
    report = quality.quality_report(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept[0] == {r["doc_id"] for r in report.filter("kept").collect()}
    leaks = decontaminate.find_leaks(seen[1], spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert kept[1] - kept[2] == {r["doc_id"] for r in leaks.collect()}
    tool = secrets.Scanner(b"")
    assert not any(tool.base(r["text"]) for r in seen[3].collect())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == kept[4]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, "x y"), (2, "")]])
def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("n_chars", F.lit("z"))
    folder = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
