"""SimHash components against all pairs, and the Golay code's promises."""

import random

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from terralane.llm import golay, simhash_dedup
from terralane.llm.components import components


def plain_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows):
    prints = {t: plain_print(t) for _, t in rows}
    nodes = sorted(set(prints.values()))
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(nodes, np.uint64)
    for i, n in enumerate(nodes):
        for m in arr[i + 1:][np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3].tolist():
            up[root(m)] = root(n)
    least = {}
    for k, t in rows:
        r = root(prints[t])
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return [(k, f"{prints[t]:016x}", least.get(root(prints[t]))) for k, t in rows]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("fp", F.lit(1)).withColumn("key", F.lit(1))
    got = [tuple(r) for r in simhash_dedup.simhash_components(df).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rows += [(None, "A b c"), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5003, "ONE"), (5004, "w " * 100_000)]
    check(spark, rows + rows[:50])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup.simhash_components(df).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_reach_all_within_three_bits():
    rng = np.random.default_rng(1)
    for flips in (0, 1, 2, 3):
        a = rng.integers(-2**63, 2**63 - 1, 3000, dtype=np.int64)
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.int64(np.uint64(1) << np.uint64(bit))
        ka, kb = (np.stack(list(simhash_dedup.exact_keys(x))) for x in (a, b))
        for i in range(len(a)):
            assert (set(ka[:, i]) & set(kb[:, i])) - {-1}


def test_golay():
    assert (golay.near(np.arange(0, 1 << 23, 997))[:, 0] >= 0).all()
    words = np.random.default_rng(2).integers(0, 1 << 23, 2000)
    for bit in range(23):
        for x, y in zip(golay.near(words), golay.near(words ^ (1 << bit))):
            assert (set(x) & set(y)) - {-1}


def test_links_of_large_groups(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "WHOLE_GROUP", 10)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    arr = np.array(sorted(prints), np.uint64).view(np.int64)
    def parts(links):
        forest = simhash_dedup.Forest()
        for a, b in links:
            forest.join(int(a), int(b))
        return {int(x): forest.root(int(x)) for x in arr}
    split = parts(simhash_dedup.tree_links(arr))
    u = arr.view(np.uint64)
    pairs = [(arr[i], arr[j]) for i in range(len(u)) for j in range(i) if np.bitwise_count(u[i] ^ u[j]) <= 3]
    assert split == parts(pairs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(3000)] + [(rng.randrange(5000, 6000), rng.randrange(5000, 6000)) for _ in range(600)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    forest = simhash_dedup.Forest()
    for a, b in links:
        forest.join(a, b)
    assert got == {x: forest.root(x) for x in {y for p in links for y in p if p[0] != p[1]}}
