"""Leaks against every window of every document."""

import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from terralane.llm import decontaminate as D
from terralane.llm.wordhash import hashed_words


def words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def plain(docs, items):
    """Best similarity of any window for each document and item."""
    out = {}
    items = [(i, words(t)) for i, t in items if words(t)]
    for d, t in docs:
        w = words(t)
        own = set(bag(w)) if len(w) >= 5 else None
        for i, iw in items:
            b = bag(iw)
            if len(iw) > len(w) or own is not None and len(iw) >= 5 and not own & set(b):
                continue
            s = max(D.similarity(bag(w[k:k + len(iw)]), b) for k in range(len(w) - len(iw) + 1))
            if s >= D.SIMILARITY:
                out[d, i] = max(out.get((d, i), 0), s)
    return out


def test_against_all_windows(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)] + ["Été", "漢字"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(8, 60)))) for i in range(40)] + [(100, "two words"), (101, ""), (102, None), (103, "a b c d e")]
    docs = [(0, None), (1, ""), (2, "x"), (3, "has TWO  words in it"), (4, "a b\nc d e"), (5, "a b c d f")]
    for i in range(10, 150):
        w = some(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                piece[rng.randrange(len(piece))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " \n".join(w)))
    docs += [(None, items[0][1]), (200, items[0][1]), (200, items[0][1])]
    want = plain([d for d in docs if d[0] is not None], items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("similarity", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_leaks(df, it).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows if r["doc_id"] is not None}
    assert got.keys() <= want.keys()
    missed = {k: v for k, v in want.items() if k not in got}
    assert len(missed) <= 0.02 * len(want) and all(v < 0.9 for v in missed.values()), missed
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert sum(r["doc_id"] == 200 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    kept = D.without_leaks(df, it)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs if d is not None} - {d for d, _ in got}


def test_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four five six"), (8, "alpha beta gamma delta epsilon zeta"), (9, "one two three four five six")], "item_id long, text string")
    monkeypatch.setattr(D.item_blocks, "__defaults__", ("item_id", "text", 1))
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()) == [(1, 8), (2, 7)]
    assert D.without_leaks(docs, items).count() == 0


def test_null_and_text_item_ids(spark):
    docs = spark.createDataFrame([("d", "alpha beta gamma delta epsilon zeta one two three four five six"), (None, "one two three four five six")], "item_id string, text string")
    texts = ["one two three four five six", "alpha beta gamma delta epsilon zeta", None]
    for ids, kind in (((None, "b", "c"), "string"), ((None, 5, 6), "int"), ((None, None, None), "long")):
        items = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
        out = D.find_leaks(docs, items, key="item_id")
        assert out.columns == ["item_id", "item_id_", "first_word", "n_words", "similarity"] and dict(out.dtypes)["item_id_"] == items.schema["item_id"].dataType.simpleString()
        assert sorted([(r["item_id"], r["item_id_"], r["first_word"]) for r in out.collect()], key=str) == sorted([("d", None, 6), ("d", ids[1], 0), (None, None, 0)], key=str)


def test_given_documents(spark):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    rows = D.find_leaks(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    want = set(plain(docs, items))
    assert want and got <= want and len(want - got) <= 0.02 * len(want)
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame(docs[:5], "doc_id long, text string")
    assert D.find_leaks(df, none).count() == 0 and D.without_leaks(df, none).count() == 5 and D.find_leaks(df.limit(0), none).count() == 0


def test_blocks_reach_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (200, 16), dtype=np.uint8)
    index = D.Index(((1, "a"),))
    index.sized[9] = index._blocks(np.arange(200), prints)
    for i in range(200):
        bits = np.unpackbits(prints[i])
        bits[rng.choice(128, D.RADIUS, replace=False)] ^= 1
        assert i in index._near(9, np.packbits(bits))


def test_word_hashes_by_content():
    a, f = hashed_words(["The cat", "", "cat the\tTHE ", "\x85x"])
    assert f.tolist() == [0, 2, 2, 5, 6] and a[0] == a[3] == a[4] and a[1] == a[2] and len(set(a.tolist())) == 3
