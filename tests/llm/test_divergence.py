"""Source divergence against plain integers, with digests that many words share."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralane.llm import divergence


def plain(rows, least=3, top=200):
    docs = [(a or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for a, s, t in rows]
    met = collections.Counter((a, w) for a, _, ws in docs for w in set(ws))
    out = []
    for lang in {a for a, _, _ in docs}:
        kept = [w for (a, w), n in met.items() if a == lang and n >= least]
        count = collections.defaultdict(collections.Counter)
        for a, s, ws in docs:
            if a == lang:
                count[s].update(w for w in ws if w in set(kept))
        whole = sum(count.values(), collections.Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, y: (x - y) ** 2 // y
        for s, own in count.items():
            pairs = [(sum(f(p(own, w), p(count[o], w)) for w in kept), o) for o in count if o != s]
            terms = [(f(p(own, w), p(whole, w)), w) for w in kept if own[w] and p(own, w) > p(whole, w)]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, v, i + 1) for i, (v, w) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Über", "漢字", "É", "A-b"]
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([*["hot"] * 5, "a", "b", "é", None]),
             " ".join(rng.choice(words[:rng.randint(1, 84)]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    rows += [("xx", "only", "one"), ("xx", "two", None), ("yy", "s", ""), (None, None, None), ("en", "long", "word " * 200_000), ("en", "wide", "w" * 300_000)]
    return rows + rows[:30]


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_against_plain_integers(spark, bits):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6).withColumn("PART", F.lit(1)).withColumn("digest", F.lit(2))
    got = divergence.source_divergence(df, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_top_and_ties(spark):
    rows = [("en", s, " ".join(f"t{chr(97 + i)}" for i in range(26)) + f" own{s}" * 3) for s in ("a", "b") for _ in range(3)]
    got = sorted(map(tuple, divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string"), top=5).collect()))
    assert got == plain(rows, top=5)


def test_small_buffers_change_nothing(spark, monkeypatch):
    """The functions themselves with little room: counts handed on early, pairs summed in parts, top terms sifted often."""
    rng = random.Random(4)
    numbers = sorted(rng.randrange(-2**62, 2**62) for _ in range(12))
    groups = divergence.Groups(np.array(numbers), np.array([rng.randrange(50, 10**6) for _ in numbers]), {"a": 5000})
    terms = [[(g, rng.randrange(1, 40)) for g in rng.sample(numbers, rng.randint(1, 12))] for _ in range(60)]
    rows = [{"lang": "a", "digest": i, "term": None, "counts": np.array(t, divergence._PAIR).tobytes()} for i, t in enumerate(terms)]
    kind = pa.schema([("lang", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("counts", pa.binary())])
    batches = lambda n: (pa.RecordBatch.from_pylist(rows[i:i + n], kind) for i in range(0, len(rows), n))

    def sums(found):
        out = collections.Counter()
        for b in found:
            for x in b.to_pylist():
                out[tuple(x.values())[:2]] += list(x.values())[2]
        return out

    below = dict(zip(numbers, groups.below.tolist()))
    p = lambda g, n: 1 + 10**9 * (n + 1) // below[g]
    f = lambda x, y: (x - y) ** 2 // y
    want, heights = collections.Counter(), collections.Counter((g, p(g, n)) for t in terms for g, n in t)
    for t in terms:
        for (g, n) in t:
            for (h, m) in t:
                if g != h:
                    want[g, h] += f(p(g, n), p(h, m)) - f(p(g, n), p(h, 0)) - f(p(g, 0), p(h, m)) + f(p(g, 0), p(h, 0))
    high = {g: sorted((f(p(g, n), q) for t in terms for k, n in t if k == g for q in [1 + 10**9 * (sum(m for _, m in t) + 1) // 5000] if p(g, n) > q), reverse=True) for g in numbers}
    for pairs in (divergence.PAIRS, 10):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        for size in (1000, 7):
            assert sums(divergence._overlaps(batches(size), groups)) == want
            assert sums(divergence._histograms(batches(size), groups)) == heights
            got = collections.defaultdict(list)
            for b in divergence._heights(batches(size), groups, 3):
                for x in b.to_pylist():
                    got[x["number"]].append(x["value"])
            assert all(sorted(got[g], reverse=True)[:3] == high[g][:3] for g in numbers)
    monkeypatch.setattr(divergence, "HELD", 20)
    held, got = divergence._Counts(64, 5), collections.Counter()
    rows = [(a or "", s or "", t or "") for a, s, t in corpus(2, 60) if len(t or "") < 1000]

    def take(found):
        for b in found:
            for x in b.to_pylist():
                got.update({(g, x["term"]): n for g, n in np.frombuffer(x["counts"], divergence._PAIR).tolist()})
    for i in range(0, len(rows), 5):
        held.add([r[:2] for r in rows[i:i + 5]], [r[2] for r in rows[i:i + 5]])
        if held.full():
            take(held.close())
    take(held.close())
    find = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    assert got == collections.Counter((divergence.group_number(a, s, 5), w) for a, s, t in rows for w in find(t))


def test_shares_beyond_64_bits():
    n, below = np.array([10**12, 3]), np.array([10**14 + 7, 10**14 + 7])
    assert divergence.share(n, below).tolist() == [1 + 10**9 * (int(x) + 1) // (10**14 + 7) for x in n]


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(none).count() == 0
    alone = spark.createDataFrame([(None, None, None)], "lang string, source string, text string")
    assert divergence.source_divergence(alone).count() == 0
