"""Repeated strings against a count of every 200-byte string."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralane.llm import repeats

N = repeats.LENGTH


def plain(rows):
    bodies = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i:i + N] for _, b in bodies for i in range(len(b) - N + 1))
    out = []
    for k, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - N + 1):
            if seen[b[i:i + N]] > 1:
                gone[i:i + N] = b"\1" * N
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed=1):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé漢 ") for _ in range(n))
    shared = [some(rng.choice([150, 185, 200, 260, 500, 1500])) for _ in range(12)]
    rows = [(None, shared[0]), (None, None), (0, ""), (1, "a" * 150), (2, "a" * 199), (3, "a" * 200 + "bc"), (4, "xy" * 400), (5, "z" * 201), (6, shared[5] + "!"), (7, "?" + shared[5])]
    for i in range(10, 220):
        parts = [some(rng.randint(0, 700))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.4:
                cut = rng.randint(0, len(s))
                s = s[:cut] + "#" + s[cut + 1:]
            parts += [s[rng.randint(0, 60):], some(rng.randint(0, 400))]
        rows.append((i, "".join(parts)))
    return rows + rows[50:60] + [(300, rows[40][1]), (301, rows[40][1][1:])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.lit("x")).withColumn("key", F.lit(1))


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_against_all_strings(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = made()
    got = sorted((tuple(r) for r in repeats.repeat_report(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_given_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(i, "license words " * 3 + f" {i} " + "the same passage of words that many documents hold in their middle " * 4 + f" {i * i}") for i in range(1000, 1400)]
    got = sorted((tuple(r) for r in repeats.repeat_report(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_long_texts_in_segments(monkeypatch):
    """Every string of a text is under one sampled suffix, once, however the text is cut."""
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (9000, 199, 200, 1000, 1199, 1200, 0)] + [None]
    seen = Counter()
    for rows, offsets, data, ends in repeats._segments(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
        first, last, *_ = repeats.sampled(np.frombuffer(data, np.uint8), ends)
        part = np.searchsorted(ends, first, "right")
        for p, a, b in zip(part, first, last):
            base = int(ends[p - 1]) if p else 0
            for i in range(a, b + 1):
                seen[rows[p], offsets[p] + i - base] += 1
    assert seen == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t or "") - N + 1))


def test_digits_of_texts_longer_than_a_place(monkeypatch):
    """Equal strings have equal digits wherever they stand in a text that has more bytes than a place can number."""
    monkeypatch.setattr(repeats, "SEGMENT", 4000)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "_PLACE", (1 << 13) - 1)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = some(3000)
    text = some(500) + shared + some(30_000) + shared + some(700)
    digits = {}
    for rows, offsets, data, ends in repeats._segments(pa.RecordBatch.from_arrays([pa.array([text])], ["text"])):
        first, last, digit, _ = repeats.sampled(np.frombuffer(data, np.uint8), ends)
        part = np.searchsorted(ends, first, "right")
        for p, a, b, d in zip(part, first, last, digit):
            for i in range(a, b + 1):
                digits[offsets[p] + i - (int(ends[p - 1]) if p else 0)] = int(d)
    assert len(digits) == len(text) - N + 1
    assert all(digits[500 + i] == digits[33_500 + i] for i in range(3000 - N + 1))


def test_empty(spark):
    assert repeats.repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
