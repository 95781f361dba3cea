"""Language models against sums over all segmentations, and held-out accuracy."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terralane.llm import langid, pretoken

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, "rb") as f:
        return langid.Vocabulary(f.read())


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        found = sorted(langid.read_ranks(f.read()), key=lambda p: (len(p), p))
    return {p: i for i, p in enumerate(found)}


def segmentations(unit, pieces):
    if not unit:
        yield []
    for n in range(1, len(unit) + 1):
        if unit[:n] in pieces:
            for rest in segmentations(unit[n:], pieces):
                yield [pieces[unit[:n]], *rest]


def test_forward_sums_all_segmentations(vocab, pieces):
    rng = np.random.default_rng(5)
    chances = rng.dirichlet(np.full(vocab.count, 0.1), 3).T + 1e-12
    units = [u.encode() for u in (" the", "über", " naïve", "x", " 漢字", " antiond", "zzzzzzzzz", " Straßen")]
    got = langid.unit_scores(units, langid.scaled(chances, vocab), vocab)
    for u, row in zip(units, got):
        want = [sum(math.prod(chances[i, k] for i in s) for s in segmentations(u, pieces)) for k in range(3)]
        assert np.allclose(row - len(u) * math.log(langid._PER_BYTE), np.log(want))


def test_expected_counts(vocab, pieces):
    chances = np.full((vocab.count, 2), 1.0 / vocab.count)
    chances[pieces[b" the"]] = 0.01
    units, lang, times = [b" then", b" then", b" ant"], np.array([0, 1, 1]), np.array([3, 5, 2])
    got = langid.expected_counts(units, lang, times, langid.scaled(chances, vocab), vocab) / langid.SCALE
    want = np.zeros_like(got)
    for u, k, n in zip(units, lang, times):
        ways = list(segmentations(u, pieces))
        mass = [math.prod(chances[i, k] for i in s) for s in ways]
        for s, m in zip(ways, mass):
            for i in s:
                want[i, k] += n * m / sum(mass)
    assert np.abs(got - want).max() < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.language_report(docs, PATH).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if got[r["doc_id"]]["held_out"] and r["lang"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out) >= 0.99 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    turned = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (sorted(map(tuple, langid.language_report(d, PATH).collect())) for d in (docs, turned))
    assert a == b


def test_odd_texts(spark):
    english, french = "the cat and the dog with that thing " * 30, "le chat et la souris avec des choses " * 30
    rows = [(0, english, "en"), (2, french, "fr"), (3, None, "en"), (6, "", "fr"), (7, "123 ... \n", None), (8, "w" * 100_000, None), (9, "漢" * 5000, None),
            (10, " the dog " * 100_000, None), (None, "la souris", None), (11, "le chat et la souris", "en"), (11, "le chat et la souris", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumn("lang_pred", F.lit(1)).withColumn("KEY", F.lit(2))
    learned = docs.filter("doc_id in (0, 2)")
    model = langid.fit(learned, PATH)
    assert model.langs == ["en", "fr"] and np.allclose(model.chances.sum(axis=0), 1)
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, model, PATH).collect()), key=str)
    by = {k: (p, s) for k, p, s in got}
    assert len(got) == 11
    assert by[3] == by[6] == by[7] == ("und", 0.0) and by[10][0] == "en" and by[None][0] == by[11][0] == "fr" and by[9][0] in ("en", "fr")
    none = langid.language_report(docs.withColumn("lang", F.lit(None).cast("string")), PATH).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.language_report(docs.limit(0), PATH).count() == 0


def test_units_are_cut(vocab):
    scorer = langid._Scorer(langid.scaled(np.full((vocab.count, 2), 1 / vocab.count), vocab), vocab)
    data, bounds, first = pretoken.cut(["ab" * 40, "", "12"])
    hashes = langid.range_hashes(np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:])
    total, lettered = scorer.texts(data, bounds, first, hashes)
    parts = langid.unit_scores([b"ab" * 16, b"ab" * 8], scorer.weights, vocab)
    assert lettered == [True, False, False] and np.allclose(total[0], parts[[0, 0, 1]].sum(axis=0)) and not total[1:].any()
