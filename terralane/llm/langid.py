"""Language of whole texts by unigram piece models: every segmentation counts.

The pieces are a fixed public vocabulary of byte strings that holds all single bytes. Each language has a probability
for every piece; a unit's probability is the sum over all ways to cut it into pieces, by a forward pass.
Units are the pre-tokens with a letter (a word with the blank before it), cut every 32 bytes; a text's log
probability is the sum over its units. The forward pass runs over all new units of a chunk at once, and units
met before are looked up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralane.llm import pretoken
from terralane.llm.bpe import _content, read_ranks
from terralane.llm.common import stored
from terralane.llm.wordhash import range_hashes

#: Units are cut after so many bytes.
UNIT = 32
#: Labelled documents that a language is learned from, at most; those with the least hashes.
FIT_DOCS = 4_000
#: Passes of expectation and maximisation.
ROUNDS = 2
#: Weight, in pieces, of the pooled distribution in that of a language.
POOLED = 2_000.0
#: Expected counts are whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1 << 20
#: Probabilities are multiplied by this for each byte, so that 32 bytes neither vanish nor overflow.
_PER_BYTE = 1e3
#: A task remembers so many units.
KNOWN = 400_000
_TOGETHER = 8192


class Vocabulary:
    """The pieces of a ranks file, found by hashes of byte ranges (two of 50,000 collide with chance 10^-10)."""

    def __init__(self, content: bytes):
        pieces = sorted(read_ranks(content), key=lambda p: (len(p), p))
        self.count = len(pieces)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(self.sizes)
        hashes = range_hashes(data, ends - self.sizes, ends)
        for size in np.unique(self.sizes[self.sizes <= UNIT]).tolist():
            own = np.flatnonzero(self.sizes == size)
            order = own[np.argsort(hashes[own])]
            self.by_size[size] = hashes[order], order

    def lattice(self, units: list[bytes]) -> Lattice:
        data = np.frombuffer(b"".join(units), np.uint8)
        size = np.array([len(u) for u in units], np.int64)
        last = np.cumsum(size)
        first = last - size
        unit = np.repeat(np.arange(len(units)), size)
        offset, room = np.arange(len(data)) - first[unit], last[unit] - np.arange(len(data))
        node = np.arange(len(data)) + unit      # one more node than bytes for each unit
        steps: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length, (hashes, piece) in self.by_size.items():
            at = np.flatnonzero(room >= length)
            if not len(at):
                break
            own = range_hashes(data, at, at + length)
            place = np.searchsorted(hashes, own)
            place[place == len(hashes)] = 0
            hit = np.flatnonzero(hashes[place] == own)
            at, found = at[hit], piece[place[hit]]
            end = offset[at] + length
            order = np.argsort(end, kind="stable")
            at, found, end = at[order], found[order], end[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(end)) + 1):
                if len(part):
                    steps.append((int(end[part[0]]), node[at[part]], node[at[part]] + length, found[part]))
        return Lattice(first + np.arange(len(units)), last + np.arange(len(units)), sorted(steps, key=lambda s: s[0]), unit)


@dataclass
class Lattice:
    """All pieces in some units: steps (end, nodes before, nodes after, pieces) in the order of their ends within the unit."""
    first: np.ndarray
    last: np.ndarray
    steps: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    unit: np.ndarray

    def forward(self, weight) -> np.ndarray:
        """For every node the summed probability of all ways to it; ``weight(pieces, units)`` has a column for each language."""
        out = None
        for _, before, after, piece in self.steps:
            w = weight(piece, before)
            if out is None:
                out = np.zeros((int(self.last[-1]) + 1, w.shape[1]))
                out[self.first] = 1.0
            out[after] += out[before] * w       # a unit has one piece of this length that ends here
        return out

    def backward(self, weight, columns: int) -> np.ndarray:
        out = np.zeros((int(self.last[-1]) + 1, columns))
        out[self.last] = 1.0
        for _, before, after, piece in reversed(self.steps):
            out[before] += out[after] * weight(piece, before)
        return out


@lru_cache(maxsize=1)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def scaled(chances: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Chances (pieces x languages) with the factor of each byte."""
    return chances * (_PER_BYTE ** np.minimum(vocab.sizes, UNIT).astype(np.float64))[:, None]


def unit_scores(units: list[bytes], weights: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The log of the summed probability of each unit (up to 32 bytes) in each language, plus a constant for each byte."""
    out = np.zeros((len(units), weights.shape[1]))
    for at in range(0, len(units), _TOGETHER):
        lattice = vocab.lattice(units[at:at + _TOGETHER])
        out[at:at + _TOGETHER] = np.log(lattice.forward(lambda piece, _: weights[piece])[lattice.last])
    return out


def expected_counts(units: list[bytes], lang: np.ndarray, times: np.ndarray, weights: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected uses of each piece in each language, from units of known languages that occur so many times."""
    out = np.zeros(weights.shape, np.int64)
    for at in range(0, len(units), _TOGETHER):
        part = slice(at, at + _TOGETHER)
        lattice = vocab.lattice(units[part])
        own = np.zeros(int(lattice.last[-1]) + 1, np.int64)
        own[lattice.first] = 1
        own = np.cumsum(own) - 1                 # the unit of each node
        of = lang[part][own]
        weight = lambda piece, before: weights[piece, of[before]][:, None]
        ahead = lattice.forward(weight)
        behind = lattice.backward(weight, 1)
        scale = (times[part] / ahead[lattice.last, 0])[own]
        for _, before, after, piece in lattice.steps:
            share = ahead[before, 0] * weights[piece, of[before]] * behind[after, 0] * scale[before]
            np.add.at(out, (piece, of[before]), np.rint(share * SCALE).astype(np.int64))
    return out


def _is_letter(piece: bytes) -> bool:
    kind = pretoken.class_table()
    return any(kind[ord(c)] == pretoken.LETTER for c in piece.decode())


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Start, texts, bytes, bounds of the pre-tokens, each text's first one, and hashes of the pre-tokens."""
    for start, texts in pretoken.chunks(batch, "text"):
        data, bounds, first = pretoken.cut(texts)
        hashes = range_hashes(np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:]) if len(data) else np.zeros(0, np.uint64)
        yield start, texts, data, bounds, first, hashes


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, unit and n for each chunk."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, texts, data, bounds, first, hashes in _chunks(batch):
            own = sorted(set(langs[start:start + len(texts)]))
            number = np.repeat([own.index(x) for x in langs[start:start + len(texts)]], np.diff(first)).astype(np.int64)
            order = np.lexsort((number, hashes))
            new = np.flatnonzero(np.concatenate([[len(order) > 0], (np.diff(hashes[order]) != 0) | (np.diff(number[order]) != 0)]))
            rows = []
            for i, n in zip(order[new].tolist(), np.diff(np.append(new, len(order))).tolist()):
                piece = data[bounds[i]:bounds[i + 1]]
                if _is_letter(piece):
                    rows += [(own[number[i]], piece[k:k + UNIT], n) for k in range(0, len(piece), UNIT)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "unit", "n"])


@dataclass(frozen=True)
class Model:
    """Languages in order, and the chance of each piece (row) in each language (column)."""
    langs: list[str]
    chances: np.ndarray


def fit(docs: DataFrame, tokenizer: str, lang: str = "lang", text: str = "text", fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """Learn from rows with a language and a text; ``fit_docs`` of each language at most, by the least hashes of their texts.

    Equal texts of a language count once. The first pass takes all pieces as equally likely, each further one the chances
    of the one before. What comes to the driver is one number for each piece and language.
    """
    content = _content(docs, tokenizer)
    given = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()
    hashed = given.withColumn("hash", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = hashed.select("lang", "hash").distinct().withColumn("place", place).filter(F.col("place") <= fit_docs).drop("place")
    sample = hashed.join(chosen, ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"]).select("lang", "text")
    units = stored(sample.mapInArrow(_unit_rows, "lang string, unit binary, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "units")
    langs = [r["lang"] for r in units.select("lang").distinct().orderBy("lang").collect()]
    number = {x: i for i, x in enumerate(langs)}
    vocab = vocabulary(content.value)
    chances = np.full((vocab.count, len(langs)), 1.0 / vocab.count)
    for _ in range(rounds if langs else 0):
        weights = docs.sparkSession.sparkContext.broadcast(scaled(chances, vocab))

        def run(batches, weights=weights):
            own = vocabulary(content.value)
            total = np.zeros(weights.value.shape, np.int64)
            for batch in batches:
                of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                total += expected_counts(batch.column("unit").to_pylist(), of, batch.column("n").to_numpy(), weights.value, own)
            piece, column = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(column), pa.array(total[piece, column])], ["piece", "lang", "n"])

        rows = units.mapInArrow(run, "piece long, lang long, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(chances.shape)
        for r in rows:      # pieces x languages at most
            counts[r["piece"], r["lang"]] = r["n"] / SCALE
        pooled = (counts.sum(axis=1) + 1) / (counts.sum() + vocab.count)
        chances = (counts + POOLED * pooled[:, None]) / (counts.sum(axis=0) + POOLED)
        weights.unpersist()
    return Model(langs, chances)


def predict(docs: DataFrame, model: Model, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, lang_pred and score (the language's share of the text's probability), a row for each row of ``docs``.

    Languages are equally likely beforehand, ties go to the first in order. Null and empty texts and those without letters
    are ``und`` with score 0, as is everything when no language was learned.
    """
    content = _content(docs, tokenizer)
    weights = docs.sparkSession.sparkContext.broadcast(model.chances)
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(content.value)
        scorer = _Scorer(scaled(weights.value, vocab), vocab)
        for batch in batches:
            for start, texts, data, bounds, first, hashes in _chunks(batch):
                total, lettered = scorer.texts(data, bounds, first, hashes)
                if langs:
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [langs[b] if ok and langs else "und" for b, ok in zip(best.tolist() if langs else [0] * len(texts), lettered)]
                score = [s if n != "und" or ok and langs else 0.0 for s, n, ok in zip(share.tolist() if langs else [0.0] * len(texts), names, lettered)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                                 ["key", "lang_pred", "score"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


class _Scorer:
    """Scores of pre-tokens; those met before are looked up by their hashes."""

    def __init__(self, weights: np.ndarray, vocab: Vocabulary):
        self.weights, self.vocab, self.langs = weights, vocab, weights.shape[1]
        self.clear()

    def clear(self):
        self.known: dict[int, int] = {}
        self.table = np.zeros((1024, self.langs + 1))       # the last column: 1 where there is a letter

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        at = len(self.known)
        while at + len(pieces) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        worded = [i for i, p in enumerate(pieces) if _is_letter(p)]
        parts = [(i, pieces[i][k:k + UNIT]) for i in worded for k in range(0, len(pieces[i]), UNIT)]
        if parts and self.langs:
            np.add.at(self.table, (at + np.array([i for i, _ in parts]), slice(0, self.langs)),
                      unit_scores([u for _, u in parts], self.weights, self.vocab))
        if worded:
            self.table[at + np.array(worded), self.langs] = 1
        self.known.update(zip(hashes, range(at, at + len(pieces))))

    def texts(self, data: bytes, bounds: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list[bool]]:
        """Summed scores of each text, and whether it has a letter."""
        if len(self.known) > KNOWN:
            self.clear()
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names = distinct.tolist()
        rows = list(map(self.known.get, names))
        new = [i for i, r in enumerate(rows) if r is None]
        if new:
            self._learn([names[i] for i in new], [data[bounds[k]:bounds[k + 1]] for k in at[new].tolist()])
            rows = list(map(self.known.__getitem__, names))
        out = np.zeros((len(first) - 1, self.langs + 1))
        full = np.flatnonzero(np.diff(first) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.table[np.array(rows, np.int64)[inverse]], first[full])
        return out[:, :self.langs], (out[:, self.langs] > 0).tolist()


def held_out(key: Column) -> Column:
    """Rows that are kept away from learning: a third, by the crc32 of the key as text (null: empty)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def language_report(docs: DataFrame, tokenizer: str, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, held_out, lang_pred and score; learned from the rows that are not held out.

    Nulls, empty texts and texts without letters: see ``predict``; rows without a language are not learned from. Repeated rows
    stay, other columns are left out.
    """
    model = fit(docs.filter(~held_out(F.col(f"`{key}`"))), tokenizer, lang, text)
    return predict(docs, model, tokenizer, key, text).select(F.col(f"`{key}`"), held_out(F.col(f"`{key}`")).alias("held_out"), "lang_pred", "score")
