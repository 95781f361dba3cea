"""Benchmark decontamination: fingerprints of item-sized windows, then exact shingle similarity.

A window can only resemble an item if the two share a shingle, so fingerprints are taken of all
windows, of every item's size, that hold a shingle of any item; that loses nothing. Blocks of the
fingerprints then guarantee every item within the radius, and exact similarity decides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from terralane.llm import pretoken
from terralane.llm.wordhash import hashed_words, mix, shingles

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints have 128 bits in 16 blocks of 8. Of two within 31 bits, some block differs in one bit at
#: most. Windows of similarity 0.8 differ in 19 bits on average, with a deviation of 4.
BITS, BLOCKS, RADIUS = 128, 16, 31
#: Items are handled so many words at a time, one pass over the documents for each; their index then fits in a task.
ITEM_WORDS = 4_000_000
_FLIPS = np.array([0, *(1 << b for b in range(8))])


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """128 bits for each shingle."""
    wide = np.stack([mix(hashes, 1), mix(hashes, 2)], axis=1).astype("<u8")
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The 128-bit fingerprint (16 bytes) of each run of ``size`` shingles."""
    sums = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(bit_rows(hashes), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little")


def similarity(a: Counter, b: Counter) -> float:
    """Shared weight by joint weight; a shingle weighs as often as it occurs."""
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class _Sized:
    """Items with the same number of words."""
    rows: np.ndarray
    prints: np.ndarray
    buckets: dict[tuple[int, int], np.ndarray]


class Index:
    """Items by size, their fingerprints by blocks, and all their shingles."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        self.ids = [i for i, _ in items]
        self.bags: list[Counter] = []
        by_size: dict[int, list[int]] = {}
        prints: dict[int, np.ndarray] = {}
        known: dict[int, list[np.ndarray]] = {}
        #: the sizes of the items that hold a shingle, by its width
        self.sizes: dict[tuple[int, int], set[int]] = {}
        words, first = hashed_words([t for _, t in items])
        for row, (a, b) in enumerate(zip(first, first[1:])):
            size = int(b - a)
            s = shingles(words[a:b], min(WIDTH, size)) if size else np.zeros(0, np.uint64)
            self.bags.append(Counter(s.tolist()))
            if size:
                by_size.setdefault(size, []).append(row)
                prints[row] = window_prints(s, len(s))[0]
                known.setdefault(min(WIDTH, size), []).append(s)
                for h in s.tolist():
                    self.sizes.setdefault((min(WIDTH, size), h), set()).add(size)
        self.known = {w: np.unique(np.concatenate(s)) for w, s in known.items()}
        self.sized = {n: self._blocks(np.array(rows), np.stack([prints[r] for r in rows])) for n, rows in by_size.items()}

    @staticmethod
    def _blocks(rows: np.ndarray, prints: np.ndarray) -> _Sized:
        """For each block and value, the items whose block differs from it in one bit at most."""
        found: dict[tuple[int, int], list[int]] = {}
        for i, p in enumerate(prints):
            for block, value in enumerate(p.tolist()):
                for flip in _FLIPS.tolist():
                    found.setdefault((block, value ^ flip), []).append(i)
        return _Sized(rows, prints, {k: np.array(v) for k, v in found.items()})

    def _near(self, size: int, fingerprint: np.ndarray) -> list[int]:
        """Rows of the items of this size within the radius."""
        of = self.sized[size]
        hits = [of.buckets[b, v] for b, v in enumerate(fingerprint.tolist()) if (b, v) in of.buckets]
        if not hits:
            return []
        some = np.unique(np.concatenate(hits))
        apart = np.bitwise_count(of.prints[some] ^ fingerprint).sum(axis=1)
        return of.rows[some[apart <= RADIUS]].tolist()

    def find(self, words: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of the best window for each item that reaches ``SIMILARITY``.

        ``hits``: for each shingle width, the shingles of the text and where an item's shingle stands among them.
        """
        best: dict[int, tuple[float, int, int]] = {}
        # a window only resembles items of its own size, and must share a shingle with one of them
        by_size: dict[int, list[int]] = {}
        for width, (own, at) in hits.items():
            for place, h in zip(at.tolist(), own[at].tolist()):
                for size in self.sizes[width, h]:
                    by_size.setdefault(size, []).append(place)
        for size, at in by_size.items():
            width = min(WIDTH, size)
            own, places = hits[width][0], np.array(at)
            m = size - width + 1
            if len(own) < m:
                continue
            # runs of shingles that windows with a hit cover
            starts, stops = np.maximum(places - m + 1, 0), np.minimum(places + m, len(own))
            new = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
            for a, b in zip(starts[new].tolist(), stops[np.append(new[1:], len(stops)) - 1].tolist()):
                for at in range(a, max(b - m + 1, a), 1 << 14):
                    part = own[at:min(b, at + (1 << 14) + m - 1)]
                    if len(part) < m:
                        continue
                    prints = window_prints(part, m)
                    seen, back = np.unique(prints, axis=0, return_inverse=True)
                    near = [self._near(size, p) for p in seen]
                    for i in np.flatnonzero(np.array([bool(n) for n in near])[back.ravel()]).tolist():
                        bag = Counter(part[i:i + m].tolist())
                        for row in near[back.ravel()[i]]:
                            s = similarity(bag, self.bags[row])
                            if s >= SIMILARITY and (s, -(at + i)) > best.get(row, (0, 0, 0))[:2]:
                                best[row] = (s, -(at + i), size)
        found = [(self.ids[r], -p, n, s) for r, (s, p, n) in best.items()]
        return sorted(found, key=lambda f: (True, f[1:]) if f[0] is None else (False, f[0], f[1:]))

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        words, first = hashed_words(texts)
        marks = {}
        for width, known in self.known.items():
            s = shingles(words, width)
            table = np.zeros(1 << 20, bool)
            table[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(table[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
            marks[width] = s, maybe[np.isin(s[maybe], known)]
        out = []
        for a, b in zip(first.tolist(), first[1:].tolist()):
            hits = {}
            for width, (s, at) in marks.items():
                last = max(b - width + 1, a)
                lo, hi = np.searchsorted(at, [a, last])
                hits[width] = s[a:last], at[lo:hi] - a
            out.append(self.find(words[a:b], hits) if any(len(p) for _, p in hits.values()) else [])
        return out


@lru_cache(maxsize=1)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(items)


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", words: int = ITEM_WORDS):
    """The items in blocks of about ``words`` words (8 bytes of text each at most, or one longer item), streamed to the driver in order."""
    block, size = [], 0
    # copies of an item are one item; the least key stands for them
    given = items.groupBy(F.col(f"`{text}`").alias("text")).agg(F.min(F.col(f"`{key}`")).alias("key")).filter("text is not null").orderBy("key", "text")
    for r in given.toLocalIterator():
        block.append((r["key"], r["text"]))
        size += len(r["text"]) // 8 + 1
        if size >= words:
            yield tuple(block)
            block, size = [], 0
    if block:
        yield tuple(block)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, item_id, first_word, n_words and similarity: the best window for each item that a document holds.

    Similarity is that of five-word shingles, weighted by how often they occur, in windows of as many
    words as the item (an item of fewer than five words is one shingle); 0.8 or more counts. Null and
    empty texts and items match nothing, copies of an item count once, under their least id; repeated
    rows are reported each; other columns are left out. Item ids keep their type; an item whose ids are all null
    is reported with a null id, after the others of its document. Items travel in bounded blocks, documents stay in place.
    """
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    of_items = items.schema["item_id"].dataType.simpleString()
    names = {"item_id": of_items, "first_word": "int", "n_words": "int", "similarity": "double"}
    schema = ", ".join([f"key {kind}", *(f"{n} {t}" for n, t in names.items())])
    out = None
    for block in item_blocks(items):
        part = given.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(block), to_arrow_type(items.schema["item_id"].dataType)), schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    # a key that is called like one of the columns keeps its name, and theirs is lengthened
    return out.select(F.col("key").alias(key), *[F.col(n).alias(n + "_" if n.lower() == key.lower() else n) for n in names])


def _finder(block, item_type: pa.DataType):
    def ids(found):
        # without any id the column is still of the items' type
        return pa.array([f[0] for _, f in found]).cast(item_type)

    def run(batches):
        index = _index(block.value)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                found = [(i, f) for i, fs in enumerate(index.search(texts)) for f in fs]
                if found:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("key").slice(start, len(texts)).take(pa.array([i for i, _ in found])),
                        ids(found), pa.array([f[1] for _, f in found], pa.int32()),
                        pa.array([f[2] for _, f in found], pa.int32()), pa.array([f[3] for _, f in found], pa.float64())],
                        ["key", "item_id", "first_word", "n_words", "similarity"])
    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns; rows are judged where they are."""
    for block in item_blocks(items):
        docs = docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(block), text), docs.schema)
    return docs


def _filter(block, text):
    def run(batches):
        index = _index(block.value)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, text):
                yield batch.slice(start, len(texts)).filter(pa.array([not f for f in index.search(texts)]))
    return run
