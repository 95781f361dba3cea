"""SimHash near-duplicates: Golay-code keys bring close fingerprints together, spanning trees link them.

Copies collapse to one fingerprint before anything is compared, a key's group only ever emits a
spanning tree, and components are found by stars, so a group of copies that holds a third of all
rows costs no more than its distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm import golay, pretoken
from terralane.llm.common import stored
from terralane.llm.components import components

#: Bits of the three segments of a fingerprint, from the lowest.
SEGMENTS = (22, 21, 21)
RADIUS = 3
#: Above so many members a group is split by equal quarters of the fingerprint before it is compared.
WHOLE_GROUP = 4096
_PART = 1 << 14


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where more than half of the 64-bit hashes have it; 0 without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        part = np.ascontiguousarray(hashes[at:at + _PART], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by blanks; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n)


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; only ASCII white space parts them."""
    return text.encode().lower().split()


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key and fp: the 64-bit fingerprint of all shingles, repeats included."""
    def run(batches):
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                found = [fingerprint(shingle_hashes(words_of(t), width)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), pa.array(found, pa.int64())], ["key", "fp"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, fp long")


def segments(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append((prints.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1))
        at += bits
    return out


def exact_keys(prints: np.ndarray) -> Iterator[np.ndarray]:
    """Key columns (-1: none) such that fingerprints within 3 bits share a key.

    Three errors over three segments either leave one segment whole, and then another has one error at
    most: a key is one segment with a codeword near another. Or each segment has one error: a key
    is codewords near the first two with the half of the third that is whole.
    """
    part = segments(prints)
    close = [golay.near(p) for p in part]
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                for c in close[j].T:
                    yield np.where(c >= 0, tag << 40 | part[i] << 12 | c, -1)
                tag += 1
    low = SEGMENTS[2] // 2
    for half in (part[2] & ((1 << low) - 1), part[2] >> low):
        for a in close[0].T:
            for b in close[1].T:
                yield np.where((a >= 0) & (b >= 0), tag << 40 | half << 24 | a << 12 | b, -1)
        tag += 1


def _spread(columns: Iterator[np.ndarray], carried: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, carried...) of every key column, a few columns at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for keys in columns:
        rows = np.flatnonzero(keys >= 0)
        if len(rows):
            held.append((keys[rows], rows))
        if sum(len(r) for _, r in held) >= 1 << 18:
            yield _rows(held, carried, names)
            held = []
    if held:
        yield _rows(held, carried, names)


def _rows(held, carried, names):
    rows = np.concatenate([r for _, r in held])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in held])), *[pa.array(c[rows]) for c in carried]], ["key", *names])


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """From rows sorted by key, the carried columns of each group of two rows or more."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ["key", *names]]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        bounds = np.flatnonzero(np.diff(cols[0])) + 1
        last = bounds[-1] if len(bounds) else 0
        held = [c[last:] for c in cols]
        edges = np.concatenate([[0], bounds])
        for k in np.flatnonzero(np.diff(edges) > 1).tolist():
            yield tuple(c[edges[k]:edges[k + 1]] for c in cols[1:])
    if held is not None and len(held[0]) > 1:
        yield tuple(held[1:])


class Forest:
    """Joined pairs so far, so that a task emits no link twice around."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tree_links(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints, joined within ``radius`` bits."""
    left = np.unique(prints)
    if len(left) > WHOLE_GROUP:      # within 3 errors one of four quarters is equal
        for shift in (0, 16, 32, 48):
            quarter = (left.view(np.uint64) >> np.uint64(shift)).astype(np.uint16)
            order = np.argsort(quarter, kind="stable")
            for part in np.split(left[order], np.flatnonzero(np.diff(quarter[order])) + 1):
                if len(part) > 1:
                    yield from _searched(part, radius)
    else:
        yield from _searched(left, radius)


def _searched(left: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    todo: list[int] = []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        x = todo.pop()
        hit = np.bitwise_count(left.view(np.uint64) ^ np.uint64(x & (1 << 64) - 1)) <= radius
        if hit.any():
            for y in left[hit].tolist():
                yield x, y
                todo.append(y)
            left = left[~hit]


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (fp: long) within 3 bits of each other, directly or through others."""
    def keys(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096).to_numpy()
                yield from _spread(exact_keys(fp), [fp], ["fp"])

    def link(batches):
        forest = Forest()
        for (fp,) in groups(batches, ["fp"]):
            found = [(a, b) for a, b in tree_links(fp) if forest.join(a, b)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    keyed = prints.select("fp").distinct().mapInArrow(keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Columns key, fingerprint (16 hexadecimal digits) and component_id.

    Words are parted by ASCII white space, A-Z in lower case; a text of fewer than ``width`` words is one
    shingle, and null or empty texts have fingerprint zero, linked like any other. Fingerprints of 3 or
    fewer differing bits are linked; component_id is the least key that can be reached (null when all of
    them are null). Repeated rows stay; other columns are left out.
    """
    prints = stored(fingerprints(docs, width, key, text), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("key").alias("first_key"))
    roots = components(fingerprint_links(prints))
    named = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_key", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_key").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
