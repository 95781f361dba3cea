"""Byte-level byte-pair encoding by a file of ranks, and decoding by retained offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm import pretoken

_SHORT = 48
#: Texts are encoded together up to about so many bytes.
_CHUNK = 1 << 18


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the adjacent pair of least rank is merged until none has a rank, leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > _SHORT:
        return _merged_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs, for long pieces."""
    n = len(piece)
    part = [piece[i:i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := piece[i:i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if part[i] is None or j >= n or part[i] + part[j] != pair:
            continue
        part[i], part[j], right[i] = pair, None, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (p := pair + part[right[i]]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if left[i] >= 0 and (p := part[left[i]] + pair) in ranks:
            heapq.heappush(heap, (ranks[p], left[i], p))
    return [ranks[p] for p in part if p is not None]


class Codec:
    """A vocabulary with a cache of pieces, and its bytes laid out for decoding."""

    def __init__(self, content: bytes):
        self.ranks = read_ranks(content)
        self.cache = pretoken.Cache(lambda piece: np.array(merged(piece, self.ranks), "<u4").tobytes())
        by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            by_id[i] = token
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and where in its UTF-8 bytes the token of each id ends."""
        pieces, first = pretoken.pieces(texts)
        found = list(map(self.cache.__getitem__, pieces))
        ids = np.frombuffer(b"".join(found), "<u4")
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        bounds = count[first]
        ends = np.cumsum(self.sizes[ids])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b], ends[a:b] - (ends[a - 1] if a else 0)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of the ids, each laid at its retained offset."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        source = np.arange(int(ends[-1])) + np.repeat(self.places[ids] - (ends - sizes), sizes)
        return self.flat[source].tobytes()


@lru_cache(maxsize=2)
def codec(content: bytes) -> Codec:
    return Codec(content)


def _content(df: DataFrame, path: str):
    """The vocabulary file (a few megabytes at most) as a broadcast, so executors need no copy of it."""
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > 64 << 20:
        raise ValueError(f"{path} is not a vocabulary file: {len(content)} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def _encoded(batches: Iterator[pa.RecordBatch], tool: Codec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in pretoken.chunks(batch, "text", _CHUNK):
            found = list(tool.encode(texts))
            yield pa.RecordBatch.from_arrays([
                batch.column("key").slice(start, len(texts)), pa.array([len(i) for i, _ in found], pa.int64()),
                pa.array([i.tobytes() for i, _ in found], pa.binary()),
                pa.array([e.astype("<u4").tobytes() for _, e in found], pa.binary())], ["key", "n_tokens", "ids", "ends"])


def _decoded(batches: Iterator[pa.RecordBatch], tool: Codec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, ends = (part.column(c).to_pylist() for c in ("ids", "ends"))
            out = [tool.decode(np.frombuffer(i, "<u4"), np.frombuffer(e, "<u4").astype(np.int64)) for i, e in zip(ids, ends)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_tokens"), part.column("ids"),
                                              pa.array(out, pa.binary())], ["key", "n_tokens", "ids", "decoded"])


def _key_and_text(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return given, given.schema["key"].dataType.simpleString()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_tokens, ids and ends (binary, little-endian unsigned 32-bit integers).

    ``ends`` are the offsets, in the text's UTF-8 bytes, at which each token ends. Null and empty
    texts have no tokens; repeated rows and null keys stay as they are; other columns are left out.
    Each row is handled alone, about a quarter of a megabyte of text at a time (or one longer text).
    """
    content = _content(docs, path)
    given, kind = _key_and_text(docs, key, text)
    encoded = given.mapInArrow(lambda batches: _encoded(batches, codec(content.value)), f"key {kind}, n_tokens long, ids binary, ends binary")
    return encoded.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Columns key, n_tokens, ids and decoded (binary: the UTF-8 bytes), from what ``encode`` returns."""
    content = _content(encoded, path)
    given = encoded.select(F.col(f"`{key}`").alias("key"), "n_tokens", "ids", "ends")
    kind = given.schema["key"].dataType.simpleString()
    return given.mapInArrow(lambda batches: _decoded(batches, codec(content.value)), f"key {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_tokens, ids and decoded: ``encode`` and then ``decode``, in one Python worker for each task."""
    content = _content(docs, path)
    given, kind = _key_and_text(docs, key, text)

    def run(batches):
        tool = codec(content.value)
        return _decoded(_encoded(batches, tool), tool)

    return given.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded binary").withColumnRenamed("key", key)


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: its number of ids, and digests of the ids and of what they decode to."""
    back = round_trip(docs, path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
