"""Token-id files: concatenated ids with Elias-Fano document bounds, written and read by Spark.

The files are a Parquet table of blocks, so the writer's commit protocol covers lost executors
and repeated tasks and any store that Spark reaches will do. A block holds whole documents:

| column | content |
|-|-|
| shard, block | place of the block; shards are in ascending order of keys |
| first_id | ids of the shard before the block |
| n_docs, n_ids, n_null | documents, ids, and leading documents without a key |
| id_bytes, ids | width of an id (2 or 4) and all ids, little-endian, one document after the other |
| bounds | Elias-Fano: where each document ends in ``ids`` |
| least_key, keys | the least key, and Elias-Fano: the keys less it |
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralane.llm import pretoken
from terralane.llm.bpe import _content
from terralane.llm.elias_fano import SAMPLE, EliasFano
from terralane.llm.wordhash import range_hashes

#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 20
END_ID = 2
#: A task remembers the ids of so many pieces, about 120 bytes each.
KNOWN_PIECES = 800_000
#: Documents that a reader handles at once, from one select sample to another.
RUN = 16 * SAMPLE
#: Documents looked up by key in one call, at most.
LOOKUPS = 100_000
#: So many new pieces are encoded as one text.
JOINED = 512
_CODE = "struct<count:int,width:int,low:binary,high:binary,samples:binary>"
SCHEMA = f"shard int, block int, first_id long, n_docs int, n_ids long, n_null int, id_bytes int, ids binary, bounds {_CODE}, least_key long, keys {_CODE}"
_CODE_TYPE = pa.struct([("count", pa.int32()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()),
                    ("id_bytes", pa.int32()), ("ids", pa.binary()), ("bounds", _CODE_TYPE), ("least_key", pa.int64()), ("keys", _CODE_TYPE)])


class _Growing:
    """An array that is appended to; its capacity doubles."""

    def __init__(self, dtype):
        self.array, self.used = np.zeros(1024, dtype), 0

    def add(self, content: bytes) -> None:
        new = np.frombuffer(content, self.array.dtype)
        if self.used + len(new) > len(self.array):
            wider = np.zeros(2 * (self.used + len(new)), self.array.dtype)
            wider[:self.used] = self.array[:self.used]
            self.array = wider
        self.array[self.used:self.used + len(new)] = new
        self.used += len(new)


class LibraryEncoder:
    """A tokenizers file; pieces that were met before are not encoded again.

    Byte-level tokenizers merge within pieces only, so a text's ids are its pieces' ids in a row. Pieces are
    known by 64-bit hashes: among a task's million two share one by chance once in 37 million times.
    Texts with special strings, and tokenizers of other kinds, go through the library whole.
    """

    def __init__(self, content: bytes):
        import json

        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(content.decode())
        given = json.loads(content)
        before = given.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not given.get("normalizer")
        self.special = [t["content"] for t in given.get("added_tokens") or []]
        count = self.tool.get_vocab_size(with_added_tokens=True)
        self.id_bytes = 2 if count <= 1 << 16 else 4
        self.sizes = np.zeros(count, np.int64)      # bytes of each token: a letter of a byte-level token is a byte
        for token, i in self.tool.get_vocab(with_added_tokens=False).items() if self.by_piece else ():
            self.sizes[i] = len(token)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}             # number of a piece, by its hash
        self.flat, self.starts, self.filled = _Growing(f"<u{self.id_bytes}"), _Growing(np.int64), 0
        self.starts.add(np.zeros(1, np.int64).tobytes())

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.id_bytes}").tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces of a blank and visible characters: wherever they follow each other, the library cuts before each blank.

        So many are encoded as one text, and its ids are parted where the bytes of a piece end.
        """
        out = {}
        for at in range(0, len(pieces), JOINED):
            own = pieces[at:at + JOINED]
            ids = self._library([b"".join(own).decode()])[0]
            ends = np.cumsum(self.sizes[np.frombuffer(ids, f"<u{self.id_bytes}")])
            wanted = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            last = np.searchsorted(ends, wanted)
            if last[-1] >= len(ends) or (ends[last] != wanted).any():
                out |= zip(own, self._library([p.decode() for p in own]))     # a vocabulary without some byte
                continue
            bounds = ((last + 1) * self.id_bytes).tolist()
            out |= {p: ids[a:b] for p, a, b in zip(own, [0, *bounds], bounds)}
        return out

    def _pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        words = [p for p in pieces if len(p) > 1 and p[0] == 0x20 and not p[1:5].decode(errors="ignore")[:1].isspace()]
        rest = list(pieces.difference(words))
        return self._joined(words) | dict(zip(rest, self._library([p.decode() for p in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, ``id_bytes`` each."""
        whole = [i for i, t in enumerate(texts) if not self.by_piece or any(s in t for s in self.special)]
        out = dict(zip(whole, self._library([texts[i] for i in whole]))) if whole else {}
        data, bounds, first = pretoken.cut([t if i not in out else "" for i, t in enumerate(texts)])
        if len(data):
            ids, ends = self._gathered(data, bounds)
            ends = np.append(0, ends)[first].tolist()
            found = [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        else:
            found = [b""] * len(texts)
        return [out.get(i, f) for i, f in enumerate(found)]

    def _gathered(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where each piece's end; known pieces are looked up by their hashes."""
        hashes = range_hashes(np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:])
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        names = distinct.tolist()
        rows = list(map(self.known.get, names))
        if None in rows:
            if len(self.known) > KNOWN_PIECES:
                self.clear()
                rows = [None] * len(names)
            holes = [i for i, r in enumerate(rows) if r is None]
            pieces = [data[bounds[k]:bounds[k + 1]] for k in at[holes].tolist()]
            fresh = self._pieces(set(pieces))
            first = len(self.known)
            self.known.update((names[i], first + k) for k, i in enumerate(holes))
            for k, i in enumerate(holes):
                rows[i] = first + k
            self.flat.add(b"".join([fresh[p] for p in pieces]))
            self.starts.add(np.cumsum([self.filled, *(len(fresh[p]) // self.id_bytes for p in pieces)], dtype=np.int64)[1:].tobytes())
            self.filled = int(self.starts.array[len(self.known)])
        own = np.array(rows, np.int64)[inverse]
        start, size = self.starts.array[own], self.starts.array[own + 1] - self.starts.array[own]
        ends = np.cumsum(size)
        return self.flat.array[np.repeat(start - ends + size, size) + np.arange(ends[-1])], ends


@lru_cache(maxsize=1)
def encoder(content: bytes) -> LibraryEncoder:
    return LibraryEncoder(content)


def _coded(values: np.ndarray) -> dict:
    return vars(EliasFano.of(values))


class _Blocks:
    """Gathers documents of one shard and closes blocks."""

    def __init__(self, shard: int, id_bytes: int):
        self.shard, self.id_bytes, self.block, self.before = shard, id_bytes, 0, 0
        self.keys: list[int | None] = []
        self.ids: list[bytes] = []
        self.held = 0

    def add(self, key: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        self.keys.append(key)
        self.ids.append(ids)
        self.held += len(ids) // self.id_bytes
        if self.held >= BLOCK_IDS:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys = np.array([k for k in self.keys if k is not None], np.int64)
        least = int(keys[0]) if len(keys) else 0
        row = {"shard": self.shard, "block": self.block, "first_id": self.before, "n_docs": len(self.keys), "n_ids": self.held,
               "n_null": len(self.keys) - len(keys), "id_bytes": self.id_bytes, "ids": b"".join(self.ids),
               "bounds": _coded(np.cumsum([len(i) // self.id_bytes for i in self.ids])), "least_key": least, "keys": _coded(keys - least)}
        yield pa.RecordBatch.from_pylist([row], _ARROW)
        self.block, self.before = self.block + 1, self.before + self.held
        self.keys, self.ids, self.held = [], [], 0


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Encode every whole text, append ``end_id`` and write the blocks to the new folder ``path`` in ascending order of keys.

    Null and empty texts hold the end id alone. Rows without a key come first; rows with equal keys stand
    in the order of their texts. Keys are integers; other columns are left out. Texts are dealt out by ranges of keys before
    they are encoded, so encoding runs once, and one task holds a block and about a megabyte of text.
    """
    content = _content(docs, tokenizer)

    def run(batches):
        tool = encoder(content.value)
        ending = b"" if end_id is None else np.array([end_id], f"<u{tool.id_bytes}").tobytes()
        blocks = _Blocks(TaskContext.get().partitionId(), tool.id_bytes)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                keys = batch.column("key").slice(start, len(texts)).to_pylist()
                for k, ids in zip(keys, tool.encode(texts)):
                    yield from blocks.add(k, ids + ending)
        yield from blocks.close()

    given = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    given.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, SCHEMA).write.parquet(path)


class Block:
    """One row of the files; bounds and keys stay coded and are read by select."""

    def __init__(self, row: dict):
        self.row, self.bounds, self.keys = row, EliasFano(**row["bounds"]), EliasFano(**row["keys"])

    def ids(self, start: int, end: int) -> np.ndarray:
        size = self.row["id_bytes"]
        return np.frombuffer(self.row["ids"], f"<u{size}", end - start, start * size).astype("<u4")

    def document(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends, by two selects."""
        return self.bounds[i - 1] if i else 0, self.bounds[i]

    def key(self, i: int) -> int | None:
        return None if i < self.row["n_null"] else self.keys[i - self.row["n_null"]] + self.row["least_key"]

    def find(self, key: int) -> range:
        """Places of the documents with ``key``, by halving: a select for each step."""
        places = range(self.row["n_null"], self.row["n_docs"])
        return places[bisect_left(places, key, key=self.key):bisect_right(places, key, key=self.key)]

    def runs(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Keys and bounds (32 bits, the start first) of RUN documents after the other."""
        nulls, coded = self.row["n_null"], self.keys.count
        for at in range(0, self.row["n_docs"], RUN):
            stop = min(at + RUN, self.row["n_docs"])
            bounds = np.append(self.document(at)[0], self.bounds.part(at, stop))
            first, last = max(at - nulls, 0), max(stop - nulls, 0)
            begin = first // SAMPLE * SAMPLE
            own = self.keys.part(begin, last)[first - begin:] + self.row["least_key"] if coded and last > first else []
            yield [None] * (stop - at - len(own)) + [int(k) for k in own], bounds.astype("<u4" if self.row["n_ids"] < 1 << 32 else np.int64)


def _starts_of_shards(blocks: DataFrame) -> dict[int, int]:
    # a number for each shard; shards are partitions, so this is small whatever the input
    before, at = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        before[r["shard"]], at = at, at + r["n"]
    return before


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


_READ = ("shard", "first_id", "n_docs", "n_ids", "n_null", "id_bytes", "ids", "bounds", "least_key", "keys")
_DOCUMENT = "key long, start long, n_tokens long, ids binary"


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row for each document of a folder: key, start (ids of all documents before it), n_tokens, ids (binary, 32 bits each)."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    before = _starts_of_shards(blocks)

    def run(batches):
        for b in _blocks(batches):
            first = before[b.row["shard"]] + b.row["first_id"]
            for keys, bounds in b.runs():
                ids, at = b.ids(int(bounds[0]), int(bounds[-1])).tobytes(), (bounds - bounds[0]).tolist()
                starts = bounds[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(first + starts), pa.array(bounds[1:] - starts),
                    pa.array([ids[4 * a:4 * z] for a, z in zip(at, at[1:])], pa.binary())], ["key", "start", "n_tokens", "ids"])

    return blocks.select(*_READ).mapInArrow(run, _DOCUMENT).withColumnRenamed("key", key)


def read_documents(spark: SparkSession, path: str, keys: list[int], key: str = "doc_id") -> DataFrame:
    """The documents with the given keys (``LOOKUPS`` at most), columns as in ``read_token_files``.

    Blocks whose keys cannot match are not read; in the others keys are found by halving and bounds by select, nothing is decoded whole.
    """
    if len(keys) > LOOKUPS:
        raise ValueError(f"{len(keys)} keys; join read_token_files for more than {LOOKUPS}")
    blocks = spark.read.schema(SCHEMA).parquet(path)
    before, wanted = _starts_of_shards(blocks), sorted(set(keys))

    def run(batches):
        for b in _blocks(batches):
            first, rows = before[b.row["shard"]] + b.row["first_id"], []
            least, most = b.row["least_key"], b.key(b.row["n_docs"] - 1)
            for k in wanted[bisect_left(wanted, least):bisect_right(wanted, most) if most is not None else 0]:
                for i in b.find(k):
                    start, end = b.document(i)
                    rows.append((k, first + start, end - start, b.ids(start, end).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "start", "n_tokens", "ids"])

    near = blocks.filter(F.col("least_key") <= wanted[-1]) if wanted else blocks.limit(0)
    return near.select(*_READ).mapInArrow(run, _DOCUMENT).withColumnRenamed("key", key)


def token_file_report(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the files, read them back, and return one row for each document with the checksum of its ids."""
    write_token_files(docs, path, tokenizer)
    back = read_token_files(docs.sparkSession, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
