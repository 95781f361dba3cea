"""Token counts by byte-pair merging on a heap and a linked list; no ids are made."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm import pretoken
from terralane.llm.bpe import _content

#: More tokens than this are over the limit.
LIMIT = 512


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is visible, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class Counter:
    """The merges of a tokenizer file, a cache of pieces, and the special strings."""

    def __init__(self, content: bytes):
        given = json.loads(content)
        kind = (given.get("pre_tokenizer") or {})
        if given["model"]["type"] not in ("BPE", 3) or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or given.get("normalizer"):
            raise ValueError("only byte-level merges without normaliser or prefix space are counted")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in given["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        special = given.get("added_tokens") or []
        if any(t.get(flag) for t in special for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special strings that take neighbours with them are not supported")
        names = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.letters = byte_letters()
        self.cache = pretoken.Cache(self.count)

    def count(self, piece: bytes) -> int:
        """Symbols at first, less one for each merge: the pair of least rank is popped, the leftmost first."""
        n = len(piece)
        if n == 1:
            return 1
        symbol: list[str | None] = [self.letters[b] for b in piece]
        rank, after, before = self.rank, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(symbol) or symbol[i] != a or symbol[j] != b:
                continue            # one of the two has been merged meanwhile
            one = symbol[i] = a + b
            symbol[j] = None
            k = after[i] = after[j]
            n -= 1
            if k < len(symbol):
                before[k] = i
                if (r := rank.get((one, symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, one, symbol[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbol[h], one))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], one))
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string is one token and parts the text."""
        if self.special is None or not any(map(self.special.search, texts)):
            return self._plain(texts)
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.special.split(t)
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        np.add.at(extra, owner, self._plain(parts))
        return extra

    def _plain(self, texts: list[str]) -> np.ndarray:
        pieces, first = pretoken.pieces(texts)
        each = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        return np.diff(np.concatenate([[0], np.cumsum(each)])[first])


@lru_cache(maxsize=2)
def counter(content: bytes) -> Counter:
    return Counter(content)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Columns key, n_bytes, n_tokens and over_limit. Null and empty texts have no tokens; each row is counted alone."""
    content = _content(docs, path)

    def run(batches):
        tool = counter(content.value)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                found = tool.counts(texts)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), pa.array(sizes, pa.int64()),
                                                  pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    counted = given.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
