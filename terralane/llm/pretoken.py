"""Where texts are cut before byte-pair merging, found without expressions.

Code points become classes, classes and a glance ahead become symbols, and each symbol is
a function on the few states of an automaton. Composing such functions is associative, so
the state before every character comes from a blocked scan with a composition table:
every step is one numpy gather over all blocks, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, END = range(7)          # classes of code points
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT = range(8)   # states
#: Symbols: the classes OTHER, LETTER, NUMBER as they are; then a quote that one or two letters may
#: complete to a contraction, white space inside a run, the last blank or other space before a
#: visible character, and the end of a document.
QUOTE_1, QUOTE_2, INNER, LAST_BLANK, LAST_SPACE, STOP = range(3, 9)
#: Texts are handled together up to about so many code points.
CHUNK = 1 << 20
_BLOCK = 64
_SENTINEL = 0x110000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the tokenizer library itself."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = np.zeros(_SENTINEL + 1, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        one = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for at in range(0, _SENTINEL, 1 << 12):         # a few at a time: the library returns a list of bytes
            text = "".join(chr(c) for c in range(at, at + (1 << 12)) if not 0xD800 <= c < 0xE000)
            found = bytes(one.encode_ordinary(text)).decode()
            out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")], out[ord("'")], out[_SENTINEL] = BLANK, QUOTE, END
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character begins a piece."""
    if symbol == STOP:
        return FRESH, False
    if symbol == LAST_BLANK:
        return AFTER_BLANK, True
    if symbol == LAST_SPACE:
        return FRESH, True
    if symbol == INNER:
        return IN_SPACE, state != IN_SPACE
    if symbol == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if state in (IN_OTHERS, AFTER_BLANK) or symbol == OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, AFTER_BLANK)
    return (ONE_LEFT if symbol == QUOTE_1 else TWO_LEFT), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols' function numbers, the composition table, functions by state, and the begin flags."""
    given = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *given]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in given:
            h = tuple(g[f[s]] for s in range(8))
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = list(known)
    then = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in functions] for f in functions], np.uint16)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([known[g] for g in given], np.uint16), then, np.array(functions, np.uint8), begins


def _scan(ids: np.ndarray, then: np.ndarray) -> np.ndarray:
    """All prefixes of a sequence of functions, composed."""
    k = np.uint32(len(then))
    table = then.ravel()
    if len(ids) <= _BLOCK:
        out = ids.copy()
        for i in range(1, len(out)):
            out[i] = then[out[i - 1], out[i]]
        return out
    rows = -(-len(ids) // _BLOCK)
    wide = np.zeros(rows * _BLOCK, np.uint16)          # function 0 is the identity
    wide[:len(ids)] = ids
    wide = np.ascontiguousarray(wide.reshape(rows, _BLOCK).T)
    for j in range(1, _BLOCK):
        wide[j] = table[wide[j - 1] * k + wide[j]]
    before = np.zeros(rows, np.uint16)
    before[1:] = _scan(wide[-1], then)[:-1]
    return table[before * k + wide].T.reshape(-1)[:len(ids)]


def _symbols(points: np.ndarray) -> np.ndarray:
    kind = class_table()[points]
    ahead = np.empty_like(kind)
    ahead[:-1], ahead[-1] = kind[1:], END
    out = kind.copy()
    white = (kind == BLANK) | (kind == SPACE)
    last = (ahead < BLANK) | (ahead == QUOTE)
    out[white] = INNER
    out[(kind == BLANK) & last] = LAST_BLANK
    out[(kind == SPACE) & last] = LAST_SPACE
    out[kind == END] = STOP
    at = np.flatnonzero(kind == QUOTE)
    if len(at):
        padded = np.append(points, [_SENTINEL, _SENTINEL])
        one, two = padded[at + 1], padded[at + 2]
        out[at] = OTHER
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
        pairs = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[at[pairs]] = QUOTE_2
    return out


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes, where each piece begins (with the end appended), and for each text its first piece (with the count appended)."""
    data = "".join(texts).encode()
    lengths = np.array([len(t) for t in texts], np.int64)
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    points = np.full(int(lengths.sum()) + len(texts), _SENTINEL, np.uint32)
    inside = np.ones(len(points), bool)
    inside[ends] = False
    points[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    symbols = _symbols(points)
    numbers, then, functions, begins = _monoid()
    after = functions[:, FRESH][_scan(numbers[symbols], then)]
    before = np.empty_like(after)
    before[0], before[1:] = FRESH, after[:-1]
    starts = np.flatnonzero(begins[before, symbols])
    width = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
    width[ends] = 0
    place = np.cumsum(width, dtype=np.int64) - width
    first = np.searchsorted(starts, np.concatenate([[0], ends + 1]))
    return data, np.append(place[starts], len(data)), first


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All pieces of all texts, and for each text the number of its first piece (with the count appended)."""
    data, at, first = cut(texts)
    bounds = at.tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])], first


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's rows of about ``limit`` bytes of text, with their first row; null texts are empty."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


class Cache(dict):
    """Results for short pieces; emptied when full, so that memory stays bounded."""

    def __init__(self, compute, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, piece: bytes):
        found = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found
