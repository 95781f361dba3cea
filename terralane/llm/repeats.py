"""Repeated byte strings by a radix sort of suffixes that stops at the threshold.

Suffixes are told apart by most significant digits first, and only down to the threshold of 200
bytes; a suffix that is alone in its group is dropped after each pass:

1. Of every 200-byte string one suffix is sampled by content: the least hash among its 64-byte
   strings. Equal strings sample equal places, so the first digit is the name of those 64 bytes,
   and one suffix stands for about 70 neighbours.
2. The second digit is the name of all bytes that the neighbours' strings span. Equal spans are
   repeated as a whole.
3. Where spans under one first digit differ, all their suffixes are sorted by the name of their 200
   bytes. Groups of two or more are exactly the repeated strings.

Tasks join equal spans before the shuffle, so a passage that a third of all documents hold sends
one row a task. Names are two 64-bit hashes each (of the sample and of the span or string).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm.common import stored
from terralane.llm.wordhash import mix, range_hashes

LENGTH, SAMPLE = 200, 64
#: Text is handled about so many bytes at a time; longer texts in overlapping segments.
CHUNK, SEGMENT = 1 << 18, 1 << 22
_PLACE = (1 << 24) - 1
#: Spans under one first digit that a task compares; of more, every suffix goes through a third shuffle.
GROUP = 10_000


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Rows, their offsets, joined bytes and where each part ends."""
    rows, offsets, parts, held = [], [], [], 0
    for row, text in enumerate(batch.column("text").to_pylist()):
        body = (text or "").encode()
        for at in range(0, max(1, len(body) - LENGTH + 1), SEGMENT):
            part = body[at:at + SEGMENT + LENGTH - 1]
            if len(part) >= LENGTH:
                rows.append(row)
                offsets.append(at)
                parts.append(part)
                held += len(part)
            if held >= CHUNK:       # within a long text too: no more than CHUNK + SEGMENT + LENGTH bytes at a time
                yield rows, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                rows, offsets, parts, held = [], [], [], 0
    if parts:
        yield rows, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def sampled(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per sampled suffix: the first and last string that it stands for, and the names of its digits.

    Strings start at ``first`` to ``last`` and lie within one part (parts end at ``ends``).
    """
    assert len(data) <= _PLACE + 1, "places must fit beside the hash"
    at = np.arange(len(data) - SAMPLE + 1)
    name = range_hashes(data, at, at + SAMPLE)
    least = (name & ~np.uint64(_PLACE)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= LENGTH - SAMPLE + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - SAMPLE + 1 - width
    least = np.minimum(least[:-rest], least[rest:])
    inside = np.zeros(len(data), np.int8)
    starts = np.concatenate([[0], ends[:-1]])
    inside[starts] = 1
    inside[ends - LENGTH + 1] -= 1
    strings = np.flatnonzero(np.cumsum(inside))
    chosen = (least[strings] & np.uint64(_PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    first, last = strings[new], strings[np.append(new[1:], len(strings)) - 1]
    return first, last, name[chosen[new]], range_hashes(data, first, last + LENGTH)


_SPAN_COLUMNS = ["digit", "span", "row", "first", "last", "copies"]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct span of a task's documents; those met before in the task are repeats at once.

    copies: 1, or 2 for two and more; 0 marks a span that is known to be repeated and needs no partner
    (its digit is a hash of its place, so that such rows spread).
    """
    for batch in batches:
        found: list[list[np.ndarray]] = []
        keys = batch.column("row").to_numpy()
        for rows, offsets, data, ends in _segments(batch):
            first, last, digit, span = sampled(np.frombuffer(data, np.uint8), ends)
            part = np.searchsorted(ends, first, "right")
            shift = (np.array(offsets) - np.concatenate([[0], ends[:-1]]))[part]
            found.append([digit, span, keys[np.array(rows)[part]], first + shift, last + shift])
        if not found:
            continue
        digit, span, row, first, last = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((span, digit))
        digit, span, row, first, last = (c[order] for c in (digit, span, row, first, last))
        new = np.concatenate([[True], (digit[1:] != digit[:-1]) | (span[1:] != span[:-1])])
        begins = np.flatnonzero(new)
        copies = np.zeros(len(digit), np.int64)
        copies[begins] = np.minimum(np.diff(np.append(begins, len(digit))), 2)
        digit = np.where(new, digit, mix(row.view(np.uint64) + first.astype(np.uint64)))
        cols = [digit.view(np.int64), span.view(np.int64), row, first, last, copies]
        for at in range(0, len(digit), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + (1 << 17)]) for c in cols], _SPAN_COLUMNS)


def _complete(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut so that no group of the first column is parted."""
    held = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        ends = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _pass_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by digit and span: spans that are repeated (rivals 0), and one of each that differs from others (rivals: how many there are)."""
    for digit, span, row, first, last, copies in _complete(batches, _SPAN_COLUMNS):
        known = copies == 0
        new_digit = np.concatenate([[True], digit[1:] != digit[:-1]])
        new_span = new_digit | np.concatenate([[True], span[1:] != span[:-1]])
        spans, digits = np.cumsum(new_span) - 1, np.cumsum(new_digit) - 1
        total = np.bincount(spans, copies)[spans]
        rivals = np.bincount(digits, new_span & ~known)[digits].astype(np.int64)
        whole = known | (total >= 2)
        differs = new_span & ~known & (rivals >= 2)
        parts = [np.flatnonzero(whole), np.flatnonzero(differs)]
        rows = np.concatenate(parts)
        if len(rows):
            count = np.concatenate([np.zeros(len(parts[0]), np.int64), rivals[parts[1]]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (digit[rows], row[rows], first[rows], last[rows], count)],
                                             ["digit", "row", "first", "last", "rivals"])


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that differ from others under their digit."""
    for batch in batches:
        held: list[tuple] = []
        size = 0
        for row, text, spans in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("spans")):
            body = text.as_py().encode()
            for s in spans.as_py():
                held.append((s["digit"], row, s["first"], body[s["first"]:s["last"] + LENGTH]))
                size += len(held[-1][3])
            if size >= 1 << 23:
                yield _span_batch(held)
                held, size = [], 0
        if held:
            yield _span_batch(held)


def _span_batch(held: list[tuple]) -> pa.RecordBatch:
    digit, row, first, body = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(digit, pa.int64()), pa.array(row, pa.int64()), pa.array(first, pa.int64()), pa.array(body, pa.binary())],
                                      ["digit", "row", "first", "body"])


def _strings(digit, row, first, body) -> tuple[np.ndarray, ...]:
    """All 200-byte strings of spans: name, row and start."""
    sizes = np.array([len(b) for b in body])
    data = np.frombuffer(b"".join(body), np.uint8)
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(body)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = inside + (np.cumsum(sizes) - sizes)[owner]
    name = range_hashes(data, at, at + LENGTH)
    return name, digit[owner], row[owner], first[owner] + inside


def _intervals(row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring strings as byte intervals; strings come in order within a span."""
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(row)) - 1
    return pa.RecordBatch.from_arrays([pa.array(row[begins]), pa.array(start[begins]), pa.array(start[stops] + LENGTH)], ["row", "a", "b"])


def _pass_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From spans sorted by digit: the strings that occur twice or more under it."""
    for digit, row, first, body in _complete(batches, ["digit", "row", "first", "body"]):
        edges = np.append(np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]])), len(digit))
        at = 0
        while at < len(edges) - 1:                # whole groups, some thousand spans at a time
            stop = at + 1
            while stop < len(edges) - 1 and edges[stop + 1] - edges[at] <= GROUP:
                stop += 1
            part = slice(edges[at], edges[stop])
            at = stop
            name, under, rows, start = _strings(digit[part], row[part], first[part], body[part])
            name = mix(name ^ mix(under.view(np.uint64)))
            _, back, count = np.unique(name, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(count[back] > 1)
            if len(hit):
                yield _intervals(rows[hit], start[hit])


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            name, digit, row, start = _strings(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("digit", "row", "first", "body")))
            yield pa.RecordBatch.from_arrays([pa.array(digit), pa.array(name.view(np.int64)), pa.array(row), pa.array(start)], ["digit", "name", "row", "start"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text less its covered bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("covered")):
                body = (text or "").encode()
                packed = np.sort(spans.values.to_numpy()) if spans.is_valid else np.zeros(0, np.int64)
                a, b = packed >> 32, packed & 0xFFFFFFFF
                kept, last, runs, removed = [], 0, 0, 0
                if len(a):
                    reach = np.maximum.accumulate(b)
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
                    begins, stops = a[new].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist()
                    runs = len(begins)
                    for x, y in zip(begins, stops):
                        kept.append(body[last:x])
                        last, removed = y, removed + y - x
                kept.append(body[last:])
                out.append((len(body), removed, runs, b"".join(kept)))
            sizes, removed, runs, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                              pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_bytes, n_removed, n_spans and kept (binary): each text less its repeated 200-byte strings.

    A byte goes if any 200-byte string that covers it also starts anywhere else, in the same text or
    another; all occurrences go, and strings never cross texts. Null and empty texts have no bytes; a repeated row is
    one more document, so both lose all they have in 200-byte strings. Rows with null keys take part; other columns
    are left out. n_spans counts the maximal removed runs. Texts are shuffled once, by a hash of key and text.
    """
    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    given = given.withColumn("row", F.xxhash64("key", "text"))
    kind = given.schema["key"].dataType.simpleString()
    samples = given.select("row", "text").mapInArrow(_sample_rows, "digit long, span long, row long, first long, last long, copies long")
    named = stored(samples.repartition("digit").sortWithinPartitions("digit", "span")
                   .mapInArrow(_pass_two, "digit long, row long, first long, last long, rivals long"), "spans")
    differing = named.filter("rivals > 0").groupBy("row").agg(F.collect_list(F.struct("digit", "first", "last", "rivals")).alias("spans"))

    def bodies(condition):
        chosen = differing.select("row", F.filter("spans", condition).alias("spans")).filter(F.size("spans") > 0)
        return given.join(chosen, "row").select("row", "text", "spans").mapInArrow(_cut_spans, "digit long, row long, first long, body binary")

    small = bodies(lambda s: s["rivals"] <= GROUP).repartition("digit").sortWithinPartitions("digit").mapInArrow(_pass_three, "row long, a long, b long")
    strings = bodies(lambda s: s["rivals"] > GROUP).mapInArrow(_string_rows, "digit long, name long, row long, start long")
    twice = strings.groupBy("digit", "name").count().filter("count > 1").select("digit", "name")
    large = strings.join(twice, ["digit", "name"]).select("row", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))
    whole = named.filter("rivals = 0").select("row", F.col("first").alias("a"), (F.col("last") + LENGTH).alias("b"))
    covered = whole.unionAll(small).unionAll(large).groupBy("row").agg(
        F.collect_list(F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("covered"))
    return given.join(covered, "row", "left").select("key", "text", "covered").mapInArrow(
        _without, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)


def repeat_report(docs: DataFrame) -> DataFrame:
    """One row for each document, with the digest of the bytes that stay."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
