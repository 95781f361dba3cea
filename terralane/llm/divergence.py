"""Divergence of sources: how far the words of each source stand from those of the other sources of its language.

Terms are counted once, as 64-bit digests with packed counts of the groups (language, source); the big shuffle moves digests
and numbers only. The words themselves stay in the written counts until two places: the least and the greatest word of each
kept digest, which show digests that two words share (those are counted again by word), and the words of the
terms that come out at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralane.llm import pretoken
from terralane.llm.common import stored

#: A term is kept where it occurs in so many documents of the language.
LEAST_DOCS = 3
#: Terms listed for each group.
TOP = 200
SCALE = 1_000_000_000
#: A task gathers so many (group, term) counts before it hands them on.
HELD = 1_000_000
#: Pairs of sources, and values for the top terms, that a task holds before it sums or sifts them.
PAIRS = 1 << 22
#: Groups are broadcast up to this number (about 100 bytes each).
SMALL = 200_000
#: Letters and everything beyond ASCII stay, A-Z in lower case; the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A group's count of a term: the group's number and the occurrences.
_PAIR = np.dtype([("group", "<i8"), ("n", "<i8")])


def group_number(lang: str, source: str, seed: int) -> int:
    """The number of a group: a 64-bit hash, with a seed under which no two groups share one."""
    return xxhash.xxh64_intdigest(f"{len(lang)}:{lang}{source}".encode(), seed) - (1 << 63)


class _Numbers(dict):
    """Numbers from 0 in the order in which keys are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


def _sums(order: np.ndarray, new: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values in ``order``, summed from each place of ``new`` to the next."""
    return [np.add.reduceat(v[order], new) if len(new) else v[:0] for v in values]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class _Counts:
    """Occurrences and documents of each (group, term) of a task, by exact words."""

    def __init__(self, bits: int, seed: int):
        self.mask, self.seed = (1 << bits) - 1, seed
        self.clear()

    def clear(self):
        self.terms, self.groups = _Numbers(), _Numbers()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: list[tuple[str, str]], texts: list[str]) -> None:
        terms, number = self.terms, []
        for text in texts:
            words = text.encode().translate(_TERMS).split()
            number.append(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))
        doc = np.repeat(np.arange(len(texts)), [len(n) for n in number])
        group = np.fromiter(map(self.groups.__getitem__, keys), np.int64, len(keys))
        in_doc, times = np.unique(doc << 40 | np.concatenate(number), return_counts=True)
        self.parts.append((group[in_doc >> 40] << 40 | in_doc & (1 << 40) - 1, times, np.ones(len(times), np.int64)))
        self.rows += len(in_doc)
        if self.rows > HELD:
            self.parts = [self._summed()]
            self.rows = len(self.parts[0][0])

    def _summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n, docs = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        new = _changes(key[order])
        return key[order][new], *_sums(order, new, n, docs)

    def full(self) -> bool:
        return self.rows > HELD // 2 and len(self.parts) == 1

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            key, n, docs = self._summed()
            names = list(self.groups)
            langs = sorted({x for x, _ in names})
            lang = np.array([langs.index(x) for x, _ in names])[key >> 40]
            pair = np.empty(len(key), _PAIR)
            pair["group"], pair["n"] = np.array([group_number(*x, self.seed) for x in names], np.int64)[key >> 40], n
            term = key & (1 << 40) - 1
            order = np.lexsort((pair["group"], lang, term))
            new = _changes(term[order], lang[order])
            (docs,) = _sums(order, new, docs)
            packed, ends = pair[order].tobytes(), np.append(new[1:], len(order)) * _PAIR.itemsize
            words = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            digests = np.fromiter((xxhash.xxh64_intdigest(t) & self.mask for t in self.terms), np.uint64, len(self.terms)).view(np.int64)
            term, lang, starts = term[order][new], lang[order][new], new * _PAIR.itemsize
            for at in range(0, len(new), 1 << 16):
                part = slice(at, at + (1 << 16))
                counts = pa.array([packed[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(lang[part])), pa.array(digests[term[part]]), pa.array(docs[part]), counts,
                                                  words.take(pa.array(term[part]))], ["lang", "digest", "docs", "counts", "term"])
        self.clear()


def term_counts(docs: DataFrame, seed: int, bits: int = 64) -> DataFrame:
    """lang, digest, docs, counts (packed), term from docs (lang, source, text; no nulls): summed up within each task only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(bits, seed)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                keys = list(zip(*(batch.column(c).slice(start, len(texts)).to_pylist() for c in ("lang", "source"))))
                held.add(keys, texts)
                if held.full():
                    yield from held.close()
        yield from held.close()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, digest long, docs long, counts binary, term string")


def _merged(counts: DataFrame, key: list[str], least_docs: int) -> DataFrame:
    """lang, digest, term, counts of the terms by ``key`` that occur in enough documents; one shuffle."""
    def rows(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(held)
        columns = [table.column(c).combine_chunks() for c in key]
        new = _changes(*(c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.to_numpy() for c in columns))
        docs = np.add.reduceat(table.column("docs").to_numpy(), new)
        kept = docs >= least_docs
        term = np.repeat(np.arange(len(new)), np.diff(np.append(new, table.num_rows)))
        chosen = pa.array(kept[term])
        content = table.column("counts").filter(chosen)
        pair = np.frombuffer(b"".join(content.to_pylist()), _PAIR)
        size = np.array([len(c) // _PAIR.itemsize for c in content.to_pylist()], np.int64)
        term = np.repeat(term[kept[term]], size)
        order = np.lexsort((pair["group"], term))
        first = _changes(term[order], pair["group"][order]) if len(order) else np.zeros(0, np.int64)
        merged = np.empty(len(first), _PAIR)
        merged["group"] = pair["group"][order][first]
        (merged["n"],) = _sums(order, first, pair["n"])
        ends = np.cumsum(np.bincount(term[order][first], minlength=len(new))[kept]) * _PAIR.itemsize
        packed, at = merged.tobytes(), [0, *ends.tolist()]
        out = table.take(pa.array(new[kept]))
        names = out.column("term") if "term" in key else pa.nulls(out.num_rows, pa.string())
        if out.num_rows:
            yield from pa.table({"lang": out.column("lang"), "digest": out.column("digest"), "term": names,
                                 "counts": pa.array([packed[a:b] for a, b in zip(at, at[1:])], pa.binary())}).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            end = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in key)
            held.append(pa.Table.from_batches([batch]))
            if end == last:         # one term only so far
                continue
            last = end
            table = pa.concat_tables(held)
            cut = table.num_rows - 1
            while cut and all(table.column(c)[cut - 1].as_py() == e for c, e in zip(key, end)):
                cut -= 1
            if cut:
                yield from rows([table.slice(0, cut)])
            held = [table.slice(cut)]
        if held:
            yield from rows(held)

    carried = list(dict.fromkeys(["lang", "digest", *key, "docs", "counts"]))
    dealt = counts.select(*carried).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "lang string, digest long, term string, counts binary")


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, digest, term, counts of all kept terms; ``term`` only where a digest alone does not tell."""
    kept = stored(_merged(counts, ["lang", "digest"], least_docs), "kept-terms")
    often = kept.select("digest").distinct()
    ends = counts.select("digest", "term").join(often, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    shared = stored(ends.filter("least <> greatest").select("digest"), "shared-digests")
    if shared.isEmpty():        # the usual case: 10^9 terms share a digest once in 37 times
        return kept
    single = _merged(counts.join(shared, "digest", "left_semi"), ["lang", "digest", "term"], least_docs)
    return stored(kept.join(shared, "digest", "left_anti").unionByName(single), "kept-terms")


@dataclass(frozen=True)
class Groups:
    """The groups in the order of their numbers, and the languages: what their shares are divided by."""
    number: np.ndarray
    below: np.ndarray           # N + V
    langs: dict[str, int]       # N + V of the languages

    def place(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.number, number)


def share(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / below), exactly."""
    if len(n) and int(n.max()) >= 9_000_000_000:        # beyond 64 bits
        return (1 + SCALE * (n.astype(object) + 1) // below.astype(object)).astype(np.int64)
    return 1 + SCALE * (n + 1) // below


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, group number and occurrences of every count in a batch."""
    content = batch.column("counts").to_pylist()
    pair = np.frombuffer(b"".join(content), _PAIR)
    row = np.repeat(np.arange(len(content)), [len(c) // _PAIR.itemsize for c in content])
    return row, pair["group"], pair["n"]


class _Sums:
    """Sums of values by two numbers; handed on when too many."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.held = names, [], 0

    def add(self, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(one):
            self.parts.append((one, two, value))
            self.held += len(one)
        if self.held > PAIRS:
            self.parts = [self._summed()]
            self.held = len(self.parts[0][0])
            if self.held > PAIRS // 2:
                yield from self.close()

    def _summed(self) -> tuple[np.ndarray, ...]:
        one, two, value = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((two, one))
        new = _changes(one[order], two[order])
        return one[order][new], two[order][new], *_sums(order, new, value)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self._summed()], self.names)
        self.parts, self.held = [], 0


def _overlaps(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    """For every two sources what the terms that both have add to their sums beyond what either adds alone."""
    rest = share(np.zeros(len(groups.below), np.int64), groups.below)
    found = _Sums(["one", "other", "value"])
    for batch in batches:
        term, number, n = _unpacked(batch)
        own = groups.place(number)
        p, z = share(n, groups.below[own]), rest[own]
        size = np.bincount(term, minlength=batch.num_rows)
        first, size = (np.cumsum(size) - size)[term], size[term]
        done, at = np.cumsum(size), 0
        while at < len(number):      # as many left sides as make PAIRS pairs
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            count = size[at:stop]
            left = np.repeat(np.arange(at, stop), count)
            right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            left, right = left[left != right], right[left != right]
            at = stop
            value = _gap(p[left], p[right]) - _gap(p[left], z[right]) - _gap(z[left], p[right]) + _gap(z[left], z[right])
            yield from found.add(number[left], number[right], value)
    yield from found.close()


def _histograms(batches: Iterator[pa.RecordBatch], groups: Groups) -> Iterator[pa.RecordBatch]:
    """How many kept terms of each group have each share."""
    found = _Sums(["number", "p", "times"])
    for batch in batches:
        _, number, n = _unpacked(batch)
        yield from found.add(number, share(n, groups.below[groups.place(number)]), np.ones(len(n), np.int64))
    yield from found.close()


def _heights(batches: Iterator[pa.RecordBatch], groups: Groups, top: int) -> Iterator[pa.RecordBatch]:
    """Terms above the language's share, with their value: of each task and group the ``top`` greatest and all that tie with the last."""
    held: list[pa.Table] = []
    count = 0

    def sifted() -> pa.Table:
        table = pa.concat_tables(held).combine_chunks()
        number, value = table.column("number").to_numpy(), table.column("value").to_numpy()
        order = np.lexsort((-value, number))
        new = _changes(number[order])
        start = np.repeat(new, np.diff(np.append(new, len(order))))
        last = np.minimum(start + top - 1, np.repeat(np.append(new[1:], len(order)) - 1, np.diff(np.append(new, len(order)))))
        return table.take(pa.array(order[value[order] >= value[order][last]]))

    for batch in batches:
        row, number, n = _unpacked(batch)
        all_n = np.zeros(batch.num_rows, np.int64)
        np.add.at(all_n, row, n)
        below = np.array([groups.langs[x] for x in batch.column("lang").to_pylist()], np.int64)
        p, q = share(n, groups.below[groups.place(number)]), share(all_n, below)[row]
        high = np.flatnonzero(p > q)
        if len(high):
            at = pa.array(row[high])
            held.append(pa.table({"number": number[high], "digest": batch.column("digest").take(at), "term": batch.column("term").take(at),
                                  "value": _gap(p[high], q[high])}))
            count += len(high)
        if count > PAIRS // 4:
            held = [sifted()]
            count = 0
    if held:
        yield from sifted().combine_chunks().to_batches()


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a written table when it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _totals(kept: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Sums(["number", "none", "total"])
        for batch in batches:
            _, number, n = _unpacked(batch)
            yield from found.add(number, np.zeros(len(n), np.int64), n)
        yield from found.close()

    return kept.mapInArrow(run, "number long, none long, total long").groupBy("number").agg(F.sum("total").alias("total"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: how the terms of each group (lang, source) differ.

    ``docs`` has lang, source and text; nulls are empty strings and other columns are left out. A language keeps
    the terms of ``least_docs`` documents or more (every row is a document, repeated ones too). A group's share of a term
    is p = 1 + floor(10^9 (count + 1) / (N + V)) over the V kept terms, N their occurrences. Part pair: every other source
    of the language, with floor((p - q)^2 / q) summed over all kept terms, q the other's share (0 without kept terms). Part term:
    kept terms of the group with p above the language's q, the ``top`` greatest by the same value. Ranks run
    from 1 by falling values, then items in the order of their UTF-8 bytes. An empty table has no rows.

    Digests have ``bits`` bits; terms that share one are told apart whatever their number. The groups (a number and a total
    each) are held by every task: the pair part alone returns the square of their number.
    """
    clean = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    named, seed = _named_groups(clean)
    counts = stored(term_counts(clean, seed, bits), "term-counts")
    kept = _kept(counts, least_docs)
    totals = _totals(kept)
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    found = stored(named.join(totals, "number", "left").join(terms, "lang", "left").fillna(0), "groups")
    rows = found.orderBy("number").collect()        # the groups; see above
    langs: dict[str, int] = {}
    for r in rows:
        langs[r["lang"]] = langs.get(r["lang"], r["terms"]) + r["total"]
    number = np.array([r["number"] for r in rows], np.int64)
    below = np.array([max(1, r["total"] + r["terms"]) for r in rows], np.int64)
    groups = docs.sparkSession.sparkContext.broadcast(Groups(number, below, langs))
    pairs = _pairs(found, kept, groups)
    return pairs.unionByName(_tops(found, counts, kept, groups, top))


def _named_groups(clean: DataFrame) -> tuple[DataFrame, int]:
    """lang, source and number of every group, and the seed of the numbers."""
    names = stored(clean.select("lang", "source").distinct(), "names")
    for seed in range(64):
        def run(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
                numbers = pa.array([group_number(a, b, seed) for a, b in zip(lang, source)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, numbers], ["lang", "source", "number"])
        named = names.mapInArrow(run, "lang string, source string, number long")
        if named.groupBy("number").count().filter("count > 1").isEmpty():
            return named, seed
    raise ValueError("no seed tells the groups apart")


def _pairs(named: DataFrame, kept: DataFrame, groups) -> DataFrame:
    with_rest = named.withColumn("rest", F.expr(f"1 + {SCALE} div nullif(total + terms, 0)"))
    gap = lambda p, q: F.call_function("div", (p - q) * (p - q), q)
    equal = stored(kept.mapInArrow(lambda batches: _histograms(batches, groups.value), "number long, p long, times long")
                   .groupBy("number", "p").agg(F.sum("times").alias("times")), "histograms")
    own = equal.groupBy("number").agg(F.sum("times").alias("own"))
    full = stored(with_rest.join(own, "number", "left").fillna(0, ["own"]), "groups")
    side = lambda at: full.select("lang", *[F.col(c).alias(f"{c}_{at}") for c in ("source", "number", "own", "terms", "rest")])
    both = side("a").join(side("b"), "lang").filter("number_a <> number_b")
    # without kept terms there is no share, and the value is 0
    neither = both.select(F.col("number_a").alias("one"), F.col("number_b").alias("other"), F.coalesce(
        (F.col("terms_a") - F.col("own_a") - F.col("own_b")) * gap(F.col("rest_a"), F.col("rest_b")), F.lit(0)).alias("value"))
    few = _few(full)
    rests = few.select("lang", F.col("number").alias("number_b"), F.col("rest").alias("rest_b"))
    single = equal.join(few.select("number", "lang"), "number").join(rests, "lang").filter("number <> number_b")
    here = single.groupBy(F.col("number").alias("one"), F.col("number_b").alias("other")).agg(
        F.sum(F.col("times") * gap(F.col("p"), F.col("rest_b"))).alias("value"),
        F.sum(F.col("times") * gap(F.col("rest_b"), F.col("p"))).alias("back"))
    here = here.select(F.explode(F.array(F.struct("one", "other", "value"), F.struct(
        F.col("other").alias("one"), F.col("one").alias("other"), F.col("back").alias("value")))).alias("x")).select("x.*")
    shared = kept.mapInArrow(lambda batches: _overlaps(batches, groups.value), "one long, other long, value long")
    total = neither.unionAll(here).unionAll(shared).groupBy("one", "other").agg(F.sum("value").alias("value"))
    a = few.select("lang", "source", F.col("number").alias("one"))
    b = few.select(F.col("source").alias("item"), F.col("number").alias("other"))
    rows = total.join(a, "one").join(b, "other")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _tops(named: DataFrame, counts: DataFrame, kept: DataFrame, groups, top: int) -> DataFrame:
    high = kept.mapInArrow(lambda batches: _heights(batches, groups.value, top), "number long, digest long, term string, value long")
    # the words decide among equal values only, so all that tie with the last are named
    by_value = Window.partitionBy("number").orderBy(F.desc("value"))
    near = stored(high.withColumn("least", F.rank().over(by_value)).filter(F.col("least") <= top).drop("least"), "top-terms")
    wanted = near.filter("term is null").select("digest").distinct()
    words = counts.select("digest", F.col("term").alias("word")).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("word").alias("word"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = near.join(words, "digest", "left").select("number", F.coalesce("term", "word").alias("item"), "value")
    ranked = told.join(_few(named).select("number", "lang", "source"), "number").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
