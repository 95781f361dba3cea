"""Importance resampling: draw the documents that look most like a target collection.

Hashed n-grams of the corpus and of the target are counted into a fixed number of buckets; a bucket's gain is
the log ratio of the two, a document's weight the sum of its n-grams' gains. A Gumbel number from the document's
key is added, so that the highest scores are a draw without replacement in proportion to exp(weight).
The cutoff is found by bracketing: a quantile sketch proposes two scores, exact counts outside them
say whether the cutoff lies between (or the bracket is widened), and only rows between them are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm import pretoken
from terralane.llm.common import fresh, stored
from terralane.llm.ranking import numbered

BUCKETS = 10_000
#: Fewer words exclude a document from the draw.
LEAST_WORDS = 20
#: Half the width of the first bracket, as a share of the rows; four times as wide after each miss.
BRACKET = 1 / 512
_ACCURACY = 10_000
#: Letters and digits, A-Z in lower case, and everything beyond ASCII stay; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def feature_buckets(words: list[bytes], longest: int, known: dict[bytes, int], buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words; ``known`` remembers single words."""
    out = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
    for size in range(2, min(longest, len(words)) + 1):
        runs = (b" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
        out.append(np.fromiter((zlib.crc32(r) % buckets for r in runs), np.int64, len(words) - size + 1))
    return np.concatenate(out)


def _known(buckets: int) -> pretoken.Cache:
    return pretoken.Cache(lambda word: zlib.crc32(word) % buckets)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall into each bucket; each task sends one row for each bucket it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _known(buckets)
        for batch in batches:
            for _, part in pretoken.chunks(batch, "text"):
                found = [feature_buckets(words_of(t), longest, known, buckets) for t in part]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the corpus, in doubles."""
    n, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    pairs = zip(corpus.astype(np.float64).tolist(), target.astype(np.float64).tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in pairs], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """Columns key, n_words, n_features and weight, a row for each row of ``docs``."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(buckets)
        for batch in batches:
            for start, part in pretoken.chunks(batch, "text"):
                rows = []
                for t in part:
                    words = words_of(t)
                    found = feature_buckets(words, longest, known, buckets)
                    rows.append((len(words), len(found), int(gain[found].sum())))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(part)), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                                                 ["key", "n_words", "n_features", "weight"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"key {given.schema['key'].dataType.simpleString()}, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int) -> DataFrame:
    """Adds score: the weight and a Gumbel number from the seed and the key (a null key counts as empty)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", (F.col("weight") + gumbel).cast("long"))


@dataclass(frozen=True)
class Cutoff:
    """The last row that is drawn, and what was sorted to find it."""
    score: int
    key: object
    row: int
    drawn: int
    bracket: int
    rounds: int


def find_cutoff(eligible: DataFrame, share: tuple[int, int], bracket: float = BRACKET) -> Cutoff | None:
    """The last drawn row of ``eligible`` (key, score, row: distinct longs), in the order of falling scores, then keys (null last).

    floor(share[0] * rows / share[1]) rows are drawn; None where that is 0. The bracket's ends are
    checked by exact counts and widened until the cutoff lies inside; at last it holds all rows.
    """
    total = eligible.count()
    wanted = total * share[0] // share[1]
    if wanted <= 0:
        return None
    if wanted > total:
        raise ValueError("the share of drawn rows is at most 1")
    place, width, rounds = 1 - wanted / total, bracket, 0
    while True:
        rounds += 1
        ends = [max(0.0, place - width), min(1.0, place + width)]
        low, high = eligible.agg(F.percentile_approx("score", ends, _ACCURACY).alias("p")).first()["p"]
        counts = eligible.agg(F.count(F.when(F.col("score") > high, 1)).alias("above"),
                              F.count(F.when(F.col("score").between(low, high), 1)).alias("inside")).first()
        if counts["above"] < wanted <= counts["above"] + counts["inside"]:
            break
        width *= 4
    inside = eligible.filter(F.col("score").between(low, high)).select("key", "score", "row")
    ordered = numbered(_ordered(inside), ["falling", "no_key", "key", "row"], "position")
    last = ordered.filter(F.col("position") == wanted - counts["above"]).first()
    return Cutoff(last["score"], last["key"], last["row"], wanted, counts["inside"], rounds)


def _ordered(scored: DataFrame) -> DataFrame:
    return scored.withColumn("falling", -F.col("score")).withColumn("no_key", F.col("key").isNull())


def _is_drawn(cut: Cutoff):
    """Is a row not behind the cutoff?"""
    at_key = F.col("key").eqNullSafe(F.lit(cut.key))
    before = F.lit(False) if cut.key is None else F.col("key") < F.lit(cut.key)
    if cut.key is None:
        before = F.col("key").isNotNull()
    tied = F.coalesce(before, F.lit(False)) | at_key & (F.col("row") <= cut.row)
    return (F.col("score") > cut.score) | (F.col("score") == cut.score) & tied


def resample_report(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = 1, buckets: int = BUCKETS,
                    seed: int = 2024, share: tuple[int, int] = (10, 100), least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: key, n_features, weight, score and rank (1 for the highest score that is drawn; undrawn null).

    ``target`` has a column of the name ``text``. Null and empty texts have no words: weight 0 and never drawn
    unless ``least_words`` is 0. Of the rows with at least ``least_words`` words, the share ``share[0] / share[1]`` (rounded down)
    is drawn, ties to the smaller key. Rows that share a key and a score are ranked among each other in the
    order in which they were read; null keys count as an empty one in the Gumbel number and come last
    among ties. Empty tables and targets are allowed. Other columns are left out.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    scored = with_score(weighed(docs, gain, key, text, longest), seed)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    cut = find_cutoff(scored.filter(F.col("n_words") >= least_words), share)
    shown = [F.col("key").alias(key), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*shown, none)
    chosen = (F.col("n_words") >= least_words) & _is_drawn(cut)
    drawn = numbered(_ordered(scored.filter(chosen)), ["falling", "no_key", "key", "row"], "rank")
    return drawn.select(*shown, "rank").unionAll(scored.filter(~chosen).select(*shown, none))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns and a column of ranks, ``rank`` or lengthened. Keys are unique and not null."""
    name = fresh(docs, "rank")
    report = resample_report(docs, target, key, text, **options).filter("rank is not null").select(F.col(f"`{key}`"), F.col("rank").alias(name))
    return docs.join(report, key).select(*[F.col(f"`{c}`") for c in docs.columns], name)
