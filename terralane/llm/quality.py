"""Quality rules: plain rules on every text, then a likelihood ratio of hashed n-grams.

Everything is a column expression; no Python runs on the executors. Counting the
n-grams pre-aggregates into a fixed number of buckets on the map side, and scoring
needs no shuffle at all, so neither hot sources nor long texts move rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralane.llm.common import fresh, words_of

#: Hashed n-grams fall into so many buckets; the fitted weights are one array of this length.
BUCKETS = 10_000
#: Keys of trusted documents are listed to every task up to this number; more are joined by shuffles.
LISTED = 2_000_000
#: Pseudo-count of each bucket.
SMOOTHING = 0.5
#: Weights are whole multiples of 1 / SCALE, so that sums don't depend on their order.
SCALE = 1 << 20
#: Documents are rejected when their mean weight falls under the trusted mean by more than so many
#: standard deviations of trusted texts of their length.
DEVIATIONS = 4.0
WINDOW = 8
_LONGS = "array<long>"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _tail(values: Column, start: int, drop: int) -> Column:
    return F.slice(values, F.lit(start), F.greatest(F.size(values) - drop, F.lit(0)))


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours, from the words' hashes (a column of its own)."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.zip_with(_tail(hashes, 1, 1), _tail(hashes, 2, 1),
                      lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(ones, F.when(F.size(hashes) > 1, twos).otherwise(F.array().cast("array<int>")))


class Materialised:
    """Adds columns under new names one projection at a time, so that lambdas only see finished arrays."""

    def __init__(self, docs: DataFrame):
        self.df, self.names, self.first = docs, {}, list(docs.columns)

    def add(self, **columns: Column) -> None:
        for name in columns:
            self.names[name] = fresh(self.df, f"{name}_tmp")
        self.df = self.df.select(*[F.col(f"`{c}`") for c in self.df.columns],
                                 *[c.alias(self.names[n]) for n, c in columns.items()])

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{self.names[name]}`")


def base_rules(docs: DataFrame, text: str = "text") -> Materialised:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and hashes."""
    m = Materialised(docs)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    m.add(words=words_of(raw))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m.add(hashes=_hashes(m["words"]), n_words=F.size(m["words"]).cast("long"),
          word_chars=F.length(F.translate(raw, " \t\n\x0b\f\r", "")).cast("long"),
          n_symbols=(F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("long"), lines=lines)
    shifted = F.arrays_zip(*[_tail(m["hashes"], k + 1, WINDOW - 1).alias(f"w{k}") for k in range(WINDOW)])
    m.add(windows=F.when(m["n_words"] >= WINDOW, F.transform(shifted, lambda s: F.xxhash64(s))).otherwise(F.array().cast(_LONGS)),
          n_dup_lines=(F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))).cast("long"))
    repeats = F.size(F.array_distinct(m["windows"])) < F.size(m["windows"])
    m.add(ordered=F.when(repeats, F.sort_array(F.transform(m["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.zip_with(_tail(m["ordered"], 1, 1), _tail(m["ordered"], 2, 1),
                                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    m.add(places=F.when(m["ordered"].isNotNull(), F.sort_array(F.array_distinct(F.flatten(twice)))))
    after = F.concat(_tail(m["places"], 2, 1), F.array(F.element_at(m["places"], -1) + WINDOW))
    covered = F.aggregate(F.zip_with(m["places"], after, lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long")),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    m.add(n_repeat_words=F.when(m["places"].isNotNull(), covered).otherwise(F.lit(0).cast("long")))
    m.add(base_failed=(m["n_words"] < 20) | (m["n_repeat_words"] * 100 > m["n_words"] * 30))
    return m


@dataclass(frozen=True)
class Ratio:
    """Fitted weights of the buckets, and how trusted documents score by them."""
    weights: list[int]
    mean: float = 0.0
    within: float = 0.0
    between: float = 0.0

    def least(self, count: Column, deviations: float) -> Column:
        """The threshold of a text with ``count`` n-grams."""
        return F.lit(self.mean) - F.lit(deviations) * F.sqrt(F.lit(self.between) + F.lit(self.within) / count)


def _scores(m: Materialised, weights: list[int], buckets: int) -> None:
    """Add count and score, from hashes. The weights are a constant of ``buckets`` numbers in the plan."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast(_LONGS)
    m.add(grams=ngram_buckets(m["hashes"], buckets))
    m.add(total=F.aggregate(m["grams"], F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1)),
          count=F.size(m["grams"]))
    m.add(score=F.when(m["count"] > 0, m["total"] / F.lit(float(SCALE)) / m["count"]))


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> Ratio:
    """Log ratio of the trusted and the raw multinomial for each bucket, as whole multiples of 1 / SCALE.

    Raw counts cover every document and target counts every trusted one. ``trusted`` holds the keys of
    trusted documents. Without trusted documents or n-grams all weights are 0. ``within`` is the variance of one n-gram's weight in trusted texts, ``between`` what
    the variance of their scores has beyond it.
    """
    chosen = trusted.select(F.col(key).alias("trusted_key")).dropna().distinct()
    chosen = F.broadcast(chosen) if chosen.count() <= LISTED else chosen.hint("merge")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body"))
    is_trusted = F.col("key") == F.col("trusted_key")
    m = Materialised(texts.join(chosen, is_trusted, "left"))
    m.add(hashes=_hashes(words_of(F.col("body"))))
    counted = m.df.select(F.col("trusted_key").isNotNull().cast("long").alias("good"),
                          F.explode(ngram_buckets(m["hashes"], buckets)).alias("bucket"))
    rows = counted.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # `buckets` rows at most
    raw, good = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    n_raw, n_good = sum(raw), sum(good)
    if not n_good:
        return Ratio([0] * buckets)
    share = lambda count, n: (count + SMOOTHING) / (n + SMOOTHING * buckets)
    weights = [round(math.log(share(g, n_good) / share(r, n_raw)) * SCALE) for g, r in zip(good, raw)]
    mean = sum(g * w for g, w in zip(good, weights)) / SCALE / n_good
    within = sum(g * (w / SCALE - mean) ** 2 for g, w in zip(good, weights)) / n_good
    m = Materialised(texts.join(chosen, is_trusted, "left_semi"))
    m.add(hashes=_hashes(words_of(F.col("body"))))
    _scores(m, weights, buckets)
    # whole multiples again, so that the sums are the same in any order
    whole = F.round(m["score"] * SCALE).cast("decimal(38,0)")
    seen = m.df.agg(
        F.count(whole).alias("n"), F.sum(whole).alias("s"), F.sum((whole * whole).cast("decimal(38,0)")).alias("q"),
        F.sum(F.when(m["count"] > 0, F.round(F.lit(within) / m["count"] * SCALE * SCALE).cast("decimal(38,0)"))).alias("w")).first()
    centre = float(seen["s"]) / seen["n"] / SCALE
    spread = float(seen["q"]) / seen["n"] / SCALE ** 2 - centre ** 2 - float(seen["w"]) / seen["n"] / SCALE ** 2
    return Ratio(weights, centre, within, max(spread, 0.0))


def judge(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS,
          deviations: float = DEVIATIONS) -> Materialised:
    """Base rules, and columns score (mean weight of the n-grams), least (the threshold) and kept.

    A document is kept when no base rule fails and its score reaches the trusted documents' mean
    less ``deviations`` standard deviations of a trusted text with as many n-grams. Null and empty
    texts have no words and fail the base rules. Equal texts get equal verdicts; rows and other
    columns stay as they are. Null keys are never trusted.
    """
    ratio = fit(docs, trusted, text, key, buckets)
    m = base_rules(docs, text)
    _scores(m, ratio.weights, buckets)
    m.add(least=F.when(m["count"] > 0, ratio.least(m["count"], deviations)))
    m.add(kept=~m["base_failed"] & F.coalesce(m["score"] >= m["least"], F.lit(False)))
    return m


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document; ``labels`` (doc_id, quality) says which are trusted (quality 1)."""
    m = judge(docs.select("doc_id", "text"), labels.filter("quality = 1").select("doc_id"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "least")
    return m.df.select("doc_id", *[m[n].alias(n) for n in shown])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    m = judge(docs, labels.filter("quality = 1").select("doc_id"))
    # the number of the row only holds the filter above the finished arrays: a filter that is pushed
    # below them writes their expressions into the lambdas, which then compute them for every word
    m.add(row=F.monotonically_increasing_id())
    return m.df.filter(m["kept"] & (m["row"] >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
