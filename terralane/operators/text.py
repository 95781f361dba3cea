"""Ranking, splitting and extraction over text and vector tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from terralane.operators.accumulate import attach_row
from terralane.session import require, spread

# Ranking constants, confidence bands and extraction patterns.
BM25_K1, BM25_B = 1.5, 0.75
CONFIDENCE = ((0.85, "high"), (0.65, "medium"), (0.40, "low"))
MIN_SCORE = 0.1
TOKEN = "[a-z0-9_]+|[\\u4e00-\\u9fff]{2,}"
ADDRESS_PATTERNS = (
    "地址[：:]\\s*([^\\s，。<]{5,60})",
    "位于\\s*([^\\s，。<]{5,60})",
    "([^\\s，。]*(?:路|街|道|巷|号)[^\\s，。]*)",
    "([^\\s，。]*(?:市|区|县|镇)[^\\s，。]+)",
)
NAME_PATTERNS = (
    "([^\\s，,。]+(?:店|馆|厅|吧|咖啡|餐厅|酒楼|酒店|超市|银行))",
    "《([^》]+)》",
)


def tokens(text: Column) -> Column:
    """Lower-case words and runs of at least two CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    low = query.lower()
    return re.findall("[a-z0-9_]+", low) + re.findall("[一-鿿]{2,}", low)


def bm25(docs: DataFrame, query: str, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best documents by BM25 with a positive score.

    Only the query terms are counted, inside each row: the corpus is scanned once and no
    exploded word table is built or shuffled.
    """
    require(docs, doc_id, text)
    terms = query_tokens(query)
    if not terms:
        return docs.select(doc_id).withColumn("score", F.lit(0.0)).limit(0)
    distinct = sorted(set(terms))
    words = spread(docs.select(doc_id, text), doc_id).select(doc_id, tokens(F.col(text)).alias("_w"))
    base = words.select(doc_id, F.size("_w").alias("_len"), F.filter("_w", lambda w: w.isin(distinct)).alias("_t"))
    counts = base.select(doc_id, "_len", *[
        F.size(F.filter("_t", _equals(t))).alias(f"_f{i}")
        for i, t in enumerate(distinct)])
    stats = counts.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[
        F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(distinct))])
    rows = attach_row(counts, stats)
    score = F.lit(0.0)
    for i, term in enumerate(distinct):
        tf, df = F.col(f"_f{i}").cast("double"), F.col(f"_d{i}").cast("double")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5) + 1)
        norm = tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_len") / F.col("_avg"))
        part = F.when(tf > 0, idf * tf * (BM25_K1 + 1) / norm).otherwise(0.0)
        score = score + part * float(terms.count(term))
    out = rows.select(doc_id, score.alias("score")).filter(F.col("score") > 0)
    return out.orderBy(F.col("score").desc(), doc_id).limit(k)


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / F.when(norm > 0, norm).otherwise(1.0)).otherwise(0.0)


def confidence(score: Column) -> Column:
    out = F.lit("none")
    for limit, name in reversed(CONFIDENCE):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_topk(vectors: DataFrame, query, k: int = 5, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k most similar vectors with their confidence band."""
    require(vectors, vec_id, column)
    score = cosine(F.col(column), _vector(query))
    out = vectors.select(vec_id, score.alias("score")).orderBy(F.col("score").desc(), vec_id).limit(k)
    return out.withColumn("confidence", confidence(F.col("score")))


def cosine_filter(vectors: DataFrame, query, threshold: float, vec_id: str = "vec_id",
                  column: str = "embedding") -> DataFrame:
    """All vectors with at least the given similarity."""
    score = cosine(F.col(column), _vector(query))
    return vectors.select(vec_id, score.alias("score")).filter(F.col("score") >= threshold)


def keyword_rank(docs: DataFrame, query: str, categories: dict[str, list[str]], k: int = 3,
                 doc_id: str = "doc_id", text: str = "text", category: str = "source") -> DataFrame:
    """10 points for a category the query mentions, 0.5 per occurrence of longer query words."""
    low = query.lower()
    hit = [c for c, words in categories.items() if any(w in low for w in words)]
    body = F.lower(F.col(text))
    score = F.when(F.col(category).isin(hit), 10.0).otherwise(0.0) if hit else F.lit(0.0)
    for word in low.split():
        if len(word) > 2:
            shrunk = F.length(body) - F.length(F.replace(body, F.lit(word)))
            score = score + shrunk / float(len(word)) * 0.5
    out = docs.select(doc_id, category, score.alias("relevance")).filter(F.col("relevance") > 0)
    return out.orderBy(F.col("relevance").desc(), doc_id).limit(k)


def split_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Sections at lines that start with #, ## or ###: doc_id, source, section, heading, body.

    The text before the first heading is section 0. The split happens inside each row, so a
    long document never becomes a group to gather.
    """
    require(docs, doc_id, text, source)
    # split before every heading line; a heading at the very start leaves no part before it
    shift = F.when(F.col(text).rlike("^#{1,3} "), 1).otherwise(0)
    parts = F.transform(F.split(text, "(?m)(?=^#{1,3} )"), lambda p, i: F.struct((i + shift).alias("section"), p.alias("body")))
    out = spread(docs, doc_id).select(doc_id, source, F.explode(parts).alias("p"))
    first_line = F.regexp_extract("p.body", "^#{1,3} ([^\n]*)", 1)
    body = F.regexp_replace("p.body", "^#{1,3} [^\n]*\n?", "")
    rows = out.select(doc_id, source, F.col("p.section").cast("long").alias("section"), first_line.alias("heading"),
                      F.trim(body).alias("body"))
    return rows.filter((F.col("heading") != "") | (F.col("body") != ""))


def first_match(text: Column, patterns, low: int, high: int | None = None) -> Column:
    """First capture of the first pattern whose trimmed length fits."""
    tries = []
    for p in patterns:
        got = F.trim(F.regexp_extract(text, p, 1))
        fits = F.length(got) >= low
        if high is not None:
            fits = fits & (F.length(got) <= high)
        tries.append(F.when(fits, got))
    return F.coalesce(*tries)


def extract_addresses(pages: DataFrame, page_id: str = "page_id", text: str = "html",
                      patterns=ADDRESS_PATTERNS, names=NAME_PATTERNS) -> DataFrame:
    """Name and address per page by ordered patterns over the whole text."""
    require(pages, page_id, text)
    return pages.select(page_id, first_match(F.col(text), names, 2, 20).alias("name"),
                        first_match(F.col(text), patterns, 5).alias("address"))


def dedup_prefix(df: DataFrame, name: str = "name", order: str = "rank", n: int = 10) -> DataFrame:
    """First row in ``order`` per first ``n`` characters of the name.

    A minimum over structs needs no sort and combines before the shuffle.
    """
    require(df, name, order)
    rest = [c for c in df.columns if c != order]
    best = df.groupBy(F.substring(F.col(name), 1, n).alias("_p")).agg(F.min(F.struct(order, *rest)).alias("m"))
    return best.select(*[F.col("m." + c).alias(c) for c in df.columns])


def merge_rankings(a: DataFrame, b: DataFrame, k: int = 5, key: str = "key", min_score: float = MIN_SCORE) -> DataFrame:
    """Union of two rankings: the higher score per key, floor, best k."""
    both = a.select(key, "score").unionByName(b.select(key, "score"))
    out = both.groupBy(key).agg(F.max("score").alias("score")).filter(F.col("score") >= min_score)
    return out.orderBy(F.col("score").desc(), key).limit(k)


def normalize_kind(df: DataFrame, column: str, rules: list[tuple[str, list[str]]], out: str = "kind") -> DataFrame:
    """First kind, in rule order, one of whose spellings occurs in the trimmed text; else null."""
    require(df, column)
    text = F.lower(F.trim(F.col(column)))
    kind = F.lit(None).cast("string")
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.lower())
        kind = F.when(hit, name).otherwise(kind)
    return df.withColumn(out, kind)
