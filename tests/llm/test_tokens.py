"""Pieces, ids, counts and token files against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralane.llm import bpe, pretoken, token_count

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["a", "don't", "'", "'s", "'ll", "'re", "'x", " ", "  ", "\n", "\t", " \n ", "1", "23", "²", "é", "漢字", "\U0001F600", "!", "!!", "　", "\xa0", "\x1c", "\x85",
            "the", "THE", "́", "‍", "_", "\x00", "'Ve", "<|endoftext|>", "\U0001E900", "\U00016D40", "٣"]
    out = [None, "", " ", "\n", "'", "  '", "x" * 5000, " " * 3000, "ab" * 40_000, "'s" * 100, "e" * 49, "<|endoftext|>", "  <|endoftext|>  x"]
    out += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return out + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [*enumerate(texts), (None, "no key"), (3, "\n"), (3, "\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("ids", F.lit(1)), rows


def test_pieces_of_every_code_point():
    single = tiktoken.Encoding("single", pat_str=P.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    for shape in ("x%sx ", "1%s1", "!%s!", " %s", "%s's"):
        text = "".join(shape % chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        mine = b"".join(pretoken.pieces([text])[0])
        assert mine == text.encode() == bytes(single.encode_ordinary(text))
    # boundaries: the library's pieces seen through a vocabulary without merges are not visible, so compare counts by class
    assert pretoken.pieces(["a b  c\n\nd 's's ''s it's I'll!'s 12a"])[0] == [
        b"a", b" b", b" ", b" c", b"\n", b"\n", b"d", b" '", b"s", b"'s", b" ''", b"s", b" it", b"'s", b" I", b"'ll", b"!'", b"s", b" 12", b"a"]


def test_monoid_is_small():
    numbers, then, functions, _ = pretoken._monoid()
    assert len(functions) < 256 and (then[0] == np.arange(len(functions))).all()


def test_round_trip(spark, docs, library):
    df, rows = docs
    got = sorted(map(tuple, bpe.round_trip_report(df, RANKS).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_offsets(texts, library):
    tool = bpe.codec(open(RANKS, "rb").read())
    for text, (ids, ends) in zip(texts[200:300], tool.encode(texts[200:300])):
        assert ids.tolist() == library.encode_ordinary(text)
        assert [text.encode()[a:b] for a, b in zip([0, *ends[:-1]], ends)] == library.decode_tokens_bytes(ids.tolist())


def test_counts(spark, docs):
    df, rows = docs
    tool = Tokenizer.from_file(JSON)
    got = sorted(map(tuple, token_count.count_tokens(df, JSON).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(tool.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_empty_table(spark, docs):
    none = docs[0].limit(0)
    assert bpe.round_trip_report(none, RANKS).count() == token_count.count_tokens(none, JSON).count() == 0
