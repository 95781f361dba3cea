"""Token files against the library, and Elias-Fano coding against plain arrays."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terralane.llm import token_files
from terralane.llm.elias_fano import SAMPLE, EliasFano


@given(st.lists(st.integers(0, 1 << 40), max_size=400))
@settings(max_examples=150, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    code = EliasFano.of(np.array(values, np.int64))
    assert code.all().tolist() == values
    assert [code[i] for i in range(len(values))] == values
    for start in range(0, len(values) + SAMPLE, SAMPLE):
        for stop in (start + 1, start + SAMPLE, start + 2 * SAMPLE + 7):
            assert code.part(start, stop).tolist() == values[start:stop]


def test_elias_fano_is_small_and_refuses_disorder():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 28, 100_000))
    code = EliasFano.of(values)
    assert code[77_777] == values[77_777]
    assert len(code.low) + len(code.high) < len(values) * (2 + np.log2((1 << 28) / len(values)) + 1) / 8
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


@pytest.mark.parametrize("block", [token_files.BLOCK_IDS, 300])
def test_files(spark, tmp_path, monkeypatch, block):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id desc").fetchall()
    rows += [(None, "no key"), (None, None), (-7, "minus"), (1 << 50, ""), (900, "a <|endoftext|> b  <|endoftext|>"), (901, "x" * 100_000), (902, "same"), (902, "same"), (902, "another")]
    tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if block != token_files.BLOCK_IDS:      # several blocks to a shard, in this process
        blocks, out = token_files._Blocks(0, 2), []
        monkeypatch.setattr(token_files, "BLOCK_IDS", block)
        enc = token_files.LibraryEncoder(open(P.path("byte_bpe_50k.json"), "rb").read())
        for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            out += blocks.add(k, enc.encode([t or ""])[0] + np.array([2], "<u2").tobytes())
        out += blocks.close()
        assert len(out) > 10
        spark.createDataFrame([r for b in out for r in b.to_pylist()], token_files.SCHEMA).write.parquet(str(tmp_path / "t"))
        back = token_files.read_token_files(spark, str(tmp_path / "t")).collect()
        got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in back]
    else:
        got = [tuple(r) for r in token_files.token_file_report(df, str(tmp_path / "t"), P.path("byte_bpe_50k.json")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents_by_key(spark, tmp_path):
    """Single documents by halving and select equal the rows of the whole read."""
    rows = [(None, "none"), *((7 * i - 500, f"text {i} " * (i % 9)) for i in range(3000)), (67, "twice"), (10**12, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_token_files(df, str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    whole = [tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()]
    keys = [-500, 67, 71, 7 * 2999 - 500, 10**12, -10**9]
    got = [tuple(r) for r in token_files.read_documents(spark, str(tmp_path / "t"), keys).collect()]
    assert sorted(got) == sorted(r for r in whole if r[0] in keys) and len(got) == 5
    assert token_files.read_documents(spark, str(tmp_path / "t"), []).count() == 0


def test_other_tokenizers_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "Some  Words here"), (2, "")], "doc_id long, text string")
    path = P.path("word_bpe_49k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.token_file_report(df, str(tmp_path / "a"), path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("Some  Words here", add_special_tokens=False).ids) + 1, 2: 1}
    assert token_files.token_file_report(df.limit(0), str(tmp_path / "b"), path).count() == 0


def test_joined_pieces_are_those_of_the_library():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        content = f.read()
    choose = random.Random(5)
    letters = " \n\t'aé中　\x1c\x85 9½stdmrevl.!😀́ǅ"
    texts = ["".join(choose.choice(letters) for _ in range(choose.randrange(60))) for _ in range(4000)] + ["<|endoftext|> a b", " ", " \x1c", ""]
    tool = token_files.LibraryEncoder(content)
    found = [np.frombuffer(ids, f"<u{tool.id_bytes}").tolist() for ids in tool.encode(texts)]
    assert found == [e.ids for e in Tokenizer.from_str(content.decode()).encode_batch(texts, add_special_tokens=False)]


def test_known_pieces_are_forgotten_in_time(monkeypatch):
    """With room for few pieces, and over many chunks, ids stay those of the library."""
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 50)
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        content = f.read()
    choose, tool = random.Random(6), token_files.LibraryEncoder(content)
    plain = Tokenizer.from_str(content.decode())
    for _ in range(40):
        texts = [" ".join(choose.choice("abcdefgh") * choose.randint(1, 5) for _ in range(30)) for _ in range(3)] + ["", "x" * 3000]
        found = [np.frombuffer(ids, f"<u{tool.id_bytes}").tolist() for ids in tool.encode(texts)]
        assert found == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
