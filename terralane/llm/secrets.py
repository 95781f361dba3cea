"""Secrets: fixed expressions, and strings that a primed compressor finds new.

A context is a line with a sensitive word and the lines next to it. Every string there that may be a
secret by its look is measured by the bytes it adds to a zstandard frame of the code around it, primed with the identifiers that the corpus uses in such lines. Names and prose cost
little, since their parts are known; random strings cost nearly their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm import pretoken

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")           # of maximal runs, those of 20 and more characters
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
#: Words that make a context sensitive.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "private", "credential", "auth", "bearer", "signature")
#: What may be a secret by its look: so long, with letters and digits.
LEAST = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: A line that holds nothing but one such run goes on with the value of the line before.
_WRAPPED = re.compile(rf"[^A-Za-z0-9+/_=-]*+[A-Za-z0-9+/_=-]{{{LEAST},}}+[^A-Za-z0-9+/_=-]*+")
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z0-9 ]+-----"), "-----END"
#: Of the body of a PEM block, what is not an escaped line end.
_BODY = re.compile(r"\\[nrt]|([A-Za-z0-9+/=]+)")
#: How much code on either side primes the frame, and the bytes a character must add to count as new.
AROUND = 256
NOVEL = 0.7
#: The dictionary takes so many identifiers, the most frequent ones (ties by name).
IDENTIFIERS = 4096
MARK = "[secret]"
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
_HINTS = ("pass", "secret", "token", "api", "private", "cred", "auth", "bearer", "signature")


def identifier_dictionary(docs: DataFrame, text: str = "text", limit: int = IDENTIFIERS) -> bytes:
    """The identifiers of letters and underscores met most often in lines with a sensitive word, over all documents, rarest first."""
    pattern = f"(?i)({'|'.join(SENSITIVE)})"
    lines = docs.select(F.col(f"`{text}`").alias("text")).filter(F.col("text").rlike(pattern)).select(F.explode(F.split("text", "\n")).alias("line"))
    # of a line that is a whole page, what stands near the sensitive words
    parts = lines.select(F.explode(F.regexp_extract_all("line", F.lit(f"(?i).{{0,{AROUND}}}(?:{'|'.join(SENSITIVE)}).{{0,{AROUND}}}"), F.lit(0))).alias("part"))
    words = parts.select(F.explode(F.regexp_extract_all("part", F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]{4,32}(?![A-Za-z0-9_])"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().filter("count > 1").orderBy(F.desc("count"), "word").limit(limit).collect()
    return "\n".join(r["word"] for r in reversed(top)).encode()


def looks(text: str) -> bool:
    """May it be a secret?"""
    return len(text) >= LEAST and bool(_DIGIT.search(text)) and bool(_LETTER.search(text))


def contexts(text: str) -> list[tuple[int, int, bool]]:
    """Sensitive lines (from, to, False) in order; bodies of PEM blocks (from, to, True) come before their lines.

    These are lines with a sensitive word, those next to them (blank ones aside), lines that go on with a wrapped value, and
    all lines of a PEM block that begins in one of them.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        if line and not line.isspace():
            lines.append((at, line))
        at += len(line) + 1
    named = [bool(_SENSITIVE.search(line)) for _, line in lines]
    out, within, until = [], False, 0
    for k, (at, line) in enumerate(lines):
        near = any(named[max(0, k - 1):k + 2])
        if not (near or at < until or within and _WRAPPED.fullmatch(line)):
            within = False
            continue
        within = True
        for m in _BEGIN.finditer(line):
            if at + m.start() >= until:
                stop = text.find(_END, at + m.end())
                until = stop if stop >= 0 else len(text)
                if stop >= 0:
                    out.append((at + m.end(), stop, True))
        out.append((at, at + len(line), False))
    return out


class Scanner:
    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        self.frame = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)

    def added(self, before: str, candidate: str, after: str) -> float:
        """Marginal compressed bytes for each byte of the candidate, next to the code around it."""
        around = before + "\n" + after
        bare, whole = (len(self.frame.compress(x.encode())) for x in (around, around + candidate))
        return (whole - bare) / len(candidate.encode())

    def base(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """(start, rank, end, kind, where the secret itself begins) of the fixed expressions."""
        found = []
        low = text.lower()
        if any(w in low for w in ("pass", "secret", "token", "api")):
            found += [(m.start(), 0, m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end(), "hex", m.start()) for m in HEX.finditer(text)]
        return sorted(found)

    def scan(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """The base spans, and novel strings that none of them touches."""
        found = self.base(text)
        low = text.lower()
        if not any(w in low for w in _HINTS):
            return found
        starts, reach = [x[0] for x in found], list(accumulate((x[2] for x in found), max))

        def new(start: int, stop: int, body: str) -> bool:
            """Is the string novel, and does no base span touch it?"""
            k = bisect_left(starts, stop)
            return not (k and reach[k - 1] > start) and self.added(text[max(0, start - AROUND):start], body, text[stop:stop + AROUND]) >= NOVEL

        bodies: tuple[list[int], list[int]] = [], []
        for low, high, block in contexts(text):
            if block:
                pieces = [m for m in _BODY.finditer(text, low, high) if m[1]]
                body = "".join(m[1] for m in pieces)
                if looks(body) and new(pieces[0].start(), pieces[-1].end(), body):
                    found.append((pieces[0].start(), 3, pieces[-1].end(), "novel", pieces[0].start()))
                    bodies[0].append(pieces[0].start())
                    bodies[1].append(pieces[-1].end())
                continue
            for m in _RUN.finditer(text, low, high):
                k = bisect_left(bodies[0], m.end())
                if k and bodies[1][k - 1] > m.start():
                    continue
                words = [x.span() for x in _SENSITIVE.finditer(m[0])]
                edges = [m.start(), *(m.start() + x for w in words for x in w), m.end()]
                hits = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if looks(text[s:e]) and new(s, e, text[s:e])]
                if words and not hits and looks(m[0]) and new(*m.span(), m[0]):
                    hits = [m.span()]
                found += [(s, 3, e, "novel", s) for s, e in hits]
        return sorted(found)

    def redacted(self, text: str) -> str:
        """The text with every secret replaced by a mark; of an assignment, the value."""
        out, at = [], 0
        for s, e in sorted((x[4], x[2]) for x in self.scan(text)):
            if s >= at:
                out += [text[at:s], MARK]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text


@lru_cache(maxsize=2)
def scanner(dictionary: bytes) -> Scanner:
    return Scanner(dictionary)


def span_text(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind, _ in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", dictionary: bytes | None = None) -> DataFrame:
    """Columns key, n_assign, n_access, n_hex, base_spans and spans (``kind:start:end``, code points, joined by commas).

    Novel strings have kind ``novel`` and never touch a base span. Null and empty texts have no spans;
    repeated rows get equal spans; other columns are left out. Each row is scanned alone; only the
    dictionary (bounded by ``IDENTIFIERS``) is gathered from the corpus.
    """
    primer = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, text) if dictionary is None else dictionary)

    def run(batches):
        tool = scanner(primer.value)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, "text"):
                found = [tool.scan(t) for t in texts]
                base = [[x for x in f if x[1] < 3] for f in found]
                counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), *counts, pa.array(map(span_text, base), pa.string()),
                                                  pa.array(map(span_text, found), pa.string())], ["key", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"])

    given = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {given.schema['key'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return given.mapInArrow(run, schema).withColumnRenamed("key", key)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", dictionary: bytes | None = None) -> DataFrame:
    """All rows and columns, with secrets in ``text`` replaced by ``MARK``; a column ``length`` follows changed texts."""
    primer = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs, text) if dictionary is None else dictionary)
    names = docs.columns

    def run(batches):
        tool = scanner(primer.value)
        for batch in batches:
            for start, texts in pretoken.chunks(batch, text):
                part = batch.slice(start, len(texts))
                was = part.column(text).to_pylist()
                new = [None if t is None else tool.redacted(t) for t in was]
                part = part.set_column(names.index(text), text, pa.array(new, batch.schema.field(text).type))
                if length in names and pa.types.is_integer(batch.schema.field(length).type):
                    sizes = [n if a == b else len(b) for n, a, b in zip(part.column(length).to_pylist(), was, new)]
                    part = part.set_column(names.index(length), length, pa.array(sizes, batch.schema.field(length).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
