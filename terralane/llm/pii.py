"""Personal data: expressions propose spans, check sums confirm them, words nearby adjust the score.

Everything is a column expression; no Python runs on the executors. Each text is
judged alone, so no row moves and copies or hot sources cost nothing extra.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralane.llm.common import fresh, prefix_sums

#: How far around a match its context words may stand, in code points.
REACH = 48
#: A span that only the method proposes is reported from this score on.
REPORT_FROM = 0.6


def _digits(match: Column) -> Column:
    return F.translate(match, "+() .-", "")


def _small_parts(match: Column) -> Column:
    """All dotted parts at most 255; leading zeros don't count."""
    part_ok = lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return F.forall(F.split(match, r"\."), part_ok)


def luhn(digits: Column) -> Column:
    """Does a string of digits end in its Luhn check digit?"""
    each = F.transform(F.array_remove(F.split(F.reverse(digits), ""), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an account number without blanks leave 1 when divided by 97, its first four characters last?"""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c <= "9", (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.array_remove(F.split(turned, ""), ""), F.lit(0), lambda a, c: step(a, c)) == 1


@dataclass(frozen=True)
class Kind:
    """One kind of span: how it is proposed, confirmed and scored."""
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    context: str
    score: float
    bonus: float = 0.3
    base: bool = False
    needs: str = ""


def _length(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


#: Matches start where a run of their first class starts (or where the last match ended), and
#: repeat possessively: the same matches as the plain patterns, without quadratic rescans.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, "mail|contact|write|address|kontakt|correo|courriel", 0.7, base=True, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _small_parts, "ip|host|server|address|login|client", 0.6, base=True, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.when(_length(12, 19)(m), luhn(_digits(m))).otherwise(False),
         "card|visa|credit|payment|karte|tarjeta|carte", 0.7, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _length(9, 15), "phone|call|tel|mobile|fax", 0.6, base=True, needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
         lambda m: F.when(F.length(F.translate(m, " ", "")).between(15, 34), mod97(F.translate(m, " ", ""))).otherwise(False),
         "iban|account|bank|konto|cuenta|compte", 0.7),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), "ssn|social|security", 0.4, needs="-"),
)


def _proposed(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The matches of a kind, and the texts between them (one more)."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    if kind.needs:
        there = F.contains(text, F.lit(kind.needs))
        return (F.when(there, found).otherwise(F.array().cast("array<string>")),
                F.when(there, gaps).otherwise(F.array(text)))
    return found, gaps


def _judged(kind: Kind, order: int, found: Column, gaps: Column, before: Column) -> Column:
    """Structs of the matches that hold; ``before``: code points before each pair of gap and match."""
    heard = lambda side: F.lower(side).rlike(rf"\b({kind.context})")

    def one(m: Column, i: Column) -> Column:
        start = F.get(before, i) + F.length(F.get(gaps, i))
        near = heard(F.right(F.get(gaps, i), F.lit(REACH))) | heard(F.left(F.get(gaps, i + 1), F.lit(REACH)))
        return F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + F.length(m)).alias("end"),
                        F.lit(kind.name).alias("kind"), m.alias("match"),
                        F.round(F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0.0), 2).alias("score"))

    holds = lambda s: kind.valid(s["match"]) if kind.valid else F.lit(True)
    if not kind.base:
        holds = lambda s: (s["score"] >= REPORT_FROM) & kind.valid(s["match"])
    spans = F.filter(F.transform(found, one), holds)
    return F.when(F.size(found) > 0, spans)


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add an array of structs ``(start, rank, end, kind, match, score)``, sorted by start and kind.

    Offsets are code points, ends exclusive. The base kinds are reported whenever
    their check holds; the others from a score of ``REPORT_FROM`` on. Null and empty
    texts have no spans; repeated rows get equal spans; other columns are kept, and
    ``into`` must not be one of them. Spans of different kinds may overlap.
    """
    if fresh(docs, into) != into:
        raise ValueError(f"a column {into} is there already")
    names = {}
    for kind in KINDS:
        for part in ("found", "gaps", "sizes", "before"):
            names[kind.name, part] = fresh(docs, f"{kind.name}_{part}_")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    at = lambda k, part: F.col(f"`{names[k.name, part]}`")
    out = docs.select(*keep, *[c.alias(names[k.name, part]) for k in KINDS
                               for part, c in zip(("found", "gaps"), _proposed(body, k))])
    out = out.select(*out.columns, *[F.zip_with(
        at(k, "found"), F.slice(at(k, "gaps"), F.lit(1), F.size(at(k, "found"))),
        lambda m, g: (F.length(m) + F.length(g)).cast("long")).alias(names[k.name, "sizes"]) for k in KINDS])
    out = out.select(*out.columns, *[F.when(F.size(at(k, "found")) > 0, prefix_sums(at(k, "sizes"))).alias(names[k.name, "before"]) for k in KINDS])
    judged = [_judged(k, i, at(k, "found"), at(k, "gaps"), at(k, "before")) for i, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string,score:double>>")
    return out.select(*keep, F.sort_array(F.concat(*[F.coalesce(j, none) for j in judged])).alias(into))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, and all spans."""
    base = [k.name for k in KINDS if k.base]
    found = find_personal_data(docs.select("doc_id", "text"))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))
