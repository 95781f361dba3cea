"""Personal data against a plain search with Python's expressions."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from terralane.llm import pii

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if holds(k, m[0])]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return [sum(x[3] == k for x in spans) for k, _ in PLAIN], hashlib.sha256(joined.encode()).hexdigest(), joined


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)  # not evaluated while planning
    got = sorted(map(tuple, pii.personal_data_report(df).drop("scores").collect()), key=str)
    want = sorted(((i, *plain(t)[0], plain(t)[1]) for i, t in rows), key=str)
    assert [g[:6] for g in got] == want
    for g in got:
        base = ",".join(x for x in g[6].split(",") if x.split(":")[0] in ("email", "ip", "card", "phone"))
        assert hashlib.sha256(base.encode()).hexdigest() == g[5]


def test_edges_and_random(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "+x@d.e", "@", ".", "1.2.3.4", "256.1.1.1", "00012.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999",
            "+", "é", "漢", "\U0001F600", " ", "-", "\n", "x@y", "a..b@c-.d", "9" * 30, "DE89 3704 0044 0532 0130 00", "123-45-6789", "+1((("]
    rows = [(None, "a@b.co"), (0, None), (1, ""), (2, "a@b.c+x@d.e.f@g.h"), (2, "a@b.c+x@d.e.f@g.h"), (3, "1.2.3.4.5.6.7.8.9")]
    rows += [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(10, 400)]
    rows += [(1000, "word " * 300_000 + "me@x.org"), (1001, "a" * 200_000), (1002, "1 " * 100_000), (1003, "k@v.io " * 20_000)]
    check(spark, rows)


def test_given_documents(spark):
    rows = duckdb.sql("select doc_id, text from read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()
    check(spark, rows)


def test_scores_and_checks(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 ok"), (2, "DE88370400440532013000"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("scores", F.lit(1)).withColumn("start", F.lit(2))
    got = {r["doc_id"]: [s["kind"] for s in r["pii"]] for r in pii.find_personal_data(df, into="pii").collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: []}
    assert pii.personal_data_report(df.limit(0)).count() == 0
