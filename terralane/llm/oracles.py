"""DuckDB texts of the text operators that SQL can say in full."""

#: CRC-32 by its table: eight steps for each byte value, then a fold over a word's bytes.
_CRC = """crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0,0,0,0,0,0,0,0]::UBIGINT[]),
                          lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) t(i)))"""

OP11 = f"""WITH {_CRC},
corpus AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
own AS (SELECT rid, unnest(words) AS w FROM corpus),
own_n AS (SELECT rid, w, count(*) AS n FROM own GROUP BY ALL),
aim_n AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM target) GROUP BY ALL),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM own_n UNION ALL SELECT w FROM aim_n)),
bytes AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::UBIGINT) AS b FROM vocab),
bucketed AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM own_n JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM aim_n JOIN bucketed USING (w) GROUP BY bucket),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), total),
weight AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM own_n JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296::DOUBLE)))::BIGINT)::BIGINT AS score
  FROM corpus LEFT JOIN weight USING (rid)),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= (10 * count(*) OVER ()) // 100)
SELECT doc_id, n_features, weight, score, rank::BIGINT AS rank FROM scored LEFT JOIN ranked USING (rid)"""

OP13 = """WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
met AS (SELECT rid, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM met GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM met SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
