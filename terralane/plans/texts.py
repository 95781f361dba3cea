"""Queries for text and vector ranking."""

from pyspark.sql import functions as F

from terralane.operators import text as X
from terralane.plans.layers import rounded
from terralane.plans.registry import query

QUESTION = "The hand of the onesen and ndwhst, reshand"
TERMS = "(values ('the',2),('hand',1),('of',1),('onesen',1),('and',1),('ndwhst',1),('reshand',1)) q(w, times)"

BM25 = f"""t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') as ws from documents),
n as (select count(*) as n, avg(len(ws)) as av from t),
f as (select doc_id, len(ws) as l, w, len(list_filter(ws, lambda x: x=w)) as tf, times from t cross join {TERMS}),
d as (select w, count(*) filter (where tf>0) as df from f group by w),
s as (select doc_id, sum(case when tf>0 then times*ln((n-df+0.5e0)/(df+0.5e0)+1)*tf*2.5e0/(tf+1.5e0*(0.25e0+0.75e0*l/av)) else 0 end) as score
 from f join d using (w) cross join n group by doc_id)"""


@query("bm25_x1", f"with {BM25} select doc_id, round(score,6) as score from s where score>0 order by s.score desc, doc_id limit 10")
def _(fx):
    return rounded(X.bm25(fx.documents, QUESTION, 10), 6, "score")


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]
VEC = "[" + ",".join(f"{v}e0" for v in QUERY_VECTOR) + "]"
COS = f"""c as (select vec_id, list_dot_product(embedding::double[], {VEC}::double[])
 /(sqrt(list_dot_product(embedding::double[], embedding::double[]))*sqrt(list_dot_product({VEC}::double[], {VEC}::double[]))) as score from embeddings)"""


@query("cosine_topk_x2", f"""
with {COS} select vec_id, round(score,6) as score, case when score>=0.85 then 'high' when score>=0.65 then 'medium'
when score>=0.4 then 'low' else 'none' end as confidence from c order by c.score desc, vec_id limit 10""")
def _(fx):
    return rounded(X.cosine_topk(fx.embeddings, QUERY_VECTOR, 10), 6, "score")


@query("cosine_filter_x3", f"with {COS} select vec_id, round(score,6) as score from c where c.score>=0.1")
def _(fx):
    return rounded(X.cosine_filter(fx.embeddings, QUERY_VECTOR, 0.1), 6, "score")


@query("keyword_rank_x4", """
with b as (select doc_id, source, lower(text) as t from documents)
select doc_id, source, case when source in ('src3','src7') then 10.0e0 else 0.0e0 end
+0.5e0*(length(t)-length(replace(t,'forest','')))/6+0.5e0*(length(t)-length(replace(t,'onesen','')))/6
+0.5e0*(length(t)-length(replace(t,'the','')))/3 as relevance from b order by relevance desc, doc_id limit 15""")
def _(fx):
    return X.keyword_rank(fx.documents, "forest onesen of the", {"src3": ["forest"], "src7": ["lake", "ones"], "src9": ["sea"]}, 15)


# the given prose has no headings: every second line start is made one
@query("split_sections_x5", """
with m as (select doc_id, source, replace(replace(text, '.' || chr(10), '.' || chr(10) || '## '), chr(13), '') as t from documents),
s as (select doc_id, source, string_split(regexp_replace(t, '(?m)^(#{1,3} )', chr(1) || '\\1', 'g'), chr(1)) as p from m),
u as (select doc_id, source, unnest(generate_series(1, len(p))) as i, p from s),
r as (select doc_id, source, i-1 as section, p[i] as b from u)
select count(*) as sections, count(distinct doc_id) as docs, cast(sum(length(regexp_extract(b,'^#{1,3} ([^\\n]*)',1))) as bigint) as heading_chars
from r where regexp_extract(b,'^#{1,3} ([^\\n]*)',1)<>'' or trim(regexp_replace(b,'^#{1,3} [^\\n]*\\n?',''), ' ')<>''""")
def _(fx):
    text = F.replace(F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n## ")), F.lit("\r"), F.lit(""))
    out = X.split_sections(fx.documents.withColumn("text", text))
    return out.agg(F.count("*").alias("sections"), F.count_distinct("doc_id").alias("docs"),
                   F.sum(F.length("heading")).alias("heading_chars"))


PAGE_TEXT = """case when page_id%3=0 then concat(t, ' 地址：', replace(t,' ','')) when page_id%3=1 then concat(t, ' 位于 ', replace(t,' ',''), '路')
 else concat(t, '《', substring(t,1,12), '》') end"""


@query("extract_addresses_x6", f"""
with a as (select page_id, regexp_extract(html,'<title>([^<]*)',1) as t, html from pages), b as (select page_id, concat({PAGE_TEXT}, html) as h from a),
c as (select page_id, trim(regexp_extract(h,'([^\\s，,。]+(?:店|馆|厅|吧|咖啡|餐厅|酒楼|酒店|超市|银行))',1)) as n1, trim(regexp_extract(h,'《([^》]+)》',1)) as n2,
 trim(regexp_extract(h,'地址[：:]\\s*([^\\s，。<]{{5,60}})',1)) as a1, trim(regexp_extract(h,'位于\\s*([^\\s，。<]{{5,60}})',1)) as a2,
 trim(regexp_extract(h,'([^\\s，。]*(?:路|街|道|巷|号)[^\\s，。]*)',1)) as a3, trim(regexp_extract(h,'([^\\s，。]*(?:市|区|县|镇)[^\\s，。]+)',1)) as a4 from b)
select page_id, coalesce(case when length(n1) between 2 and 20 then n1 end, case when length(n2) between 2 and 20 then n2 end) as name,
coalesce(case when length(a1)>=5 then a1 end, case when length(a2)>=5 then a2 end, case when length(a3)>=5 then a3 end, case when length(a4)>=5 then a4 end) as address from c""")
def _(fx):
    t = F.regexp_extract("html", "<title>([^<]*)", 1)
    flat, page = F.replace(t, F.lit(" "), F.lit("")), F.col("page_id")
    text = (F.when(page % 3 == 0, F.concat(t, F.lit(" 地址："), flat))
            .when(page % 3 == 1, F.concat(t, F.lit(" 位于 "), flat, F.lit("路")))
            .otherwise(F.concat(t, F.lit("《"), F.substring(t, 1, 12), F.lit("》"))))
    return X.extract_addresses(fx.pages.withColumn("html", F.concat(text, F.col("html"))))


@query("dedup_prefix_x7", """
select name, rank from (select concat(p_name, ' ', p_type) as name, p_partkey as rank,
row_number() over (partition by substring(concat(p_name,' ',p_type),1,10) order by p_partkey) as rn from part) where rn=1""")
def _(fx):
    hits = fx.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"), F.col("p_partkey").alias("rank"))
    return X.dedup_prefix(hits)


@query("merge_rankings_x8", """
with a as (select c_custkey%997 as key, max(c_acctbal/10000) as score from customer group by 1),
b as (select o_custkey as key, max(o_totalprice/500000) as score from orders group by 1)
select key, round(max(score),6) as score from (select * from a union all select * from b) group by key having max(score)>=0.1
order by max(score) desc, key limit 20""")
def _(fx):
    a = fx.customer.groupBy((F.col("c_custkey") % 997).alias("key")).agg(F.max(F.col("c_acctbal") / 10000).alias("score"))
    b = fx.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.col("o_totalprice") / 500000).alias("score"))
    return rounded(X.merge_rankings(a, b, 20), 6, "score")


@query("normalize_kind_x9", """
select p_partkey as id, case when contains(lower(trim(p_name)),'ring') or contains(lower(trim(p_name)),'widget') then 'shop'
when contains(lower(trim(p_name)),'small') then 'kiosk' when contains(lower(trim(p_name)),'red') then 'station' end as kind from part""")
def _(fx):
    rules = [("shop", ["RING", "widget"]), ("kiosk", ["small"]), ("station", ["Red"])]
    return X.normalize_kind(fx.part, "p_name", rules).select(F.col("p_partkey").alias("id"), "kind")
