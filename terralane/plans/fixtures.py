"""Spatial layers derived from the given tables; each body runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terralane.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


BODIES = {
    "fx_places": """select c_custkey as id, 116.0e0 + ((c_custkey*7919)%10007)/10007.0e0 as x,
        39.5e0 + ((c_custkey*6271)%10009)/10009.0e0 as y, c_acctbal as v,
        c_nationkey as grp from customer""",
    "fx_facilities": """select s_suppkey as id, 116.0e0 + ((s_suppkey*4513)%10007)/10007.0e0 as x,
        39.5e0 + ((s_suppkey*3571)%10009)/10009.0e0 as y, s_acctbal as v from supplier""",
    "fx_districts": """select n_nationkey as id, n_name as name,
        116.0e0+(n_nationkey%5)*0.2e0 as minx, 39.5e0+floor(n_nationkey/5.0e0)*0.2e0 as miny,
        116.2e0+(n_nationkey%5)*0.2e0 as maxx, 39.7e0+floor(n_nationkey/5.0e0)*0.2e0 as maxy,
        n_regionkey as grp from nation""",
    "fx_pois": """select p_partkey as id, concat('poi_', cast(p_partkey as varchar(20))) as name,
        p_partkey%6 as kind, 116.0e0+((p_partkey*2741)%10007)/10007.0e0 as x,
        39.5e0+((p_partkey*1979)%10009)/10009.0e0 as y from part""",
    "fx_dem": """select cast(floor(o_orderkey/500.0e0) as int) as r, cast(o_orderkey%500 as int) as c,
        100.0e0+2*floor(o_orderkey/500.0e0)+0.5e0*(o_orderkey%500)+((o_orderkey*37)%17) as v
        from orders""",
    "fx_bands": """select cast(floor(o_orderkey/500.0e0) as int) as r, cast(o_orderkey%500 as int) as c,
        b.band as band, case when b.band=4 then 500.0e0+(o_orderkey*13)%700
        else 900.0e0+(o_orderkey*29)%1500 end as v
        from orders cross join (select 4 as band union all select 8 as band) b""",
    # twelve bands, so that every index has its inputs
    "fx_scene": """select cast(floor(o_orderkey/500.0e0) as int) as r, cast(o_orderkey%500 as int) as c,
        b.band as band, 300.0e0+100*b.band+(o_orderkey*(7+2*b.band))%(500+50*b.band) as v
        from orders cross join (select n_nationkey as band from nation
        where n_nationkey between 1 and 12) b""",
    "fx_edges": """select p_partkey as src, p_partkey+1 as dst, 100.0e0+(p_partkey*31)%50 as length
        from part where p_partkey%40<39 union all
        select a.p_partkey, a.p_partkey+40, 100.0e0+(a.p_partkey*17)%50
        from part a join part b on b.p_partkey=a.p_partkey+40""",
    "fx_track": """select user_id as track, event_id as id, ts as tm,
        116.0e0+((event_id*3307)%10007)/10007.0e0 as x,
        39.5e0+((event_id*8123)%10009)/10009.0e0 as y, value as speed from events""",
    "fx_cloud": """select o_orderkey as id, 500000.0e0+(o_orderkey*7919)%10007/10.0e0 as x,
        4400000.0e0+(o_orderkey*6271)%10009/10.0e0 as y,
        50.0e0+(o_orderkey*911)%1000/20.0e0 as z,
        case when o_orderkey%4=0 then 2 when o_orderkey%4=1 then 6
        when o_orderkey%4=2 then 4 else 5 end as cls from orders""",
    # small boxes on a lattice of whole units; sizes 4..10, so that neighbours overlap
    "fx_parcels": """select p_partkey as id, p_partkey%7 as kind,
        1.0e0*((p_partkey*17)%211)*3 as minx, 1.0e0*((p_partkey*29)%199)*3 as miny,
        1.0e0*((p_partkey*17)%211)*3+4+p_partkey%7 as maxx,
        1.0e0*((p_partkey*29)%199)*3+4+p_partkey%5 as maxy from part""",
    # planning zones that tile the parcel plane in 40 x 40 unit boxes
    "fx_zones": """select cast(a.n_nationkey*25+b.n_nationkey as bigint) as id,
        40.0e0*a.n_nationkey as minx, 40.0e0*b.n_nationkey as miny,
        40.0e0*a.n_nationkey+40 as maxx, 40.0e0*b.n_nationkey+40 as maxy,
        (a.n_nationkey+b.n_nationkey)%4 as landuse
        from nation a join nation b on a.n_nationkey<17 and b.n_nationkey<16""",
}


def needed(sql: str) -> list[str]:
    """Fixture views a text refers to, dependencies first."""
    return [name for name in BODIES if re.search(rf"\b{name}\b", sql)]


def with_fixtures(sql: str) -> str:
    """Prefix a DuckDB query with the fixture bodies it uses."""
    ctes = ", ".join(f"{name} AS ({BODIES[name]})" for name in needed(sql))
    text = sql.strip()
    if not ctes:
        return text
    recursive = re.match(r"with\s+recursive\s", text, re.I)
    plain = re.match(r"with\s", text, re.I)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {text[recursive.end():]}"
    if plain:
        return f"WITH {ctes}, {text[plain.end():]}"
    return f"WITH {ctes} {text}"


class Layers:
    """Reads the given tables and the derived layers of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table; one that is read in fewer pieces than there are cores is dealt out over all of them."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism else df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        body = BODIES.get("fx_" + name)
        if body is None:
            raise AttributeError(name)
        used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
        return self.spark.sql(re.sub(r"\b(" + "|".join(used) + r")\b(?=\s*(a|b|where|cross|join|on|$))",
                                     r"{\1}", body), **{t: self.table(t) for t in used})
