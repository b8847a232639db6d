"""The given tables in the role of series, maps and classes, in Spark and in SQL.

Amounts are sums in thousands, rounded to the digits that the sums have, so that both engines start from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import position, week_label

#: a factor that leaves no short decimals, whose means could lie midway between two rounded numbers
ODD = 0.987654321

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def s1(spark: SparkSession, d: str) -> DataFrame:
    """Weekly orders by nation: k, time, value; has gaps."""
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", week_label(F.col("o_orderdate")).alias("time"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("k", "time").agg((F.round(F.sum("o_totalprice") / 1000.0, 5) * ODD).alias("value"))


def s2(spark: SparkSession, d: str) -> DataFrame:
    """Weekly shipments by the supplier's nation: k, time, t, value; nearly dense."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", week_label(F.col("l_shipdate")).alias("time"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    g = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("k", "time").agg((F.round(F.sum("l_extendedprice") / 1000.0, 5) * ODD).alias("value"))
    return g.withColumn("t", position(["k"]))


def s3(spark: SparkSession, d: str) -> DataFrame:
    """Hourly events by type: k, time, value."""
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), F.date_trunc("hour", "ts").alias("time"), "value")
    return e.groupBy("k", "time").agg(F.round(F.sum("value"), 2).alias("value"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as cells of a map: lat, lon (0..360), k, nation, value."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select((-89.5 + (k * 7) % 180).cast("double").alias("lat"), (0.5 + (k * 13) % 360).cast("double").alias("lon"), k.alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"))


def customer_cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cells: lat, lon, k, nation, segment, value."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select((-89.5 + (k * 7) % 180).cast("double").alias("lat"), (0.5 + (k * 13) % 360).cast("double").alias("lon"), k.alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"))


def maps(spark: SparkSession, d: str) -> DataFrame:
    """Made-up tests of real cells: k, region, lat, area, and for five indicators tau and p from arithmetic on the key and balance."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = customer_cells(spark, d).join(F.broadcast(n), F.col("nation") == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # the tables of nations and regions have fixed sizes
    out = c.select("k", F.col("r_name").alias("region"), "segment", "lat", "lon", F.cos(F.radians("lat")).alias("area"), "value")
    for i, name in enumerate(("ac1", "std", "skew", "kurt", "fd")):
        out = out.withColumn(f"{name}_tau", (F.pmod(F.col("k") * (17 + 6 * i) + F.lit(i), F.lit(201)) - 100) / 100.0).withColumn(f"{name}_pval", F.pmod(F.col("k") * (29 + 4 * i), F.lit(97)) / 970.0)
    return out


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: key, fold, y, p from their length (with ties)."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    p = F.round(F.least(F.lit(0.999), F.greatest(F.lit(0.001), (F.col("n_chars") % 1000) / 1000.0)), 3)
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id").select(F.col("doc_id").alias("key"), (F.col("doc_id") % 5).cast("int").alias("fold"), "y", p.alias("p"))


_WEEK = "cast({0} as date) + cast((7 - extract(dow from {0})) % 7 as integer)"
S1 = f"s1 as (select c_nationkey k, {_WEEK.format('o_orderdate')} as time, round(sum(o_totalprice) / 1000, 5) * {ODD}::double as value from orders join customer on o_custkey = c_custkey group by 1, 2)"
S2 = f"""s2 as (select *, cast(row_number() over (partition by k order by time) - 1 as integer) t from (
  select s_nationkey k, {_WEEK.format('l_shipdate')} as time, round(sum(l_extendedprice) / 1000, 5) * {ODD}::double as value from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2))"""
S3 = "s3 as (select event_type k, date_trunc('hour', ts) as time, round(sum(value), 2) as value from events group by 1, 2)"
CELLS = "cells as (select cast(-89.5 + (s_suppkey * 7) % 180 as double) lat, cast(0.5 + (s_suppkey * 13) % 360 as double) lon, s_suppkey k, s_nationkey nation, s_acctbal as value from supplier)"
CUSTOMER_CELLS = "ccells as (select cast(-89.5 + (c_custkey * 7) % 180 as double) lat, cast(0.5 + (c_custkey * 13) % 360 as double) lon, c_custkey k, c_nationkey nation, c_mktsegment segment, c_acctbal as value from customer)"
MAPS = (
    CUSTOMER_CELLS
    + ", maps as (select k, r_name region, segment, lat, lon, cos(radians(lat)) area, value, "
    + ", ".join(f"((k * {17 + 6 * i} + {i}) % 201 - 100) / cast(100 as double) {n}_tau, ((k * {29 + 4 * i}) % 97) / cast(970 as double) {n}_pval" for i, n in enumerate(("ac1", "std", "skew", "kurt", "fd")))
    + " from ccells join nation on nation = n_nationkey join region on n_regionkey = r_regionkey)"
)
SCORED = "scored as (select doc_id as key, cast(doc_id % 5 as integer) fold, quality y, round(least(0.999, greatest(0.001, (n_chars % 1000) / cast(1000 as double))), 3) p from labels join documents using (doc_id))"


def tolerant_windows(rows: str, by: str) -> str:
    """CTEs up to `ind` (by, t, std, ac1, skew, kurt, fd): gap-tolerant indicators by their definition, every window's points gathered and
    summed, from `rows` (by, t, len, half, value, p, q: the values one and two steps before)."""
    return f"""win as (select {by}, c.t, 2 * c.half + 1 w, b.value as v, case when b.t - 1 >= c.t - c.half then b.p end v1, case when b.t - 2 >= c.t - c.half then b.q end v2
  from {rows} b join (select {by}, t, half from {rows} where t >= half and t < len - half) c using ({by}) where b.t between c.t - c.half and c.t + c.half),
mo as (select {by}, t, count(v) n, avg(v) m, var_samp(v) vs, nullif(stddev_samp(v), 0) s from win group by all),
su as (select {by}, t, w, n, vs, s, coalesce(sum((v - m) * (v1 - m)), 0) num, avg(((v - m) / s) ** 3) sk, avg(((v - m) / s) ** 4) ku, sum(abs(v - v1)) a1, sum(abs(v - v2)) a2 from win join mo using ({by}, t) where n > 2 group by all),
ind as (select {by}, t, coalesce(s, 0) std, num / (vs * (w - 1)) ac1, sk skew, ku kurt, case when a1 > 0 and a2 > 0 then greatest(1, least(2, 2 - (ln(a2 / (2 * (w - 2))) - ln(a1 / (2 * (w - 1)))) / ln(2))) end fd from su)"""


def draw_sql(seed: int, *key: str) -> str:
    """`functions.hashing.draw` in SQL."""
    return f"('0x' || substr(md5('{seed}' || {' || '.join(f"""'|' || {k}""" for k in key)}), 1, 15))::bigint"
