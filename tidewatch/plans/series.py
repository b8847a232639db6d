"""Queries over series: groups A, B, D and E."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import rolling, trend
from ..sources import tables
from .inputs import CELLS, ODD, S1, S2, S3, cells, query, rounded, s1, s2, s3, table, tolerant_windows

HALF = 6
W = 2 * HALF + 1
_WEEK_OF = "cast(l_shipdate as date) + cast((7 - extract(dow from l_shipdate)) % 7 as integer)"


@query(f"with {CELLS} select k, lat, ((lon + 180) % 360) - 180 lon from cells")
def wrap_longitude(spark, d):
    c = cells(spark, d)
    return c.select("k", "lat", tables.wrap_longitude(F.col("lon")).alias("lon"))


@query("with c as (select s_suppkey % 180 lat, s_suppkey // 180 lon, s_acctbal as value from supplier) select cast(lat as double) lat, cast(lon as double) lon, value from c where lat is not null")
def rename_axes_and_concat(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 180).cast("double").alias("latitude"), F.expr("cast(s_suppkey div 180 as double)").alias("x"), F.col("s_acctbal").alias("value"))
    parts = [tables.nan_to_null(tables.rename_axes(s.where(F.col("latitude") % 2 == i), required=("lat", "lon"))) for i in (0, 1)]
    return tables.merge_parts(parts)


@query("select o_custkey k, max(o_totalprice) filter (o_orderstatus = 'F') f, max(o_totalprice) filter (o_orderstatus = 'O') o, max(o_totalprice) filter (o_orderstatus = 'P') p from orders group by 1")
def merge_variables(spark, d):
    long = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    return tables.merge_variables(long, ["k"], "o_orderstatus", "v", ["F", "O", "P"]).withColumnsRenamed({"F": "f", "O": "o", "P": "p"})


@query("select c_custkey k, c_mktsegment segment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def unfinished_keys(spark, d):
    """Customers for whom no order is in the state that would make them done."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return tables.unfinished(c, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), ["k"])


@query("select o_custkey k, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def resumed_job(spark, d):
    """Totals by customer in a job that first did the customers with an urgent order, then the rest, each key once."""
    import uuid

    from ..sources.storage import shared_folder

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_totalprice")
    path = f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}"
    job = lambda part: part.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("k").distinct()
    tables.resume(o.join(urgent, "k", "left_semi"), path, ["k"], job, blocks=16, at_once=8)
    tables.resume(o, path, ["k"], job, blocks=16, at_once=8)
    return tables.results(spark, path, ["k"], "k " + dict(o.dtypes)["k"])


_WIDE = ", ".join(f"round(sum(o_totalprice) filter (month(o_orderdate) = {i}), 2) m{i}" for i in range(1, 13))


@query(f"with w as (select year(o_orderdate) y, {_WIDE} from orders group by 1) " + " union all ".join(f"select make_date(y, {i}, 1) as time, m{i} as value from w" for i in range(1, 13)))
def monthly_from_wide(spark, d):
    o = table(spark, d, "orders")
    wide = o.groupBy(F.year("o_orderdate").alias("year")).agg(*(F.round(F.sum(F.when(F.month("o_orderdate") == i, F.col("o_totalprice"))), 2).alias(f"m{i}") for i in range(1, 13)))
    return tables.monthly_from_wide(wide)


@query(f"with {CELLS} select k, case when lat between -30 and 30 and lon between 90 and 270 then 0.0::double else case when value < 9000 then value end end as value from cells")
def sentinel_and_override(spark, d):
    c = cells(spark, d)
    v = tables.sentinel(F.col("value"), F.col("value") < 9000)
    return c.select("k", tables.override_box(v, F.col("lat"), F.col("lon"), (-30.0, 30.0, 90.0, 270.0)).alias("value"))


@query("select o_orderkey k, max(l_quantity) filter (l_linenumber = 1) first_line, max(l_quantity) filter (l_linenumber = 2) second_line from orders join lineitem on o_orderkey = l_orderkey where l_linenumber in (1, 2) group by 1")
def split_bands(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber in (1, 2)")
    o = table(spark, d, "orders").select("o_orderkey")
    long = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderkey").alias("k"), "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return tables.split_bands(long, ["k"], "l_linenumber", "q", {1: "first_line", 2: "second_line"})


@query("select s_suppkey k, 90 - (s_suppkey // 36) * 0.25::double lat, -180 + (s_suppkey % 36) * 0.25::double lon from supplier")
def raster_coordinates(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("cast(s_suppkey div 36 as int)").alias("r"), (F.col("s_suppkey") % 36).cast("int").alias("c"))
    lat, lon = tables.cell_coordinates(F.col("r"), F.col("c"), -180.0, 90.0, 0.25)
    return s.select("k", lat.alias("lat"), lon.alias("lon"))


@query(f"with {S1} select k, time, value from s1 where time between date '1996-01-01' and date '1997-12-31'")
def weekly_resample(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    raw = o.join(c, o.o_custkey == c.c_custkey).select("k", F.to_date("o_orderdate").alias("time"), (F.col("o_totalprice") / 1000.0).alias("value"))
    weekly = cal.resample(raw, ["k"], "W", cal.weekly_how("total_price")).withColumn("value", F.round("value", 5) * ODD)
    return cal.time_slice(weekly, "1996-01-01", "1997-12-31")


@query(f"with {S1} select k, cast(date_trunc('month', time) as date) as time, round(avg(value), 8) as value from s1 group by 1, 2")
def monthly_resample(spark, d):
    return rounded(cal.resample(s1(spark, d), ["k"], "MS", "mean"), 8)


@query(f"with {S1} select k, cast(date_trunc('year', time) as date) as time, round(sum(value), 5) as value from s1 group by 1, 2")
def annual_resample(spark, d):
    return rounded(cal.resample(s1(spark, d), ["k"], "YS", "sum"), 5)


_DENSE1 = f"""{S1}, ends as (select min(time) a, max(time) b from s1), axis as (select unnest(generate_series(a, b, interval 7 day))::date as time from ends),
dense as (select k, time, s1.value from (select distinct k from s1) cross join axis left join s1 using (k, time))"""


@query(f"with {_DENSE1} select k, time, value, cast(row_number() over (partition by k order by time) - 1 as integer) t from dense")
def dense_calendar(spark, d):
    return cal.densify(s1(spark, d), ["k"], "7 days").withColumn("t", cal.position(["k"])).select("k", "time", "value", "t")


@query(f"with {_DENSE1}, m as (select k, cast(date_trunc('month', time) as date) as time, round(avg(value), 8) as value from s1 group by 1, 2) select k, cast(date '2000-01-01' + to_months(cast(dense_rank() over (partition by k order by time) - 1 as integer)) as date) as time, value from m")
def restamped_months(spark, d):
    m = rounded(cal.resample(s1(spark, d), ["k"], "MS", "mean"), 8)
    return cal.restamp_months(m, ["k"], F.lit("2000-01-01").cast("date")).select("k", "time", "value")


@query("select k, time, o_orderkey from (select o_custkey k, cast(o_orderdate as date) as time, o_orderkey, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey) n from orders) where n = 1")
def first_of_time(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("time"), "o_orderkey")
    return cal.first_of_time(o, ["k"], "o_orderkey")


@query(f"with {S1} select k, greatest(3, cast(round_even(count(*) / nullif(date_diff('day', min(time), max(time)) / cast(365.2425 as double), 0), 0) as integer)) steps_per_year from s1 group by 1")
def steps_per_year(spark, d):
    return cal.steps_per_year(s1(spark, d), ["k"])


@query(f"with {S1}, g as (select k, date_diff('day', lag(time) over (partition by k order by time), time) g from s1) select k, case when median(g) >= 5 then 52 else 365 end as period from g group by 1")
def seasonal_period(spark, d):
    return cal.seasonal_period(s1(spark, d), ["k"])


@query(f"with {S1}, m as (select *, max(time) over (partition by k) - interval 30 month l, min(time) over (partition by k) f from s1) select k, time, value from m where time <= l or f > l")
def trimmed_end(spark, d):
    return cal.trim_end(s1(spark, d), ["k"], 30)


@query(f"with {S2}, b as (select distinct k, k * 20 cp from s2) select k, cp, time cp_time from b left join s2 on s2.k = b.k and s2.t = b.cp".replace("select k, cp, time", "select b.k, cast(b.cp as integer) cp, s2.time"))
def time_of_index(spark, d):
    s = s2(spark, d)
    b = s.select("k").distinct().withColumn("cp", F.col("k") * 20)
    return cal.time_of_index(b, s.select("k", "t", "time"), "cp", "cp_time", ["k"]).select("k", "cp", "cp_time")


@query(f"with {S2}, g as (select k, time, date_diff('day', lag(time) over (partition by k order by time), time) g from s2), a as (select k, min(time) t0, coalesce(median(g), 7) step from g group by 1) select k, t0, cast(step as double) step, t0 + cast(floor(10 * step) as integer) date from a")
def time_by_step(spark, d):
    return cal.time_by_step(s2(spark, d), ["k"], F.lit(10))


@query(f"with {S2} select k, t, cast(floor(2000 + t / cast(52.1775 as double)) as integer) as year, round(date_diff('day', date '1992-01-01', time) / cast(30.44 as double), 6) as months, round(date_diff('day', date '1992-01-01', time) / cast(365.25 as double), 6) as years from s2")
def numeric_axes(spark, d):
    first = F.lit("1992-01-01").cast("date")
    return rounded(s2(spark, d).select("k", "t", cal.year_of_index(F.col("t")).alias("year"), cal.months_since(F.col("time"), first).alias("months"), cal.years_since(F.col("time"), first).alias("years")))


@query(f"with {S2} select k, time, round(value - lag(value) over (partition by k order by time), 5) diff from s2")
def first_difference(spark, d):
    return s2(spark, d).select("k", "time", F.round(cal.first_difference(["k"]), 5).alias("diff"))


@query(f"with {CELLS} select k, case when (k % 3) * 1000.0::double = 0 then 1e-6::double else (k % 3) * 1000.0::double end scaled, case when value > 4500 then 1 when value < 4500 then -1 else 0 end sign from cells")
def scaled_and_sign(spark, d):
    c = cells(spark, d)
    return c.select("k", cal.scaled((F.col("k") % 3).cast("double"), 1000.0).alias("scaled"), cal.sign_class(F.col("value") - 4500).alias("sign"))


@query(f"with {CELLS} select k, round(sqrt(u * u + v * v), 6) speed, round(((degrees(atan2(u, v)) + 180) % 360), 6) direction from (select k, lat / 10 + 0.01::double u, (lon - 180) / 10 + 0.02::double v from cells)")
def wind(spark, d):
    c = cells(spark, d).select("k", (F.col("lat") / 10 + 0.01).alias("u"), ((F.col("lon") - 180) / 10 + 0.02).alias("v"))
    speed, direction = cal.wind(F.col("u"), F.col("v"))
    return rounded(c.select("k", speed.alias("speed"), direction.alias("direction")))


@query(f"with {CELLS}, b as (select k, lat, case when value < 0 then 'debt' when value < 3000 then 'low' when value < 6000 then 'middle' else 'high' end cls from cells where lat > -60) select k, cls, case cls when 'debt' then 'poor' when 'low' then 'poor' when 'high' then 'rich' end grp from b where cls <> 'middle'")
def classes_and_groups(spark, d):
    c = cells(spark, d).where("lat > -60")
    c = c.select("k", cal.to_class(F.col("value"), [0.0, 3000.0, 6000.0], ["debt", "low", "middle", "high"]).alias("cls"))
    return cal.map_group(c, spark.createDataFrame([("debt", "poor"), ("low", "poor"), ("high", "rich")], "cls string, grp string"), "cls").select("k", "cls", "grp")


_TAG = "'freq-' || (case s_suppkey % 2 when 0 then 'W' else 'MS' end) || '_win-' || (s_suppkey % 3 + 3) || '_diff-' || (s_suppkey % 2) || '_stl-' || (case s_suppkey % 2 when 0 then 'robust' else 'plain' end)"


@query(f"select s_suppkey k, {_TAG} tag, (case s_suppkey % 2 when 0 then 'W' else 'MS' end) freq, cast(s_suppkey % 3 + 3 as double) win, cast(s_suppkey % 2 as integer) diff, (case s_suppkey % 2 when 0 then 'robust' else 'plain' end) stl, 'SD_up_AC1_' || s_suppkey as label from supplier")
def tags_and_labels(spark, d):
    k = F.col("s_suppkey")
    tag = cal.make_tag(F.when(k % 2 == 0, "W").otherwise("MS"), k % 3 + 3, k % 2, F.when(k % 2 == 0, "robust").otherwise("plain"))
    s = table(spark, d, "supplier").select(k.alias("k"), tag.alias("tag"), F.concat(F.lit(" SD ↑/AC1 "), k).alias("raw"))
    s = s.withColumn("label", cal.plain_label(F.col("raw")))
    return s.select("k", "tag", *(c.alias(n) for n, c in cal.parse_tag(F.col("tag")).items()), "label")


@query(f"with {CELLS}, a as (select distinct lat from cells), r as (select lat, dense_rank() over (order by lat) - 1 i from a) select k, lat from cells join r using (lat) where i between 5 and 14")
def sub_grid(spark, d):
    return cal.index_slice(cells(spark, d), "lat", 5, 14).select("k", "lat")


# --- rolling indicators

_FRAME = f"rows between {HALF} preceding and {HALF} following"
_ROLL = f"""{S2}, d as (select *, lag(value) over w p, lag(value, 2) over w q from s2 window w as (partition by k order by t)),
r as (select k, t, count(value) over f n, avg(value) over f m, stddev_pop(value) over f sd, var_pop(value) over f vp, stddev_samp(value) over f sds, var_samp(value) over f vs, skewness(value) over f sk, kurtosis_pop(value) over f ku,
  sum(value * p) over f1 sxy, sum(value + p) over f1 sx, count(value * p) over f1 c1, sum(abs(value - p)) over f1 a1, sum(abs(value - q)) over f2 a2, count(value - q) over f2 c2
  from d window f as (partition by k order by t {_FRAME}), f1 as (partition by k order by t rows between {HALF - 1} preceding and {HALF} following), f2 as (partition by k order by t rows between {HALF - 2} preceding and {HALF} following))"""


@query(f"""with {_ROLL} select k, t, case when n = {W} then round(sd, 6) end std, case when n = {W} and vp > 0 then round((sxy - m * sx + c1 * m * m) / ({W} * vp), 6) end ac1,
case when n = {W} and vp > 0 then round(sk * (n - 2) / sqrt(n * (n - 1)), 6) end skew, case when n = {W} and vp > 0 then round(ku + 3, 6) end kurt,
case when n = {W} then round(greatest(1, least(2, 2 - (ln(a2 / (2 * c2)) - ln(a1 / (2 * c1))) / ln(2))), 6) end fd from r""")
def rolling_indicators(spark, d):
    return rounded(rolling.indicators(s2(spark, d), ["k"], W - 1).select("k", "t", *rolling.INDICATORS))


_TOLERANT = f"""{_DENSE1}, nth as (select k, value, row_number() over (partition by k order by time) - 1 t, count(*) over (partition by k) len, {HALF} half from dense),
lagged as (select *, lag(value) over (partition by k order by t) p, lag(value, 2) over (partition by k order by t) q from nth), {tolerant_windows("lagged", "k")}
select k, cast(t as integer) t, round(std, 6) std, round(ac1, 6) ac1, round(skew, 6) skew, round(kurt, 6) kurt, round(fd, 6) fd from lagged left join ind using (k, t)"""


def _gappy(spark, d):
    return cal.densify(s1(spark, d), ["k"], "7 days").withColumn("t", cal.position(["k"]))


@query(f"with {_TOLERANT}")
def rolling_tolerant(spark, d):
    """Weekly orders by nation, which have gaps."""
    return rounded(rolling.indicators(_gappy(spark, d), ["k"], W, "tolerant").select("k", "t", *rolling.INDICATORS))


@query(f"with {_TOLERANT}")
def rolling_tolerant_by_prefix(spark, d):
    return rounded(rolling.indicators_by_prefix(_gappy(spark, d), ["k"], W, "tolerant").select("k", "t", *rolling.INDICATORS))


@query(f"""with {_ROLL} select k, t, case when n = {W} then round(sd, 5) end std, case when n = {W} and vp > 0 then round((sxy - m * sx + c1 * m * m) / ({W} * vp), 5) end ac1,
case when n = {W} and vp > 0 then round(sk * (n - 2) / sqrt(n * (n - 1)), 5) end skew, case when n = {W} and vp > 0 then round(ku + 3, 5) end kurt,
case when n = {W} then round(greatest(1, least(2, 2 - (ln(a2 / (2 * c2)) - ln(a1 / (2 * c1))) / ln(2))), 5) end fd from r""")
def rolling_by_prefix_sums(spark, d):
    return rounded(rolling.indicators_by_prefix(s2(spark, d), ["k"], W).select("k", "t", *rolling.INDICATORS), 5)


_STRICT = f"""select k, t, case when n = {W} then sd end std, case when n = {W} and vp > 0 then (sxy - m * sx + c1 * m * m) / ({W} * vp) end ac1, case when n = {W} and vp > 0 then sk * (n - 2) / sqrt(n * (n - 1)) end skew,
  case when n = {W} and vp > 0 then ku + 3 end kurt, case when n = {W} then greatest(1, least(2, 2 - (ln(a2 / (2 * c2)) - ln(a1 / (2 * c1))) / ln(2))) end fd from r"""
_DELTAS = "case when min(t) filter (v = lo) > min(t) filter (v = hi) then lo - hi else hi - lo end"


@query(f"""with {_ROLL}, i as ({_STRICT}), l as (select k, t, indicator, v, max(v) over (partition by k, indicator) hi, min(v) over (partition by k, indicator) lo from (unpivot i on std, ac1, skew, kurt, fd into name indicator value v)),
b as (select k, indicator, {_DELTAS} delta from l group by k, indicator, hi, lo)
select k, {", ".join(f"round(max(delta) filter (indicator = '{n}'), 6) delta_{n}" for n in rolling.INDICATORS)} from (select distinct k from s2) left join b using (k) group by k""")
def indicator_deltas(spark, d):
    found = rolling.indicators(s2(spark, d), ["k"], W)
    return rounded(rolling.deltas(found, ["k"], list(rolling.INDICATORS)))


@query(f"with {_DENSE1} select k, time, value from dense where k in (select k from s1 where k % 2 = 0)")
def series_with_data(spark, d):
    s = cal.densify(s1(spark, d), ["k"], "7 days")
    s = s.withColumn("value2", F.when(F.col("k") % 2 == 0, F.col("value")))
    return rolling.with_data(s, ["k"], "value2").select("k", "time", "value")


@query(f"with {_DENSE1} select k, time, round(coalesce(value, avg(value) over (partition by k)), 6) filled from dense")
def gaps_by_mean(spark, d):
    return rounded(cal.densify(s1(spark, d), ["k"], "7 days").select("k", "time", rolling.fill_mean(["k"]).alias("filled")))


@query(f"""with {_DENSE1}, t as (select k, value, row_number() over (partition by k order by time) - 1 t from dense),
g as (select *, last_value(value ignore nulls) over b v0, last_value(case when value is not null then t end ignore nulls) over b t0, first_value(value ignore nulls) over a v1, first_value(case when value is not null then t end ignore nulls) over a t1
  from t window b as (partition by k order by t rows unbounded preceding), a as (partition by k order by t rows between current row and unbounded following))
select k, cast(t as integer) t, round(coalesce(value, v0 + (v1 - v0) * (cast(t - t0 as double) / nullif(t1 - t0, 0)), avg(value) over (partition by k)), 6) filled from g""")
def gaps_by_line(spark, d):
    s = cal.densify(s1(spark, d), ["k"], "7 days").withColumn("t", cal.position(["k"]))
    return rounded(rolling.fill_linear(s, ["k"]).select("k", "t", "filled"))


@query()
def stl_residual(spark, d):
    return rounded(rolling.stl_residual(s2(spark, d), ["k"], 52).select("k", "t", "resid"))


def _shipments(spark, d):
    """Every shipment in thousands, with the supplier's nation and its date."""
    li = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("time"), (F.col("l_extendedprice") / 1000.0).alias("value"))
    return li.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), F.col("l_suppkey") == F.col("s_suppkey")).select("k", "time", "value")


@query()
def early_warning_job(spark, d):
    """From single shipments to weekly sums, robust residuals, differences and all five indicators over a year."""
    found = rolling.early_warning(_shipments(spark, d), ["k"], 53, freq="W", how="sum", period=52)
    return rounded(found.signals())


@query()
def early_warning_summary(spark, d):
    """Deltas and trends of the same job."""
    found = rolling.early_warning(_shipments(spark, d), ["k"], 53, freq="W", how="sum", period=52)
    return rounded(found.trends().join(found.deltas(), "k"))


_PLAIN = f"""raw as (select s_nationkey k, {_WEEK_OF} as time, sum(l_extendedprice / 1000) as value from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2), ends as (select min(time) a, max(time) b from raw),
axis as (select unnest(generate_series(a, b, interval 7 day))::date as time from ends), dense as (select k, time, value from (select distinct k from raw) cross join axis left join raw using (k, time)),
s2 as (select k, row_number() over (partition by k order by time) - 1 t, value - lag(value) over (partition by k order by time) as value from dense), {_ROLL.removeprefix(S2 + ", ")}"""


@query(f"""with {_PLAIN}, i as ({_STRICT}), u as (unpivot i on std, ac1, skew, kurt, fd into name indicator value v), l as (select k, t, indicator, round(v, 9) v, max(round(v, 9)) over w hi, min(round(v, 9)) over w lo from u window w as (partition by k, indicator)),
b as (select k, indicator, {_DELTAS} delta, count(*) n from l group by k, indicator, hi, lo),
q as (select x.k, x.indicator, sum(sign(y.v - x.v)) s, cast(count(*) as double) * sum((y.v <> x.v)::int) u from l x join l y on x.k = y.k and x.indicator = y.indicator and x.t < y.t group by 1, 2)
select k, indicator, cast(n as integer) n, round(delta, 5) delta, round(s / sqrt(nullif(u, 0)), 5) tau from b left join q using (k, indicator)""")
def early_warning_plain(spark, d):
    """The job without seasons: weekly sums, differences, indicators, deltas and trends in one exchange."""
    found = rolling.early_warning(_shipments(spark, d), ["k"], W, freq="W", how="sum")
    deltas = found.deltas().unpivot(["k"], [f"delta_{n}" for n in rolling.INDICATORS], "indicator", "delta").withColumn("indicator", F.substring("indicator", 7, 9))
    return rounded(found.trends().where("n > 0").select("k", "indicator", "n", "tau").join(deltas, ["k", "indicator"]), 5)


# --- trends

_PAIRS = f"""{S2}, pairs as (select a.k, sign(b.value - a.value) s, b.value <> a.value u, (b.value - a.value) / ((b.t - a.t) / cast(52 as double)) slope from s2 a join s2 b on a.k = b.k and a.t < b.t)"""
_TAU = f"{_PAIRS}, c as (select k, count(*) n from s2 group by 1) select k, cast(n as integer) n, round(sum(s) / sqrt(cast(count(*) as double) * sum(u::int)), 6) tau from pairs join c using (k) group by k, n"


@query(f"with {_TAU}")
def kendall_tau(spark, d):
    return rounded(trend.kendall(s2(spark, d), ["k"], 4).select("k", "n", "tau"))


@query(f"with {_TAU}")
def kendall_tau_in_arrays(spark, d):
    return rounded(trend.kendall_pairs(s2(spark, d), ["k"]))


@query()
def kendall_test(spark, d):
    return rounded(trend.kendall(s2(spark, d), ["k"]))


_SEN = f"""{_PAIRS}, o as (select k, list_sort(list(slope)) l, cast(count(*) as double) m from pairs group by 1), ti as (select k, value, cast(count(*) as double) c from s2 group by 1, 2), nn as (select k, cast(count(*) as double) n from s2 group by 1),
va as (select k, sqrt((any_value(n) * (any_value(n) - 1) * (2 * any_value(n) + 5) - sum(c * (c - 1) * (2 * c + 5))) / 18) sg from ti join nn using (k) group by 1),
rk as (select k, l, m, cast(greatest(round_even((m - 1.959963984540054::double * sg) / 2, 0) - 1, 0) as bigint) a, cast(least(round_even((m + 1.959963984540054::double * sg) / 2, 0), m - 1) as bigint) b from o join va using (k))"""


@query(f"with {_SEN} select k, round(list_aggregate(l, 'median'), 6) slope, round(l[a + 1], 6) lo, round(l[b + 1], 6) hi, case when l[a + 1] > 0 then 1 when l[b + 1] < 0 then -1 else 0 end sig from rk")
def theil_sen_slope(spark, d):
    return rounded(trend.theil_sen(s2(spark, d), ["k"]).select("k", "slope", "lo", "hi", "sig"))


_WELCH = f"""{S2}, h as (select k, value, t, count(*) over (partition by k) n from s2), g as (select k, avg(value) filter (t < n // 2) m1, var_samp(value) filter (t < n // 2) v1, count(value) filter (t < n // 2) n1,
avg(value) filter (t >= n - n // 2) m2, var_samp(value) filter (t >= n - n // 2) v2, count(value) filter (t >= n - n // 2) n2 from h group by 1)"""


@query(f"with {_WELCH} select k, round(m2 - m1, 6) mean_change, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 6) t_stat, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) dof from g")
def mean_change_welch(spark, d):
    return rounded(trend.mean_change(s2(spark, d), ["k"], with_p=False))


@query()
def mean_change_test(spark, d):
    return rounded(trend.mean_change(s2(spark, d), ["k"]))


@query(f"with {S1} select k, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(regr_slope(value, date_diff('day', date '1992-01-01', time) / cast(30.44 as double)), 6) trend from s1 group by 1")
def trend_stats(spark, d):
    return rounded(trend.trend_stats(s1(spark, d), ["k"], cal.months_since(F.col("time"), F.lit("1992-01-01").cast("date"))))


@query(f"with {S2}, i as (select time, round(sum(value), 5) total from s2 group by 1) select k, round(corr(value, total), 6) corr from s2 join i using (time) group by 1")
def index_correlation(spark, d):
    s = s2(spark, d)
    index = s.groupBy("time").agg(F.round(F.sum("value"), 5).alias("value"))
    return rounded(trend.index_correlation(s, index, ["k"]))


@query(f"""with {S2}, m as (select cast(date_trunc('month', time) as date) m, round(sum(value), 5) total from s2 group by 1), x as (select distinct time from s2),
a as (select time, m ma, total va from x asof join m on m <= time), b as (select time, m mb, total vb from x asof join m on m >= time),
i as (select time, round(va + (vb - va) * coalesce(cast(mb - ma <> 0 as integer) * (time - ma) / cast(nullif(mb - ma, 0) as double), 0), 5) total from a join b using (time))
select k, round(corr(value, total), 6) corr from s2 join i using (time) group by 1""")
def interpolated_index_correlation(spark, d):
    """A monthly index, interpolated to the weeks of each series; weeks after the last month start have none."""
    s = s2(spark, d)
    index = s.groupBy(F.trunc("time", "month").alias("time")).agg(F.round(F.sum("value"), 5).alias("value"))
    weekly = rolling.interpolate_onto(index, s.select("time").distinct(), []).withColumn("value", F.round("value", 5))
    return rounded(trend.index_correlation(s, weekly, ["k"]))


@query(f"with {S3} select k, strftime(time, '%Y-%m-%d %H') as hour, value from s3 where k in ('error', 'view')")
def qualifying_series(spark, d):
    return trend.qualifying(s3(spark, d), ["error", "view"], "k").select("k", F.date_format("time", "yyyy-MM-dd HH").alias("hour"), "value")


_TREND = f"""{_ROLL}, i as (select k, t, 'std' indicator, case when n = {W} then round(sd, 9) end v from r union all select k, t, 'ac1', case when n = {W} and vp > 0 then round((sxy - m * sx + c1 * m * m) / ({W} * vp), 9) end from r)"""


@query(f"""with {_TREND}, j as (select * from i where v is not null), c as (select k, indicator, count(*) n from j group by 1, 2),
p as (select a.k, a.indicator, sum(sign(b.v - a.v)) s, cast(count(*) as double) * sum((b.v <> a.v)::int) u from j a join j b on a.k = b.k and a.indicator = b.indicator and a.t < b.t group by 1, 2)
select k, indicator, cast(n as integer) n, round(s / sqrt(u), 6) tau from p join c using (k, indicator)""")
def indicator_trends(spark, d):
    """The flagship: weekly shipments by nation, rolling spread and lag-1 autocorrelation, Kendall's tau of each."""
    r = rolling.indicators(s2(spark, d), ["k"], W).select("k", "t", F.round("std", 9).alias("std"), F.round("ac1", 9).alias("ac1"))
    long = r.unpivot(["k", "t"], ["std", "ac1"], "indicator", "value")
    return rounded(trend.kendall(long, ["k", "indicator"]).select("k", "indicator", "n", "tau"))
