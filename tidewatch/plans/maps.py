"""Queries over maps: groups C, H and I."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import regrid, zonal
from .inputs import CELLS, CUSTOMER_CELLS, MAPS, S1, S2, cells, customer_cells, maps, query, rounded, s1, s2, table, tolerant_windows

NAMES = ("ac1", "std", "skew", "kurt", "fd")


@query(f"with {S1}, {S2} select s1.k, s1.time, s1.value a, s2.value b from s1 join s2 on s1.k = s2.k and s1.time = s2.time")
def aligned_cubes(spark, d):
    a, b = s1(spark, d).withColumnRenamed("value", "a"), s2(spark, d).select("k", "time", F.col("value").alias("b"))
    return regrid.align(a, b, ["k", "time"])


@query("with a as (select o_custkey k, count(*) orders from orders group by 1), b as (select c_custkey k, c_acctbal balance from customer where c_acctbal > 1000), c as (select s_suppkey k, s_acctbal supplier from supplier) select k, orders, balance, supplier from a full join b using (k) full join c using (k)")
def merged_maps(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("supplier"))
    return regrid.merge_maps([a, b, c], ["k"])


@query("with a as (select o_custkey k, count(*) orders from orders group by 1) select c_custkey k, orders from customer left join a on k = c_custkey")
def attached_predictors(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    return regrid.attach(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), a, ["k"])


@query(f"with {CELLS} select k, case when (k * 37) % 100 / 100.0 > 0.7 then value end as value, (k * 37) % 100 / 100.0 > 0.5 soft from cells")
def land_mask(spark, d):
    c = cells(spark, d)
    mask = c.select("k", ((F.col("k") * 37) % 100 / 100.0).alias("lsm"))
    soft = mask.select("k", regrid.soft_land(F.col("lsm")).alias("soft"))
    return regrid.land_mask(c, mask, ["k"], "value").join(soft, "k").select("k", "value", "soft")


@query(f"with {CELLS} select k from cells where (k * 37) % 100 / 100.0 > 0.7")
def land_rows(spark, d):
    c = cells(spark, d)
    return regrid.on_land(c, c.select("k", ((F.col("k") * 37) % 100 / 100.0).alias("lsm")), ["k"]).select("k")


@query(f"with {CELLS} select k, case when lat >= -80 and lat <= 70 then cast(floor((lat + 80) / 2.5 + 0.5) as integer) end i from cells")
def snap_nearest(spark, d):
    return cells(spark, d).select("k", regrid.snap(F.col("lat"), -80.0, 2.5, 61).alias("i"))


@query(f"""with {CELLS}, a as (select distinct lat + 0.3::double x from cells where k % 7 = 0), b as (select x x0, lead(x) over (order by x) x1 from a)
select k, lat, case when x1 is null or lat - x0 <= x1 - lat then x0 else x1 end near from cells left join b on lat >= x0 and lat < x1 or x1 is null and lat = x0""")
def nearest_on_axis(spark, d):
    c = cells(spark, d)
    axis = c.where("k % 7 = 0").select((F.col("lat") + 0.3).alias("x")).distinct()
    return regrid.nearest_on_axis(c.select("k", "lat"), axis, "lat", "near")


def _grid(spark, d):
    """Sums of balances on a whole map of 10 x 10 degrees, NULL where there are none: lat, lon, value."""
    c = customer_cells(spark, d)
    at = lambda x: (F.floor(F.col(x) / 10) * 10).cast("double").alias(x)
    summed = c.groupBy(at("lat"), at("lon")).agg(F.round(F.sum("value"), 2).alias("value"))
    whole = spark.range(18 * 36, numPartitions=1).select(((F.floor(F.col("id") / 36) - 9) * 10).cast("double").alias("lat"), ((F.col("id") % 36) * 10).cast("double").alias("lon"))
    return whole.join(summed, ["lat", "lon"], "left")


_GRID = f"""{CUSTOMER_CELLS}, summed as (select cast(floor(lat / 10) * 10 as double) lat, cast(floor(lon / 10) * 10 as double) lon, round(sum(value), 2) as value from ccells group by 1, 2),
whole as (select cast((i // 36 - 9) * 10 as double) lat, cast((i % 36) * 10 as double) lon from range({18 * 36}) r(i)), grid as (select whole.lat, whole.lon, value from whole left join summed using (lat, lon))"""
_BILINEAR = f"""with {_GRID}, la as (select lat a0, lead(lat) over (order by lat) a1 from (select distinct lat from grid)), lo as (select lon o0, lead(lon) over (order by lon) o1 from (select distinct lon from grid)),
t as (select distinct lat, lon from (select cast(-89.5 + (s_suppkey * 7) % 180 as double) lat, cast(0.5 + (s_suppkey * 13) % 360 as double) lon from supplier)),
w as (select lat, lon, a0, a1, o0, o1, coalesce((lat - a0) / (a1 - a0), case when a0 is not null then 0 end) wa, coalesce((lon - o0) / (o1 - o0), case when o0 is not null then 0 end) wo from t
  left join la on lat >= a0 and lat < a1 or a1 is null and lat = a0 left join lo on lon >= o0 and lon < o1 or o1 is null and lon = o0)
select w.lat, w.lon, round(case when (1 - wa) * (1 - wo) = 0 then 0 else (1 - wa) * (1 - wo) * p.value end + case when (1 - wa) * wo = 0 then 0 else (1 - wa) * wo * q.value end + case when wa * (1 - wo) = 0 then 0 else wa * (1 - wo) * r.value end + case when wa * wo = 0 then 0 else wa * wo * s.value end, 6) as value
from w left join grid p on p.lat = a0 and p.lon = o0 left join grid q on q.lat = a0 and q.lon = o1 left join grid r on r.lat = a1 and r.lon = o0 left join grid s on s.lat = a1 and s.lon = o1"""


@query(_BILINEAR)
def bilinear(spark, d):
    return rounded(regrid.bilinear(cells(spark, d).select("lat", "lon").distinct(), _grid(spark, d)))


@query(f"""with {_GRID}, la as (select lat, (row_number() over (order by lat) - 1) // 2 b, count(*) over () // 2 n from (select distinct lat from grid)), lo as (select lon, (row_number() over (order by lon) - 1) // 2 b, count(*) over () // 2 n from (select distinct lon from grid)),
a2 as (select lat, avg(lat) over (partition by b) m from la where b < n), o2 as (select lon, avg(lon) over (partition by b) m from lo where b < n)
select a2.m lat, o2.m lon, round(avg(value), 6) as value from grid join a2 using (lat) join o2 using (lon) group by 1, 2""")
def coarsened(spark, d):
    return rounded(regrid.coarsen(_grid(spark, d), 2, []))


@query()
def common_grid(spark, d):
    g = _grid(spark, d)
    return rounded(regrid.common_grid([g.where("lon < 200"), g.where("lon > 120")], 5.0))


# a square, a triangle that overlaps it and a concave ring: zone, poly_id, x1, y1, x2, y2
# corners and sides lie on points of the map, which belong to the polygon
_RINGS = {("west", 1): [(0.5, -50.5), (180.5, -50.5), (180.5, 40.5), (0.5, 40.5)], ("north", 2): [(90, 0), (300, 0), (200, 85)], ("horn", 3): [(200, -80), (350, -80), (350, -10), (275, -60), (200, -10)]}
_EDGES = [(z, p, float(a), float(b), float(c), float(e)) for (z, p), ring in _RINGS.items() for (a, b), (c, e) in zip(ring, ring[1:] + ring[:1], strict=True)]
_EDGE_SQL = "edges as (select * from (values " + ", ".join(f"('{z}', {p}, {a}::double, {b}::double, {c}::double, {e}::double)" for z, p, a, b, c, e in _EDGES) + ") e(zone, poly_id, x1, y1, x2, y2))"


@query(f"""with {CUSTOMER_CELLS}, {_EDGE_SQL}, h as (select k, zone from ccells, edges where y1 <> y2 and least(y1, y2) <= lat and lat < greatest(y1, y2) and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon group by k, zone, poly_id having count(*) % 2 = 1),
o as (select k, zone from ccells, edges where lat between least(y1, y2) and greatest(y1, y2) and lon between least(x1, x2) and greatest(x1, x2) and (x2 - x1) * (lat - y1) = (y2 - y1) * (lon - x1))
select ccells.k, zone from ccells left join (select k, zone from h union select k, zone from o) h using (k)""")
def polygon_zone(spark, d):
    """Zones of all customers' cells, those on a border too."""
    edges = spark.createDataFrame(_EDGES, "zone string, poly_id int, x1 double, y1 double, x2 double, y2 double")
    return regrid.zone_of_point(customer_cells(spark, d).select("k", "lat", "lon"), edges, levels=(4.0,)).select("k", "zone")


@query(f"with {CELLS} select k, (k % 7 <= 3) not_urban, k % 53 > 25 cropland, k % 53 > 25 and k % 101 >= 60 irrigated, k % 53 > 25 and k % 101 < 60 rainfed from cells")
def crop_masks(spark, d):
    c = cells(spark, d)
    return c.select("k", *(m.alias(n) for n, m in regrid.crop_masks((F.col("k") % 7).cast("double"), F.col("k") % 53, F.col("k") % 101).items()))


@query(f"with {CELLS} select k, value / 100 as value from cells")
def percent_cover(spark, d):
    return regrid.percent_to_share(cells(spark, d).select("k", "value"), "value")


@query(f"with {MAPS} select k, case when k % 3 = 0 then ac1_tau when k % 3 = 1 then std_tau else skew_tau end tau from maps")
def chosen_by_mask(spark, d):
    m = maps(spark, d)
    return m.select("k", regrid.choose_by_mask(F.col("k") % 3 == 0, F.col("k") % 3 == 1, F.col("ac1_tau"), F.col("std_tau"), F.col("skew_tau")).alias("tau"))


@query("select o_custkey k, max((o_orderstatus = 'F')::int) = 1 target from orders where o_totalprice < 400000 group by 1")
def domain_label(spark, d):
    o = table(spark, d, "orders")
    return regrid.domain_label(o.withColumn("k", F.col("o_custkey")), ["k"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 400000), F.when(F.col("o_totalprice") < 400000, 1))


def _filled(spark, d, least: float):
    """Customers in rows of 40 whose balance is high: i, j."""
    c = table(spark, d, "customer").where(F.col("c_acctbal") > least)
    return c.select(F.expr("(c_custkey - 1) div 40").alias("i"), ((F.col("c_custkey") - 1) % 40).alias("j"))


def _reached(cells: str) -> str:
    """CTE `reach` (i, j, l): every cell of `cells` (i, j) with the codes of all cells that it is connected with."""
    return f"""reach as (select i, j, i * 40 + j l from {cells} union select c.i, c.j, r.l from reach r join {cells} c on abs(c.i - r.i) + abs(c.j - r.j) = 1)"""


@query(f"""with recursive cells as (select (c_custkey - 1) // 40 i, (c_custkey - 1) % 40 j from customer where c_acctbal > 5000), {_reached("cells")},
lab as (select i, j, min(l) l from reach group by 1, 2) select i, j, (l // 40) || ',' || (l % 40) component, count(*) over (partition by l) size from lab qualify size >= 5""")
def connected_cells(spark, d):
    """Groups of five or more neighbouring cells; tiles smaller than the groups."""
    return regrid.components(_filled(spark, d, 5000.0), tile=8, step=4).where("size >= 5")


@query(f"""with recursive n as (select (max(c_custkey) - 1) // 40 + 1 h from customer), grid as (select (x // 40) i, (x % 40) j from range((select h * 40 from n)) r(x)),
cells as (select (c_custkey - 1) // 40 i, (c_custkey - 1) % 40 j from customer where c_acctbal > 1000), empty as (select i, j from grid anti join cells using (i, j)), {_reached("empty")},
lab as (select i, j, min(l) l from reach group by 1, 2) select i, j from lab, n where l not in (select l from lab, n where i = 0 or j = 0 or i = h - 1 or j = 39)""")
def enclosed_holes(spark, d):
    """Cells of low balance shut in by cells of high balance."""
    c = table(spark, d, "customer")
    rows = c.agg(F.expr("(max(c_custkey) - 1) div 40 + 1")).first()[0]
    return regrid.holes(_filled(spark, d, 1000.0), rows, 40)


# --- agreement

_LONG = f"{MAPS}, long as (" + " union all ".join(f"select k, region, '{n}' indicator, {n}_tau tau, {n}_pval pval from maps" for n in NAMES) + ")"


def _long(spark, d):
    m = maps(spark, d)
    return m.select("k", "region", F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(f"{n}_tau").alias("tau"), F.col(f"{n}_pval").alias("pval")) for n in NAMES))).alias("r")).select("k", "region", "r.*")


@query(f"""with {_LONG} select indicator, round(avg(tau), 6) mean_tau, round(median(tau), 6) median_tau, round(stddev_pop(tau), 6) std_tau, round(100 * avg((tau > 0.05)::int), 6) pct_up, round(100 * avg((tau < -0.05)::int), 6) pct_down,
round(100 * avg((abs(tau) <= 0.05)::int), 6) pct_flat, round(100 * avg((pval > 0.05)::int), 6) pct_ns from long group by 1""")
def tau_summary(spark, d):
    return rounded(ag.tau_summary(_long(spark, d), ["indicator"]))


_LABEL = "case when pval <= 0.05 and tau > 0.05 then 1 when pval <= 0.05 and tau < -0.05 then -1 else 0 end"


@query(f"with {_LONG} select k, indicator, {_LABEL} as label from long")
def tau_labels(spark, d):
    return _long(spark, d).select("k", "indicator", ag.tau_label(F.col("tau"), F.col("pval")).alias("label"))


_KAPPA = f"""{_LONG}, lab as (select k, indicator, {_LABEL} l from long), t as (select a.indicator map_a, b.indicator map_b, a.l a, b.l b, cast(count(*) as double) n from lab a join lab b on a.k = b.k and a.indicator < b.indicator group by 1, 2, 3, 4),
g as (select map_a, map_b, sum(n) n, sum(n) filter (a = b) / sum(n) po, sum(n * (1 - abs(a - b) / 2)) / sum(n) pw, coalesce(sum(n) filter (a = 1 and b = 1), 0) / nullif(sum(n) filter (a = 1 or b = 1), 0) ju, coalesce(sum(n) filter (a = -1 and b = -1), 0) / nullif(sum(n) filter (a = -1 or b = -1), 0) jd from t group by 1, 2),
ma as (select map_a, map_b, a, sum(n) s from t group by 1, 2, 3), mb as (select map_a, map_b, b, sum(n) s from t group by 1, 2, 3),
e as (select ma.map_a, ma.map_b, sum(ma.s * mb.s) filter (a = b) e, sum(ma.s * mb.s * (1 - abs(a - b) / 2)) ew from ma join mb on ma.map_a = mb.map_a and ma.map_b = mb.map_b group by 1, 2),
kp as (select g.map_a, g.map_b, cast(n as bigint) n, po agreement, (po - e / n / n) / (1 - e / n / n) kappa, (pw - ew / n / n) / (1 - ew / n / n) kappa_weighted, ju jaccard_up, jd jaccard_down from g join e using (map_a, map_b))"""


def _pairs(spark, d):
    lab = _long(spark, d).withColumn("label", ag.tau_label(F.col("tau"), F.col("pval")))
    return ag.kappa_pairs(lab, ["k"], "indicator", "label")


@query(f"with {_KAPPA} select map_a, map_b, n, round(agreement, 6) agreement, round(kappa, 6) kappa, round(kappa_weighted, 6) kappa_weighted, round(jaccard_up, 6) jaccard_up, round(jaccard_down, 6) jaccard_down from kp")
def kappa_pairs(spark, d):
    return rounded(_pairs(spark, d))


@query(f"with {_KAPPA}, s as (select map_a, map_b, kappa from kp union all select map_b, map_a, kappa from kp union all select map_a, map_a, 1 from (select map_a from kp union select map_b from kp)) select map_a, " + ", ".join(f"round(max(kappa) filter (map_b = '{n}'), 6) {n}" for n in NAMES) + " from s group by 1")
def kappa_matrix(spark, d):
    return rounded(ag.kappa_matrix(_pairs(spark, d), list(NAMES)))


@query(f"with {_KAPPA} select round(avg(kappa), 6) lights_kappa from kp")
def lights_kappa(spark, d):
    return rounded(ag.lights_kappa(_pairs(spark, d)))


@query(f"with {_KAPPA} select round(quantile_cont(kappa, 0.1), 6) p10, round(quantile_cont(kappa, 0.5), 6) p50, round(quantile_cont(kappa, 0.9), 6) p90 from kp")
def kappa_distribution(spark, d):
    return rounded(ag.kappa_distribution(_pairs(spark, d)))


@query(f"with {_KAPPA}, b as (select map_a, map_b, kappa, row_number() over (order by kappa desc, map_a, map_b) x, row_number() over (order by kappa, map_a, map_b) y from kp) select map_a, map_b, round(kappa, 6) kappa, 'best' as end, cast(x as integer) rank from b where x <= 3 union all select map_a, map_b, round(kappa, 6), 'worst', cast(y as integer) from b where y <= 3".replace("as end", 'as "end"'))
def best_and_worst(spark, d):
    return rounded(ag.best_and_worst(_pairs(spark, d), 3))


_CONFIG = "conf as (select k, config, case config when 0 then sign(ac1_tau) when 1 then sign(std_tau) when 2 then sign(skew_tau) else sign(kurt_tau) end::int l from maps, (values (0), (1), (2), (3)) c(config))"


@query(f"""with {MAPS}, {_CONFIG}, t as (select a.config map_a, b.config map_b, a.l a, b.l b, cast(count(*) as double) n from conf a join conf b on a.k = b.k and a.config < b.config group by 1, 2, 3, 4),
g as (select map_a, map_b, sum(n) n, coalesce(sum(n) filter (a = b), 0) / sum(n) po from t group by 1, 2), ma as (select map_a, map_b, a, sum(n) s from t group by 1, 2, 3), mb as (select map_a, map_b, b, sum(n) s from t group by 1, 2, 3),
e as (select ma.map_a, ma.map_b, sum(ma.s * mb.s) e from ma join mb on ma.map_a = mb.map_a and ma.map_b = mb.map_b and a = b group by 1, 2),
kp as (select g.map_a, g.map_b, (po - e / n / n) / (1 - e / n / n) kappa from g join e using (map_a, map_b))
select case when map_a % 2 <> map_b % 2 then 'freq' else 'diff' end factor, round(avg(kappa), 6) mean_kappa, count(*) n_pairs from kp where (map_a % 2 <> map_b % 2)::int + (map_a // 2 <> map_b // 2)::int = 1 group by 1""")
def one_factor(spark, d):
    m = maps(spark, d)
    lab = m.select("k", F.posexplode(F.array(*(F.signum(f"{n}_tau").cast("int") for n in NAMES[:4]))).alias("config", "label"))
    settings = ag.configurations(spark, {"freq": [0, 1], "diff": [0, 1]}).withColumn("config", F.col("freq") + 2 * F.col("diff")).select(F.col("config").cast("int"), "freq", "diff")
    return rounded(ag.one_factor(ag.kappa_pairs(lab, ["k"], "config", "label"), settings, ["freq", "diff"]))


@query(f"""with {MAPS}, q as (select region, quantile_cont(abs(ac1_tau), 0.975) lim from maps group by 1) select k, case when ac1_pval < 0.05 then sign(ac1_tau)::int else 0 end kt, case when k % 4 <> 0 then sign(std_tau)::int else 0 end ts, case when abs(ac1_tau) > lim then sign(ac1_tau)::int else 0 end delta from maps join q using (region)""")
def class_maps(spark, d):
    m = ag.class_by_quantile(maps(spark, d), ["region"], "ac1_tau", "delta")
    return m.select("k", ag.class_by_p(F.col("ac1_tau"), F.col("ac1_pval")).alias("kt"), ag.class_by_flag(F.col("std_tau"), F.col("k") % 4).alias("ts"), "delta")


@query(f"""with {_LONG}, l as (select k, max({_LABEL}) filter (indicator = 'ac1') a, max({_LABEL}) filter (indicator = 'std') b from long group by 1), t as (select a, b, cast(count(*) as double) n from l where a <> 0 or b <> 0 group by 1, 2)
select a, b, cast(n as bigint) n from t""")
def non_neutral_contingency(spark, d):
    m = maps(spark, d).select("k", ag.tau_label(F.col("ac1_tau"), F.col("ac1_pval")).alias("x"), ag.tau_label(F.col("std_tau"), F.col("std_pval")).alias("y"))
    return ag.contingency(ag.non_neutral(m, "x", "y"), [], "x", "y")


@query(f"with {_LONG}, l as (select indicator, avg(abs(tau)) lights_kappa from long group by 1) select indicator, round(lights_kappa, 6) lights_kappa, cast(row_number() over (order by lights_kappa desc, indicator) as integer) rank from l")
def ranked_indicators(spark, d):
    l = _long(spark, d).groupBy("indicator").agg(F.avg(F.abs("tau")).alias("lights_kappa"))  # noqa: E741
    return rounded(ag.rank_indicators(l))


@query(f"with {_LONG} select indicator, round(coalesce(nullif(quantile_cont(abs(tau), 0.995), 0), nullif(max(abs(tau)), 0), 1), 6) as limit_ from long group by 1")
def symmetric_limits(spark, d):
    return rounded(ag.symmetric_limit(_long(spark, d), ["indicator"], "tau")).withColumnRenamed("limit", "limit_")


@query(f"with {MAPS} select k, case when ac1_pval < 0.05 and ac1_tau <> 0 then ac1_tau end ac1, case when fd_pval < 0.05 then -sign(fd_tau) * abs(fd_tau) end + 0.0 fd, round(ln(1 + least(greatest(value, 0), 5000)) / ln(5001::double), 6) effect from maps")
def significant_maps(spark, d):
    m = maps(spark, d)
    return rounded(m.select("k", ag.significant_map(F.col("ac1_tau"), F.col("ac1_pval")).alias("ac1"), (ag.signed_magnitude(F.col("fd_tau"), F.col("fd_pval")) + 0.0).alias("fd"), ag.log_scaled(F.col("value"), 5000.0).alias("effect")))


@query(f"with {MAPS}, b as (select least(7, greatest(0, cast(floor((ac1_tau + 1) / 2 * 8) as integer))) a_bin, least(7, greatest(0, cast(floor((std_tau + 1) / 2 * 8) as integer))) b_bin from maps where ac1_pval < 0.05 and std_pval < 0.05) select a_bin, b_bin, count(*) n from b group by 1, 2")
def bins_of_two(spark, d):
    m = maps(spark, d).where("ac1_pval < 0.05 and std_pval < 0.05")
    return ag.bins_2d(m, F.col("ac1_tau"), F.col("std_tau"))


@query("select s_suppkey k, s_acctbal as value from supplier")
def field_by_candidates(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), ag.first_field(s, ["mean_change", "s_acctbal"]).alias("value"))


# --- zones

@query(f"with {CELLS} select k, round(6371.0::double ** 2 * radians(0.25::double) * radians(0.25::double) * cos(radians(lat)), 6) area from cells")
def cell_area(spark, d):
    return rounded(cells(spark, d).select("k", zonal.cell_area(F.col("lat")).alias("area")))


@query(f"with {CELLS}, x as (select distinct lat from cells), g as (select abs(lat - lag(lat) over (order by lat)) s from x) select round(median(s), 6) step from g")
def axis_step(spark, d):
    return rounded(zonal.axis_step(cells(spark, d), "lat"))


_DIR = "case when pval < 0.05 and tau < 0 then 'decrease' when pval < 0.05 and tau > 0 then 'increase' else 'neutral' end"


@query(f"""with {_LONG}, a as (select region, indicator, {_DIR} dir, area from long join (select k, area from maps) using (k)), g as (select region, indicator, coalesce(sum(area) filter (dir = 'decrease'), 0) decrease, coalesce(sum(area) filter (dir = 'neutral'), 0) neutral, coalesce(sum(area) filter (dir = 'increase'), 0) increase from a group by 1, 2)
select region, indicator, round(decrease, 6) decrease, round(neutral, 6) neutral, round(increase, 6) increase, round(100 * decrease / (decrease + neutral + increase), 6) pct_decrease, round(100 * neutral / (decrease + neutral + increase), 6) pct_neutral, round(100 * increase / (decrease + neutral + increase), 6) pct_increase from g""")
def zonal_area_split(spark, d):
    m = maps(spark, d)
    long = m.select("k", "region", "area", F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(f"{n}_tau").alias("tau"), F.col(f"{n}_pval").alias("pval")) for n in NAMES))).alias("r")).select("region", "area", "r.*")
    return rounded(zonal.area_split(long, ["region", "indicator"], "tau", "pval"))


_UP = {n: f"({n}_pval < 0.05 and {n}_tau > 0)" for n in NAMES}
_DOWN = {n: f"({n}_pval < 0.05 and {n}_tau < 0)" for n in NAMES}
_COMPOSITE = {"ac1_sd_up": f"{_UP['ac1']} and {_UP['std']}", "ac1_sd_down": f"{_DOWN['ac1']} and {_DOWN['std']}", "ac1_sd_mixed": f"{_UP['ac1']} and {_DOWN['std']} or {_DOWN['ac1']} and {_UP['std']}", "fd_down": _DOWN["fd"], "skew_kurt_up": f"{_UP['skew']} and {_UP['kurt']}"}
_FAMILY = {
    "slowing_up": _COMPOSITE["ac1_sd_up"], "slowing_down": _COMPOSITE["ac1_sd_down"], "slowing_mixed": _COMPOSITE["ac1_sd_mixed"], "roughness_down": _DOWN["fd"], "roughness_up": _UP["fd"],
    "asymmetry_up": _COMPOSITE["skew_kurt_up"], "asymmetry_down": f"{_DOWN['skew']} and {_DOWN['kurt']}", "asymmetry_mixed": f"{_UP['skew']} and {_DOWN['kurt']} or {_DOWN['skew']} and {_UP['kurt']}",
}


@query(f"with {MAPS} select segment, " + ", ".join(f"round(100 * coalesce(sum(area) filter ({c}), 0) / sum(area), 6) {n}" for n, c in _COMPOSITE.items()) + " from maps group by 1")
def composite_percent(spark, d):
    m = maps(spark, d)
    return rounded(zonal.signal_percent(m, ["segment"], zonal.composite_signals(m)))


@query(f"with {MAPS} " + " union all ".join(f"select region, '{n}' signal, round(100 * coalesce(sum(area) filter (({c}) and k % 7 <= 3), 0) / sum(area), 6) percent from maps group by 1" for n, c in _FAMILY.items()))
def family_percent(spark, d):
    m = maps(spark, d)
    wide = zonal.signal_percent(m, ["region"], zonal.family_signals(m), counted=F.col("k") % 7 <= 3)
    return rounded(zonal.tidy(wide, ["region"], list(_FAMILY)))


_ARID = "m as (select c_nationkey k, cast(date_trunc('month', o_orderdate) as date) as time, round(sum(o_totalprice), 2) / 1e6 tp, cast(count(*) as double) pet from orders join customer on o_custkey = c_custkey group by 1, 2)"


def _arid(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy("k", F.trunc("o_orderdate", "month").alias("time")).agg((F.round(F.sum("o_totalprice"), 2) / 1e6).alias("tp"), F.count("*").cast("double").alias("pet"))
    return m.select("k", "time", F.col("tp").alias("value")), m.select("k", "time", F.col("pet").alias("value"))


@query(f"""with {_ARID}, y as (select k, year(time) y, sum(case when tp = 0 then 1e-6 else tp end) / sum(case when pet = 0 then 1e-6 else pet end) r from m group by 1, 2), a as (select k, avg(r) filter (r <= 100) * 10 aridity from y group by 1)
select k, round(aridity, 6) aridity, case when aridity < 1.45 then 'dry' when aridity < 1.55 then 'middle' else 'wet' end as class from a""")
def aridity_class(spark, d):
    from ..operators.drivers import aridity_class as classed

    tp, pet = _arid(spark, d)
    return rounded(classed(zonal.aridity_index(tp, pet, ["k"], scale=10.0), [1.45, 1.55], ["dry", "middle", "wet"]))


@query(f"with {_ARID} select k, round(avg(case when tp = 0 then 1e-6 else tp end / case when pet = 0 then 1e-6 else pet end), 6) aridity from m group by 1")
def aridity_by_month(spark, d):
    tp, pet = _arid(spark, d)
    return rounded(zonal.aridity_index(tp, pet, ["k"], method="monthly_ratio"))


_WARN = "case when indicator in ('ac1', 'std') then pval < 0.05 when indicator in ('skew', 'kurt') then pval < 0.05 and tau > 0 else pval < 0.05 and tau < 0 end"
_FLAGS = f"{_LONG}, flags as (select k, region, indicator, area, {_WARN} w, value > 4500 b from long join (select k, area, value from maps) using (k))"
_CONF = "sum((w and b)::int) tp, sum((w and not b)::int) fp, sum((not w and b)::int) fn, sum((not w and not b)::int) tn"


def _flags(spark, d):
    m = maps(spark, d)
    long = m.select("k", "region", "area", (F.col("value") > 4500).alias("b"), F.explode(F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(f"{n}_tau").alias("tau"), F.col(f"{n}_pval").alias("pval")) for n in NAMES))).alias("r")).select("k", "region", "area", "b", "r.*")
    return long.withColumn("w", zonal.warning(F.col("indicator"), F.col("tau"), F.col("pval")))


@query(f"""with {_FLAGS}, g as (select indicator, {_CONF} from flags group by 1) select indicator, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(fn as bigint) fn, cast(tn as bigint) tn, round(tp / nullif(tp + fp, 0), 6) as precision_, round(tp / nullif(tp + fn, 0), 6) recall, round(tn / nullif(tn + fp, 0), 6) specificity,
round((tp + tn) / (tp + fp + fn + tn), 6) accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) f1,
round((cast(tp as double) * tn - cast(fp as double) * fn) / nullif(sqrt(cast(tp + fp as double)) * sqrt(cast(tp + fn as double)) * sqrt(cast(tn + fp as double)) * sqrt(cast(tn + fn as double)), 0), 6) mcc from g""")
def warning_scores(spark, d):
    return rounded(zonal.scores(zonal.confusion(_flags(spark, d), ["indicator"], "w", "b")).withColumnRenamed("precision", "precision_"))


@query(f"with {_FLAGS}, c as (select region, indicator, case when w and b then 1 when w then 2 when b then 3 else 4 end as class, sum(area) area from flags group by 1, 2, 3) select region, indicator, class, round(area, 6) area, round(area / sum(area) over (partition by region, indicator), 6) fraction from c")
def confusion_by_zone(spark, d):
    return rounded(zonal.confusion_fractions(_flags(spark, d), ["region"], ["indicator"], "w", "b"))


@query(f"with {_FLAGS}, g as (select indicator, case when w and b then 1 when w then 2 when b then 3 else 4 end as class, count(*) n from flags group by 1, 2) select indicator, class, n, round(n / sum(n) over (partition by indicator), 6) share from g")
def class_shares(spark, d):
    f = _flags(spark, d)
    return rounded(zonal.class_share(f, ["indicator"], zonal.outcome(F.col("w"), F.col("b"))))


@query(f"with {_FLAGS}, p as (select indicator, case when b then w when k % 5 > 0 then not w end w2, b from flags) select indicator, cast(sum((w2 and b)::int) as bigint) tp, cast(sum((w2 and not b)::int) as bigint) fp, cast(sum((not w2 and b)::int) as bigint) fn, cast(sum((not w2 and not b)::int) as bigint) tn from p where w2 is not null group by 1")
def prebreak_confusion(spark, d):
    f = _flags(spark, d)
    p = zonal.prebreak(f, F.col("b"), F.col("w"), F.when(F.col("k") % 5 > 0, ~F.col("w")))
    return zonal.confusion(p, ["indicator"], "warned", "b")


@query(f"with {_FLAGS}, g as (select region, indicator, {_CONF} from flags group by 1, 2), s as (select region, indicator, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 v from g) select region, " + ", ".join(f"round(max(v) filter (indicator = '{n}'), 6) {n}" for n in NAMES) + " from s group by 1")
def balanced_accuracy_matrix(spark, d):
    return rounded(zonal.balanced_matrix(zonal.confusion(_flags(spark, d), ["region", "indicator"], "w", "b"), "region", "indicator", list(NAMES)))


@query(f"with {CELLS} select k from cells where lat > -60 and k % 9 <> 0 and k not in (select s_suppkey from supplier where s_acctbal > 0)")
def no_data_cells(spark, d):
    c = cells(spark, d)
    return zonal.no_data(c.where("k % 9 != 0"), c.withColumn("v", F.when(F.col("value") > 0, F.col("value"))), ["k"], "v").select("k")


@query(f"with {MAPS} select k from maps where k % 6 <> 0 and k % 10 <> 0")
def validity_domain(spark, d):
    m = maps(spark, d).withColumn("x", F.when(F.col("k") % 6 != 0, 1)).withColumn("y", F.when(F.col("k") % 10 != 0, 1))
    return m.where(zonal.all_known(F.col("x"), F.col("y"))).select("k")


_DIRECTED = f"""{_LONG}, lab as (select k, region, indicator, {_LABEL} l from long), t as (select a.region, a.indicator map_a, b.indicator map_b, a.l a, b.l b, cast(count(*) as double) n from lab a join lab b on a.k = b.k and a.indicator < b.indicator where a.l <> 0 or b.l <> 0 group by all),
g as (select region, map_a, map_b, sum(n) n, sum(n * (1 - abs(a - b) / 2)) / sum(n) pw from t group by all), ma as (select region, map_a, map_b, a, sum(n) s from t group by all), mb as (select region, map_a, map_b, b, sum(n) s from t group by all),
e as (select ma.region, ma.map_a, ma.map_b, sum(ma.s * mb.s * (1 - abs(a - b) / 2)) ew from ma join mb on ma.region = mb.region and ma.map_a = mb.map_a and ma.map_b = mb.map_b group by all),
kw as (select region, map_a || '_' || map_b pair, (pw - ew / n / n) / (1 - ew / n / n) kappa from g join e using (region, map_a, map_b))"""
_PAIR_NAMES = [f"{a}_{b}" for a in NAMES for b in NAMES if a < b]


@query(f"with {_DIRECTED} select region, " + ", ".join(f"round(max(kappa) filter (pair = '{p}'), 6) {p}" for p in _PAIR_NAMES) + " from kw group by 1")
def directed_agreement(spark, d):
    """Weighted kappa of every two maps on cells with a direction in either, by region."""
    lab = _long(spark, d).withColumn("label", ag.tau_label(F.col("tau"), F.col("pval")))
    return rounded(ag.pair_table(ag.kappa_pairs(lab, ["k"], "indicator", "label", ["region"], directed=True), "region", list(NAMES)))


_METHODS = ("delta", "flag", "p", "tau")
_METHOD_PAIRS = [f"{a}_{b}" for a in _METHODS for b in _METHODS if a < b]
_AGREED = f"""{_LONG}, lim as (select indicator, quantile_cont(abs(tau), 0.8) lim from long group by 1), lab as (select k, indicator, unnest(['delta', 'flag', 'p', 'tau']) m, unnest([cast(case when abs(tau) > lim then sign(tau) else 0 end as integer), cast(case when pval < 0.07 then sign(tau) else 0 end as integer),
  cast(case when pval < 0.05 then sign(tau) else 0 end as integer), {_LABEL}]) l from long join lim using (indicator)), t as (select a.indicator, a.m map_a, b.m map_b, a.l a, b.l b, cast(count(*) as double) n from lab a join lab b on a.k = b.k and a.indicator = b.indicator and a.m < b.m where a.l <> 0 or b.l <> 0 group by all),
g as (select indicator, map_a, map_b, sum(n) n, sum(n * (1 - abs(a - b) / 2)) / sum(n) pw from t group by all), ma as (select indicator, map_a, map_b, a, sum(n) s from t group by all), mb as (select indicator, map_a, map_b, b, sum(n) s from t group by all),
e as (select ma.indicator, ma.map_a, ma.map_b, sum(ma.s * mb.s * (1 - abs(a - b) / 2)) ew from ma join mb on ma.indicator = mb.indicator and ma.map_a = mb.map_a and ma.map_b = mb.map_b group by all),
kw as (select indicator, map_a || '_' || map_b pair, (pw - ew / n / n) / (1 - ew / n / n) kappa from g join e using (indicator, map_a, map_b))"""


@query(f"with {_AGREED} select indicator, " + ", ".join(f"round(max(kappa) filter (pair = '{p}'), 6) {p}" for p in _METHOD_PAIRS) + " from kw group by 1")
def methods_agreement(spark, d):
    """Weighted kappa of every two of four methods that give a cell its class, for each of five indicators, on cells with a direction in either."""
    long = ag.class_by_quantile(_long(spark, d), ["indicator"], "tau", "delta", 0.8)
    tau, p = F.col("tau"), F.col("pval")
    long = long.withColumns({"flag": ag.class_by_flag(tau, (p < 0.07).cast("int")), "p": ag.class_by_p(tau, p), "tau": ag.tau_label(tau, p)})
    labels = long.unpivot(["k", "indicator"], list(_METHODS), "method", "label")
    return rounded(ag.pair_table(ag.kappa_pairs(labels, ["k"], "method", "label", ["indicator"], directed=True), "indicator", list(_METHODS)))


def _sweep_sql(then: str) -> str:
    """Twelve settings without STL, by definition: windows gathered point by point, trends from all pairs; up to `t` (k, freq, win, diff, tag, indicator, n, tau, s, z)."""
    base = {"W": ("time", "7 day", 7), "MS": ("cast(date_trunc('month', time) as date)", "1 month", 0)}
    out, parts = [S1], []
    for freq, (label, step, _) in base.items():
        out.append(f"{freq}_b as (select k, {label} as time, avg(value) as value from s1 group by 1, 2), {freq}_e as (select min(time) a, max(time) b from {freq}_b), {freq}_x as (select unnest(generate_series(a, b, interval {step}))::date as time from {freq}_e)")
        out.append(f"{freq}_0 as (select k, value, row_number() over (partition by k order by time) - 1 t, count(*) over (partition by k) len, greatest(3, cast(round_even(count(*) over (partition by k) / (date_diff('day', a, b) / cast(365.2425 as double)), 0) as integer)) per_year from (select distinct k from {freq}_b) cross join {freq}_x cross join {freq}_e left join {freq}_b using (k, time))")
        out.append(f"{freq}_1 as (select * replace (value - lag(value) over (partition by k order by t) as value) from {freq}_0)")
        for diff in (0, 1):
            for years in (2.5, 5.0, 10.0):
                full, cut = f"cast(round_even({years}::double * per_year, 0) as integer)", "least(len - 1, cast(round_even(0.8::double * len, 0) as integer))"
                odd = lambda w: f"({w} + ({w} + 1) % 2)"
                parts.append(f"select k, 'freq-{freq}_win-{years}_diff-{diff}_stl-none' tag, t, len, (case when {odd(full)} < len then {odd(full)} else {odd(cut)} end - 1) // 2 half, value, lag(value) over w p, lag(value, 2) over w q from {freq}_{diff} window w as (partition by k order by t)")
    out += ["base as (" + " union all ".join(parts) + ")", tolerant_windows("base", "k, tag")]
    out.append("long as (select k, tag, t, indicator, round(v, 9) v from (unpivot ind on std, ac1, skew, kurt, fd into name indicator value v))")
    out.append("c as (select k, tag, indicator, count(v) n from long group by all), ti as (select k, tag, indicator, v, cast(count(*) as double) m from long group by all), tt as (select k, tag, indicator, sum(m * (m - 1) * (2 * m + 5)) tied from ti group by all)")
    out.append("q as (select a.k, a.tag, a.indicator, sum(sign(b.v - a.v)) s, cast(count(*) as double) * sum((b.v <> a.v)::int) u from long a join long b on a.k = b.k and a.tag = b.tag and a.indicator = b.indicator and a.t < b.t group by all)")
    out.append("t as (select k, tag, indicator, cast(n as integer) n, case when n >= 4 then s / sqrt(nullif(u, 0)) end tau, case when n >= 4 and u > 0 then s / sqrt((cast(n as double) * (n - 1) * (2 * n + 5) - tied) / 18) end z, n <= 33 and tied = 0 exact from c join tt using (k, tag, indicator) left join q using (k, tag, indicator))")
    return "with " + ", ".join(out) + then


def _swept(spark, d):
    return ag.sweep(s1(spark, d), ["k"], stl=("none",), digits=9)


@query(_sweep_sql(" select k, tag, indicator, n, round(tau, 6) tau from t"))
def sensitivity_sweep(spark, d):
    """Trend of all five indicators under every frequency, window and differencing, without STL, so that SQL can follow."""
    return rounded(_swept(spark, d).where("n > 0").select("k", "tag", "indicator", "n", "tau"))


@query()
def sensitivity_study(spark, d):
    """The whole study: 24 settings with STL, robust and plain, labels and kappa of every two settings, summed up by indicator."""
    return rounded(ag.study(ag.sweep(s1(spark, d), ["k"]), ["k"])[1])


@query(f"with {MAPS}, g as (select *, case when k % 5 = 0 then 'cropland' else region end grp from maps where k % 5 = 0 or region <> 'ASIA') select grp, " + ", ".join(f"round(100 * coalesce(sum(area) filter (({c}) and k % 7 <= 3), 0) / sum(area), 6) {n}" for n, c in _FAMILY.items()) + " from g group by 1")
def cropland_percent(spark, d):
    m = zonal.with_cropland(maps(spark, d).withColumn("grp", F.col("region")), "grp", F.col("k") % 5 == 0, ("ASIA",))
    return rounded(zonal.signal_percent(m, ["grp"], zonal.family_signals(m), counted=F.col("k") % 7 <= 3))


_DRY = "case when value < 1000 then 'dry' when value < 5000 then 'middle' else 'wet' end"


@query(f"with {_FLAGS}, c as (select {_DRY} dryness, indicator, case when w and b then 1 when w then 2 when b then 3 else 4 end as class, sum(flags.area) area from flags join (select k, value from maps) using (k) group by 1, 2, 3) select dryness, indicator, class, round(area, 6) area, round(area / sum(area) over (partition by dryness, indicator), 6) fraction from c")
def confusion_by_aridity(spark, d):
    """Outcomes by class of a cell value in the role of its aridity."""
    from ..operators.drivers import aridity_class as classed

    dryness = classed(customer_cells(spark, d).select("k", F.col("value").alias("aridity")), [1000.0, 5000.0], ["dry", "middle", "wet"]).select("k", F.col("class").alias("dryness"))
    return rounded(zonal.confusion_fractions(_flags(spark, d).join(dryness, "k"), ["dryness"], ["indicator"], "w", "b"))
