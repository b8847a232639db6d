"""Queries over driver features and the classifier: groups J and K."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drivers, model
from .inputs import CELLS, CUSTOMER_CELLS, S1, S2, SCORED, cells, customer_cells, draw_sql, query, rounded, s1, s2, scored, table


@query(f"with {S1} select k, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(regr_slope(value, date_diff('day', date '1996-01-01', time) / cast(30.44 as double)), 6) trend from s1 where time between date '1996-01-01' and date '1999-12-31' group by 1")
def driver_map(spark, d):
    return rounded(drivers.driver_map(s1(spark, d), ["k"], "1996-01-01", "1999-12-31"))


@query()
def evaporation_driver(spark, d):
    c = customer_cells(spark, d)
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    cube = c.drop("value").join(o, c.k == o.o_custkey).groupBy((F.floor(F.col("lat") / 10) * 10).cast("double").alias("lat"), (F.floor(F.col("lon") / 10) * 10).cast("double").alias("lon"), F.trunc("time", "month").alias("time")).agg(F.sum("value").alias("value"))
    return rounded(drivers.evaporation([cube.where("lat < 0"), cube.where("lat >= 0")], 2, "1996-01-01", "1999-12-31", nodata=1e12), 4)


@query()
def groundwater_driver(spark, d):
    c = customer_cells(spark, d)
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    cube = c.drop("value").join(o, c.k == o.o_custkey).groupBy((F.floor(F.col("lat") / 10) * 10).cast("double").alias("lat"), (F.floor(F.col("lon") / 10) * 10).cast("double").alias("lon"), F.trunc("time", "year").alias("time")).agg(F.sum("value").alias("value"))
    return rounded(drivers.groundwater([cube.where("lon < 200"), cube.where("lon > 120")], 2, 20.0, "1995-01-01", "2001-12-31"), 4)


@query("""with m as (select c_nationkey k, cast(date_trunc('month', o_orderdate) as date) as time, round(sum(o_totalprice), 2) / 1e6 tp, cast(count(*) as double) pet from orders join customer on o_custkey = c_custkey group by 1, 2),
y as (select k, year(time) as y, sum(case when tp = 0 then 1e-6 else tp end) / sum(case when pet = 0 then 1e-6 else pet end) r from m group by 1, 2), z as (select k, y, case when r <= 100 then 10 * r end v from y)
select k, round(avg(v), 6) mean, round(stddev_pop(v), 6) std, round(regr_slope(v, (make_date(y, 1, 1) - date '2000-01-01') / 365.25::double), 6) trend from z group by 1""")
def aridity_driver(spark, d):
    from .maps import _arid

    tp, pet = _arid(spark, d)
    return rounded(drivers.aridity_driver(tp, pet, ["k"]))


@query(f"with {S2}, i as (select time, round(sum(value), 5) total from s2 group by 1) select k, round(corr(value, total), 6) corr from s2 join i using (time) group by 1")
def index_driver(spark, d):
    s = s2(spark, d)
    index = s.groupBy("time").agg(F.round(F.sum("value"), 5).alias("value"))
    return rounded(drivers.index_driver(s, index, ["k"]))


@query(f"with {CUSTOMER_CELLS}, c as (select cast(floor(lat / 30) * 30 as double) lat, cast(floor(lon / 30) * 30 as double) lon, segment, count(*) n from ccells group by 1, 2, 3), r as (select *, row_number() over (partition by lat, lon order by n desc, segment) r from c) select lat, lon, segment from r where r = 1")
def majority_class(spark, d):
    return drivers.majority(customer_cells(spark, d), 30.0, "segment")


@query("""with y as (select o_custkey % 100 k, year(o_orderdate) y, sum((o_orderstatus = 'F')::int) nd, avg((o_orderstatus = 'F')::int) frac from orders group by 1, 2)
select k, round(avg(nd), 6) fire_days, round(avg(frac), 6) fire_fraction, round(regr_slope(cast(nd as double), cast(y as double)), 6) fire_trend from y group by 1""")
def fire_days(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("time"), "o_orderstatus")
    return rounded(drivers.fire(o, ["k"], F.col("o_orderstatus") == "F"))


@query(f"with {CUSTOMER_CELLS} select cast(floor(lat / 10) * 10 as double) lat, cast(floor(lon / 10) * 10 as double) lon, round(avg(value), 6) acct_value from ccells group by 1, 2")
def harmonised_predictor(spark, d):
    c = customer_cells(spark, d).select((F.floor(F.col("lat") / 10) * 10).cast("double").alias("latitude"), (F.floor(F.col("lon") / 10) * 10).cast("double").alias("longitude"), "value", F.col("k").alias("extra"))
    return rounded(drivers.harmonise(c, "acct", drop=("extra",)))


@query(f"""with {CUSTOMER_CELLS}, g as (select cast(floor(lat / 10) * 10 as double) lat, cast(floor(lon / 10) * 10 as double) lon, avg(value) v from ccells group by 1, 2), la as (select distinct lat from g), lo as (select distinct lon from g),
w as (select la.lat, lo.lon, v from la cross join lo left join g on g.lat = la.lat and g.lon = lo.lon), n as (select lat, lon, v, lead(lon) over (partition by lat order by lon) lon1, lead(v) over (partition by lat order by lon) v1 from w)
select lat, lon + 2.5 lon, round(0.75::double * v + 0.25::double * v1, 6) acct_value from n where lon1 = lon + 10""")
def regridded_predictor(spark, d):
    """A predictor on a coarse map, brought to a finer one: a quarter of the way to each eastern neighbour."""
    c = customer_cells(spark, d)
    at = lambda x: (F.floor(F.col(x) / 10) * 10).cast("double")
    coarse = c.select(at("lat").alias("latitude"), at("lon").alias("longitude"), "value")
    points = coarse.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    lats, lons = points.select("lat").distinct(), points.select("lon").distinct()
    pairs = lons.select(F.col("lon").alias("_o")).join(lons.withColumn("_o", F.col("lon") - 10).select("_o"), "_o")
    return rounded(drivers.harmonise(coarse, "acct", grid=lats.crossJoin(pairs.select((F.col("_o") + 2.5).alias("lon")))))


@query("select s_suppkey k, s_acctbal balance from supplier")
def without_constant_columns(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("nothing"))
    return s.drop(*drivers.constant_columns(s, ["balance", "one", "nothing"]))


@query("select p_partkey k, (p_size > 25)::int big, try_cast(regexp_extract(p_brand, '#(.*)', 1) as double) brand from part")
def binary_and_numeric(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") - 25).alias("big"), F.regexp_extract("p_brand", "#(.*)", 1).alias("brand"))
    return drivers.binary_and_numeric(p, ["big"], ["brand"])


@query("select 'p_size' as \"column\", max(p_size)::double largest, max(p_size) > 100 bad from part union all select 'p_retailprice', max(p_retailprice), max(p_retailprice) > 100 from part")
def range_check(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return drivers.out_of_range(p, ["p_size", "p_retailprice"], 100.0)


_DESCRIBE = "count({0}) as count, round(avg({0}), 6) mean, round(stddev_samp({0}), 6) std, min({0})::double as min, round(quantile_cont({0}, 0.01), 6) p01, round(quantile_cont({0}, 0.5), 6) p50, round(quantile_cont({0}, 0.99), 6) p99, max({0})::double as max"


@query(" union all ".join(f"select '{c}' as \"column\", {_DESCRIBE.format(c)} from part" for c in ("p_size", "p_retailprice")))
def described_columns(spark, d):
    return rounded(drivers.describe(table(spark, d, "part"), ["p_size", "p_retailprice"]))


@query(f"with {CELLS} select k, value > 5000 target, case when value > 5000 then value + 1 else value - 1 end as value from cells where value is not null")
def target_table(spark, d):
    """Cells of high value are positives, the others negatives."""
    c = cells(spark, d).select("k", "value")
    return drivers.target_table(c, c.where("value > 5000").withColumn("value", F.col("value") + 1), c.where("value <= 5000").withColumn("value", F.col("value") - 1), ["k"], ["value"])


# --- classifier

@query(f"with {CELLS}, b as (select distinct floor(lat / 10) i, floor(lon / 10) j from cells), n as (select i, j, (row_number() over (order by i, j) - 1) % 5 f from b) select k, cast(f as integer) fold from cells join n on i = floor(lat / 10) and j = floor(lon / 10)")
def spatial_folds(spark, d):
    return model.spatial_folds(cells(spark, d), seed=None).select("k", "fold")


_CURVE = f"""{SCORED}, g as (select p, sum((y = 1)::int) pos, sum((y <> 1)::int) neg from scored group by 1), c as (select p threshold, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over () positives, sum(neg) over () negatives from g window w as (order by p desc))"""


@query(f"with {_CURVE} select threshold, cast(tp as bigint) tp, cast(fp as bigint) fp, cast(positives as bigint) positives, cast(negatives as bigint) negatives, round(tp / (tp + fp), 6) as precision_, round(tp / positives, 6) recall, round(fp / negatives, 6) fpr from c")
def score_curve(spark, d):
    return rounded(model.curve(scored(spark, d), [])).withColumnRenamed("precision", "precision_")


_AP = f"""{SCORED}, g as (select fold, p, sum((y = 1)::int) pos, sum((y <> 1)::int) neg from scored group by 1, 2), c as (select fold, p, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over (partition by fold) np from g window w as (partition by fold order by p desc)),
s as (select fold, p, tp / (tp + fp) pr, tp / np rc from c), ap as (select fold, sum((rc - coalesce(prev, 0)) * pr) average_precision from (select *, lag(rc) over (partition by fold order by p desc) prev from s) group by 1)"""


@query(f"with {_AP} select fold, round(average_precision, 6) average_precision from ap")
def average_precision(spark, d):
    return rounded(model.average_precision(scored(spark, d), ["fold"]))


@query(f"with {SCORED}, g as (select fold, p, sum((y = 1)::int) pos, sum((y <> 1)::int) neg from scored group by 1, 2), w as (select fold, pos, neg, pos * (coalesce(sum(neg) over (partition by fold order by p rows between unbounded preceding and 1 preceding), 0) + neg / 2.0) w from g) select fold, round(sum(w)::double / (sum(pos)::double * sum(neg)), 6) roc_auc from w group by 1")
def roc_auc(spark, d):
    return rounded(model.roc_auc(scored(spark, d), ["fold"]))


@query(f"""with {_AP}, f as (select ap.fold, average_precision ap, n, positives from ap join (select fold, count(*) n, sum(y) positives from scored group by 1) x on x.fold = ap.fold), sm as (select avg(ap) macro, sum(ap * n) / sum(n) by_size, sum(ap * positives) / sum(positives) by_positives, sum(positives) / sum(n) base from f)
select round(macro, 6) macro, round(by_size, 6) by_size, round(by_positives, 6) by_positives, round(base, 6) base, round(macro / base, 6) lift, round((macro - base) / (1 - base), 6) gain from sm""")
def fold_summary(spark, d):
    s = scored(spark, d)
    sizes = s.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    return rounded(model.fold_summary(model.average_precision(s, ["fold"]).join(sizes, "fold"), "average_precision"))


@query(f"with {SCORED} select greatest(cast(ceil(p * 10) as integer) - 1, 0) bin, round(avg(p), 6) mean_p, round(avg((y = 1)::int), 6) observed, count(*) n from scored group by 1")
def calibration(spark, d):
    return rounded(model.calibration(scored(spark, d), []))


_CORR = [("p_size", "p_size"), ("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_retailprice"), ("p_retailprice", "p_partkey"), ("p_partkey", "p_partkey")]


@query(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) corr from part" for a, b in _CORR))
def correlations(spark, d):
    return rounded(model.correlations(table(spark, d, "part"), ["p_size", "p_retailprice", "p_partkey"]))


@query(f"""with {SCORED}, e as (select unnest(quantile_cont(p, [0.25, 0.5, 0.75])) e from scored), x as (select n_chars, p, (select count(*) from e where e <= p) bin from documents join scored on doc_id = key)
select cast(bin as integer) bin, count(*) n, round(median(p), 6) x_median, round(quantile_cont(n_chars, 0.5), 6) median, round(quantile_cont(n_chars, 0.05), 6) p05, round(quantile_cont(n_chars, 0.95), 6) p95 from x group by 1 having count(*) >= 20""")
def dependence(spark, d):
    s = scored(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars"), "key")
    return rounded(model.dependence(s, "p", "n_chars", bins=4))


@query(f"with {SCORED} select key, case when y = 1 then (select sum(1 - y) from scored)::double / (select sum(y) from scored) else 1 end weight from scored".replace("else 1 end weight", "else 1 end w").replace(" w from", " weight from"))
def class_weight(spark, d):
    return model.class_weight(scored(spark, d).withColumn("target", F.col("y") == 1)).select("key", "weight")


@query(f"with {SCORED} select * from scored qualify row_number() over (partition by y order by {draw_sql(42, 'key')}, key) <= 40")
def balanced_sample(spark, d):
    return model.balanced_sample(scored(spark, d), ["key"], 40, "y")


@query(f"with {SCORED} select * from scored qualify row_number() over (partition by fold order by {draw_sql(42, 'key')}, key) <= 15")
def sample_by_group(spark, d):
    """As many rows of each fold in the role of a zone."""
    return model.balanced_sample(scored(spark, d), ["key"], 15, "fold")


@query(f"with {SCORED}, h as (select *, {draw_sql(42, 'key')} h from scored), r as (select *, (h >> 20) % 64 sl from h) select key, y, p, cast((row_number() over (partition by y, sl order by h, key) - 1 + sl) % 5 as integer) fold from r")
def stratified_folds(spark, d):
    return model.stratified_folds(scored(spark, d).drop("fold"), ["key"], "y")


@query(f"with {CELLS}, b as (select distinct cast(floor(lat / 10) as bigint) i, cast(floor(lon / 10) as bigint) j from cells), n as (select i, j, (row_number() over (order by {draw_sql(42, 'i', 'j')}, i, j) - 1) % 5 f from b) select k, cast(f as integer) fold from cells join n on i = floor(lat / 10) and j = floor(lon / 10)")
def shuffled_spatial_folds(spark, d):
    return model.spatial_folds(cells(spark, d)).select("k", "fold")


def _features(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("key"), (F.col("label") < 5).alias("target"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)), (F.col("vec_id") % 3).cast("string").alias("soil"), (F.col("vec_id") % 3).cast("int").alias("fold"))


_X = [f"x{i}" for i in range(64)]
#: fewer and shallower trees than the operator's defaults, as queries run on small tables
_SMALL = {"trees": 5, "depth": 3}


@query()
def out_of_fold_scores(spark, d):
    return rounded(model.out_of_fold(_features(spark, d), _X, ["soil"], folds=3, **_SMALL).select("key", "target", "fold", "p"))


@query()
def feature_importance(spark, d):
    f = _features(spark, d)
    return rounded(model.importance(model.fit(f, _X, ["soil"], **_SMALL), f, top=5))


@query()
def partial_dependence(spark, d):
    f = _features(spark, d)
    return rounded(model.partial_dependence(f, model.fit(f, _X, [], **_SMALL), "x0", ["key"], points=10))


@query()
def individual_expectations(spark, d):
    """Score of each row as one of its features moves over the feature's range."""
    f = _features(spark, d)
    return rounded(model.expectations(f, model.fit(f, _X, [], **_SMALL), "x0", ["key"], points=5))


@query()
def attribution(spark, d):
    """Exact contributions of all features to the log odds of every row."""
    f = _features(spark, d)
    phi = model.attribution(f, model.fit(f, _X, ["soil"], **_SMALL), [*_X, "soil"], ["key"])
    return rounded(model.attribution_summary(phi, [], 5, f))


@query()
def attribution_by_class(spark, d):
    f = _features(spark, d)
    phi = model.attribution(f, model.fit(f, _X, ["soil"], **_SMALL), [*_X, "soil"], ["key"])
    return rounded(model.attribution_summary(phi.join(f.select("key", "soil"), "key"), ["soil"], 3, f))


@query()
def ablations(spark, d):
    return rounded(model.ablations(_features(spark, d), {"first": (_X[:32], []), "last": (_X[32:], []), "full": (_X, ["soil"])}, folds=3, **_SMALL))


@query()
def attribution_base(spark, d):
    """The log odds that attributions start from."""
    return rounded(model.base_value(model.fit(_features(spark, d), _X, ["soil"], **_SMALL)))
