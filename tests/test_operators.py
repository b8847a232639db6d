"""Closed forms and invariants on small hand-made series and maps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import agreement, changepoint, masking, model, regrid, rolling, trend, zonal
from tidewatch.operators import calendar as cal
from tidewatch.sources import tables


def series(spark, *values, names=None):
    rows = [(names[i] if names else f"s{i}", t, None if v is None else float(v)) for i, ys in enumerate(values) for t, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, t int, value double")


def one(df, **where):
    for c, v in where.items():
        df = df.where(F.col(c) == v)
    return df.collect()[0]


def test_all_missing_and_constant_series(spark):
    s = series(spark, [None] * 20, [3.0] * 20)
    rows = rolling.indicators(s, ["k"], 5).where("t = 10").orderBy("k").collect()
    assert rows[0]["std"] is None and rows[1]["std"] == 0
    assert rows[1]["ac1"] is None and rows[1]["skew"] is None and rows[1]["kurt"] is None
    k = trend.kendall(s, ["k"]).orderBy("k").collect()
    assert len(k) == 2 and k[0]["tau"] is None and k[0]["n"] == 0 and k[1]["tau"] is None
    assert changepoint.testable(s, ["k"]).count() == 0


def test_line(spark):
    s = series(spark, range(40), [-2 * x for x in range(40)])
    k = trend.kendall(s, ["k"]).orderBy("k").collect()
    assert [r["tau"] for r in k] == pytest.approx([1, -1]) and k[0]["pval"] < 1e-6
    ts = trend.theil_sen(s, ["k"], per_year=1).orderBy("k").collect()
    assert ts[0]["slope"] == ts[0]["lo"] == ts[0]["hi"] == pytest.approx(1) and ts[1]["slope"] == pytest.approx(-2)
    assert [r["sig"] for r in ts] == [1, -1]


def test_kendall_forms_agree(spark):
    rng = np.random.default_rng(1)
    s = series(spark, *[[None if rng.random() < 0.1 else int(v) for v in rng.integers(0, 9, 41)] for _ in range(6)])
    a = {r["k"]: r["tau"] for r in trend.kendall(s, ["k"]).collect()}
    b = {r["k"]: r["tau"] for r in trend.kendall_pairs(s, ["k"]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_gap_strict_and_tolerant(spark):
    y = [1.0, 3, 2, 5, None, 4, 8, 6, 7, 9, 3]
    s = series(spark, y)
    strict = {r["t"]: r["std"] for r in rolling.indicators(s, ["k"], 3).collect()}
    tolerant = {r["t"]: r["std"] for r in rolling.indicators(s, ["k"], 5, "tolerant").collect()}
    assert strict[4] is None and strict[5] is None and strict[7] is not None
    assert tolerant[5] is not None and tolerant[0] is None and tolerant[9] is None  # only whole windows count


@pytest.mark.parametrize("seed", range(3))
def test_windows_prefix_sums_and_numpy_agree(spark, seed):
    y = np.random.default_rng(seed).normal(10, 2, 60).round(3)
    s = series(spark, y).repartition(3)
    a = {r["t"]: r for r in rolling.indicators(s, ["k"], 9).collect()}
    b = {r["t"]: r for r in rolling.indicators_by_prefix(s, ["k"], 9).collect()}
    for t in range(60):
        w = y[max(0, t - 4) : t + 5]
        if len(w) < 9:
            assert a[t]["std"] is None and b[t]["std"] is None
            continue
        m, v = w.mean(), w.var()
        expected = {"std": w.std(), "ac1": ((w[1:] - m) * (w[:-1] - m)).sum() / 9 / v, "skew": ((w - m) ** 3).mean() / v**1.5, "kurt": ((w - m) ** 4).mean() / v**2}
        g1, g2 = (math.log(np.abs(w[h:] - w[:-h]).sum() / (2 * (9 - h))) for h in (1, 2))
        for n, x in expected.items():
            assert a[t][n] == pytest.approx(x) and b[t][n] == pytest.approx(x, abs=1e-8)
        assert a[t]["fd"] == pytest.approx(min(2, max(1, 2 - (g2 - g1) / math.log(2))))


def test_delta_sign(spark):
    s = series(spark, [5, 9, 1, 3], [1, 2, 9, 5])
    found = {r["k"]: r["delta_value"] for r in rolling.deltas(s, ["k"], ["value"]).collect()}
    assert found == {"s0": -8, "s1": 8}


def test_step_is_found(spark):
    rng = np.random.default_rng(3)
    y = np.concatenate((rng.normal(0, 1, 50), rng.normal(2, 1, 50)))
    s = series(spark, y)
    p = changepoint.pettitt(s, ["k"]).first()
    assert abs(p["pettitt_cp"] - 49) <= 3 and p["pettitt_pval"] < 0.01
    around = changepoint.around(s, changepoint.pettitt(s, ["k"]), ["k"], "pettitt_cp", "p").first()
    assert around["diff_p"] == pytest.approx(2, abs=0.6)
    f = changepoint.sup_f(s, ["k"])
    assert abs(f.first()["sc_bp"] - 50) <= 8 and f.first()["f_stat"] > 5
    assert stats.sup_f_p(f, stats.sup_f_null(spark, sims=400, steps=200)).first()["f_pval"] < 0.2


def test_variance_break(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate((rng.normal(0, 1, 100), rng.normal(0, 4, 100)))
    s = series(spark, y, rng.normal(0, 1, 200))
    b = {r["k"]: r["bp_var"] for r in changepoint.variance_break(s, ["k"]).collect()}
    assert abs(b["s0"] - 99) <= 12 and b["s1"] is None
    split = changepoint.single_variance_split(s.where("k = 's0'"), ["k"])
    assert changepoint.variance_ratio(s, split, ["k"], "split").first()["var_pval"] < 0.01


def test_variance_partition_is_the_cheapest():
    """Against every partition with up to three changes of a short series."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(5):
        y = np.concatenate((rng.normal(0, 1, 12), rng.normal(0, 5, 12)))
        c2 = np.concatenate(([0.0], np.cumsum((y - y.mean()) ** 2)))

        def cost(cuts, c2=c2):
            at = [0, *cuts, 24]
            return sum((b - a) * (math.log(2 * math.pi) + math.log(max((c2[b] - c2[a]) / (b - a), 1e-8)) + 1) + math.log(b - a) for a, b in zip(at, at[1:], strict=False)) + 3 * math.log(24) * len(cuts)

        choices = [c for n in range(4) for c in combinations(range(2, 23), n) if all(b - a >= 2 for a, b in zip((0, *c), (*c, 24), strict=True))]
        best = min(choices, key=cost)
        found = changepoint._first_variance_break(y)
        assert found == (best[0] - 1 if best else None)


def test_stl_leaves_little_of_season_and_trend(spark):
    t = np.arange(260)
    s = series(spark, 3 * np.sin(2 * np.pi * t / 26) + 0.01 * t)
    for robust in (False, True):
        r = rolling.stl_residual(s, ["k"], 26, robust=robust).where("t between 30 and 230").agg(F.max(F.abs("resid"))).first()[0]
        assert r < 0.15


def test_stl_keeps_gaps_and_missing_series(spark):
    s = series(spark, [None if t == 7 else float(t % 4) for t in range(40)], [None] * 40)
    found = rolling.stl_residual(s, ["k"], 4, robust=False)
    assert found.count() == 80
    assert found.where("k = 's0' and resid is null").count() == 1 and found.where("k = 's1' and resid is not null").count() == 0


def test_spline_through_a_cubic(spark):
    y = [0.01 * x**3 - x for x in range(12)]
    gaps = [None if i in (4, 7) else v for i, v in enumerate(y)]
    found = [r["value"] for r in changepoint.fill_spline(series(spark, gaps), ["k"]).orderBy("t").collect()]
    assert found == pytest.approx(y, abs=1e-6)


def test_distributions(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (None, 5.0), (12.7062, 1.0)], "t double, df double")
    p = [r[0] for r in df.select(stats.student_two_sided(F.col("t"), F.col("df"))).collect()]
    assert p[0] == pytest.approx(0.07338803, abs=1e-6) and p[1] == pytest.approx(1) and p[2] is None and p[3] == pytest.approx(0.05, abs=1e-5)
    f = spark.createDataFrame([(3.0, 5.0, 10.0)], "f double, a double, b double").select(stats.fisher_two_sided(F.col("f"), F.col("a"), F.col("b"))).first()[0]
    assert f == pytest.approx(2 * 0.0655624, abs=1e-4)
    z = spark.createDataFrame([(1.959964,), (-1.959964,)], "z double").select(stats.normal_two_sided(F.col("z"))).collect()
    assert [r[0] for r in z] == pytest.approx([0.05, 0.05], abs=1e-6)


def test_longitudes(spark):
    df = spark.createDataFrame([(0.0,), (179.9,), (180.0,), (359.75,)], "x double")
    assert [r[0] for r in df.select(tables.wrap_longitude(F.col("x"))).collect()] == pytest.approx([0, 179.9, -180, -0.25])


def test_axes(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"))], "latitude double, x double, v double")
    assert tables.rename_axes(df, required=("lat", "lon")).columns == ["lat", "lon", "v"]
    assert tables.nan_to_null(df).first()["v"] is None
    with pytest.raises(ValueError):
        tables.rename_axes(df, required=("time",))


def test_results_are_replaced_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lon double, v double")
    for _ in range(2):
        tables.write_result(df, f"file://{tmp_path}/r")
        tables.write_csv(df, f"file://{tmp_path}/c")
    assert tables.read_folder(spark, [f"file://{tmp_path}/r", f"file://{tmp_path}/r"]).count() == 2
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["lat", "lon", "v"]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1999;" + ";".join(map(str, range(1, 13))) + "\n1999;" + ";".join(["7"] * 12) + "\n")
    found = tables.read_wide_csv(spark, f"file://{tmp_path}/w.csv").orderBy("time").collect()
    assert len(found) == 12 and found[0]["value"] == 1 and found[11]["value"] == 7


def test_resample_errors_and_empty_sums(spark):
    df = spark.createDataFrame([("a", "2000-01-03", None)], "k string, time string, value double").withColumn("time", F.to_date("time"))
    assert cal.resample(df, ["k"], "W", "sum").first()["value"] == 0
    assert cal.resample(df, ["k"], "W", "sum", min_count=1).first()["value"] is None
    assert str(cal.resample(df, ["k"], "W", "mean").first()["time"]) == "2000-01-09"
    with pytest.raises(ValueError):
        cal.resample(df, ["k"], "D", "sum")


def test_kappa(spark):
    rows = [(k, "a", l) for k, l in enumerate([1, 1, 0, 0, -1, -1, None])] + [(k, "b", l) for k, l in enumerate([1, 1, 0, 0, -1, -1, 1])] + [(k, "c", l) for k, l in enumerate([-1, -1, 0, 0, 1, 1, 0])]
    df = spark.createDataFrame(rows, "k int, name string, label int")
    found = {(r["map_a"], r["map_b"]): r for r in agreement.kappa_pairs(df, ["k"], "name", "label").collect()}
    assert found["a", "b"]["kappa"] == pytest.approx(1) and found["a", "b"]["n"] == 6
    assert found["a", "c"]["kappa_weighted"] < 0


def test_scores_of_perfect_and_constant_predictions(spark):
    df = spark.createDataFrame([("perfect", i % 2, float(i % 2)) for i in range(20)] + [("constant", i % 2, 0.5) for i in range(20)], "g string, y int, p double")
    ap = {r["g"]: r["average_precision"] for r in model.average_precision(df, ["g"]).collect()}
    auc = {r["g"]: r["roc_auc"] for r in model.roc_auc(df, ["g"]).collect()}
    assert ap == pytest.approx({"perfect": 1, "constant": 0.5}) and auc == pytest.approx({"perfect": 1, "constant": 0.5})


def test_ring_has_one_hole(spark):
    ring = [(i, j) for i in range(1, 4) for j in range(1, 4) if (i, j) != (2, 2)]
    cells = spark.createDataFrame(ring, "i int, j int")
    assert [tuple(r) for r in regrid.holes(cells, 6, 6).collect()] == [(2, 2)]
    sizes = {r["size"] for r in regrid.components(cells).collect()}
    assert sizes == {8}


def test_bilinear_plane_and_missing_corner(spark):
    source = spark.createDataFrame([(float(i), float(j), None if (i, j) == (2, 2) else 2.0 * i + j) for i in range(3) for j in range(3)], "lat double, lon double, value double")
    target = spark.createDataFrame([(0.25, 0.5), (1.5, 1.5), (2.0, 1.0), (5.0, 0.0)], "lat double, lon double")
    found = {(r["lat"], r["lon"]): r["value"] for r in regrid.bilinear(target, source).collect()}
    assert found == {(0.25, 0.5): 1.0, (1.5, 1.5): None, (2.0, 1.0): 5.0, (5.0, 0.0): None}


def test_breaks_and_cuts(spark):
    rows = [("a", "2001-01-01", True, "2010-01-01", False), ("b", "2001-01-01", False, "2010-01-01", True), ("c", "2001-01-01", False, "2010-01-01", False)]
    df = spark.createDataFrame(rows, "k string, x_date string, x_pos boolean, y_date string, y_pos boolean").withColumns({c: F.to_date(c) for c in ("x_date", "y_date")})
    cuts = {(r["k"], r["test"]): str(r["cut_date"]) for r in masking.positive_cuts(df, ["k"], ["x", "y"]).collect()}
    assert cuts == {("a", "x"): "2001-01-01", ("a", "all"): "2001-01-01", ("b", "y"): "2010-01-01", ("b", "all"): "2001-01-01"}
    pool = {r["k"]: str(r["cut_date"]) for r in masking.combined_negative_pool(df, ["k"], ["x", "y"]).collect()}
    assert pool == {"a": "2001-01-01", "b": "2010-01-01"}
    late = spark.createDataFrame([("2013-01-01",), ("2011-12-31",), (None,)], "d string").select(masking.late_enough(F.to_date("d"), F.lit("2000-01-01").cast("date"))).collect()
    assert [r[0] for r in late] == [True, False, False]


def test_pseudo_breaks_come_from_the_pool(spark):
    keys = spark.range(200).select(F.col("id").alias("k"))
    pool = spark.createDataFrame([("2001-01-01",), ("2001-01-01",), ("2003-05-05",)], "d string").select(F.to_date("d").alias("cut_date"))
    found = masking.pseudo_breaks(keys, pool, ["k"], F.lit("1999-01-01").cast("date")).groupBy("cut_date").count().collect()
    assert {str(r["cut_date"]) for r in found} == {"2001-01-01", "2003-05-05"} and sum(r["count"] for r in found) == 200
    none = masking.pseudo_breaks(keys, pool.where("false"), ["k"], F.lit("1999-01-01").cast("date"))
    assert {str(r["cut_date"]) for r in none.collect()} == {"1999-01-01"}


def test_earth_area(spark):
    cells = spark.range(180).select((F.col("id") - 89.5).alias("lat"))
    total = cells.agg(F.sum(zonal.cell_area(F.col("lat"), 1.0, 1.0)) * 360).first()[0]
    assert total == pytest.approx(zonal.earth_area(), rel=1e-4)


def test_folds(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).alias("target"), (F.col("id") % 170 - 85).cast("double").alias("lat"), (F.col("id") % 350).cast("double").alias("lon"))
    counts = [r["count"] for r in model.stratified_folds(df, ["key"]).where("target").groupBy("fold").count().collect()]
    assert len(counts) == 5
    s = model.spatial_folds(df)
    blocks = s.groupBy(F.floor(F.col("lat") / 10), F.floor(F.col("lon") / 10)).agg(F.count_distinct("fold").alias("n"))
    assert blocks.agg(F.max("n")).first()[0] == 1 and s.count() == 500
    assert {r["count"] for r in model.balanced_sample(df, ["key"], 20).groupBy("target").count().collect()} == {20}


def test_variances_of_every_break_but_p_of_inner_ones(spark):
    s = spark.createDataFrame([(k, t, float((t * 7) % 5)) for k in range(4) for t in range(8)], "k int, t int, value double")
    at = spark.createDataFrame([(0, 1), (1, 2), (2, 5), (3, 6)], "k int, at int")
    found = {r["k"]: r for r in changepoint.variance_ratio(s, at, ["k"], "at").collect()}
    assert [found[k]["var_pval"] is None for k in range(4)] == [True, False, False, True]
    assert found[3]["v1"] is not None and found[1]["v1"] is not None and found[0]["v2"] is not None


def test_the_first_point_can_be_a_break(spark):
    df = spark.createDataFrame([(0.01, 0), (0.01, None), (0.2, 3), (None, 3)], "p double, cp int")
    assert [r[0] for r in df.select(changepoint.significant(F.col("p"), F.col("cp"))).collect()] == [True, False, False, False]


def test_examples_are_of_breaks_that_count(spark):
    df = spark.createDataFrame([(1, 9.0, 0.01), (2, 8.0, 0.5), (3, 30.0, 0.01)], "k int, score double, p double")
    assert [r["k"] for r in changepoint.top_examples(df, 2, "score", 20.0, ["k"], F.col("p") < 0.05).collect()] == [1]


def test_absurd_years_are_left_out_of_the_aridity_index(spark):
    import datetime

    from tidewatch.operators import drivers, zonal

    month = lambda y, m: datetime.date(y, m, 1)
    tp = spark.createDataFrame([(1, month(y, m), 2.0) for y in (2000, 2001, 2002) for m in (1, 2)], "k int, time date, value double")
    pet = spark.createDataFrame([(1, month(y, m), 0.0 if y == 2001 else 4.0) for y in (2000, 2001, 2002) for m in (1, 2)], "k int, time date, value double")
    assert zonal.aridity_index(tp, pet, ["k"]).first()["aridity"] == 0.5
    assert zonal.aridity_index(tp, pet, ["k"], method="monthly_ratio").first()["aridity"] > 1e5
    found = drivers.aridity_driver(tp, pet, ["k"]).first()
    assert found["mean"] == 5.0 and abs(found["trend"]) < 1e-12


def test_importance_sums_the_columns_of_a_category(spark):
    from tidewatch.operators import model

    rows_ = [(i, i % 3 == 0, float(i % 7), "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows_, "key int, target boolean, x double, soil string")
    found = {r["feature"]: r["importance"] for r in model.importance(model.fit(df, ["x"], ["soil"], trees=2, depth=2), df).collect()}
    assert set(found) == {"x", "soil"} and found["soil"] > 0.5 and abs(sum(found.values()) - 1) < 1e-6


def test_exact_p_of_short_series(spark):
    """Against all orders of six values; ties and long series take the normal approximation."""
    import itertools

    from tidewatch.operators import trend

    score = lambda y: sum((b > a) - (b < a) for i, a in enumerate(y) for b in y[i + 1 :])
    orders = [abs(score(o)) for o in itertools.permutations(range(6))]
    series = {"a": [1, 2, 3, 4, 5, 6], "b": [2, 1, 3, 6, 4, 5], "c": [6, 5, 3, 4, 2, 1], "d": [3, 6, 1, 4, 5, 2], "tied": [1, 1, 2, 3, 4, 5], "long": list(range(40))}
    df = spark.createDataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)], "k string, t int, value double")
    found = {r["k"]: r["pval"] for r in trend.kendall(df, ["k"]).collect()}
    for k in "abcd":
        assert found[k] == pytest.approx(sum(o >= abs(score(series[k])) for o in orders) / len(orders))
    assert 0 < found["tied"] < 0.05 and 0 <= found["long"] < 1e-9


def test_ranges_by_bands(spark):
    """Ranges of very different widths, gaps between them, ends, missing values and an axis of one point."""
    from tidewatch.operators import regrid

    edges = [-1000.0, -3.5, -3.25, 0.0, 0.001, 7.0, 5000.0]
    points = [(float(x),) for x in [*edges, -2000, -999.5, -3.3, 0.0005, 3, 6999, 4999.9]] + [(None,)]
    near = {r["x"]: r["near"] for r in regrid.nearest_on_axis(spark.createDataFrame(points, "x double"), spark.createDataFrame([(e,) for e in edges], "x double").withColumnRenamed("x", "x"), "x", "near").collect()}
    for (x,) in points:
        inside = x is not None and edges[0] <= x <= edges[-1]
        assert near[x] == (min(edges, key=lambda e: (abs(e - x), e)) if inside else None)
    one = regrid.nearest_on_axis(spark.createDataFrame([(4.0,), (5.0,)], "x double"), spark.createDataFrame([(4.0,)], "x double"), "x", "near").collect()
    assert {r["x"]: r["near"] for r in one} == {4.0: 4.0, 5.0: None}
    none = regrid.nearest_on_axis(spark.createDataFrame([(4.0,)], "x double"), spark.createDataFrame([], "x double"), "x", "near").collect()
    assert [r["near"] for r in none] == [None]


def test_series_onto_another_axis(spark):
    from tidewatch.operators import rolling

    df = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 5.0), ("a", 12, None), ("a", 20, 25.0)], "k string, t int, value double")
    axis = spark.createDataFrame([("a", t) for t in (-1, 0, 4, 10, 15, 20, 21)] + [("b", 3)], "k string, t int")
    found = {(r["k"], r["t"]): r["value"] for r in rolling.interpolate_onto(df, axis, ["k"], "t").collect()}
    assert found == {("a", -1): None, ("a", 0): 0.0, ("a", 4): 2.0, ("a", 10): 5.0, ("a", 15): 15.0, ("a", 20): 25.0, ("a", 21): None, ("b", 3): None}


def test_holes_on_land_only(spark):
    from tidewatch.operators import regrid

    ring = [(i, j) for i in range(1, 4) for j in range(1, 4) if (i, j) != (2, 2)] + [(i, j) for i in range(5, 8) for j in range(1, 4) if (i, j) != (6, 2)]
    cells = spark.createDataFrame(ring, "i long, j long")
    holes = lambda **more: sorted(map(tuple, regrid.holes(cells, 10, 6, **more).collect()))
    assert holes() == [(2, 2), (6, 2)]
    assert holes(land=spark.createDataFrame([(6, 2), (0, 0)], "i long, j long")) == [(6, 2)]


def test_counts_of_attributions(spark):
    from tidewatch.operators import model

    phi = spark.createDataFrame([("x", "a", 1.0), ("x", "b", -3.0), ("y", "a", 2.0)], "soil string, feature string, phi double")
    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "soil string")
    found = {(r["soil"], r["feature"]): (r["n_used"], r["n_available"], r["rank"]) for r in model.attribution_summary(phi, ["soil"], available=rows).collect()}
    assert found == {("x", "a"): (1, 2, 2), ("x", "b"): (1, 2, 1), ("y", "a"): (1, 1, 1)}
    assert {r["n_available"] for r in model.attribution_summary(phi.drop("soil"), [], available=rows).collect()} == {3}


def test_sweep_with_residuals(spark):
    """Two settings of a noisy seasonal series: one row each, and the robust one differs from the plain."""
    import datetime
    import random

    from tidewatch.operators import agreement

    rng = random.Random(3)
    first = datetime.date(2000, 1, 2)
    df = spark.createDataFrame([("a", first + datetime.timedelta(days=7 * i), float(i % 52) + rng.gauss(0, 1 + i / 300) + (50 if i % 97 == 0 else 0)) for i in range(300)], "k string, time date, value double")
    found = agreement.sweep(df, ["k"], freqs=("W",), windows=(1,), differences=(1,), names=("std",)).collect()
    assert sorted(r["tag"] for r in found) == ["freq-W_win-1.0_diff-1_stl-plain", "freq-W_win-1.0_diff-1_stl-robust"]
    assert len({r["tau"] for r in found}) == 2 and all(r["n"] == 300 - 52 for r in found)  # a window may hold the gap that differencing leaves


def test_tridiagonal_solution_and_long_daily_series(spark):
    """Against a dense solve; a daily series of 24 years is filled and keeps its cubic."""
    import numpy as np
    import pandas as pd

    from tidewatch.operators import changepoint

    rng = np.random.default_rng(5)
    low, high, right = rng.normal(size=(3, 40))
    diagonal = 4 + rng.random(40)
    dense = np.diag(diagonal) + np.diag(low[1:], -1) + np.diag(high[:-1], 1)
    assert np.allclose(changepoint._tridiagonal(low, diagonal, high, right), np.linalg.solve(dense, right))
    t = np.arange(8766)
    y = (t / 1000.0) ** 3 - t / 50.0
    gaps = rng.random(len(t)) < 0.3
    gaps[[0, 1, 2, 3, -1, -2, -3, -4]] = False
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": t, "value": np.where(gaps, np.nan, y)}))
    found = changepoint.fill_spline(df, ["k"]).toPandas().sort_values("t")["value"].to_numpy()
    assert np.allclose(found, y, atol=1e-6)


def test_theil_sen_against_all_pairs(spark):
    import itertools
    import statistics

    from tidewatch.operators import trend

    rows = [("a", t, float((t * 37) % 11)) for t in (0, 1, 2, 2, 5, 6, 9)] + [("b", 3, 1.0), ("b", 3, 2.0), ("c", 1, 1.0)]
    found = {r["k"]: r for r in trend.theil_sen(spark.createDataFrame(rows, "k string, t int, value double"), ["k"], per_year=1.0).collect()}
    slopes = [(v2 - v1) / (t2 - t1) for (k1, t1, v1), (k2, t2, v2) in itertools.combinations(rows[:7], 2) if t2 != t1]
    assert found["a"]["slope"] == pytest.approx(statistics.median(slopes)) and found["a"]["lo"] in [pytest.approx(s) for s in slopes]
    assert found["b"]["slope"] is None and found["c"]["slope"] is None


def test_legacy_flags(spark):
    """Indices from 1 looked up as if from 0 give the next step's date; missing labels may count as neutral."""
    from tidewatch.operators import agreement, calendar

    axis = spark.createDataFrame([(0, "2001-01-07"), (1, "2001-01-14"), (2, "2001-01-21")], "t int, d string").select("t", F.to_date("d").alias("time"))
    breaks = spark.createDataFrame([(1,), (2,)], "cp int")
    dates = lambda **more: {r["cp"]: str(r["date"]) for r in calendar.time_of_index(breaks, axis, "cp", "date", **more).collect()}
    assert dates() == {1: "2001-01-14", 2: "2001-01-21"} and dates(legacy_offset=True) == {1: "2001-01-21", 2: "None"}
    labels = spark.createDataFrame([(k, m, v) for k, (a, b) in enumerate([(1, 1), (0, None), (None, 1), (-1, -1)]) for m, v in (("a", a), ("b", b))], "k int, map string, label int")
    n = lambda **more: agreement.kappa_pairs(labels, ["k"], "map", "label", **more).first()["n"]
    assert n() == 2 and n(legacy_missing_as_neutral=True) == 4


def test_filling_takes_the_nearest_values_on_either_side(spark):
    y = [None, 2.0, None, None, 8.0, None, 4.0, None]
    found = [r["filled"] for r in rolling.fill_linear(series(spark, y), ["k"]).orderBy("t").collect()]
    assert found == pytest.approx([14 / 3, 2, 4, 6, 8, 6, 4, 14 / 3])
