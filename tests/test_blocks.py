"""Numerics on blocks of series against plain definitions, and the jobs built on them."""

import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import blocks
from tidewatch.operators import agreement, rolling, trend


def plain_window(w, strict):
    """std, ac1, skew, kurt, fd of one window, straight from their definitions."""
    known = w[~np.isnan(w)]
    if (strict and len(known) < len(w)) or len(known) < 3:
        return [np.nan] * 5
    m, v = known.mean(), known.var(ddof=0 if strict else 1)
    constant = len(set(known.tolist())) == 1
    v = 0.0 if constant else v
    out = [math.sqrt(v)]
    if v == 0:
        out += [np.nan] * 3
    else:
        z = (known - m) / math.sqrt(v)
        out += [np.nansum((w[1:] - m) * (w[:-1] - m)) / (v * (len(w) if strict else len(w) - 1)), (z**3).mean(), (z**4).mean()]
    d1, d2 = (np.nansum(np.abs(w[h:] - w[:-h])) / (2 * (len(w) - h)) for h in (1, 2))
    out.append(min(2, max(1, 2 - (math.log(d2) - math.log(d1)) / math.log(2))) if d1 > 0 and d2 > 0 else np.nan)
    return out


def gappy(seed, n, rows=1):
    rng = np.random.default_rng(seed)
    y = rng.normal(50, 3, (rows, n)).round(2)
    y[rng.random((rows, n)) < 0.3] = np.nan
    y[0, n // 2 : n // 2 + n // 4] = 7.25  # constant for a while
    y[0, n // 4 : n // 3] = np.nan
    return y


@pytest.mark.parametrize("half", [1, 2, 4, 11])
@pytest.mark.parametrize("strict", [False, True])
def test_windows_by_running_sums(spark, half, strict):
    y = gappy(half, 60, 3) if not strict else np.random.default_rng(half).normal(50, 3, (3, 60)).round(2)
    found = blocks.indicators(y, half, strict)
    mode = "strict" if strict else "tolerant"
    df = spark.createDataFrame([(k, t, None if np.isnan(v) else float(v)) for k, row in enumerate(y) for t, v in enumerate(row)], "k int, t int, value double")
    frames, prefix = ({(r["k"], r["t"]): r for r in f(df, ["k"], 2 * half, mode).collect()} for f in (rolling.indicators, rolling.indicators_by_prefix))
    for k in range(3):
        for t in range(60):
            whole = half <= t < 60 - half
            want = plain_window(y[k, t - half : t + half + 1], strict) if whole else [np.nan] * 5
            for name, x in zip(blocks.INDICATORS, want, strict=True):
                for got in (found[name][k, t], prefix[k, t][name], frames[k, t][name]):
                    got = np.nan if got is None else got
                    assert (np.isnan(x) and np.isnan(got)) or got == pytest.approx(x, abs=1e-7), (k, t, name)


def test_time_does_not_grow_with_the_window(spark):
    """A window of 521 steps over daily years takes no longer than one of 13."""
    y = np.random.default_rng(0).normal(0, 1, 9000)
    df = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(y)], "k int, t int, value double").repartition(1).cache()
    df.count()

    def took(w):
        best = []
        for _ in range(3):
            began = time.time()
            rolling.indicators_by_prefix(df, ["k"], w, "tolerant").write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    took(13)
    assert took(521) < 2.5 * took(13) + 0.5
    found = rolling.indicators_by_prefix(df, ["k"], 521, "tolerant").where("t = 4000").first()
    assert [found[n] for n in blocks.INDICATORS] == pytest.approx(plain_window(y[3740:4261], False), rel=1e-8)


def test_odd_window():
    assert rolling.odd_window(2.5, 52) == 131 and rolling.odd_window(5, 12) == 61
    assert rolling.odd_window(10, 52, 345) == 277  # no longer than the series: four fifths of it, made odd
    assert rolling.odd_window(5, 12, 61) == 49 and rolling.odd_window(1, 5, 5) == 5 and rolling.odd_window(1, 9, 3) == 3


@pytest.mark.parametrize("seed", range(4))
def test_inversions_and_kendall(seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 12, (5, 40)).astype(float)
    y[rng.random(y.shape) < 0.2] = np.nan
    y[2], y[3] = np.nan, 4.0
    found = blocks.kendall(y)
    for k, row in enumerate(y):
        v = row[~np.isnan(row)]
        signs = [np.sign(v[j] - v[i]) for i in range(len(v)) for j in range(i + 1, len(v))]
        assert found["n"][k] == len(v) and found["s"][k] == sum(signs)
        untied = sum(s != 0 for s in signs)
        assert (np.isnan(found["tau"][k]) and not untied) or found["tau"][k] == pytest.approx(sum(signs) / math.sqrt(len(signs) * untied))
    rank = rng.integers(0, 30, 50)
    pairs = {(i, j) for i in range(50) for j in range(i + 1, 50) if rank[i] > rank[j]}
    assert blocks._inverted(rank) == len(pairs)
    assert set(zip(*(a.tolist() for a in blocks._inverted(rank, np.arange(len(pairs)))), strict=True)) == pairs
    some = np.sort(rng.choice(len(pairs), 20, replace=False))
    assert len(set(zip(*(a.tolist() for a in blocks._inverted(rank, some)), strict=True)) & pairs) == 20


@pytest.mark.parametrize("digits", [0, 1, 8])
def test_slopes_are_those_of_all_pairs(digits):
    rng = np.random.default_rng(digits)
    n = 300
    x = np.sort(rng.choice(1000, n, replace=False)).astype(float)
    y = np.round(0.01 * x + rng.normal(0, 1, n), digits)
    i, j = np.triu_indices(n, 1)
    slopes = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    for k in (0, 1, len(slopes) // 3, len(slopes) // 2, len(slopes) - 1):
        assert blocks.slope_at(x, y, k, held=300, sample=200) == pytest.approx(slopes[k], abs=1e-12)
    assert blocks.slope_at(x, np.zeros(n), 1000, held=300, sample=200) == 0


def test_theil_sen_of_24_daily_years(spark):
    """Selected ranks equal those of all pairs, in a fraction of their memory."""
    import tracemalloc

    rng = np.random.default_rng(1)
    n = 8766
    y = 0.2 * np.arange(n) / 365 + rng.normal(0, 1, n)
    tracemalloc.start()
    slope, low, high = trend._slopes(np.arange(n) / 365.25, y, 1.959963984540054)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert used < 50e6 and low < slope < high and slope == pytest.approx(0.2, abs=0.02)
    few = 2000  # beyond DIRECT, small enough for all pairs
    want = trend._slopes(np.arange(few) / 52.0, y[:few], 1.96)
    old, trend.DIRECT = trend.DIRECT, few
    try:
        assert trend._slopes(np.arange(few) / 52.0, y[:few], 1.96) == pytest.approx(want, rel=1e-12)
    finally:
        trend.DIRECT = old


@pytest.mark.parametrize("robust", [False, True])
def test_smoothing_by_convolution(robust):
    rng = np.random.default_rng(6)
    y = rng.normal(100, 2, (3, 300)).cumsum(axis=1)
    w = rng.random((3, 300)) * (rng.random((3, 300)) < 0.8) if robust else None
    if robust:
        w[1, 100:160] = 0  # weights vanish over more than a window
    assert blocks.loess_everywhere(y, 31, w) == pytest.approx(blocks.loess(y, 31, np.arange(300), w), rel=1e-6)


def test_residuals_of_blocks_and_of_single_series():
    rng = np.random.default_rng(8)
    t = np.arange(260)
    y = np.stack([a * np.sin(t * 2 * np.pi / 26) + b * t + rng.normal(0, 0.2, 260) for a, b in ((1, 0.01), (3, 0), (0.5, -0.02))])
    y[0, 50], y[1, 100:110], y[2] = 40.0, np.nan, y[2] + 1000
    for robust in (True, False):
        together = blocks.residual(y, 26, robust)
        apart = np.concatenate([blocks.residual(y[k : k + 1], 26, robust) for k in range(3)])
        assert np.nanmax(np.abs(together - apart)) < 1e-8 and np.isnan(together[1, 100:110]).all() and not np.isnan(together[0]).any()
    assert np.isnan(blocks.residual(np.full((1, 260), np.nan), 26, True)).all() and np.isnan(blocks.residual(y[:, :40], 26, True)).all()


def raw(spark):
    rng = np.random.default_rng(11)
    first = datetime.date(2001, 1, 1)
    rows = [(k, None if k == "b" else 1, first + datetime.timedelta(days=d), float(rng.normal(5, 1) + 0.001 * d)) for k in "abc" for d in range(0, 1500, 2 if k == "c" else 1)]
    return spark.createDataFrame(rows + [("d", 1, first, None)], "k string, l int, time date, value double").repartition(5)


def test_the_job_is_one_exchange(spark, capsys):
    job = rolling.early_warning(raw(spark), ["k", "l"], 27, freq="W", period=52)
    job.signals().explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 0


def test_the_job_equals_its_steps(spark):
    df = raw(spark)
    job = rolling.early_warning(df, ["k", "l"], 27, freq="W", period=52, mode="tolerant")
    weekly = df.groupBy("k", "l", F.next_day(F.date_sub("time", 1), "SUN").alias("time")).agg(F.avg("value").alias("value"))
    first, last = weekly.agg(F.min("time"), F.max("time")).first()
    axis = weekly.select("k", "l").distinct().select("k", "l", F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days"))).alias("time"))
    dense = axis.alias("x").join(weekly.alias("y"), F.expr("x.k = y.k and x.l <=> y.l and x.time = y.time"), "left").select("x.k", "x.l", "x.time", "y.value")
    dense = dense.withColumn("t", (F.datediff("time", F.lit(first)) / 7).cast("int"))
    rest = rolling.stl_residual(dense.fillna({"l": -1}), ["k", "l"], 52)
    from pyspark.sql import Window

    order = Window.partitionBy("k", "l").orderBy("t")
    diffed = rest.withColumn("value", F.col("resid") - F.lag("resid").over(order))
    want = {(r["k"], r["t"]): r for r in rolling.indicators(diffed, ["k", "l"], 27, "tolerant").collect()}
    signals = job.signals().collect()
    assert len(signals) == len(want)
    for r in signals:
        w = want[r["k"], r["t"]]
        assert r["time"] == w["time"]
        for n in ("value", "detrended"):
            pass
        for n in rolling.INDICATORS:
            assert (r[n] is None and w[n] is None) or r[n] == pytest.approx(w[n], abs=1e-6)
    long = spark.createDataFrame([(r["k"], r["t"], n, r[n]) for r in signals for n in rolling.INDICATORS], "k string, t int, indicator string, value double")
    tau = {(r["k"], r["indicator"]): r for r in trend.kendall(long, ["k", "indicator"]).collect()}
    deltas = {(r["k"], n): r[f"delta_{n}"] for r in job.deltas().collect() for n in rolling.INDICATORS}
    for r in job.trends().collect():
        w = tau[r["k"], r["indicator"]]
        assert r["n"] == w["n"] and (r["tau"], r["pval"]) == ((None, None) if w["tau"] is None else pytest.approx((w["tau"], w["pval"])))
        values = [(x[r["indicator"]], x["t"]) for x in signals if x["k"] == r["k"] and x[r["indicator"]] is not None]
        if not values:
            assert deltas[r["k"], r["indicator"]] is None
            continue
        top, low = max(values, key=lambda v: (v[0], -v[1])), min(values)
        assert deltas[r["k"], r["indicator"]] == pytest.approx((low[0] - top[0]) if low[1] > top[1] else (top[0] - low[0]))


def test_months_days_numbers_and_no_rows(spark):
    df = raw(spark)
    monthly = rolling.early_warning(df, ["k", "l"], years=1, freq="MS", how="sum", difference=False)
    rows = [r for r in monthly.signals().collect() if r["k"] == "a"]
    assert [r["time"].month for r in sorted(rows, key=lambda r: r["t"])][:13] == [*range(1, 13), 1]
    want = {r["m"]: r["v"] for r in df.where("k = 'a'").groupBy(F.trunc("time", "month").alias("m")).agg(F.sum("value").alias("v")).collect()}
    assert all(r["value"] == pytest.approx(want[r["time"]]) for r in rows)
    daily = rolling.early_warning(df, ["k", "l"], 31, freq="D").signals().where("k = 'c' and t = 3").first()
    assert daily["time"] == datetime.date(2001, 1, 4) and daily["value"] is None
    numbered = rolling.early_warning(spark.createDataFrame([("a", t, float(t * t)) for t in range(5, 25)], "k string, t int, value double"), ["k"], 5)
    assert sorted(r["t"] for r in numbered.signals().collect()) == list(range(5, 25))
    assert rolling.early_warning(df.limit(0), ["k", "l"], 5, freq="W").signals().collect() == []


def test_blocks_hold_whole_series(spark):
    """Every series lies in one block, whatever the batches and the block size."""
    from tidewatch.operators import blocks as dealt

    rows = [(k, None if k % 3 else float("nan"), t, float(t)) for k in range(40) for t in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "k int, x double, t int, value double").repartition(3)

    def count(table, starts):
        import pyarrow as pa

        ends = np.append(starts[1:], table.num_rows)
        assert (table.column("t").to_numpy()[starts] == 0).all()
        return pa.table({"k": table.column("k").take(pa.array(starts)), "n": pa.array(ends - starts, pa.int32())})

    for size in (1, 7, 1000):
        found = dealt.map_series(df, ["k", "x"], "t", ["value"], "k int, n int", count, rows=size).collect()
        assert sorted(map(tuple, found)) == [(k, k % 7 + 1) for k in range(40)]


def plain_kappa(a, b):
    both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
    if not both:
        return None
    n = len(both)
    if len({x for x, _ in both}) == len({y for _, y in both}) == 1:
        return float(both[0][0] == both[0][1])
    po = sum(x == y for x, y in both) / n
    pe = sum(sum(x == c for x, _ in both) * sum(y == c for _, y in both) for c in (-1, 0, 1)) / n / n
    return (po - pe) / (1 - pe)


def test_study_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    settings = [(f, w, d, s) for f in ("W", "MS") for w in (2.5, 5.0, 10.0) for d in (1, 0) for s in ("robust", "plain")]
    rows = []
    for cell in range(30):
        lean = rng.normal(0, 0.2)
        for f, w, d, s in settings:
            tau, p = float(np.clip(lean + rng.normal(0, 0.1), -1, 1)), float(rng.choice([0.01, 0.05, 0.2]))
            rows.append((cell, f, w, d, s, f"freq-{f}_win-{w}_diff-{d}_stl-{s}", "ac1", None if rng.random() < 0.05 else tau, p))
    pairs, summary = agreement.study(spark.createDataFrame(rows, "k int, freq string, win double, diff int, stl string, tag string, indicator string, tau double, pval double"), ["k"])
    label = {}
    for cell, f, w, d, s, _, _, tau, p in rows:
        label.setdefault((f, w, d, s), []).append(None if tau is None else 0 if p > 0.05 or abs(tau) <= 0.05 else int(np.sign(tau)))
    kappa = {(a, b): plain_kappa(label[a], label[b]) for i, a in enumerate(settings) for b in settings[i + 1 :]}
    r = summary.first()
    mean = lambda keep: pytest.approx(np.mean([v for (a, b), v in kappa.items() if keep(a, b) and v is not None]))
    differ = lambda a, b: [x != y for x, y in zip(a, b, strict=True)]
    assert pairs.count() == r["n_pairs"] == 276 and r["rank"] == 1
    assert r["lights_kappa"] == mean(lambda a, b: True) and r["p50"] == pytest.approx(np.median(list(kappa.values())))
    for f in ("W", "MS"):
        assert r[f"lights_kappa_{f}"] == mean(lambda a, b: a[0] == b[0] == f)
    for i, name in enumerate(("freq", "win", "diff", "stl")):
        assert r[f"only_{name}"] == mean(lambda a, b: sum(differ(a, b)) == 1 and differ(a, b)[i])
        if i:
            assert r[f"only_{name}_W"] == mean(lambda a, b: a[0] == b[0] == "W" and sum(differ(a, b)) == 1 and differ(a, b)[i])


def test_sweep_runs_stl_once_for_each_frequency_and_form(spark, capsys):
    swept = agreement.sweep(raw(spark), ["k", "l"], windows=(0.5, 1.0, 9.0))
    swept.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 2  # one of each for a frequency
    rows = swept.collect()
    assert len(rows) == 4 * 24 * 5 and {r["tag"] for r in rows} >= {"freq-W_win-0.5_diff-1_stl-robust", "freq-MS_win-9.0_diff-0_stl-plain"}
    one = [r for r in rows if r["k"] == "a" and r["tag"] == "freq-W_win-1.0_diff-1_stl-plain"]
    job = rolling.early_warning(raw(spark), ["k", "l"], 53, freq="W", period=52, robust=False, mode="tolerant", least=4)
    want = {r["indicator"]: r for r in job.trends().collect() if r["k"] == "a"}
    assert {r["indicator"]: (r["n"], r["tau"], r["pval"]) for r in one} == {k: (w["n"], pytest.approx(w["tau"]), pytest.approx(w["pval"])) for k, w in want.items()}
