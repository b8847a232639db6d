"""Group F: change-point tests per series. Break indices count from 0; a break is the last point before the change."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher_two_sided
from . import blocks


def testable(df: DataFrame, key: list[str], missing: int = 50, value: str = "value") -> DataFrame:
    """rows of series with at most `missing` gaps and some variance."""
    good = df.groupBy(*key).agg(F.sum(F.col(value).isNull().cast("int")).alias("_gaps"), F.var_samp(value).alias("_v")).where((F.col("_gaps") <= missing) & (F.col("_v") > 0))
    return df.join(good.select(*key), key, "left_semi")


def _tridiagonal(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system by elimination down and substitution up, O(n); low[0] and high[-1] are not read."""
    n = len(diagonal)
    c, r = np.zeros(n), np.zeros(n)
    c[0], r[0] = high[0] / diagonal[0], right[0] / diagonal[0]
    for i in range(1, n):
        pivot = diagonal[i] - low[i] * c[i - 1]
        c[i], r[i] = high[i] / pivot, (right[i] - low[i] * r[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        r[i] -= c[i] * r[i + 1]
    return r


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through (x, y) at places between the ends; end slopes as in the cubics through the four outer points."""
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    r = np.zeros(n)
    third = lambda i: ((d[i + 2] - d[i + 1]) / (x[i + 3] - x[i + 1]) - (d[i + 1] - d[i]) / (x[i + 2] - x[i])) / (x[i + 3] - x[i])
    r[0], r[-1] = third(0) * h[0] ** 2, -third(n - 4) * h[-1] ** 2
    r[1:-1] = np.diff(d)
    s = _tridiagonal(np.append(0, h), np.concatenate(([-h[0]], 2 * (h[:-1] + h[1:]), [-h[-1]])), np.append(h, 0), r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u = at - x[k]
    b = d[k] - h[k] * (2 * s[k] + s[k + 1])
    return y[k] + u * (b + u * (3 * s[k] + u * (s[k + 1] - s[k]) / h[k]))


def _without_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    there = ~np.isnan(y)
    if there.all() or not there.any():
        return y
    y = y.copy()
    y[~there] = _spline(x[there], y[there], np.clip(x[~there], x[there][0], x[there][-1]))
    return y


def fill_spline(df: DataFrame, key: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """gaps by a cubic spline through what is there; flat beyond the ends."""

    def filled(table, starts):
        import pyarrow as pa

        x, y = blocks.numbers(table, time), blocks.numbers(table, value).copy()
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True):
            y[i:j] = _without_gaps(x[i:j], y[i:j])
        return table.set_column(table.schema.get_field_index(value), value, pa.array(y, from_pandas=True))

    return blocks.map_series(df, key, time, [value], blocks.ddl(df, [*key, time, value]), filled)


def around(df: DataFrame, breaks: DataFrame, key: list[str], at: str, name: str, time: str = "t", value: str = "value", stat=F.avg) -> DataFrame:
    """A statistic before and after the break (the point itself in neither), their ratio and difference."""
    joined = df.join(breaks.select(*key, F.col(at).alias("_at")), key)
    g = joined.groupBy(*key).agg(stat(F.when(F.col(time) < F.col("_at"), F.col(value))).alias(f"m1_{name}"), stat(F.when(F.col(time) > F.col("_at"), F.col(value))).alias(f"m2_{name}"))
    a, b = F.col(f"m1_{name}"), F.col(f"m2_{name}")
    return g.select("*", F.try_divide(b, a).alias(f"prop_{name}"), (b - a).alias(f"diff_{name}"))


def pettitt(df: DataFrame, key: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """index of the largest |U|, its size K (`k_stat`) and p of Pettitt's test, on series without gaps."""
    by_value, by_time = Window.partitionBy(*key).orderBy(value), Window.partitionBy(*key).orderBy(time)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*key, value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    r = df.withColumn("_r", F.rank().over(by_value) + (ties - 1) / 2.0).withColumn("_n", n).withColumn("_i", F.row_number().over(by_time))
    u = 2 * F.sum("_r").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_i") * (F.col("_n") + 1)
    r = r.withColumn("_u", F.abs(u))
    g = r.groupBy(*key).agg(F.max_by(time, F.struct("_u", -F.col("_i"))).alias("pettitt_cp"), F.max("_u").alias("k_stat"), F.max("_n").cast("double").alias("_n"))
    p = F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("k_stat") * F.col("k_stat") / (F.pow("_n", F.lit(3)) + F.col("_n") * F.col("_n"))))
    return g.select(*key, "pettitt_cp", "k_stat", p.alias("pettitt_pval"))


def sup_f(df: DataFrame, key: list[str], trim: float = 0.15, time: str = "t", value: str = "value") -> DataFrame:
    """largest F and its index for a break in value = a + b * previous value, over the central part, from prefix sums.

    Sums are of values less the series mean, which changes no residual.
    """
    order = Window.partitionBy(*key).orderBy(time)
    whole = Window.partitionBy(*key)
    d = df.withColumn("_y", F.col(value) - F.avg(value).over(whole)).withColumn("_x", F.lag("_y").over(order)).where(F.col("_x").isNotNull())
    d = d.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole))
    sums = {"x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") * F.col("_y")}
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_a{k}": F.sum(v).over(run) for k, v in sums.items()} | {f"_t{k}": F.sum(v).over(whole) for k, v in sums.items()})

    def rss(n: Column, s: dict[str, Column]) -> Column:
        sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / n, s["xy"] - s["x"] * s["y"] / n, s["yy"] - s["y"] * s["y"] / n
        return syy - F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))

    left = {k: F.col(f"_a{k}") for k in sums}
    total = {k: F.col(f"_t{k}") for k in sums}
    right = {k: total[k] - left[k] for k in sums}
    low, high = F.floor(F.col("_n") * trim), F.floor(F.col("_n") * (1 - trim))
    inside = d.where((F.col("_i") >= F.greatest(low, F.lit(3))) & (F.col("_i") <= F.least(high, F.col("_n") - 3)))
    both = rss(F.col("_i"), left) + rss(F.col("_n") - F.col("_i"), right)
    inside = inside.withColumn("_f", F.try_divide(rss(F.col("_n"), total) - both, both / (F.col("_n") - 4)))
    return inside.groupBy(*key).agg(F.max_by(time, F.struct("_f", -F.col("_i"))).alias("sc_bp"), F.max("_f").alias("f_stat"))


def _first_variance_break(y: np.ndarray, least: int = 2) -> int | None:
    """First change of the cheapest partition by variance about the global mean: cost n (ln(2 pi s2) + 1), and for each
    segment the penalty 3 ln n with ln of its share of the length (MBIC). Pruned dynamic program."""
    n = len(y)
    if n < 2 * least:
        return None
    c2 = np.concatenate(([0.0], np.cumsum((y - y.mean()) ** 2)))
    penalty = 3 * math.log(n)

    def cost(i, j):
        m = j - i
        return m * (math.log(2 * math.pi) + np.log(np.maximum((c2[j] - c2[i]) / m, 1e-8)) + 1) + np.log(m)

    best = np.full(n + 1, np.inf)
    best[0], last, open_ = -penalty, np.zeros(n + 1, int), np.array([0])
    for j in range(least, n + 1):
        i = open_[open_ <= j - least]
        total = best[i] + cost(i, j) + penalty
        k = int(total.argmin())
        best[j], last[j] = total[k], i[k]
        keep = total - penalty <= best[j] + math.log(n)  # the length term can still fall by ln n at most
        open_ = np.concatenate((i[keep], open_[open_ > j - least], [j - least + 1] if j - least + 1 > 0 and j - least + 1 not in open_ else []))
        open_ = np.unique(open_.astype(int))
    at, first = n, None
    while at > 0:
        at = int(last[at])
        if at > 0:
            first = at
    return None if first is None else first - 1


def variance_break(df: DataFrame, key: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """index of the first variance change of each series, NULL where there is none."""

    def breaks(table, starts):
        import pyarrow as pa

        y, out = blocks.numbers(table, value), []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True):
            known = np.flatnonzero(~np.isnan(y[i:j])) + i
            at = _first_variance_break(y[known])
            out.append(None if at is None else int(known[at]))
        when = table.column(time).cast(pa.int64()).to_pylist()
        return pa.table({k: table.column(k).take(pa.array(starts)) for k in key} | {"bp_var": pa.array([None if k is None else when[k] for k in out], pa.int64())})

    return blocks.map_series(df, key, time, [value], f"{blocks.ddl(df, key)}, bp_var long", breaks)


def single_variance_split(df: DataFrame, key: list[str], least: int = 2, time: str = "t", value: str = "value") -> DataFrame:
    """F7 restricted to one change: the split with the lowest cost, from prefix sums, in windows only."""
    order, whole = Window.partitionBy(*key).orderBy(time), Window.partitionBy(*key)
    d = df.withColumn("_c", F.pow(F.col(value) - F.avg(value).over(whole), F.lit(2)))
    d = d.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_a", F.sum("_c").over(order)).withColumn("_t", F.sum("_c").over(whole))
    d = d.where((F.col("_i") >= least) & (F.col("_n") - F.col("_i") >= least))
    part = lambda s, n: n * F.log(F.greatest(s / n, F.lit(1e-8)))
    d = d.withColumn("_cost", part(F.col("_a"), F.col("_i")) + part(F.col("_t") - F.col("_a"), F.col("_n") - F.col("_i")))
    return d.groupBy(*key).agg(F.min_by(time, F.struct("_cost", "_i")).alias("split"), F.min("_cost").alias("cost"))


def variance_ratio(df: DataFrame, breaks: DataFrame, key: list[str], at: str, time: str = "t", value: str = "value", with_p: bool = True) -> DataFrame:
    """F8: variances before and after every break, their ratio and difference; F and its two-sided p (N3) of breaks that are
    neither among the first two points nor among the last two."""
    whole = Window.partitionBy(*key)
    d = df.join(breaks.select(*key, F.col(at).alias("_at")), key).withColumn("_n", F.count(F.lit(1)).over(whole))
    first, second = F.when(F.col(time) < F.col("_at"), F.col(value)), F.when(F.col(time) > F.col("_at"), F.col(value))
    inner = F.max((F.col("_at") > 1) & (F.col("_at") < F.col("_n") - 2)).alias("_inner")
    g = d.groupBy(*key).agg(F.var_samp(first).alias("v1"), F.var_samp(second).alias("v2"), F.count(first).alias("_n1"), F.count(second).alias("_n2"), inner)
    found = g.select(*key, "v1", "v2", F.try_divide(F.col("v2"), F.col("v1")).alias("prop_var"), (F.col("v2") - F.col("v1")).alias("diff_var"), F.when(F.col("_inner"), F.try_divide(F.col("v1"), F.col("v2"))).alias("f_var"), "_n1", "_n2")
    if with_p:
        found = found.withColumn("var_pval", fisher_two_sided(F.col("f_var"), F.col("_n1") - 1, F.col("_n2") - 1))
    return found.drop("_n1", "_n2")


def _pettitt(y: np.ndarray) -> tuple[int, float]:
    """place of the largest |U| and p."""
    n = len(y)
    _, back, counts = np.unique(y, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[back]
    u = np.abs(2 * np.cumsum(rank) - np.arange(1, n + 1) * (n + 1))
    return int(u.argmax()), float(min(1.0, 2 * np.exp(-6 * u.max() ** 2 / (float(n) ** 3 + float(n) ** 2))))


def _sup_f(y: np.ndarray, trim: float = 0.15) -> tuple[int | None, float | None]:
    """place and size of the largest F for a break in the regression on the value before."""
    c = y - y.mean()
    x, c = c[:-1], c[1:]
    n = len(c)
    i = np.arange(1, n + 1)
    left = {k: np.cumsum(v) for k, v in {"x": x, "y": c, "xx": x * x, "xy": x * c, "yy": c * c}.items()}
    total = {k: v[-1:] for k, v in left.items()}

    def rss(m, s):
        with np.errstate(divide="ignore", invalid="ignore"):
            sxx, sxy, syy = s["xx"] - s["x"] ** 2 / m, s["xy"] - s["x"] * s["y"] / m, s["yy"] - s["y"] ** 2 / m
            return syy - np.where(sxx != 0, sxy * sxy / np.where(sxx != 0, sxx, 1), 0.0)

    inside = (i >= max(np.floor(n * trim), 3)) & (i <= min(np.floor(n * (1 - trim)), n - 3))
    if not inside.any():
        return None, None
    both = rss(i, left) + rss(n - i, {k: total[k] - left[k] for k in left})
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(inside & (both != 0), (rss(n, total) - both) / (both / (n - 4)), -np.inf)
    at = int(f.argmax())
    return (at + 1, float(f[at])) if np.isfinite(f[at]) else (None, None)


_SIDES = lambda s: (f"m1_{s}", f"m2_{s}", f"prop_{s}", f"diff_{s}")
#: What is found for each series; places are times
_FOUND = {"pettitt_cp": "long", "pettitt_pval": "double"} | dict.fromkeys(_SIDES("pettitt"), "double") | {"sc_bp": "long", "f_stat": "double"} | dict.fromkeys(_SIDES("stc"), "double") | {"bp_var": "long"} | dict.fromkeys(("v1", "v2", "prop_var", "diff_var", "f_var", "var_pval"), "double")


def _tests(x: np.ndarray, y: np.ndarray, missing: int) -> dict:
    """All of _FOUND for one series, and `error`: an exception in one test leaves its own columns NULL and is told by its name."""
    from ..functions.stats import _incomplete_beta

    out: dict = {}
    known = y[~np.isnan(y)]
    if len(y) - len(known) > missing or len(known) < 2 or not (known != known[0]).any():
        return {"error": "too many gaps or no variance"}
    problems = []

    def guarded(name, test):
        try:
            with np.errstate(over="raise", invalid="raise"):
                out.update(test())
        except Exception as problem:  # noqa: BLE001  any series, whatever is in it, gets a row
            problems.append(f"{name}: {type(problem).__name__}: {problem}")

    def sides(name, at):
        a, b = (z.mean() if len(z) else None for z in (y[:at], y[at + 1 :]))
        both = a is not None and b is not None
        return dict(zip(_SIDES(name), (a, b, b / a if both and a else None, b - a if both else None), strict=True))

    def spline():
        nonlocal y
        y = _without_gaps(x, y)
        return {}

    def pettitt_():
        at, p = _pettitt(y)
        return {"pettitt_cp": int(x[at]), "pettitt_pval": p} | sides("pettitt", at)

    def sup_f_():
        at, f = _sup_f(y)
        return {} if at is None else {"sc_bp": int(x[at]), "f_stat": f} | sides("stc", at)

    def variance():
        at = _first_variance_break(y)
        if at is None:
            return {}
        a, b = y[:at], y[at + 1 :]
        v1, v2 = (z.var(ddof=1) if len(z) > 1 else None for z in (a, b))
        both = v1 is not None and v2 is not None
        found = {"bp_var": int(x[at]), "v1": v1, "v2": v2, "prop_var": v2 / v1 if both and v1 else None, "diff_var": v2 - v1 if both else None}
        if both and v2 and 1 < x[at] < len(y) - 2:
            f = v1 / v2
            below = float(_incomplete_beta((len(a) - 1) / 2, (len(b) - 1) / 2, (len(a) - 1) * f / ((len(a) - 1) * f + len(b) - 1)))
            found |= {"f_var": f, "var_pval": 2 * min(below, 1 - below)}
        return found

    guarded("spline", spline)
    if not problems:
        for name, test in (("pettitt", pettitt_), ("sup F", sup_f_), ("variance", variance)):
            guarded(name, test)
    return out | {"error": "; ".join(problems) or None}


def all_tests(df: DataFrame, key: list[str], null: DataFrame, missing: int = 50, time: str = "t", value: str = "value") -> DataFrame:
    """every test for every series, in one exchange and one pass over its rows.

    A series that fails the guard, or breaks a test, keeps its row: what could not be found is NULL and `error` says why; no
    other series is touched by it.
    """
    from ..functions.stats import sup_f_p

    def found(table, starts):
        import pyarrow as pa

        x, y = table.column(time).to_numpy(), blocks.numbers(table, value)
        rows = [_tests(x[i:j], y[i:j], missing) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(y)], strict=True)]
        columns = {n: pa.array([r.get(n) for r in rows], pa.int64() if t == "long" else pa.float64()) for n, t in _FOUND.items()}
        return pa.table({k: table.column(k).take(pa.array(starts)) for k in key} | columns | {"error": pa.array([r["error"] for r in rows], pa.string())})

    schema = ", ".join([blocks.ddl(df, key), *(f"{n} {t}" for n, t in _FOUND.items()), "error string"])
    names = [*_FOUND]
    names.insert(names.index("f_stat") + 1, "f_pval")
    return sup_f_p(blocks.map_series(df, key, time, [value], schema, found), null).select(*key, *names, "error")


def significant(p: Column, cp: Column, alpha: float = 0.05) -> Column:
    """the break counts; false where anything is missing. Indices count from 0, so the first point can be a break."""
    return F.coalesce((p < alpha) & (cp >= 0), F.lit(False))


def top_examples(df: DataFrame, n: int, score: str, cap: float, order: list[str], counts: Column | None = None) -> DataFrame:
    """of the rows whose break `counts` (F10; all if not given), the n highest scores up to the cap, or of all if none
    is within it. One aggregate and one top-n, no full sort."""
    df = df if counts is None else df.where(F.coalesce(counts, F.lit(False)))
    within = df.agg(F.max(F.coalesce(F.col(score) <= cap, F.lit(False))).alias("_any"))
    marked = df.join(F.broadcast(within)).where((F.col(score) <= cap) | ~F.col("_any")).drop("_any")
    return marked.orderBy(F.desc(score), *order).limit(n)


def examples(series: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """rows of the chosen series; `chosen` is a top-n table."""
    return series.join(F.broadcast(chosen.select(*key)), key, "left_semi")


def cumulative_area(breaks: DataFrame, year: str, cp: str, area: str, last: int, first: int, label: str | None = None) -> DataFrame:
    """per cent of the area with a test result whose break lies in or before each year, 0 before the first, on all years."""
    g = [label] if label else []
    total = breaks.where(F.col(cp).isNotNull()).groupBy(*g).agg(F.sum(area).alias("_all"))
    yearly = breaks.where(F.col(year).isNotNull()).groupBy(*g, F.col(year).alias("year")).agg(F.sum(area).alias("_a"))
    years = total.select(*g, "_all", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    w = Window.partitionBy(*g).orderBy("year")
    joined = years.join(yearly, [*g, "year"], "left")
    return joined.select(*g, "year", (100 * F.coalesce(F.sum("_a").over(w), F.lit(0.0)) / F.col("_all")).alias("percent"))


def forward_fill(df: DataFrame, order: str, value: str, key: list[str]) -> Column:
    """the last value before, 0 before the first."""
    return F.coalesce(F.last(value, True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
