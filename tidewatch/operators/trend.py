"""Group E: trend estimators per series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as numeric
from ..functions.stats import normal_two_sided, student_two_sided
from . import blocks
from .rolling import interpolate_onto

#: series up to this length have an exact p of Kendall's tau if no values tie
EXACT = 33
#: series up to this length have all their slopes computed (8 bytes for each pair of steps)
DIRECT = 1500


def _exact_p(s: float, n: int) -> float:
    """Two-sided p of n values without ties: the share of orders that are at least as far from no trend."""
    pairs = n * (n - 1) // 2
    share = np.ones(1)
    for j in range(2, n + 1):  # orders of j values by their inversions: the j-th adds 0 to j - 1
        share = np.convolve(share, np.full(j, 1 / j))
    fewer = int(round((pairs - abs(s)) / 2))
    return 1.0 if 2 * fewer >= pairs else min(1.0, 2 * share[: fewer + 1].sum())


def exact_p(found: dict) -> np.ndarray:
    """Exact p of the series in a result of `blocks.kendall_of` that are short and without ties, NaN for others."""
    short = (found["n"] >= 2) & (found["n"] <= EXACT) & ~found["tied"]
    return np.array([_exact_p(s, n) if ok else np.nan for s, n, ok in zip(found["s"].tolist(), found["n"].tolist(), short.tolist(), strict=True)])


def kendall(df: DataFrame, key: list[str], least: int = 2, time: str = "t", value: str = "value") -> DataFrame:
    """Key, n, tau (tau-b against time) and pval (N1) of each series; NULL below `least` values, keys kept.

    Series are counted in blocks, after one exchange. p is exact up to EXACT values without ties, and the normal approximation with ties beyond.
    """

    def taus(table, starts):
        import pyarrow as pa

        y, row = blocks.numbers(table, value), blocks.owners(starts, table.num_rows)
        known = ~np.isnan(y)
        found = numeric.kendall_of(y[known], row[known], len(starts))
        few = found["n"] < max(2, least)
        columns = {k: table.column(k).take(pa.array(starts)) for k in key} | {"n": pa.array(found["n"])}
        columns |= {n: pa.array(np.where(few, np.nan, a), from_pandas=True) for n, a in (("tau", found["tau"]), ("z", found["z"]), ("exact", exact_p(found)))}
        return pa.table(columns)

    found = blocks.map_series(df, key, time, [value], f"{blocks.ddl(df, key)}, n int, tau double, z double, exact double", taus)
    return found.select(*key, "n", "tau", F.when(F.col("tau").isNotNull(), F.coalesce("exact", normal_two_sided(F.col("z")))).alias("pval"))


def kendall_pairs(df: DataFrame, key: list[str], time: str = "t", value: str = "value") -> DataFrame:
    """E1 for short series: all pairs inside one row, with no join."""
    ordered = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))), lambda x: x["v"]).alias("_y"))
    later = lambda y, i: F.slice(y, i + 2, F.greatest(F.size(y) - i - 1, F.lit(0)))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("u"))
    inner = lambda a, v, w: F.struct((a["s"] + F.signum(w - v).cast("bigint")).alias("s"), (a["u"] + F.when(w != v, 1).otherwise(0)).alias("u"))
    per = F.transform("_y", lambda v, i: F.aggregate(later(F.col("_y"), i), zero, lambda a, w: inner(a, v, w)))
    summed = F.aggregate(per, zero, lambda a, p: F.struct((a["s"] + p["s"]).alias("s"), (a["u"] + p["u"]).alias("u")))
    n = F.size("_y").cast("bigint")
    pairs = n * (n - 1) / 2
    return ordered.withColumn("_s", summed).select(*key, F.size("_y").alias("n"), F.try_divide(F.col("_s.s").cast("double"), F.sqrt(pairs * F.col("_s.u"))).alias("tau"))


def _slopes(x: np.ndarray, y: np.ndarray, z: float) -> tuple[float, float, float]:
    """Median of the slopes of all pairs and the two ends of its interval (Sen 1968), NaN without pairs."""
    n = len(y)
    plain = n <= DIRECT or len(np.unique(x)) < n
    slopes, size = np.zeros(0), n * (n - 1) // 2
    if plain:
        slopes, size = np.empty(size), 0
        for i in range(n - 1):
            dx = x[i + 1 :] - x[i]
            later = dx > 0
            slopes[size : size + later.sum()] = (y[i + 1 :] - y[i])[later] / dx[later]
            size += later.sum()
        slopes = slopes[:size]
    if not size:
        return np.nan, np.nan, np.nan
    _, ties = np.unique(y, return_counts=True)
    sigma = np.sqrt(max(0.0, (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5.0)).sum()) / 18))
    low = max(int(np.round((size - z * sigma) / 2)) - 1, 0)
    high = min(int(np.round((size + z * sigma) / 2)), size - 1)
    wanted = sorted({low, high, (size - 1) // 2, size // 2})
    if plain:
        slopes.partition(wanted)
        at = {k: slopes[k] for k in wanted}
    else:
        at = {k: numeric.slope_at(x, y, k) for k in wanted}
    return (at[(size - 1) // 2] + at[size // 2]) / 2, at[low], at[high]


def theil_sen(df: DataFrame, key: list[str], per_year: float = 52.0, alpha: float = 0.95, time: str = "t", value: str = "value") -> DataFrame:
    """N, slope per year, its interval and sig (-1, 0, 1 by where the interval lies; 0 if it holds 0).

    Beyond DIRECT steps the three ranks are selected by counting slopes below a bound as inversions, so a series takes O(n log n) time and O(n) memory.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf((1 + alpha) / 2)

    def slopes(table, starts):
        import pyarrow as pa

        y, x = blocks.numbers(table, value), blocks.numbers(table, time) / per_year
        ends, known = np.append(starts[1:], len(y)), ~np.isnan(y)
        found = np.array([_slopes(x[i:j][known[i:j]], y[i:j][known[i:j]], z) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]).reshape(-1, 3)
        columns = {k: table.column(k).take(pa.array(starts)) for k in key} | {"n": pa.array(np.add.reduceat(known, starts, dtype=np.int32))}
        return pa.table(columns | {n: pa.array(found[:, i], from_pandas=True) for i, n in enumerate(("slope", "lo", "hi"))})

    found = blocks.map_series(df, key, time, [value], f"{blocks.ddl(df, key)}, n int, slope double, lo double, hi double", slopes)
    sig = F.when(F.col("lo") > 0, 1).when(F.col("hi") < 0, -1).otherwise(0)
    return found.withColumn("sig", F.when(F.col("slope").isNotNull(), sig))


def mean_change(df: DataFrame, key: list[str], alpha: float = 0.05, time: str = "t", value: str = "value", with_p: bool = True) -> DataFrame:
    """Second less first of the two equal halves around the middle row, and Welch's t with its p."""
    whole = Window.partitionBy(*key)
    df = df.withColumn("_i", F.row_number().over(whole.orderBy(time)) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    half = F.floor(F.col("_n") / 2)
    first, second = F.when(F.col("_i") < half, F.col(value)), F.when(F.col("_i") >= F.col("_n") - half, F.col(value))
    g = df.groupBy(*key).agg(*(f(c).alias(f"{name}{i}") for i, c in enumerate((first, second), 1) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    e1, e2 = (F.when(enough, F.try_divide(F.col(f"v{i}"), F.col(f"n{i}"))) for i in (1, 2))
    free = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1))
    change = F.col("m2") - F.col("m1")
    found = g.select(*key, change.alias("mean_change"), F.try_divide(change, F.sqrt(e1 + e2)).alias("t_stat"), free.alias("dof"))
    if with_p:
        found = found.withColumn("t_pval", student_two_sided(F.col("t_stat"), F.col("dof"))).withColumn("sig", F.col("t_pval") < alpha)
    return found


def trend_stats(df: DataFrame, key: list[str], x: Column, value: str = "value") -> DataFrame:
    """Mean, population deviation and least-squares slope over the numeric time `x`, in one aggregate."""
    return df.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.regr_slope(F.col(value), x).alias("trend"))


def index_correlation(df: DataFrame, index: DataFrame, key: list[str], time: str = "time", value: str = "value", interpolate: bool = False) -> DataFrame:
    """Pearson's correlation of each series with one index series on the times they share, or with the index interpolated to the times of the series."""
    index = interpolate_onto(index, df.select(time).distinct(), [], time, "value") if interpolate else index
    shared = df.join(index.select(time, F.col("value").alias("_index")), time)
    return shared.groupBy(*key).agg(F.corr(value, "_index").alias("corr"))


def qualifying(long: DataFrame, names: list[str], column: str = "indicator") -> DataFrame:
    """Rows of the indicators asked for."""
    return long.where(F.col(column).isin(names))
