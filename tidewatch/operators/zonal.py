"""Group I: area-weighted summaries by zone and scores of warnings against breaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
TESTS = ("tp", "fp", "fn", "tn")


def cell_area(lat: Column, dlat: float | Column = 0.25, dlon: float | Column = 0.25) -> Column:
    """km^2 of a cell, R^2 dlat dlon cos(lat)."""
    return F.lit(RADIUS_KM**2).cast("double") * F.radians(F.lit(dlat) if isinstance(dlat, float) else dlat) * F.radians(F.lit(dlon) if isinstance(dlon, float) else dlon) * F.cos(F.radians(lat))


def axis_step(df: DataFrame, axis: str, how: str = "median") -> DataFrame:
    """The step of an axis from its distinct points, as one row."""
    points = df.select(axis).distinct()
    d = points.select(F.abs(F.col(axis) - F.lag(axis).over(Window.orderBy(axis))).alias("d"))  # the distinct points of one axis
    return d.agg((F.median("d") if how == "median" else F.avg("d")).alias("step"))


def direction(tau: Column, p: Column, alpha: float = 0.05) -> Column:
    """Decrease, neutral or increase; NULL where tau is missing."""
    sig = F.coalesce(p < alpha, F.lit(False))
    return F.when(tau.isNull(), F.lit(None).cast("string")).when(sig & (tau < 0), "decrease").when(sig & (tau > 0), "increase").otherwise("neutral")


def area_split(df: DataFrame, group: list[str], tau: str, p: str, area: str = "area") -> DataFrame:
    """Area and per cent of each direction, per group."""
    d = df.withColumn("_d", direction(F.col(tau), F.col(p)))
    g = d.groupBy(*group).agg(*(F.coalesce(F.sum(F.when(F.col("_d") == n, F.col(area))), F.lit(0.0)).alias(n) for n in ("decrease", "neutral", "increase")))
    total = F.col("decrease") + F.col("neutral") + F.col("increase")
    return g.select(*group, "decrease", "neutral", "increase", *(F.try_divide(100 * F.col(n), total).alias(f"pct_{n}") for n in ("decrease", "neutral", "increase")))


def _moves(df: DataFrame, indicators: tuple[str, ...], alpha: float) -> dict[str, tuple[Column, Column]]:
    part = lambda n, up: F.coalesce((F.col(f"{n}_pval") < alpha) & ((F.col(f"{n}_tau") > 0) if up else (F.col(f"{n}_tau") < 0)), F.lit(False))
    return {n: (part(n, True), part(n, False)) for n in indicators}


def composite_signals(df: DataFrame, alpha: float = 0.05) -> dict[str, Column]:
    """I4: AC1 and SD together up, down or mixed; FD down; skewness and kurtosis up. Columns <name>_tau and <name>_pval."""
    m = _moves(df, ("ac1", "std", "fd", "skew", "kurt"), alpha)
    (a, a_), (s, s_) = m["ac1"], m["std"]
    return {"ac1_sd_up": a & s, "ac1_sd_down": a_ & s_, "ac1_sd_mixed": (a & s_) | (a_ & s), "fd_down": m["fd"][1], "skew_kurt_up": m["skew"][0] & m["kurt"][0]}


def family_signals(df: DataFrame, alpha: float = 0.05) -> dict[str, Column]:
    """Eight categories in three families: slowing (AC1 and SD), roughness (FD), asymmetry (skewness and kurtosis)."""
    m = _moves(df, ("ac1", "std", "fd", "skew", "kurt"), alpha)
    (a, a_), (s, s_), (f, f_), (k, k_), (u, u_) = (m[n] for n in ("ac1", "std", "fd", "skew", "kurt"))
    return {
        "slowing_up": a & s, "slowing_down": a_ & s_, "slowing_mixed": (a & s_) | (a_ & s), "roughness_down": f_, "roughness_up": f, "asymmetry_up": k & u, "asymmetry_down": k_ & u_, "asymmetry_mixed": (k & u_) | (k_ & u),
    }


def signal_percent(df: DataFrame, group: list[str], signals: dict[str, Column], area: str = "area", counted: Column | None = None) -> DataFrame:
    """Per cent of a group's area under each signal. `counted` limits the numerator (as to cells that are not urban), not the denominator."""
    inside = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    hits = [F.try_divide(100 * F.coalesce(F.sum(F.when(c & inside, F.col(area))), F.lit(0.0)), F.sum(area)).alias(n) for n, c in signals.items()]
    return df.groupBy(*group).agg(*hits)


def with_cropland(df: DataFrame, group: str, cropland: Column, excluded: tuple[str, ...] = (), name: str = "cropland") -> DataFrame:
    """Cropland becomes a group of its own and leaves the numerator and denominator of the others; `excluded` and unknown groups drop out, but for their cropland."""
    inside = F.coalesce(cropland, F.lit(False))
    kept = df.where(inside | F.col(group).isNotNull() & ~F.col(group).isin(*excluded)) if excluded else df.where(inside | F.col(group).isNotNull())
    return kept.withColumn(group, F.when(inside, F.lit(name)).otherwise(F.col(group)))


def tidy(df: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """One row per group and signal."""
    return df.unpivot(group, names, "signal", "percent")


def aridity_index(tp: DataFrame, pet: DataFrame, key: list[str], method: str = "annual", scale: float = 1.0, cap: float = 100.0, time: str = "time") -> DataFrame:
    """Mean over years of annual sums of precipitation over evaporation, ratios above `cap` left out (`annual`), or
    mean of all monthly ratios (`monthly_ratio`). Zeros of both are guarded month by month."""
    both = tp.select(*key, time, F.col("value").alias("tp")).join(pet.select(*key, time, F.col("value").alias("pet")), [*key, time])
    guard = lambda c: F.when(c == 0, F.lit(1e-6)).otherwise(c)
    both = both.withColumns({c: guard(F.col(c)) for c in ("tp", "pet")})
    if method == "annual":
        both = both.groupBy(*key, F.year(time).alias("_y")).agg(F.sum("tp").alias("tp"), F.sum("pet").alias("pet"))
    elif method != "monthly_ratio":
        raise ValueError(f"unknown method {method!r}")
    ratio = F.try_divide(F.col("tp"), guard(F.col("pet")))
    return both.groupBy(*key).agg((F.avg(F.when(ratio <= cap, ratio) if method == "annual" else ratio) * scale).alias("aridity"))


def warning(indicator: Column, tau: Column, p: Column, alpha: float = 0.05) -> Column:
    """Any significant trend of AC1 and SD, a rise of skewness and kurtosis, a fall of FD."""
    sig = F.coalesce(p < alpha, F.lit(False))
    up, down = F.coalesce(tau > 0, F.lit(False)), F.coalesce(tau < 0, F.lit(False))
    return F.when(indicator.isin("ac1", "std"), sig).when(indicator.isin("skew", "kurt"), sig & up).when(indicator == "fd", sig & down).otherwise(F.lit(False))


def outcome(warned: Column, broken: Column) -> Column:
    """1 hit, 2 false alarm, 3 miss, 4 correct rest."""
    w, b = F.coalesce(warned, F.lit(False)), F.coalesce(broken, F.lit(False))
    return F.when(w & b, 1).when(w, 2).when(b, 3).otherwise(4)


def confusion(df: DataFrame, group: list[str], warned: str, broken: str, weight: str | None = None) -> DataFrame:
    """Tp, fp, fn, tn by group, as counts or as sums of a weight."""
    code = outcome(F.col(warned), F.col(broken))
    unit = F.col(weight) if weight else F.lit(1).cast("long")
    zero = F.lit(0.0) if weight else F.lit(0).cast("long")
    return df.withColumn("_c", code).groupBy(*group).agg(*(F.coalesce(F.sum(F.when(F.col("_c") == i, unit)), zero).alias(n) for i, n in enumerate(TESTS, 1)))


def scores(df: DataFrame) -> DataFrame:
    """Precision, recall, specificity, accuracy, balanced_accuracy, f1, mcc from tp, fp, fn, tn; NULL where undefined."""
    tp, fp, fn, tn = (F.col(n).cast("double") for n in TESTS)
    div = F.try_divide
    recall, specificity = div(tp, tp + fn), div(tn, tn + fp)
    mcc = div(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    return df.select("*", div(tp, tp + fp).alias("precision"), recall.alias("recall"), specificity.alias("specificity"), div(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"))


def class_share(df: DataFrame, group: list[str], code: Column) -> DataFrame:
    """Share of cells in each class, all cells alike."""
    g = df.where(code.isNotNull()).groupBy(*group, code.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def all_known(*columns: Column) -> Column:
    """None of the columns is missing."""
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull()
    return out


def confusion_fractions(df: DataFrame, zone: list[str], label: list[str], warned: str, broken: str, area: str = "area") -> DataFrame:
    """Share of a zone's area in each outcome, in long form (class, fraction)."""
    g = df.withColumn("class", outcome(F.col(warned), F.col(broken))).groupBy(*zone, *label, "class").agg(F.sum(area).alias("area"))
    return g.withColumn("fraction", F.col("area") / F.sum("area").over(Window.partitionBy(*zone, *label)))


def prebreak(df: DataFrame, broken: Column, positive: Column, negative: Column) -> DataFrame:
    """`warned` from the positive pass where the series broke, from the negative pass elsewhere; rows of cells where that pass has no result drop out."""
    return df.withColumn("warned", F.when(F.coalesce(broken, F.lit(False)), positive).otherwise(negative)).where("warned is not null")


def balanced_matrix(df: DataFrame, zone: str, label: str, labels: list[str]) -> DataFrame:
    """Balanced accuracy, zones by labels, from tp, fp, fn, tn; NULL where undefined."""
    return scores(df).groupBy(zone).pivot(label, labels).agg(F.first("balanced_accuracy"))


def no_data(land: DataFrame, data: DataFrame, key: list[str], value: str, lat: str = "lat", south: float = -60.0) -> DataFrame:
    """Land cells north of `south` without a value."""
    return land.where(F.col(lat) > south).join(data.where(F.col(value).isNotNull()).select(*key).distinct(), key, "left_anti")


def earth_area() -> float:
    """km^2 of the sphere, against which sums of cell areas can be held."""
    return 4 * math.pi * RADIUS_KM**2
