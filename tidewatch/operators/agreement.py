"""Group H: sensitivity to settings and agreement between class maps (classes -1, 0, 1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as numeric
from ..functions.percentiles import exact_percentiles
from ..functions.stats import normal_two_sided
from . import blocks
from .calendar import make_tag, parse_tag
from .rolling import INDICATORS, odd_window, steps_of
from .trend import exact_p

CLASSES = (-1, 0, 1)


def configurations(spark, axes: dict[str, list]) -> DataFrame:
    """H1: every combination of settings, a table of a few rows."""
    out = None
    for name, values in axes.items():
        table = spark.createDataFrame([(v,) for v in values], [name])
        out = table if out is None else out.crossJoin(table)
    return out


def sweep(series: DataFrame, key: list[str], freqs: tuple[str, ...] = ("W", "MS"), windows: tuple[float, ...] = (2.5, 5.0, 10.0), differences: tuple[int, ...] = (1, 0), stl: tuple[str, ...] = ("robust", "plain"), how: str = "mean", fill: str = "mean", mode: str = "tolerant", names: tuple[str, ...] = INDICATORS, digits: int | None = None, least: int = 4) -> DataFrame:
    """H1: the whole job under every combination of settings: key, freq, win, diff, stl, tag, indicator, n, tau, pval.

    `series` (key, time, value) crosses one exchange for each frequency. A block of series is put on the steps of the calendar, freed
    of season and trend once for each form of `stl` (robust, plain or none; the period is the steps in a year), and differenced or
    not; then all windows of so many years, shortened where the series are too short for them, are tested for trend. Indicators
    are rounded to `digits` first, if given.
    """
    found = None
    for freq in freqs:
        ready, first, steps = steps_of(series, key, freq, how)
        per_year = _per_year(first, steps, freq)
        schema = f"{blocks.ddl(series, key)}, freq string, win double, diff int, stl string, indicator string, n int, tau double, z double, exact double"

        def settings(table, starts, freq=freq, steps=steps, per_year=per_year):
            import pyarrow as pa

            made, at_once = [], max(1, (1 << 22) // max(1, steps))
            bounds = np.append(starts, table.num_rows)
            for i in range(0, len(starts), at_once):
                some = bounds[i : i + at_once + 1]
                part = table.slice(int(some[0]), int(some[-1] - some[0]))
                begins = some[:-1] - some[0]
                y = blocks.grid(part, begins, "value", part.column("t").to_numpy(), steps)
                of = {k: part.column(k).take(pa.array(begins)) for k in key}
                for form in stl:
                    rest = y if form == "none" else numeric.residual(y, per_year, form == "robust", fill)
                    for diff in differences:
                        ready = np.concatenate((np.full((len(y), 1), np.nan), np.diff(rest, axis=1)), axis=1) if diff else rest
                        for years in windows:
                            signals = numeric.indicators(ready, odd_window(years, per_year, steps) // 2, mode == "strict")
                            for name in names:
                                tau = numeric.kendall(signals[name] if digits is None else np.round(signals[name], digits))
                                few = tau["n"] < max(2, least)
                                same = {"freq": freq, "win": float(years), "diff": diff, "stl": form, "indicator": name}
                                columns = of | {k: pa.array([v] * len(y)) for k, v in same.items()} | {"n": pa.array(tau["n"])}
                                columns |= {k: pa.array(np.where(few, np.nan, v), from_pandas=True) for k, v in (("tau", tau["tau"]), ("z", tau["z"]), ("exact", exact_p(tau)))}
                                made.append(pa.table(columns))
            return pa.concat_tables(made)

        part = blocks.map_series(ready, key, "t", ["value"], schema, settings, dealt=True)
        found = part if found is None else found.unionByName(part)
    tag = make_tag(F.col("freq"), F.col("win"), F.col("diff"), F.col("stl"))
    return found.select(*key, "freq", "win", "diff", "stl", tag.alias("tag"), "indicator", "n", "tau", F.when(F.col("tau").isNotNull(), F.coalesce("exact", normal_two_sided(F.col("z")))).alias("pval"))


def _per_year(first, steps: int, freq: str) -> int:
    """Steps in a year, inferred from the calendar: 3 at least."""
    if first is None or steps < 2:
        return 3
    months = first.year * 12 + first.month - 1 + steps - 1
    days = (first.replace(year=months // 12, month=months % 12 + 1) - first).days if freq == "MS" else (steps - 1) * (7 if freq == "W" else 1)
    return max(3, round(steps / (days / 365.2425)))


def study(swept: DataFrame, key: list[str], eps: float = 0.05, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """H2-H10 on a sweep: kappa of every two settings by indicator (indicator, map_a, map_b, ...), and the summary of each indicator:
    Light's kappa over all settings and over those of either frequency, its spread, the mean over pairs that differ in one
    setting only, also by frequency, and its rank."""
    labels = swept.withColumn("label", tau_label(F.col("tau"), F.col("pval"), eps, alpha))
    pairs = kappa_pairs(labels, key, "tag", "label", ["indicator"])
    a, b = parse_tag(F.col("map_a")), parse_tag(F.col("map_b"))
    same = {f: (a[f] == b[f]).cast("int") for f in a}
    marked = pairs.select("*", *(c.alias(f"_{f}") for f, c in same.items()), a["freq"].alias("_of"))
    only = lambda f, more=None: (F.col("_freq") + F.col("_win") + F.col("_diff") + F.col("_stl") == 3) & (F.col(f"_{f}") == 0) & (F.lit(True) if more is None else more)
    one = lambda f, more=None: F.avg(F.when(only(f, more), F.col("kappa")))
    summary = marked.groupBy("indicator").agg(
        F.avg("kappa").alias("lights_kappa"), *(F.percentile("kappa", F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))),
        *(F.avg(F.when((F.col("_freq") == 1) & (F.col("_of") == f), F.col("kappa"))).alias(f"lights_kappa_{f}") for f in ("W", "MS")),
        *(one(f).alias(f"only_{f}") for f in ("freq", "win", "diff", "stl")), *(one(f, F.col("_of") == g).alias(f"only_{f}_{g}") for g in ("W", "MS") for f in ("win", "diff", "stl")), F.count(F.lit(1)).alias("n_pairs"),
    )
    return pairs, rank_indicators(summary)


def tau_summary(df: DataFrame, group: list[str], eps: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """H2: centre and spread of tau and shares (%) over all cells; a comparison with what is missing counts as false."""
    share = lambda c: (100 * F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    return df.groupBy(*group).agg(
        F.avg("tau").alias("mean_tau"), F.median("tau").alias("median_tau"), F.stddev_pop("tau").alias("std_tau"),
        share(F.col("tau") > eps).alias("pct_up"), share(F.col("tau") < -eps).alias("pct_down"), share(F.abs("tau") <= eps).alias("pct_flat"), share(F.col("pval") > alpha).alias("pct_ns"),
    )


def tau_label(tau: Column, p: Column, eps: float = 0.05, alpha: float = 0.05) -> Column:
    """H3: -1, 0, 1 (a p of `alpha` is significant still); NULL if either is missing."""
    return F.when(tau.isNull() | p.isNull(), F.lit(None).cast("int")).when((p <= alpha) & (tau > eps), 1).when((p <= alpha) & (tau < -eps), -1).otherwise(0)


def contingency(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Counts of (a, b) among cells where both are known."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _marginals() -> list[Column]:
    n = F.col("n")
    return [F.sum(F.when(F.col(side) == k, n).otherwise(0)).cast("double").alias(f"{side}{k + 1}") for side in ("a", "b") for k in CLASSES]


def kappa(table: DataFrame, group: list[str]) -> DataFrame:
    """H4, H13, H14, H16 from one contingency table: unweighted and linearly weighted kappa, observed agreement, Jaccard up and down.

    Where chance agreement is complete, kappa is 1 for equal maps and 0 otherwise.
    """
    n, same = F.col("n"), F.col("a") == F.col("b")
    weight = 1 - F.abs(F.col("a") - F.col("b")) / 2.0
    both = lambda k: F.sum(F.when((F.col("a") == k) & (F.col("b") == k), n).otherwise(0))
    either = lambda k: F.sum(F.when((F.col("a") == k) | (F.col("b") == k), n).otherwise(0))
    g = table.groupBy(*group).agg(F.sum("n").cast("double").alias("_n"), F.sum(F.when(same, n).otherwise(0)).alias("_o"), F.sum(weight * n).alias("_w"), *(f(k).cast("double").alias(f"_{m}{k + 1}") for k in (-1, 1) for m, f in (("i", both), ("u", either))), *_marginals())
    nn = F.col("_n") * F.col("_n")
    chance = sum(F.col(f"a{i}") * F.col(f"b{i}") for i in range(3)) / nn
    chance_w = sum(F.col(f"a{i}") * F.col(f"b{j}") * (1 - abs(i - j) / 2) for i in range(3) for j in range(3)) / nn
    po, pw = F.col("_o") / F.col("_n"), F.col("_w") / F.col("_n")
    of = lambda p, e: F.when(e >= 1 - 1e-12, F.when(po >= 1 - 1e-12, 1.0).otherwise(0.0)).otherwise(F.try_divide(p - e, 1 - e))
    return g.select(*group, F.col("_n").cast("long").alias("n"), po.alias("agreement"), of(po, chance).alias("kappa"), of(pw, chance_w).alias("kappa_weighted"), F.try_divide(F.col("_i2"), F.col("_u2")).alias("jaccard_up"), F.try_divide(F.col("_i0"), F.col("_u0")).alias("jaccard_down"))


def pairs_of_maps(long: DataFrame, cell: list[str], name: str, label: str, group: list[str] | None = None) -> DataFrame:
    """For each cell the labels under each two names (a few), map_a < map_b: an equality join on the cell."""
    g = group or []
    a = long.select(*g, *cell, F.col(name).alias("map_a"), F.col(label).alias("a"))
    b = long.select(*g, *cell, F.col(name).alias("map_b"), F.col(label).alias("b"))
    return a.join(b, [*g, *cell]).where("map_a < map_b")


def kappa_pairs(long: DataFrame, cell: list[str], name: str, label: str, group: list[str] | None = None, directed: bool = False, legacy_missing_as_neutral: bool = False) -> DataFrame:
    """Agreement of every pair of maps, in one pass; of cells with a direction in either map only, if `directed`.

    Cells without a label in either map are left out, or are neutral in it with `legacy_missing_as_neutral`.
    """
    if legacy_missing_as_neutral:
        long = long.withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    by = [*(group or []), "map_a", "map_b"]
    pairs = pairs_of_maps(long, cell, name, label, group)
    return kappa(contingency(non_neutral(pairs, "a", "b") if directed else pairs, by, "a", "b"), by)


def pair_table(pairs: DataFrame, group: str, names: list[str], measure: str = "kappa_weighted") -> DataFrame:
    """A measure of every pair of maps (one column <a>_<b> for each two of `names`), by group (as the indicator)."""
    return pairs.withColumn("_pair", F.concat_ws("_", "map_a", "map_b")).groupBy(group).pivot("_pair", [f"{a}_{b}" for a in names for b in names if a < b]).agg(F.first(measure))


def kappa_matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """H5: symmetric matrix with 1 on the diagonal."""
    both = pairs.select("map_a", "map_b", "kappa").unionByName(pairs.select(F.col("map_b").alias("map_a"), F.col("map_a").alias("map_b"), "kappa"))
    names_ = both.select("map_a").distinct()
    both = both.unionByName(names_.select("map_a", F.col("map_a").alias("map_b"), F.lit(1.0).alias("kappa")))
    return both.groupBy("map_a").pivot("map_b", names).agg(F.first("kappa"))


def lights_kappa(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """H6: mean of the pairwise kappas, NULL ones left out."""
    return pairs.groupBy(*(group or [])).agg(F.avg("kappa").alias("lights_kappa"))


def kappa_distribution(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """H7: p10, median and p90."""
    return pairs.groupBy(*(group or [])).agg(*(F.percentile("kappa", F.lit(q)).alias(n) for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))))


def best_and_worst(pairs: DataFrame, top: int = 5) -> DataFrame:
    """H8: the top pairs of either end, with `rank` from 1."""
    keyed = pairs.where(F.col("kappa").isNotNull()).select("map_a", "map_b", "kappa")
    end = lambda name, order: keyed.orderBy(*order).limit(top).withColumn("end", F.lit(name))
    both = end("best", [F.desc("kappa"), "map_a", "map_b"]).unionByName(end("worst", ["kappa", "map_a", "map_b"]))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.when(F.col("end") == "best", -F.col("kappa")).otherwise(F.col("kappa")), "map_a", "map_b"))
    return both.withColumn("rank", rank)


def one_factor(pairs: DataFrame, settings: DataFrame, factors: list[str], name: str = "config", group: list[str] | None = None) -> DataFrame:
    """H9: mean kappa of pairs whose settings differ in exactly one factor, by that factor (and by `group`, common to both)."""
    side = lambda s: settings.select(F.col(name).alias(s), *(F.col(f).alias(f"{s}_{f}") for f in factors))
    joined = pairs.join(F.broadcast(side("map_a")), "map_a").join(F.broadcast(side("map_b")), "map_b")
    differs = [(F.col(f"map_a_{f}") != F.col(f"map_b_{f}")).cast("int") for f in factors]
    which = F.lit(None).cast("string")
    for f, d in zip(factors, differs, strict=True):
        which = F.when(d == 1, F.lit(f)).otherwise(which)
    kept = joined.where(sum(differs) == 1).withColumn("factor", which).withColumns({g: F.col(f"map_a_{g}") for g in group or []})
    kept = kept.where("factor not in ({})".format(", ".join(f"'{g}'" for g in group))) if group else kept
    return kept.groupBy(*(group or []), "factor").agg(F.avg("kappa").alias("mean_kappa"), F.count("kappa").alias("n_pairs"))


def rank_indicators(lights: DataFrame, name: str = "indicator") -> DataFrame:
    """Indicators by Light's kappa, best first; a handful of rows."""
    return lights.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("lights_kappa"), name)))


def class_by_p(x: Column, p: Column, alpha: float = 0.05) -> Column:
    """The sign where significant, 0 where not, NULL where either is missing."""
    return F.when(x.isNull() | p.isNull(), F.lit(None).cast("int")).when(p < alpha, F.signum(x).cast("int")).otherwise(0)


def class_by_flag(x: Column, flag: Column) -> Column:
    """The sign where the flag is set."""
    return F.when(x.isNull(), F.lit(None).cast("int")).when(F.coalesce(flag != 0, F.lit(False)), F.signum(x).cast("int")).otherwise(0)


def class_by_quantile(df: DataFrame, group: list[str], x: str, out: str, q: float = 0.975) -> DataFrame:
    """The sign where |x| exceeds its quantile within the group (one of few: an indicator, a region)."""
    limit = exact_percentiles(df, group, {x: F.abs(x)}, [q]).select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("value").alias("_limit"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    joined = df.join(F.broadcast(limit), same, "left")  # as many rows as groups, which the driver has held
    return joined.withColumn(out, F.when(F.col(x).isNull(), F.lit(None).cast("int")).when(F.abs(x) > F.col("_limit"), F.signum(x).cast("int")).otherwise(0)).drop("_limit", *(f"_of_{g}" for g in group))


def non_neutral(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells with a direction in either map."""
    return df.where((F.col(a) != 0) | (F.col(b) != 0))


def symmetric_limit(df: DataFrame, group: list[str], x: str, q: float = 0.995) -> DataFrame:
    """Quantile of |x|, its maximum where that is 0, or 1."""
    found = exact_percentiles(df, group, {x: F.abs(x)}, [q, 1.0])
    of = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    known = found.groupBy(*group).agg(of(q).alias("_q"), of(1.0).alias("_top"))
    names = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    joined = names.join(F.broadcast(known), group, "left") if group else known
    return joined.select(*group, F.coalesce(F.nullif("_q", F.lit(0.0)), F.nullif("_top", F.lit(0.0)), F.lit(1.0)).alias("limit"))


def significant_map(tau: Column, p: Column, alpha: float = 0.05) -> Column:
    """The value where it is significant and not 0."""
    return F.when((p < alpha) & (tau != 0), tau)


def signed_magnitude(tau: Column, p: Column, alpha: float = 0.05) -> Column:
    """Size of a significant tau, with its sign turned (a falling dimension warns)."""
    return F.when(p < alpha, -F.signum(tau) * F.abs(tau))


def bins_2d(df: DataFrame, a: Column, b: Column, bins: int = 8, limit: float = 1.0) -> DataFrame:
    """Counts in bins x bins cells over [-limit, limit]; what lies beyond is in the outer bins."""
    at = lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x + limit) / (2 * limit) * bins).cast("int")))
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(at(a).alias("a_bin"), at(b).alias("b_bin")).agg(F.count(F.lit(1)).alias("n"))


def log_scaled(x: Column, top: float) -> Column:
    """0..1 on a logarithmic scale, clipped."""
    import math

    return F.log1p(F.least(F.greatest(x, F.lit(0.0)), F.lit(float(top)))) / math.log1p(top)


def first_field(df: DataFrame, names: list[str]) -> Column:
    """The first of the candidate columns that is there and not NULL."""
    there = [F.col(n) for n in names if n in df.columns]
    if not there:
        raise ValueError(f"none of {names} among {df.columns}")
    return F.coalesce(*there)
