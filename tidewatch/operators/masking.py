"""Group G: series cut at their breaks (positives) and at borrowed dates (negatives)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from .regrid import within
from .rolling import INDICATORS, indicators
from .trend import kendall


def late_enough(when: Column, start: Column, years: int = 12) -> Column:
    """G1: false where a date is missing."""
    return F.coalesce(when >= F.add_months(start, 12 * years), F.lit(False))


def positive_cuts(breaks: DataFrame, key: list[str], tests: list[str]) -> DataFrame:
    """(key, test, cut_date) from columns <test>_date and <test>_pos, one row per positive test, and `all`:
    the union of the positives cut at the earliest break of any test, significant or not."""
    rows = [F.struct(F.lit(t).alias("test"), F.when(F.col(f"{t}_pos"), F.col(f"{t}_date")).alias("cut_date")) for t in tests]
    anyone = reduce(lambda a, b: a | b, (F.col(f"{t}_pos") for t in tests))
    dates = [F.col(f"{t}_date") for t in tests]
    rows.append(F.struct(F.lit("all").alias("test"), F.when(anyone, F.least(*dates) if len(dates) > 1 else dates[0]).alias("cut_date")))
    return breaks.select(*key, F.explode(F.array(*rows)).alias("_r")).select(*key, "_r.*").where("cut_date is not null")


def cut(series: DataFrame, cuts: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """Rows up to and including the cut, for each test."""
    return series.join(cuts, key).where(F.col(time) <= F.col("cut_date"))


def negatives(series: DataFrame, positives: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Keys with data that are no positives."""
    return series.where(F.col(value).isNotNull()).select(*key).distinct().join(positives.select(*key).distinct(), key, "left_anti")


def combined_negative_pool(breaks: DataFrame, key: list[str], tests: list[str]) -> DataFrame:
    """Earliest break among the significant, late ones of each key."""
    dates = [F.when(F.col(f"{t}_pos"), F.col(f"{t}_date")) for t in tests]
    return breaks.select(*key, (F.least(*dates) if len(dates) > 1 else dates[0]).alias("cut_date")).where("cut_date is not null")


def pseudo_breaks(keys: DataFrame, pool: DataFrame, key: list[str], fallback: Column, seed: int = 42) -> DataFrame:
    """A date drawn with replacement from the pool's for each key, by a hash of the key; `fallback` where the pool is empty.

    Dates are few (at most one for each step of the axis), so they are numbered by their running counts and
    found by the place that the hash points at.
    """
    counts = pool.groupBy("cut_date").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.orderBy("cut_date")  # one row for each step of the axis
    ranges = counts.withColumn("_to", F.sum("_n").over(run)).withColumn("_from", F.col("_to") - F.col("_n")).drop("_n")
    size = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_size"))
    drawn = keys.join(F.broadcast(size)).withColumn("_draw", F.when(F.col("_size") > 0, F.pmod(draw(seed, *key), F.col("_size"))))
    found = within(drawn, ranges, "_draw", "_from", "_to")
    return found.select(*keys.columns, F.coalesce("cut_date", fallback).alias("cut_date"))


def fallback_date(start: Column, end: Column, years: int = 12) -> Column:
    """The later of the earliest date allowed and seven tenths of the axis."""
    return F.greatest(F.add_months(start, 12 * years), F.date_add(start, F.floor(F.datediff(end, start) * F.lit(0.7).cast("double")).cast("int")))


def runs(series: DataFrame, positive: DataFrame, negative: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """The full, positive and negative passes as one table with a `run` column, so that one job does all three."""
    full = series.withColumn("run", F.lit("full"))
    part = lambda cuts, name: cut(series, cuts, key, time).select(*series.columns, F.concat(F.lit(f"{name}_"), "test").alias("run"))
    return full.unionByName(part(positive, "pos")).unionByName(part(negative, "neg"))


def trends_by_run(passes: DataFrame, key: list[str], window: int, mode: str = "strict", digits: int | None = None, names: tuple[str, ...] = INDICATORS) -> DataFrame:
    """Indicators and their Kendall's tau again for each pass: key, run, indicator, n, tau, pval. The three passes are one job.

    `passes` is what `runs` returns, with `t`. Indicators are rounded to `digits` first, if given.
    """
    found = indicators(passes, [*key, "run"], window, mode)
    found = found.withColumns({n: F.round(n, digits) for n in names}) if digits is not None else found
    return kendall(found.unpivot([*key, "run", "t"], list(names), "indicator", "value"), [*key, "run", "indicator"])
