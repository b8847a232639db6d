"""Group B: selection, calendar and column operators over series (key columns, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUM_NAMES = ("precip", "tp", "rain", "total")


def by(key: list[str], order: str | Column):
    return Window.partitionBy(*key).orderBy(order)


def week_label(time: Column) -> Column:
    """The Sunday that ends the week (weeks are labelled and closed on the right)."""
    return F.next_day(F.date_sub(time.cast("date"), 1), "SUN")


def time_slice(df: DataFrame, first: str, last: str, time: str = "time") -> DataFrame:
    """B1: both ends included."""
    return df.where(F.col(time).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def index_slice(df: DataFrame, axis: str, first: int, last: int) -> DataFrame:
    """Rows whose place among the distinct points of an axis lies between two, both included."""
    places = df.select(axis).distinct().withColumn("_i", F.row_number().over(Window.orderBy(axis)) - 1)  # the distinct points of one axis
    return df.join(places.where(F.col("_i").between(first, last)).select(axis), axis, "left_semi")


def weekly_how(variable: str) -> str:
    """Sums for amounts of water, means otherwise."""
    return "sum" if any(s in variable.lower() for s in SUM_NAMES) else "mean"


def resample(df: DataFrame, key: list[str], freq: str, how: str, time: str = "time", value: str = "value", min_count: int = 0) -> DataFrame:
    """Weeks ("W", labelled by Sunday), months ("MS") or years ("YS"); `how` sum or mean.

    A bin whose values are all NULL sums to 0, or to NULL with min_count of 1 or more.
    """
    label = {"W": week_label(F.col(time)), "MS": F.trunc(time, "month"), "YS": F.trunc(time, "year")}.get(freq)
    if label is None:
        raise ValueError(f"unsupported frequency {freq!r}")
    if how == "sum":
        agg = F.when(F.count(value) >= min_count, F.coalesce(F.sum(value), F.lit(0.0)))
    elif how == "mean":
        agg = F.avg(value)
    else:
        raise ValueError(f"unsupported aggregation {how!r}")
    return df.groupBy(*key, label.alias("time")).agg(agg.alias("value"))


def densify(df: DataFrame, key: list[str], step: str, fill: float | None = None, time: str = "time") -> DataFrame:
    """Every key on every step from the first to the last time of all; NULL, or `fill`, where there was no row.

    The two ends come from one aggregate of a single row, and each key unrolls its own steps.
    """
    ends = df.agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    axis = df.select(*key).distinct().join(F.broadcast(ends)).select(*key, F.explode(F.expr(f"sequence(_t0, _t1, interval {step})")).alias(time))
    full = axis.join(df, [*key, time], "left")
    return full.withColumn("value", F.coalesce("value", F.lit(fill))) if fill is not None else full


def restamp_months(df: DataFrame, key: list[str], first: Column, time: str = "time") -> DataFrame:
    """Times become consecutive month starts from `first`."""
    return df.withColumn(time, F.add_months(first, F.dense_rank().over(by(key, time)) - 1))


def first_of_time(df: DataFrame, key: list[str], order: str, time: str = "time") -> DataFrame:
    """One row for each key and time, the first by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key, time).orderBy(order))).where("_n = 1").drop("_n")


def position(key: list[str], time: str = "time") -> Column:
    """Place in the series, from 0."""
    return (F.row_number().over(by(key, time)) - 1).cast("int")


def steps_per_year(df: DataFrame, key: list[str], time: str = "time") -> DataFrame:
    """max(3, n / years spanned, halves to even)."""
    years = F.datediff(F.max(time), F.min(time)) / F.lit(365.2425)
    return df.groupBy(*key).agg(F.greatest(F.lit(3), F.bround(F.try_divide(F.count(time).cast("double"), years.cast("double")), 0).cast("int")).alias("steps_per_year"))


def seasonal_period(df: DataFrame, key: list[str], weekly_hint: bool = False, time: str = "time") -> DataFrame:
    """52 for weekly data (by hint or a median step of 5 days or more), else 365."""
    step = df.withColumn("_d", F.datediff(time, F.lag(time).over(by(key, time))))
    weekly = F.lit(weekly_hint) | (F.median("_d") >= 5)
    return step.groupBy(*key).agg(F.when(weekly, 52).otherwise(365).alias("period"))


def trim_end(df: DataFrame, key: list[str], months: int = 30, time: str = "time") -> DataFrame:
    """The last months dropped, unless that leaves nothing of the series."""
    whole = Window.partitionBy(*key)
    last = F.add_months(F.max(time).over(whole), -months)
    marked = df.withColumn("_keep", F.col(time) <= last).withColumn("_any", F.max(F.col("_keep")).over(whole))
    return marked.where("_keep or not _any").drop("_keep", "_any")


def time_of_index(df: DataFrame, axis: DataFrame, index: str, out: str, key: list[str] | None = None, legacy_offset: bool = False) -> DataFrame:
    """Date at an index by the axis table (key, t, time); NULL outside it. `legacy_offset`: indices count from 1, but are looked up as if from 0, so dates are a step late."""
    on = [*(key or []), index]
    return df.join(axis.select(*(key or []), (F.col("t") - int(legacy_offset)).alias(index), F.col("time").alias(out)), on, "left")


def time_by_step(df: DataFrame, key: list[str], index: Column, time: str = "time") -> DataFrame:
    """Date at an index (a column of `df`'s keys) extrapolated by the median step; 7 days where there is one point."""
    step = df.withColumn("_d", F.datediff(time, F.lag(time).over(by(key, time))))
    found = step.groupBy(*key).agg(F.min(time).alias("t0"), F.coalesce(F.median("_d"), F.lit(7.0)).alias("step"))
    return found.withColumn("date", F.date_add("t0", F.floor(index * F.col("step")).cast("int")))


def year_of_index(index: Column, first: int = 2000, per_year: float = 52.1775) -> Column:
    """B16."""
    return F.floor(F.lit(float(first)) + index / F.lit(per_year)).cast("int")


def months_since(time: Column, first: Column) -> Column:
    """B17."""
    return F.datediff(time, first) / F.lit(30.44).cast("double")


def years_since(time: Column, first: Column) -> Column:
    """B17."""
    return F.datediff(time, first) / F.lit(365.25).cast("double")


def first_difference(key: list[str], time: str = "time", value: str = "value") -> Column:
    """NULL for the first element."""
    return F.col(value) - F.lag(value).over(by(key, time))


def scaled(value: Column, factor: float, zero: float = 1e-6) -> Column:
    """Unit conversion; an exact zero becomes `zero`."""
    return F.when(value * factor == 0, F.lit(zero)).otherwise(value * factor)


def wind(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed, and direction in degrees that the wind comes from."""
    return F.sqrt(u * u + v * v), F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0))


def sign_class(x: Column) -> Column:
    """-1, 0 or 1; missing counts as 0."""
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def to_class(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval, closed on the left; one label more than inner edges. NULL stays NULL."""
    found = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        found = found.when(x < edge, label)
    return found.otherwise(labels[-1])


def map_group(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """The group of a fine class by a mapping table; classes without a group drop out."""
    return df.join(mapping, column)


def parse_tag(tag: Column) -> dict[str, Column]:
    """Frequency, window, difference and robust flag from `freq-W_win-5_diff-1_stl-robust`."""
    part = lambda name, of: F.regexp_extract(tag, rf"(?:^|_){name}-({of})", 1)
    return {"freq": part("freq", "[A-Za-z]+"), "win": part("win", "[0-9.]+").cast("double"), "diff": part("diff", "[01]").cast("int"), "stl": part("stl", "[a-z]+")}


def make_tag(freq: Column, win: Column, diff: Column, stl: Column) -> Column:
    """The tag of a configuration."""
    return F.concat(F.lit("freq-"), freq, F.lit("_win-"), win.cast("string"), F.lit("_diff-"), diff.cast("string"), F.lit("_stl-"), stl)


def plain_label(s: Column) -> Column:
    """Arrows as words, spaces and slashes as underscores."""
    s = F.replace(F.replace(s, F.lit("↑"), F.lit("up")), F.lit("↓"), F.lit("down"))
    return F.regexp_replace(F.trim(s), r"[\s/]+", "_")
