"""Group J: driver features per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calendar, regrid, trend
from ..functions.percentiles import exact_percentiles
from ..sources import tables


def driver_map(cube: DataFrame, key: list[str], first: str, last: str, unit: str = "months") -> DataFrame:
    """Mean, std and slope per month (or year) of a cube between two dates; time counts from the first date kept."""
    kept = calendar.time_slice(cube, first, last)
    since = calendar.months_since if unit == "months" else calendar.years_since
    return trend.trend_stats(kept, key, since(F.col("time"), F.lit(first).cast("date")))


def evaporation(daily: list[DataFrame], factor: int, first: str, last: str, nodata: float = 9999.0) -> DataFrame:
    """Daily grids cleaned, coarsened, averaged by month and described."""
    clean = [d.withColumn("value", tables.sentinel(F.col("value"), F.col("value") < nodata)) for d in daily]
    coarse = [regrid.coarsen(d, factor, ["time"]) for d in clean]
    monthly = calendar.resample(reduce(lambda a, b: a.unionByName(b), coarse), ["lat", "lon"], "MS", "mean")
    return driver_map(monthly, ["lat", "lon"], first, last)


def groundwater(regions: list[DataFrame], factor: int, step: float, first: str, last: str) -> DataFrame:
    """Regional cubes coarsened and described, then averaged on one grid; the slope is `trend`."""
    maps = [driver_map(regrid.coarsen(r, factor, ["time"]), ["lat", "lon"], first, last, "years") for r in regions]
    each = [regrid.common_grid([m.select("lat", "lon", F.col(c).alias("value")) for m in maps], step).withColumnRenamed("value", c) for c in ("mean", "std", "trend")]
    return regrid.merge_maps(each, ["lat", "lon"])


def aridity_driver(tp: DataFrame, pet: DataFrame, key: list[str], scale: float = 10.0, cap: float = 100.0) -> DataFrame:
    """Annual index (zeros of both guarded month by month, ratios above `cap` left out) times `scale`: its mean, std and
    slope per 365.25 days."""
    both = tp.select(*key, "time", F.col("value").alias("tp")).join(pet.select(*key, "time", F.col("value").alias("pet")), [*key, "time"])
    guard = lambda c: F.when(c == 0, F.lit(1e-6)).otherwise(c)
    annual = both.withColumns({c: guard(F.col(c)) for c in ("tp", "pet")}).groupBy(*key, F.year("time").alias("year")).agg(F.sum("tp").alias("tp"), F.sum("pet").alias("pet"))
    ratio = F.try_divide(F.col("tp"), guard(F.col("pet")))
    annual = annual.withColumn("value", F.when(ratio <= cap, scale * ratio))
    days = F.datediff(F.make_date("year", F.lit(1), F.lit(1)), F.lit("2000-01-01").cast("date"))
    return trend.trend_stats(annual, key, days / F.lit(365.25).cast("double"))


def index_driver(cube: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Correlation with an index series."""
    return trend.index_correlation(cube, index, key)


def majority(df: DataFrame, factor: float, value: str) -> DataFrame:
    """The commonest category of each coarse cell, the least of equals."""
    cell = lambda c: (F.floor(F.col(c) / factor) * factor).cast("double").alias(c)
    counts = df.where(F.col(value).isNotNull()).groupBy(cell("lat"), cell("lon"), value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("lat", "lon").agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def fire(df: DataFrame, key: list[str], burning: Column) -> DataFrame:
    """Days on fire and their fraction for each year, then the mean of the years and the slope over them."""
    yearly = df.groupBy(*key, F.year("time").alias("year")).agg(F.sum(burning.cast("int")).cast("double").alias("days"), F.avg(burning.cast("int")).alias("fraction"))
    return yearly.groupBy(*key).agg(F.avg("days").alias("fire_days"), F.avg("fraction").alias("fire_fraction"), F.regr_slope(F.col("days"), F.col("year").cast("double")).alias("fire_trend"))


def harmonise(df: DataFrame, prefix: str, grid: DataFrame | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Axes renamed, further dimensions averaged, columns prefixed, regridded if a grid is given."""
    df = tables.rename_axes(df, required=("lat", "lon")).drop(*drop)
    columns = [n for n, t in df.dtypes if n not in ("lat", "lon") and t in ("double", "float", "int", "bigint")]
    df = df.groupBy("lat", "lon").agg(*(F.avg(c).alias(f"{prefix}_{c}") for c in columns))
    if grid is None:
        return df
    return regrid.merge_maps([regrid.bilinear(grid.select("lat", "lon"), regrid.complete_grid(df, f"{prefix}_{c}"), f"{prefix}_{c}") for c in columns], ["lat", "lon"])


def constant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns of at most one distinct value (missing counts as a value), found in one pass by least and greatest."""
    checks = [(F.min(c).eqNullSafe(F.max(c)) & ((F.count(c) == 0) | (F.count(c) == F.count(F.lit(1))))).alias(c) for c in columns]
    row = df.agg(*checks).first()
    return [c for c in columns if row[c]]


def binary_and_numeric(df: DataFrame, binary: list[str], numeric: list[str]) -> DataFrame:
    """Shares to 0/1, texts to numbers (NULL where they are none)."""
    return df.withColumns({c: (F.col(c) > 0).cast("int") for c in binary} | {c: F.col(c).try_cast("double") for c in numeric})


def out_of_range(df: DataFrame, columns: list[str], limit: float = 1.0) -> DataFrame:
    """Largest size of each column, and whether it exceeds the limit."""
    wide = df.agg(*(F.max(F.abs(c)).alias(c) for c in columns))
    return wide.unpivot([], columns, "column", "largest").withColumn("bad", F.coalesce(F.col("largest") > limit + 1e-9, F.lit(False)))


def describe(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """Count, mean, std, min, quantiles (exact, by distributed selection) and max of each column, in long form."""
    structs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    plain = df.agg(F.array(*structs).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    exact = exact_percentiles(df, [], {c: F.col(c) for c in columns}, list(quantiles))
    wide = exact.groupBy("column").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in zip(quantiles, names, strict=True)))
    return plain.join(F.broadcast(wide), "column", "left").select("column", "count", "mean", "std", "min", *names, "max")  # a row for each column


def target_table(full: DataFrame, positive: DataFrame, negative: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Tau columns of the pass each cell belongs to, and `target`: true for positives, false for negatives; others drop out."""
    side = lambda df, s: df.select(*key, *(F.col(n).alias(f"_{s}_{n}") for n in names), F.lit(True).alias(f"_{s}"))
    joined = full.select(*key, *names).join(side(positive, "pos"), key, "left").join(side(negative, "neg"), key, "left")
    joined = joined.where("_pos or _neg")
    return joined.select(*key, F.coalesce("_pos", F.lit(False)).alias("target"), *(regrid.choose_by_mask(F.col("_pos"), F.col("_neg"), F.col(f"_pos_{n}"), F.col(f"_neg_{n}"), F.col(n)).alias(n) for n in names))


def aridity_class(df: DataFrame, edges: list[float], labels: list[str]) -> DataFrame:
    """Class of the aridity index."""
    return df.withColumn("class", calendar.to_class(F.col("aridity"), edges, labels))
