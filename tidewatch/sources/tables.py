"""Group A: sources, sinks and layout. A cube is a long table (key columns, time, value); NULL marks what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = {"latitude": "lat", "y": "lat", "longitude": "lon", "x": "lon", "datetime": "time", "date": "time", "valid_time": "time"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN as NULL, once, where data come in."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def read_cube(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A1: a cube by path, axes under their usual names, NaN as NULL."""
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(rename_axes(reader.parquet(path)))


def read_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A2: files along time, columns that some lack filled with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (read_cube(spark, p) for p in paths))


def rename_axes(df: DataFrame, axes: dict[str, str] = AXES, required: tuple[str, ...] = ()) -> DataFrame:
    """A3: aliases of axes to lat, lon, time. An axis already under its name stays; a missing required one is an error."""
    found = {a: b for a, b in axes.items() if a in df.columns and b not in df.columns}
    if len(set(found.values())) < len(found):
        raise ValueError(f"several columns would be one axis: {sorted(found)}")
    df = df.withColumnsRenamed(found)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"no axis {', '.join(missing)} among {df.columns}")
    return df


def wrap_longitude(lon: Column) -> Column:
    """A4: degrees from 0..360 (or any turn) to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """A5: parts of one result, one below the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_variables(long: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Variables on the same grid side by side, from long form: one shuffle on the key, no chain of joins."""
    return long.groupBy(*key).pivot(name, names).agg(F.first(value, ignorenulls=True))


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces what is at `path`."""
    (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def unfinished(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Input of the keys that have no result yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def manifest(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """The keys whose results under `path` are whole: key (of `schema`), block."""
    place = f"{path}/_manifest"
    if not _exists(spark, place):
        return spark.createDataFrame([], f"{schema}, block int")
    return spark.read.schema(f"{schema}, block int").parquet(place)


def resume(todo: DataFrame, path: str, key: list[str], job, blocks: int = 64, at_once: int = 8) -> int:
    """The results of `job(part)` for all keys of `todo`, under `path`/results, so that a job stopped half-way goes on where it stood.

    Keys are dealt to `blocks` by a hash, and `at_once` blocks are one job: its results are written with dynamic partition
    overwrite, a folder for each block, and then its keys go into a manifest. A block half-written is not in the manifest and is replaced as
    a whole, so no key is left out and none is there twice; new keys in a finished block bring only that block back. Blocks whose keys are all in the
    manifest are not touched. Returns the number of blocks that were run.
    """
    spark = todo.sparkSession
    kinds = dict(todo.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    block = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    dealt = todo.withColumn("block", block)
    keys = dealt.select(*key, "block").distinct()
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*key, "block")]
    open_ = keys.alias("a").join(manifest(spark, path, key, schema).alias("b"), same, "left_anti")
    left = sorted(r["block"] for r in open_.select("block").distinct().collect())  # `blocks` at most
    for i in range(0, len(left), at_once):
        those = left[i : i + at_once]
        part = dealt.where(F.col("block").isin(those))
        found = job(part.drop("block")).withColumn("block", block)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{path}/results")
        part.select(*key, "block").distinct().coalesce(1).write.mode("append").parquet(f"{path}/_manifest")
    return len(left)


def results(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """A5: what `resume` has finished: the rows of the blocks in the manifest (key of `schema`)."""
    whole = manifest(spark, path, key, schema).select("block").distinct()
    return spark.read.parquet(f"{path}/results").join(F.broadcast(whole), "block", "left_semi").drop("block")  # as many rows as blocks


def monthly_from_wide(wide: DataFrame, year: str = "year", months: list[str] | None = None) -> DataFrame:
    """A10: rows of a year and twelve columns to (time, value), repeated months dropped but for the least value."""
    months = months or [f"m{i}" for i in range(1, 13)]
    long = wide.unpivot([year], months, "_m", "value")
    at = reduce(lambda c, im: c.when(F.col("_m") == im[1], im[0]), enumerate(months, 1), F)
    return long.select(F.make_date(F.col(year), at.otherwise(None), F.lit(1)).alias("time"), "value").groupBy("time").agg(F.min("value").alias("value"))


def read_wide_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A10: the same from a headerless file."""
    return monthly_from_wide(spark.read.schema("year int, " + ", ".join(f"m{i} double" for i in range(1, 13))).csv(path, sep=sep))


def sentinel(value: Column, valid: Column) -> Column:
    """NULL where `valid` does not hold."""
    return F.when(valid, value)


def override_box(value: Column, lat: Column, lon: Column, box: tuple[float, float, float, float], new: float = 0.0) -> Column:
    """`new` inside a box (lat from, to, lon from, to), the value elsewhere."""
    return F.when(lat.between(*box[:2]) & lon.between(*box[2:]), F.lit(new)).otherwise(value)


def split_bands(long: DataFrame, key: list[str], band: str, value: str, names: dict[int, str]) -> DataFrame:
    """Bands by number to named columns."""
    wide = long.groupBy(*key).pivot(band, list(names)).agg(F.first(value))
    return wide.withColumnsRenamed({str(k): v for k, v in names.items()})


def cell_coordinates(row: Column, col: Column, x0: float, y0: float, cell: float) -> tuple[Column, Column]:
    """Lat and lon of a raster cell from its row and column, the upper left corner and the size of a cell."""
    return F.lit(y0) - row * cell, F.lit(x0) + col * cell
