"""Exact percentiles of large columns by distributed selection.

Spark's own exact percentile holds every distinct value of a group in one task. Here the range that a rank lies in is cut into bins,
rows are counted by bin where they are, and only the bin with the rank is cut again, until it holds one value. What comes to the
driver are counts, at most `bins` for each rank sought; the values of a group never meet.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def _unpivoted(df: DataFrame, group: list[str], columns: dict) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("column"), c.cast("double").alias("x")) for n, c in columns.items())))
    return df.select(*group, rows.alias("_r")).select(*group, "_r.column", "_r.x").where(F.abs("x") < F.lit(float("inf")))  # false for null, and NaN is larger


def exact_percentiles(df: DataFrame, group: list[str], columns: dict, qs: list[float], bins: int = 4096) -> DataFrame:
    """group, column, q, value: percentiles with linear interpolation of each named Column of `columns`, equal to those of `percentile`.

    `group` should have few values (names of regions or indicators), as the ranks sought of every one are held on the driver. Each
    round is one pass of counting; the value is found once all of a bin's values are equal. Null, NaN and infinite values are left out; groups without
    values are absent.
    """
    long = _unpivoted(df, group, columns)
    spark = df.sparkSession
    sizes = long.groupBy(*group, "column").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    kinds = [f for f in df.select(*group).schema.fields]
    name = lambda r: (*(r[g] for g in group), r["column"])
    count = {name(r): r["n"] for r in sizes}
    found: dict[tuple, dict[int, float]] = {k: {} for k in count}
    open_: dict[tuple, list] = {}  # (names, low, high) -> ranks inside and values below
    for r in sizes:
        ranks = sorted({f(q * (r["n"] - 1)) for q in qs for f in (floor, ceil)})
        if r["low"] == r["high"]:
            found[name(r)] = dict.fromkeys(ranks, r["low"])
        else:
            open_[name(r), r["low"], r["high"]] = [ranks, 0]
    shape = StructType([*kinds, StructField("column", StringType()), StructField("_low", DoubleType()), StructField("_high", DoubleType())])
    while open_:
        ranges = spark.createDataFrame([(*k, a, b) for k, a, b in open_], shape)
        # halves of the ends are subtracted, as the whole of them may be beyond a double
        place = F.floor((F.col("x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * bins)
        same = F.lit(True)
        for c in (*group, "column"):
            same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"r.{c}"))
        inside = long.alias("v").join(F.broadcast(ranges).alias("r"), same & F.col("x").between(F.col("_low"), F.col("_high")))  # as many rows as ranks sought
        counted = inside.groupBy(*(F.col(f"r.{c}") for c in (*group, "column")), "_low", "_high", F.least(F.lit(bins - 1), place).alias("_bin"))
        rows = counted.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault((name(r), r["_low"], r["_high"]), []).append(r)
        further: dict[tuple, list] = {}
        for range_, (ranks, below) in open_.items():
            for r in sorted(by[range_], key=lambda r: r["_bin"]):
                here = [k for k in ranks if below <= k < below + r["n"]]
                if here and r["least"] == r["most"]:
                    found[range_[0]] |= dict.fromkeys(here, r["least"])
                elif here:
                    further[range_[0], r["least"], r["most"]] = [here, below]
                below += r["n"]
        open_ = further
    out = []
    for k, values in found.items():
        for q in qs:
            at = q * (count[k] - 1)
            a, b = values[floor(at)], values[ceil(at)]
            out.append((*k, float(q), a + (b - a) * (at - floor(at))))
    return spark.createDataFrame(out, StructType([*kinds, StructField("column", StringType()), StructField("q", DoubleType()), StructField("value", DoubleType())]))
