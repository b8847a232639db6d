"""Percentiles by distributed selection equal Spark's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.percentiles import exact_percentiles

QS = [0.0, 0.005, 0.1, 0.5, 0.975, 0.995, 1.0]


@pytest.mark.parametrize("bins", [2, 16, 4096])
def test_equal_to_percentile(spark, bins):
    rng = np.random.default_rng(bins)
    values = {"normal": rng.normal(0, 1, 400), "ties": rng.integers(0, 3, 400) * 0.1, "one": np.full(5, 7.25), "single": np.array([3.0]), "far": np.concatenate((rng.normal(0, 1e-9, 200), [1e300, -1e300, 1e17])), "close": 1 + np.arange(300) * 2.0**-52}
    rows = [(None if g == "ties" else g, float(v), float(-v) if i % 3 else None) for g, vs in values.items() for i, v in enumerate(vs)] + [("none", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    found = {(r["g"], r["column"], r["q"]): r["value"] for r in exact_percentiles(df, ["g"], {"a": F.col("a"), "size": F.abs("b")}, QS, bins=bins).collect()}
    clean = df.withColumn("b", F.when(~F.isnan("b"), F.abs("b")))
    want = clean.groupBy("g").agg(F.percentile("a", F.array(*map(F.lit, QS))).alias("a"), F.percentile("b", F.array(*map(F.lit, QS))).alias("size")).collect()
    assert len(found) == sum(len(QS) for r in want for c in ("a", "size") if r[c] is not None)
    for r in want:
        for c in ("a", "size"):
            for q, v in zip(QS, r[c] or [], strict=False):
                assert found[r["g"], c, q] == pytest.approx(v, rel=1e-14), (r["g"], c, q)


def test_without_groups_or_rows(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert [(r["q"], r["value"]) for r in exact_percentiles(df, [], {"x": F.col("x")}, [0.25, 0.9995]).collect()] == [(0.25, 250.0), (0.9995, 999.5)]
    assert exact_percentiles(df.limit(0), [], {"x": F.col("x")}, [0.5]).collect() == []


def test_no_task_sees_all_values(spark, monkeypatch):
    """The plans count by bin before anything is shuffled."""
    kind = type(spark.range(1))
    seen, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(self) or collect(self))
    exact_percentiles(spark.range(100_000).select((F.col("id") * 0.37 % 1).alias("x")), [], {"x": F.col("x")}, [0.5], bins=64)
    sizes = [len(collect(df)) for df in seen]
    assert len(sizes) >= 3 and max(sizes) <= 64
