"""Keyed writes that go on where they stopped."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import tables


def todo(spark, keys):
    return spark.createDataFrame([(k, None if k % 5 == 0 else k % 3, t, float(k * t)) for k in keys for t in range(4)], "k int, l int, t int, value double")


def total(part):
    return part.groupBy("k", "l").agg(F.sum("value").alias("total"))


KEY = (["k", "l"], "k int, l int")


def test_a_job_stopped_half_way_is_finished_once(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/out"
    calls = []

    def breaks(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("executors are gone")
        return total(part)

    with pytest.raises(RuntimeError):
        tables.resume(todo(spark, range(60)), path, KEY[0], breaks, blocks=16, at_once=4)
    done = {r["k"] for r in tables.results(spark, path, *KEY).collect()}
    assert 0 < len(done) < 60
    # a block written but not told of in the manifest is replaced as a whole
    half = todo(spark, range(60)).where(F.pmod(F.xxhash64("k", "l"), F.lit(16)) == 15).limit(3)
    half.select("k", "l", F.lit(-1.0).alias("total"), F.lit(15).alias("block")).write.mode("append").partitionBy("block").parquet(f"{path}/results")
    seen = []
    assert tables.resume(todo(spark, range(60)), path, KEY[0], lambda part: seen.extend(r["k"] for r in part.select("k").distinct().collect()) or total(part), blocks=16, at_once=4) == 8
    assert not set(seen) & done and set(seen) | done == set(range(60))
    rows = tables.results(spark, path, *KEY).collect()
    assert sorted((r["k"], r["total"]) for r in rows) == [(k, 6.0 * k) for k in range(60)]
    assert tables.resume(todo(spark, range(60)), path, KEY[0], total, blocks=16) == 0


def test_new_keys_bring_their_blocks_back(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/out"
    assert tables.manifest(spark, path, *KEY).collect() == []
    assert tables.resume(todo(spark, range(10)), path, KEY[0], total, blocks=4) == 4
    assert 0 < tables.resume(todo(spark, range(11)), path, KEY[0], total, blocks=4) <= 1
    assert sorted(r["k"] for r in tables.results(spark, path, *KEY).collect()) == list(range(11))
    assert tables.resume(todo(spark, []), path, KEY[0], total, blocks=4) == 0
