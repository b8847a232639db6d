"""Operator 3: sharding by extendible hashing.

A document lies in the bucket named by the first bits of the hash of its id and text. A bucket whose bytes
exceed the limit splits on its next bit, and only such a bucket does, until every shard fits. The directory is
worked out by Spark from the bytes under each prefix: each round sums the prefixes that are still too large one
bit deeper and settles those that fit, so the rounds shrink and no list of documents leaves the cluster.
Documents then find their shard by joining their prefix of each depth in use.

Rows whose hash is equal to the last bit (repeated rows) cannot be told apart by more bits: a bucket that is
still too large after MAX_BITS bits is cut by running total, in parts of documents in order of id. A document
larger than the limit is a shard of its own with `oversize` true. Null text has 0 bytes, a null id is hashed as
null. An empty table gives an empty result. Shards are named by their bits, with `+n` for the parts of such a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

MAX_BITS = 40


def prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(sized: DataFrame, limit: int, first_bits: int) -> DataFrame:
    """depth, prefix, bytes, docs of every shard, from rows (hash, bytes)."""
    fine = sized.groupBy(prefix(F.col("hash"), MAX_BITS).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    fine = materialize(fine, "prefixes")
    settled, depth = None, first_bits
    while True:
        summed = fine.groupBy(F.shiftrightunsigned("fine", MAX_BITS - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        summed = materialize(summed.withColumn("depth", F.lit(depth)), "directory")
        fits = F.col("bytes") <= limit
        done = summed if depth == MAX_BITS else summed.where(fits | (F.col("docs") == 1))
        settled = done if settled is None else settled.unionByName(done)
        large = summed.where(~fits & (F.col("docs") > 1)).select("prefix")
        if depth == MAX_BITS or not large.limit(1).count():
            return settled
        fine = fine.withColumn("prefix", F.shiftrightunsigned("fine", MAX_BITS - depth)).join(large, "prefix", "left_semi").select("fine", "bytes", "docs")
        depth += 1


def shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """id, bytes, shard, shard_bits, shard_bytes, oversize, one row per row of `df`; shard_bytes is the whole shard's."""
    sized = df.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("hash"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"))
    sized = materialize(sized, "sizes")
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    found = materialize(directory(sized, limit, min(MAX_BITS, max(0, (total // limit).bit_length() - 1))), "shards")
    depths = sorted(r["depth"] for r in found.select("depth").distinct().collect())  # at most MAX_BITS + 1 numbers
    tries = sized.withColumn("_try", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("hash"), d).alias("prefix")) for d in depths)))) if depths else sized.withColumn("_try", F.lit(None).cast("struct<depth:int,prefix:bigint>"))
    tries = tries.select(id_col, "hash", "bytes", "_try.depth", "_try.prefix")
    placed = tries.join(found.withColumnRenamed("bytes", "shard_bytes"), ["depth", "prefix"])
    name = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0")
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(name))
    whole = placed.where((F.col("shard_bytes") <= limit) | (F.col("docs") == 1)).select(id_col, "bytes", "shard", F.col("depth").alias("shard_bits"), "shard_bytes")
    run = Window.partitionBy("shard").orderBy(id_col, "hash").rowsBetween(Window.unboundedPreceding, -1)
    # equal hashes only: each part starts where the total before it has passed a multiple of what is left beside the largest document
    largest = F.least(F.max("bytes").over(Window.partitionBy("shard")), F.lit(limit - 1))
    cut = placed.where((F.col("shard_bytes") > limit) & (F.col("docs") > 1)).withColumn("_part", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / F.greatest(limit - largest, F.lit(1))))
    cut = cut.withColumn("_part", F.when(F.col("bytes") > limit, F.concat(F.col("_part").cast("string"), F.lit("."), F.row_number().over(Window.partitionBy("shard").orderBy(id_col, "hash")).cast("string"))).otherwise(F.col("_part").cast("string")))
    cut = cut.withColumn("shard", F.concat("shard", F.lit("+"), "_part"))
    cut = cut.withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("shard"))).select(id_col, "bytes", "shard", F.col("depth").alias("shard_bits"), "shard_bytes")
    return whole.unionByName(cut).withColumn("oversize", F.col("shard_bytes") > limit)


def write(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> None:
    """The rows of `df` under `path`, a folder `shard=...` for each shard. Ids must be unique."""
    placed = shards(df, id_col=id_col, text_col=text_col, limit=limit).select(id_col, "shard")
    df.join(placed, id_col).repartition("shard").write.partitionBy("shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard of every document, at most 16 MiB of text each."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
