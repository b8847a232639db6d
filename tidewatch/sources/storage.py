"""Tables written once and read again, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: where a session on one machine keeps the name of the folder that was made for it
_MADE = "spark.tidewatch.scratch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is not set, a temporary one if all tasks run in this process, as in
    tests; on a cluster an error, as executors do not see each other's folders."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_MADE, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_MADE, folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read back, so that lost executors recompute nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
