"""A training corpus from `documents`, in four stages that filter whole documents and then pack what is left.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Null and empty texts have no
language and go in the first stage. Rows equal in doc_id and text are one document to the third, and it leaves rows
without doc_id alone. Extra columns
stay until the last stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, near_dedup, packing, toxicity
from tidewatch.llm.storage import materialize

#: rows of one key that may be broadcast
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled documents teach."""
    model = language_id.train(docs)
    found = language_id.predict(docs, model, keep=tuple(docs.columns), names=("_language", "_sure"))
    return found.where("_language != 'und' and _sure >= 0.5").select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=tuple(docs.columns), name="_toxic").where(F.col("_toxic") < model.cut).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least doc_id, and of its texts the one of the least hash.

    Texts of one doc_id are judged apart; rows equal in doc_id and text are one. Rows without doc_id all stay.
    """
    keyed = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))
    known = keyed.where("_row is not null")
    classes = materialize(near_dedup.near_duplicates(known, id_col="_row").select(F.col("doc_id").alias("_row"), "class_id"), "classes")
    members = classes.distinct().join(known.select("_row", "doc_id").distinct(), "_row")
    first = members.groupBy("class_id").agg(F.min(F.struct("doc_id", "_row")).alias("_first"))
    gone = materialize(members.join(first, "class_id").where("_row != _first._row").select("_row").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS  # beyond that, Spark sorts and merges
    kept = known.join(F.broadcast(gone) if few else gone, "_row", "left_anti")
    if classes.groupBy("_row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row"])
    return kept.select(*docs.columns).unionByName(keyed.where("_row is null").select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers as P

    return packing.pack(packing.token_pieces(docs, P.path("word_bpe_49k.json")))


STAGES = [("language_id", language), ("toxicity", clean), ("near_dedup", distinct), ("packing", packed)]

#: Models and tokenizers cannot be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
