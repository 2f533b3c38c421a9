"""A training-data pipeline over documents: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor wrote. All but the last return the columns of documents: rejected,
duplicate and leaking documents go, and a document that the mix repeats is a repeated row. The last returns a place for every row:
doc_id, size, text_crc32, curve, shard, slot.

Rows are told apart by doc_id and text, not by doc_id alone, so no text is lost to another one with its doc_id.

Defined cases: rows with a null doc_id pass the near-duplicate stage (they cannot be named there) but lose leaks like others; of rows with
equal doc_id and text the near-duplicate stage keeps one (the first by its columns as JSON); extra columns, whatever their names, pass
through; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, hilbert_shards, mixing, near_dup, quality
from shelfspark.llm.common import durable, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, docs.columns, prefix="quality ").where("`quality predicted` = 1").select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone (doc_id, row: a hash of the text) names."""
    gone = gone.select(F.col("doc_id").alias("gone id"), F.col("row").alias("gone row")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone id")) & (F.xxhash64(docs["text"]) == F.col("gone row")), "left_anti")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = durable(near_dup.near_duplicates(docs).where("NOT first OR copies > 1").select("doc_id", "row", "first"), "marked")
    kept = _without(docs, found)
    repeated = found.where("first").select("doc_id", "row").distinct()
    if not repeated.limit(1).count():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = (docs["doc_id"] == F.col("again id")) & (F.xxhash64(docs["text"]) == F.col("again row"))
    again = docs.join(repeated.select(F.col("doc_id").alias("again id"), F.col("row").alias("again row")), key)
    one = again.groupBy("again id", "again row").agg(F.min_by(whole, F.to_json(whole)).alias("kept one"))
    return kept.union(one.select(*[F.col("kept one")[c].alias(c) for c in docs.columns]))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), by_row=True))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chosen, _ = mixing.mix(docs)
    # by source too: a text that rows without doc_id have in several sources is taken for one of them, not for each as often as for any
    key = [F.col("doc_id").alias("mix id"), F.col("row").alias("mix row"), F.col("source").alias("mix source")]
    copies = durable(chosen.groupBy(*key).agg(F.max("copies").alias("mix copies")).where("`mix copies` > 0"), "copies")
    same = docs["doc_id"].eqNullSafe(F.col("mix id")) & (F.xxhash64(docs["text"]) == F.col("mix row")) & docs["source"].cast("string").eqNullSafe(F.col("mix source"))
    taken = docs.join(copies, same)
    return taken.withColumn("mix copy", F.explode(F.sequence(F.lit(1), F.col("mix copies").cast("int")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard(docs).drop("row")


STAGES = [("quality", good_quality), ("near duplicates", one_of_each_group), ("decontamination", without_leaks), ("mix", mixed), ("shards", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, "stage")
    return docs
