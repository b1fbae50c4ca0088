"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgenrich.llm import decontam, kdshard, langid, mixing, neardup
from kgenrich.llm.common import read
from kgenrich.session import stage_folder, stage_run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: learns from the labelled rows and drops what it rejects
    (texts without letters, or far from every centroid)."""
    cols = docs.columns
    model = langid.fit(docs)
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])     # no clash with the answers' names
    told = langid.predict(plain, model, plain.columns, text_col=f"c{cols.index('text')}")
    return told.where("not rejected").select(*plain.columns).toDF(*cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: exactly one row of every class stays, the smallest by id and
    then by the hash of id and text, null ids last; of texts without words, one
    row of every id and text."""
    marked = neardup.near_duplicates(docs, with_class=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey"))
    kept = marked.where("class is not null").groupBy("class").agg(first.alias("first")).select("first.tkey") \
        .union(marked.where("class is null").select("tkey")).distinct()
    keyed = docs.withColumn("__tkey", F.xxhash64("doc_id", "text"))
    kept = kept.select(F.col("tkey").alias("__kept"))
    return keyed.join(kept, F.col("__tkey") == F.col("__kept"), "left_semi").dropDuplicates(["__tkey"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 against ``benchmark``: contaminated documents go. Null and empty
    texts hold no benchmark words and stay; repeated rows stay or go together;
    further columns, whatever their names, pass through."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents of the mix (their taken words, one row per pass).
    Null and blank texts give no words and go, a null source is a source, of
    fully repeated rows one gives its words."""
    return mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every row with its shard and slot; null texts have no bytes
    but 8, repeated rows get a slot each."""
    s = kdshard.kd_shards(docs, n_shards=24)
    return s.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

# Fitting centroids, hashing and permutations are not SQL; tests/llm compare
# every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables that a stage makes on its way go
    when its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{stage_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with stage_run(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
