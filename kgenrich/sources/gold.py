"""A11 gold-set reader and B8 evaluation-sample sink.

Layout: ``<root>/<percent-encoded relation>/entities`` (whitespace-separated
entity names) and ``.../values`` (``entity v1 v2 ...``; any alternative is
correct; for a repeated entity the last line wins). The relation is taken
from the file path (``_metadata.file_path``), so one scan reads all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.iri import percent_decode


def _relation(path_col) -> F.Column:
    """The folder above ``entities`` / ``values`` (a file, or a folder of part
    files). The path is a URI: one decoding for the URI, one for the name."""
    folder = F.regexp_extract(path_col, r"/([^/]+)/(entities|values)(/[^/]*)?$", 1)
    return percent_decode(percent_decode(folder))


def read_gold(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``gold_entities(p, entity)`` and ``gold_values(p, entity, values)``."""
    ents = spark.read.text(f"{root}/*/entities").select(
        _relation(F.col("_metadata.file_path")).alias("p"),
        F.explode(F.split(F.trim("value"), r"\s+")).alias("entity")).where(F.col("entity") != "")
    lines = spark.read.text(f"{root}/*/values").select(
        _relation(F.col("_metadata.file_path")).alias("p"),
        F.col("_metadata.file_path").alias("f"),
        F.monotonically_increasing_id().alias("ord"),
        F.split(F.trim("value"), r"\s+").alias("parts")).where(F.size("parts") > 0) \
        .where(F.get("parts", 0) != "")
    last = lines.groupBy("p", F.get("parts", 0).alias("entity")).agg(
        F.max_by("parts", "ord").alias("parts"))
    vals = last.select("p", "entity", F.slice("parts", 2, 1 << 20).alias("values"))
    return ents, vals


def write_evaluation_sample(sample: DataFrame, articles: DataFrame, out: str) -> None:
    """``entities`` (one per line), ``values`` (``entity value`` with spaces
    as ``_``) and article texts headed by the subject."""
    s = sample.cache()
    s.select("entity").write.mode("overwrite").text(f"{out}/entities")
    s.select(F.concat_ws(" ", "entity", F.replace(F.get("values", 0), F.lit(" "), F.lit("_")))
             .alias("value")).write.mode("overwrite").text(f"{out}/values")
    s.join(articles.withColumnRenamed("title", "entity"), "entity") \
        .select(F.concat_ws("\n", "entity", "text").alias("value")) \
        .write.mode("overwrite").text(f"{out}/articles")
    s.unpersist()


def write_gold(gold_entities: DataFrame, gold_values: DataFrame, root: str) -> None:
    """Gold sets as ``<root>/<relation>/entities`` and ``.../values`` folders."""
    from ..functions.iri import _quote
    ge = gold_entities.withColumn("rel", _quote(F.col("p")))
    gv = gold_values.withColumn("rel", _quote(F.col("p")))
    for rel in [r.rel for r in ge.select("rel").distinct().collect()]:   # relation names only
        ge.where(F.col("rel") == rel).select("entity").write.mode("overwrite").text(f"{root}/{rel}/entities")
        gv.where(F.col("rel") == rel).select(F.concat_ws(" ", F.col("entity"), F.array_join("values", " "))
                                             .alias("value")).write.mode("overwrite").text(f"{root}/{rel}/values")
