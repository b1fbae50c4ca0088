"""Entity catalog and candidate selection.

Only a scalar reaches the driver (the number of typed subjects); the chosen
candidate type is a one-row DataFrame (``limit(1)``, a proven size bound)
that is broadcast into the join; type counts are partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import (CATALOG_TYPES, MIN_TYPE_SIZE, PREDOMINANT_SHARE, WIDE_TYPES,
                      RelationSpec)


def build_catalog(types: DataFrame, catalog_types=None) -> DataFrame:
    """``entities(name, types array<string>)`` for the catalog types; a name
    with a disambiguator ``X_(y)`` also registers ``X``."""
    wanted = list(catalog_types or CATALOG_TYPES)
    t = types.where(F.col("type").isin(wanted)).select(F.col("entity").alias("name"), "type")
    short = t.where(F.col("name").contains("_(")).select(
        F.split(F.col("name"), r"_\(", 2).getItem(0).alias("name"), "type")
    return t.unionAll(short).groupBy("name").agg(
        F.array_sort(F.collect_set("type")).alias("types"))


def exploded_catalog(catalog: DataFrame) -> DataFrame:
    """``(name, type)`` rows of the catalog, for joins."""
    return catalog.select("name", F.explode("types").alias("type"))


def is_entity(df: DataFrame, col: str, catalog: DataFrame, flag: str = "is_entity") -> DataFrame:
    """Add a boolean catalog-membership column (left join on the name; the
    planner broadcasts the catalog only when its measured size allows)."""
    names = catalog.select(F.col("name").alias("__n")).withColumn("__hit", F.lit(True))
    out = df.join(names, df[col] == names["__n"], "left")
    return out.withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__n", "__hit")


def predominant_types(triples: DataFrame, types: DataFrame, spec: RelationSpec,
                      subject: bool = True, share: float = PREDOMINANT_SHARE,
                      wide_types=None) -> DataFrame:
    """``(type)`` rows held by at least ``share`` of the typed subjects
    (of subjects' or objects' types); wide types never count. A relation's type
    restriction wins (for objects too, as in the original behaviour)."""
    override = spec.subject_type if subject else (spec.object_type or spec.subject_type)
    spark = triples.sparkSession
    if override:
        return spark.createDataFrame([(override,)], "type string")
    wide = list(wide_types if wide_types is not None else WIDE_TYPES)
    pairs = triples.where(F.col("p") == spec.p).select("s", "o")
    whose = "s" if subject else "o"
    j = pairs.join(types, pairs[whose] == types.entity).select("s", "type")
    n_entities = j.agg(F.countDistinct("s")).first()[0]          # a scalar
    counts = j.where(~F.col("type").isin(wide)).groupBy("type").agg(
        F.count(F.lit(1)).alias("cnt"))
    return counts.where(F.col("cnt") >= F.lit(share * n_entities)).select("type")


def type_sizes(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def most_specific_types(predominant: DataFrame, types: DataFrame,
                        threshold: int = MIN_TYPE_SIZE) -> DataFrame:
    """Predominant types having more than ``threshold`` entities, ``(type, n)``."""
    return predominant.join(type_sizes(types), "type").where(F.col("n") > threshold)


def candidate_type(triples: DataFrame, types: DataFrame, spec: RelationSpec) -> DataFrame:
    """The one type candidates are drawn from: smallest qualifying, tie by name."""
    qual = most_specific_types(predominant_types(triples, types, spec), types)
    return qual.orderBy("n", "type").limit(1).select("type")


def candidates(triples: DataFrame, types: DataFrame, spec: RelationSpec,
               limit: int | None = None) -> DataFrame:
    """Entities of the candidate type that lack the relation, minus the
    relation's name exclusions. Empty when no type qualifies."""
    chosen = candidate_type(triples, types, spec)           # <= 1 row
    of_type = types.join(F.broadcast(chosen), "type").select("entity")
    subj = triples.where(F.col("p") == spec.p).select(F.col("s").alias("entity"))
    out = of_type.join(subj, "entity", "left_anti")
    for word in spec.name_exclusions:
        out = out.where(~F.col("entity").contains(word))
    if limit is not None:                                    # D8
        out = out.orderBy("entity").limit(limit)
    return out


def chunked(candidates_df: DataFrame, chunk: int = 1000) -> DataFrame:
    """The chunk loop becomes partitions of about ``chunk`` rows (a range
    repartition keeps names sorted within chunks)."""
    n = max(1, candidates_df.count() // chunk + 1)
    return candidates_df.repartitionByRange(n, "entity")
