"""Triple-pattern queries over ``triples(s, p, o)`` and ``types(entity, type)``.

Every function is DataFrame -> DataFrame; Catalyst pushes the constant
filters into the parquet scan (and prunes ``p`` partitions when the triples
table is written partitioned by ``p``, see ``sources.ntriples.write_triples``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def select_all(triples: DataFrame, s: str | None = None, p: str | None = None,
               o: str | None = None, order: bool = True) -> DataFrame:
    """Match a pattern with any of s/p/o bound; return the unbound columns,
    ordered by ``s`` (a global sort only when ``order`` and ``s`` is unbound)."""
    bound = {"s": s, "p": p, "o": o}
    df = triples
    for c, v in bound.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    free = [c for c, v in bound.items() if v is None]
    df = df.select(*free)
    if order and "s" in free:
        df = df.orderBy("s", *[c for c in free if c != "s"])
    return df


def subject_types(triples: DataFrame, types: DataFrame, predicate: str,
                  subject: bool = True) -> DataFrame:
    """Per subject of ``predicate``, the types of the subject (or of its
    objects) with multiplicity -- one count per (pair, type), as the original
    list keeps duplicates. Result ``(s, type, n)``: a multiset, so a subject
    with millions of objects never becomes one huge list."""
    pairs = triples.where(F.col("p") == predicate).select("s", "o")
    whose = "s" if subject else "o"
    j = pairs.join(types, pairs[whose] == types.entity)
    return j.groupBy("s", "type").agg(F.count(F.lit(1)).alias("n"))


def count_entities_of_type(types: DataFrame, type_name: str | None = None) -> DataFrame:
    """``(type, n)``; with ``type_name`` a one-row frame for that type."""
    df = types if type_name is None else types.where(F.col("type") == type_name)
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def entities_of_type(types: DataFrame, type_name: str) -> DataFrame:
    """C4: ``(entity)`` of a type."""
    return types.where(F.col("type") == type_name).select("entity")


def entities_of_type_not_in_relation(types: DataFrame, triples: DataFrame,
                                     type_name: str, predicate: str) -> DataFrame:
    """Entities of a type that are no subject of ``predicate`` (MINUS that
    keeps duplicates) -- a left anti join."""
    subj = triples.where(F.col("p") == predicate).select(F.col("s").alias("entity"))
    return entities_of_type(types, type_name).join(subj, "entity", "left_anti")


def entities_of_type_in_relation(types: DataFrame, triples: DataFrame,
                                 type_name: str, predicate: str) -> DataFrame:
    """``(s, o)`` pairs of ``predicate`` whose subject has the type."""
    pairs = triples.where(F.col("p") == predicate).select("s", "o")
    typed = entities_of_type(types, type_name).withColumnRenamed("entity", "s")
    return pairs.join(typed, "s")


def all_subjects(triples: DataFrame) -> DataFrame:
    """Distinct subjects."""
    return triples.select("s").distinct()
