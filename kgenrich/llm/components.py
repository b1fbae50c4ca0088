"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(v, comp)``: the smallest vertex reachable.

    Every round takes the smallest label among the neighbours, then the label of
    the label, and is written out; a star is done in two rounds, a chain in a
    logarithmic number. Self-links and repeated edges do no harm; null ends are
    dropped; no edges, no rows."""
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc")
    while True:
        near = e.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")) \
            .agg(F.min("comp").alias("near"))
        step = labels.join(near, "v").select("v", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("v").alias("low"), F.col("comp").alias("above"))
        new = step.join(up, "low").select("v", F.least("low", "above").alias("comp"),
                                          (F.least("low", "above") != F.col("comp")).alias("moved"))
        new = materialise(new, "cc")
        labels = new.select("v", "comp")
        if not new.where("moved").limit(1).count():
            return labels


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(v, comp)`` of earlier links and further ``links(a, b)`` -> the labels
    of all links. Only the components that are joined are worked on."""
    def of(end: str) -> DataFrame:
        return labels.select(F.col("v").alias(end), F.col("comp").alias(f"c{end}"))

    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left") \
        .select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = materialise(ends, "cc-ends")
    low = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    fresh = ends.where("a = ca").select("a").union(ends.where("b = cb").select("b")).distinct() \
        .select(F.col("a").alias("v"), F.col("a").alias("comp"))
    every = labels.union(fresh.join(labels, "v", "left_anti"))
    named = every.join(low.select(F.col("v").alias("comp"), F.col("comp").alias("low")), "comp", "left")
    return materialise(named.select("v", F.coalesce("low", "comp").alias("comp")), "cc")
