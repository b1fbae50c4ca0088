"""Word-sense features from a lexical database given as tables.

``senses(lemma, pos, rank, synset)`` and ``hypernyms(synset, parent)`` are
inputs (any wordnet exported to parquet). F15 takes the first-ranked synset
of a word's (lemma, simple POS), or of the lemma alone when the tag has no
simple POS. F16 is the hypernym closure, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tags import simple_tag
from ..session import checkpoint_dir, stage_table


def first_senses(senses: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_pos = senses.groupBy("lemma", "pos").agg(F.min_by("synset", "rank").alias("syn_pos"))
    any_pos = senses.groupBy("lemma").agg(F.min_by("synset", F.struct("rank", "pos")).alias("syn_any"))
    return by_pos, any_pos


def with_synsets(sentences: DataFrame, senses: DataFrame) -> DataFrame:
    """adds ``synsets array<string>`` aligned with ``words`` ("" when none)."""
    # written out: the join then knows their size, and small ones need no exchange of the tokens
    by_pos, any_pos = [stage_table(x, "senses") for x in first_senses(senses)]
    toks = sentences.select("title", "sent_id", F.posexplode("words").alias("i", "w")) \
        .select("title", "sent_id", "i", F.col("w.lemma").alias("lemma"), simple_tag(F.col("w.tag")).alias("pos"))
    j = toks.join(by_pos, ["lemma", "pos"], "left").join(any_pos, "lemma", "left")
    syn = F.when(F.col("pos").isNull(), F.col("syn_any")).otherwise(F.col("syn_pos"))
    g = j.groupBy("title", "sent_id").agg(F.array_sort(F.collect_list(
        F.struct("i", F.coalesce(syn, F.lit("")).alias("s")))).alias("__s"))
    return sentences.join(g, ["title", "sent_id"], "left") \
        .withColumn("synsets", F.transform("__s", lambda x: x["s"])).drop("__s")


def hypernym_closure(hypernyms: DataFrame, depth: int | None = None) -> DataFrame:
    """F16: ``(synset, ancestor, depth)`` for ancestors up to ``depth`` levels
    (None: all), with their least depth. Semi-naive: a level joins only the
    pairs that the level before found first, and pairs already known go, so
    paths do not multiply in a DAG and cycles end. Every level is a reliable
    checkpoint. Null ends are no edges; a synset on a cycle is its own ancestor."""
    checkpoint_dir(hypernyms.sparkSession)
    edges = hypernyms.select("synset", F.col("parent").alias("ancestor")) \
        .where("synset is not null and ancestor is not null").distinct().checkpoint()
    step = edges.select(F.col("synset").alias("ancestor"), F.col("ancestor").alias("above"))
    frontier, known, d = edges, edges.withColumn("depth", F.lit(1)), 1
    while d != depth:
        d += 1
        found = frontier.join(step, "ancestor").select("synset", F.col("above").alias("ancestor")).distinct()
        frontier = found.join(known, ["synset", "ancestor"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier.withColumn("depth", F.lit(d)))
    return known
