"""Training data by distant supervision.

Labelling joins known pairs to the subjects' sentences. "Best sentence per
pair" is a partial aggregation (``max_by`` on a struct), so a subject holding a
large share of the rows is combined map-side instead of landing in one window
partition. Training pairs are ranked within their value; of a value with more
pairs than the limit only about twice the limit reach its window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import TRAINING_LIMIT, RelationSpec
from ..functions.tags import relation_words
from ..functions.values import prepare_value
from ..sources.stopwords import default_stop_words
from . import graph
from .selection import first_rows


class TooFewExamples(RuntimeError):
    pass


def pair_hash(seed: int | None = None):
    """A uniform order of pairs that other engines can reproduce; another for every seed."""
    return F.md5(F.concat_ws("|", F.col("s"), F.col("o"), *([] if seed is None else [F.lit(str(seed))])))


def training_pairs(triples: DataFrame, types: DataFrame, spec: RelationSpec,
                   limit: int | None = TRAINING_LIMIT) -> DataFrame:
    """``(s, o)`` known pairs; typed relations use only subjects of the
    type. At most ``limit`` pairs, one rule at every size (None: all): the first
    pair of every value by a hash of the pair, then the second, and so on (G2), or
    by the hash alone for a relation without ``dedupe_values``."""
    if spec.subject_type:
        pairs = graph.entities_of_type_in_relation(types, triples, spec.subject_type, spec.p)
    else:
        pairs = graph.select_all(triples, p=spec.p, order=False)
    if limit is None:
        return pairs
    if not spec.dedupe_values:
        return first_rows(pairs, pair_hash(), limit)
    # A hash threshold for values over the limit keeps about twice the limit before
    # the exact cut; repeated pairs pass together, so distinct ones are counted.
    large = pairs.select("s", "o").distinct().groupBy("o").agg(F.count("*").alias("c")).where(F.col("c") > limit) \
        .select(F.col("o").alias("value"), ((2 * limit + 50) / F.col("c") * 2 ** 48).alias("most"))
    near = pairs.join(large, F.col("o") == F.col("value"), "left") \
        .where(F.col("most").isNull() | (F.conv(F.substring(pair_hash(), 1, 12), 16, 10).cast("long") <= F.col("most")))
    w = Window.partitionBy("o").orderBy(pair_hash(), "s")
    ranked = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    last = before = 0                       # pairs of ranks under ``last``; at most ``limit`` ranks
    for last, n in ranked.groupBy("rank").count().orderBy("rank").collect():
        if before + n >= limit:
            break
        before += n
    whole = ranked.where(F.col("rank") < last)
    part = first_rows(ranked.where(F.col("rank") == last), pair_hash(), limit - before)
    return whole.unionByName(part).select(*pairs.columns)


def drop_gold(pairs: DataFrame, gold_entities: DataFrame) -> DataFrame:
    """Leak guard -- gold entities never train."""
    g = gold_entities.select(F.col("entity").alias("s")).distinct()
    return pairs.join(g, "s", "left_anti")


def lemmas(words: Column) -> Column:
    return F.transform(words, lambda w: w["lemma"])


def label_sentences(pairs: DataFrame, sentences: DataFrame, spec: RelationSpec,
                    stop_words=None) -> DataFrame:
    """One row per (pair, sentence) with ``values`` (prepared, F12/F13),
    ``kind``: ``pos`` (holds a value token, and a relation-name word when the
    relation needs one), ``neg`` (no value token) or ``none``."""
    words = list(spec.words) if spec.words else None
    p = pairs.select("s", "o", prepare_value(F.col("o"), spec.is_numeric, stop_words).alias("values"))
    j = p.join(sentences.withColumnRenamed("title", "s"), "s")
    lem = lemmas(F.col("words"))
    match = F.arrays_overlap(lem, F.col("values"))
    if spec.needs_word:
        name_words = F.array(*[F.lit(w) for w in words]) if words else relation_words(F.lit(spec.p))
        ok = match & F.coalesce(F.arrays_overlap(lem, name_words), F.lit(False))
    else:
        ok = match
    kind = F.when(F.coalesce(ok, F.lit(False)), "pos") \
        .when(~F.coalesce(match, F.lit(False)), "neg").otherwise("none")
    return j.select("s", "o", "values", "sent_id", "words", kind.alias("kind"),
                    F.size(F.array_intersect(lem, F.col("values"))).alias("n_match"))


def best_positives(labelled: DataFrame, cap: int | None = None, seed: int | None = None) -> DataFrame:
    """G6 (+G8): per pair the positive sentence with most distinct matching
    tokens, earliest on a tie. ``(s, o, sent_id, words, values)``. With a cap the
    first pairs in the seed's order, so a cap's sample holds those of smaller caps."""
    pos = labelled.where(F.col("kind") == "pos")
    best = pos.groupBy("s", "o").agg(F.max_by(
        F.struct("sent_id", "words", "values"),
        F.struct(F.col("n_match"), -F.col("sent_id"))).alias("b"))
    out = best.select("s", "o", "b.sent_id", "b.words", "b.values")
    if cap is not None:                                      # G8
        out = first_rows(out, pair_hash(seed), cap, ["s", "o", "sent_id"])
    return out


def nested_samples(positives: DataFrame, caps: list[int], seeds: list[int]) -> DataFrame:
    """The samples of a learning curve, ``(cap, seed)`` and the columns of
    ``positives``: per seed the first ``cap`` pairs in the seed's order. The
    largest cap's rows are selected first, so only they are ranked."""
    out = None
    for seed in seeds:
        top = first_rows(positives, pair_hash(seed), max(caps), ["s", "o", "sent_id"])
        w = Window.partitionBy(F.lit(seed)).orderBy(pair_hash(seed), F.xxhash64("s", "o", "sent_id"))
        one = top.withColumn("rank", F.row_number().over(w)) \
            .withColumn("cap", F.explode(F.filter(F.array(*[F.lit(c) for c in caps]), lambda c: c >= F.col("rank")))) \
            .select("cap", F.lit(seed).alias("seed"), *positives.columns)
        out = one if out is None else out.unionByName(one)
    return out


def negatives(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("kind") == "neg").select("s", "o", "sent_id", "words")


def check_enough(positives: DataFrame, minimum: int = 10) -> int:
    """Fail when there are not more than ``minimum`` positives."""
    n = positives.count()
    if n <= minimum:
        raise TooFewExamples(f"{n} positive sentences, need more than {minimum}")
    return n


def undersample(neg: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` negatives drawn uniformly with a seeded hash order, by exact
    histogram selection: ``n`` may be any share of the data. The hash is md5, so
    other engines can reproduce the draw."""
    key = F.md5(F.concat_ws("|", F.col("s"), F.col("o"), F.col("sent_id").cast("string"),
                            F.lit(str(seed))))
    return first_rows(neg, key, n, ["s", "o", "sent_id"])


def features(words: Column, stop_words=None) -> Column:
    """Lemmas starting with a lower-case letter that are not stop words
    (duplicates kept)."""
    stop = F.array(*[F.lit(w) for w in (stop_words if stop_words is not None
                                          else default_stop_words())])
    return F.filter(lemmas(words), lambda l: l.rlike(r"^\p{Ll}") & ~F.array_contains(stop, l))


def vocabulary_threshold(cap: int | None) -> int:
    """G10 threshold: 2 below a cap of 100, 5 below 1000, else 10 -- and 2 when
    there is no cap (the original compares ``None < 100``, which holds)."""
    if cap is None or cap < 100:
        return 2
    return 5 if cap < 1000 else 10


def vocabulary(positives: DataFrame, k: int = 2, stop_words=None) -> DataFrame:
    """``(feature, n)`` for features occurring more than ``k`` times in
    the positive sentences (token occurrences)."""
    f = positives.select(F.explode(features(F.col("words"), stop_words)).alias("feature"))
    return f.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
