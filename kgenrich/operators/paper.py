"""K1-K5: operators the paper describes beyond the code path.

K1 re-joins multi-token geographic names (catalog n-grams, longest match
left to right); K2 maps names to their canonical form through redirects;
K3 adds token features (position, all parts capitalised, likely year, entity
types); K4 is the paper's labelling rule (the name word is needed only when
the value occurs in more than one sentence); K5 scores classifier and
extractor separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import prepare_value
from ..config import RelationSpec
from ..session import stage_table
from . import evaluate as ev
from .supervise import lemmas

WORD = "struct<segment:string,lemma:string,tag:string,parse:string>"


# --- K1 ------------------------------------------------------------------------------

SMALL_INDEX = 64 << 20      # bytes of name prefixes that every executor may hold


def name_index(catalog: DataFrame) -> DataFrame:
    """``(start, k, name)`` of the names of two parts or more: their first two
    parts, their number of parts, the name."""
    parts = F.split("name", "_")
    return catalog.select("name").distinct().where(F.size(parts) > 1) \
        .select(F.array_join(F.slice(parts, 1, 2), "_").alias("start"), F.size(parts).alias("k"), "name")


def name_hits(sentences: DataFrame, catalog: DataFrame, max_n: int | None = None) -> DataFrame:
    """``(title, sent_id, i, k)``: the longest catalog name of ``k`` segments at
    position ``i``. Positions are first looked up by their two segments among
    the starts of names, held in memory while they are under SMALL_INDEX bytes;
    only positions that start a name go on to the comparison with whole names."""
    index = name_index(catalog)
    if max_n is not None:
        index = index.where(F.col("k") <= max_n)
    lengths = index.select("start", "k").distinct()
    size, longest = lengths.agg(F.sum(F.octet_length("start") + 16), F.max("k")).first()
    if not longest:
        return sentences.select("title", "sent_id", F.lit(0).alias("i"), F.lit(0).alias("k")).where("false")
    # segments in a projection of their own: written inside the lambda, all of a sentence's are taken again at
    # every position; elements are taken by their place, as a slice in a lambda costs several times as much
    segs = sentences.where(F.size("words") > 1).select("title", "sent_id", F.col("words.segment").alias("segs"))
    n = F.size("segs")
    places = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(
        i.alias("i"), F.concat_ws("_", F.get("segs", i), F.get("segs", i + 1)).alias("start"),
        F.transform(F.sequence(i, F.least(i + longest, n) - 1), lambda j: F.get("segs", j)).alias("ahead")))
    here = segs.select("title", "sent_id", F.explode(places).alias("p")).select("title", "sent_id", "p.*")
    starts = F.broadcast(lengths) if size <= SMALL_INDEX else lengths
    cand = here.join(starts, "start").where(F.size("ahead") >= F.col("k")) \
        .select("title", "sent_id", "i", "k", F.array_join(F.expr("slice(ahead, 1, k)"), "_").alias("name"))
    found = cand.join(index.select("name", "k"), ["name", "k"], "left_semi")
    return found.groupBy("title", "sent_id", "i").agg(F.max("k").alias("k"))


def join_names(sentences: DataFrame, catalog: DataFrame, max_n: int | None = None) -> DataFrame:
    """K1: consecutive segments whose ``_``-joined form is a catalog name become
    one word (longest match first, left to right, no overlaps)."""
    longest = name_hits(sentences, catalog, max_n)
    per_sent = longest.groupBy("title", "sent_id").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("__m"))
    j = sentences.join(per_sent, ["title", "sent_id"], "left")
    init = F.struct(F.array().cast(f"array<{WORD}>").alias("out"), F.lit(0).alias("skip"))

    def step(acc, i):
        w = F.get(F.col("words"), i)
        k = F.element_at(F.col("__m"), i)
        name = F.array_join(F.transform(F.slice(F.col("words"), i + 1, F.coalesce(k, F.lit(1))),
                                        lambda x: x["segment"]), "_")
        merged = F.struct(name.alias("segment"), name.alias("lemma"), w["tag"].alias("tag"),
                          w["parse"].alias("parse"))
        return (F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip")))
                .when(k.isNotNull(), F.struct(F.array_append(acc["out"], merged).alias("out"),
                                              (k - 1).alias("skip")))
                .otherwise(F.struct(F.array_append(acc["out"], w).alias("out"), F.lit(0).alias("skip"))))

    words = F.when(F.col("__m").isNull(), F.col("words")).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size("words") - 1), init, step)["out"])
    return j.select("title", "sent_id", words.alias("words"))


# --- K2 ------------------------------------------------------------------------------

REDIRECT_RE = r"(?is)^\s*#(?:redirect|patrz|przekieruj)\s*:?\s*\[\[([^\]|#]+)"


def redirects(pages: DataFrame) -> DataFrame:
    """K2: ``(name, canonical)``, one row a name, from redirect pages
    (``#REDIRECT [[Target]]``): the target named by the page with the largest
    id (ties: the larger target), as a later page replaces an earlier one."""
    target = F.regexp_extract(F.col("wikitext"), REDIRECT_RE, 1)
    r = pages.select(F.replace(F.col("title"), F.lit(" "), F.lit("_")).alias("name"), "page_id",
                     F.replace(F.trim(target), F.lit(" "), F.lit("_")).alias("canonical"))
    return r.where((F.col("canonical") != "") & F.col("name").isNotNull()).groupBy("name") \
        .agg(F.max_by("canonical", F.struct("page_id", "canonical")).alias("canonical"))


def resolve_redirects(redirect_table: DataFrame) -> DataFrame:
    """K2: ``(name, canonical)`` with chains followed to their end, by pointer
    doubling: round r takes every open name 2^r redirects ahead, so a chain of n
    needs log2(n) rounds. Once a round brings no name to its end, what is left
    leads into cycles; there the smallest name on the cycle is the canonical
    form. Every round is a stage table of the names still open."""
    links = stage_table(redirect_table.select("name", F.col("canonical").alias("to")), "redirects")
    names = links.select(F.col("name").alias("to"))
    open_ = stage_table(links.join(names, "to", "left_semi").select("name", "to"), "redirects")
    ended = links.join(names, "to", "left_anti").select("name", "to")
    while not open_.isEmpty():
        there = ended.withColumn("end", F.lit(True)).unionByName(open_.withColumn("end", F.lit(False)))
        step = stage_table(_hop(open_, there, "end"), "redirects")
        if step.where("end").isEmpty():
            return ended.unionByName(_cycle_names(links.join(open_.select("name"), "name", "left_semi"))) \
                .select("name", F.col("to").alias("canonical"))
        ended = ended.unionByName(step.where("end").select("name", "to"))
        open_ = step.where("not end").select("name", "to")
    return ended.select("name", F.col("to").alias("canonical"))


def _hop(rows: DataFrame, there: DataFrame, *more: str) -> DataFrame:
    """``rows`` with ``to`` and the columns ``more`` of the row that ``to`` names."""
    ahead = there.select(F.col("name").alias("at"), F.col("to").alias("next"), *more)
    return rows.join(ahead, F.col("to") == F.col("at")).select("name", F.col("next").alias("to"), *more)


def _cycle_names(links: DataFrame) -> DataFrame:
    """``(name, to)`` for names that all lead into cycles: ``to`` is the smallest
    name on the cycle. Doubling keeps the least name of the next 2^r steps; once
    2^r is the number of names, a pointer is on its cycle and sees all of it."""
    walk = stage_table(links.withColumn("least", F.col("name")), "cycles")
    for _ in range((walk.count() - 1).bit_length()):
        mine = walk.select(F.col("name").alias("self"), F.col("least").alias("mine"))
        walk = stage_table(_hop(walk.select("name", "to"), walk, "least").join(mine, F.col("name") == F.col("self"))
                           .select("name", "to", F.least("least", "mine").alias("least")), "cycles")
    return _hop(walk.select("name", "to"), walk, "least").select("name", F.col("least").alias("to"))


def canonical_names(df: DataFrame, col: str, redirect_table: DataFrame) -> DataFrame:
    """Replace ``col`` by its canonical form where a redirect exists."""
    r = redirect_table.select(F.col("name").alias("__n"), F.col("canonical").alias("__c"))
    j = df.join(r, df[col] == r["__n"], "left")
    return j.withColumn(col, F.coalesce("__c", col)).drop("__n", "__c")


# --- K3 ------------------------------------------------------------------------------

def extra_features(words: Column, types: Column | None = None) -> Column:
    """K3: per token ``position``, ``allcaps`` (every ``_``/``-`` part starts
    upper-case), ``year`` (1000-2012) and ``type_<T>`` flags when ``types``
    (``array<array<string>>`` aligned with ``words``) is given."""
    def one(w, i):
        parts = F.filter(F.split(w["segment"], "[_-]"), lambda p: p != "")
        allcaps = F.forall(parts, lambda p: p.rlike(r"^\p{Lu}")) & (F.size(parts) > 0)
        year = F.when(w["lemma"].rlike(r"^\d{4}$"), w["lemma"].cast("int").between(1000, 2012)) \
            .otherwise(F.lit(False))
        base = F.array(F.concat(F.lit("position="), i.cast("string")),
                       F.concat(F.lit("allcaps="), allcaps.cast("int").cast("string")),
                       F.concat(F.lit("year="), year.cast("int").cast("string")))
        if types is None:
            return base
        return F.concat(base, F.transform(F.coalesce(F.get(types, i), F.array().cast("array<string>")),
                                          lambda t: F.concat(F.lit("type_"), t, F.lit("=1"))))
    return F.transform(words, one)


def word_types(sentences: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entity types per word (``types array<array<string>>``) by a join of the
    segments with the catalog."""
    toks = sentences.select("title", "sent_id", F.posexplode("words").alias("pos", "w"))
    t = toks.join(catalog.select(F.col("name").alias("seg"), "types"),
                  F.col("w.segment") == F.col("seg"), "left")
    g = t.groupBy("title", "sent_id").agg(F.array_sort(F.collect_list(
        F.struct("pos", F.coalesce("types", F.array().cast("array<string>")).alias("t")))).alias("__t"))
    return sentences.join(g, ["title", "sent_id"], "left") \
        .withColumn("types", F.transform("__t", lambda x: x["t"])).drop("__t")


# --- K4 ------------------------------------------------------------------------------

def label_sentences_paper(pairs: DataFrame, sentences: DataFrame, spec: RelationSpec,
                          stop_words=None) -> DataFrame:
    """K4: a matching sentence is positive when it is the only match in the
    article; with several matches only those holding a relation-name word."""
    words = list(spec.words) or [spec.p.lower()]
    p = pairs.select("s", "o", prepare_value(F.col("o"), spec.is_numeric, stop_words).alias("values"))
    j = p.join(sentences.withColumnRenamed("title", "s"), "s")
    lem = lemmas(F.col("words"))
    match = F.coalesce(F.arrays_overlap(lem, F.col("values")), F.lit(False))
    j = j.withColumn("__match", match)
    # a pair's sentences are its article's first sentences: a bounded window
    n_match = F.sum(F.col("__match").cast("int")).over(Window.partitionBy("s", "o"))
    has_word = F.coalesce(F.arrays_overlap(lem, F.array(*[F.lit(w) for w in words])), F.lit(False))
    kind = F.when(F.col("__match") & ((n_match == 1) | has_word), "pos") \
        .when(~F.col("__match"), "neg").otherwise("none")
    return j.select("s", "o", "values", "sent_id", "words", kind.alias("kind"),
                    F.size(F.array_intersect(lem, F.col("values"))).alias("n_match"))


# --- K5 ------------------------------------------------------------------------------

def classifier_scores(kept: DataFrame, gold: DataFrame, spec: RelationSpec, p: str | None = None,
                      stop_words=None) -> DataFrame:
    """K5: the classifier is right for an entity when at least one kept
    sentence holds a gold value. ``kept(title, sent_id, words)``,
    ``gold(entity, values)``."""
    gv = gold.select("entity", F.flatten(F.transform("values", lambda v: prepare_value(
        v, spec.is_numeric, stop_words))).alias("pv"), "values")
    k = kept.select(F.col("title").alias("entity"), lemmas(F.col("words")).alias("lem"))
    hit = k.join(gv, "entity", "left").groupBy("entity").agg(
        F.max(F.coalesce(F.arrays_overlap("lem", "pv"), F.lit(False)).cast("int")).alias("hit"))
    pred = hit.select("entity", F.when(F.col("hit") == 1, F.lit("__hit")).otherwise(F.lit("__miss")).alias("value"))
    g = gold.select("entity", F.array(F.lit("__hit")).alias("values"))
    return ev.scores(ev.classify_errors(g, pred), p)


def extractor_scores(values: DataFrame, gold: DataFrame, kept: DataFrame, p: str | None = None) -> DataFrame:
    """K5: value scores restricted to entities with at least one kept sentence."""
    ents = kept.select(F.col("title").alias("entity")).distinct()
    return ev.scores(ev.classify_errors(gold.join(ents, "entity", "left_semi"),
                                        values.join(ents, "entity", "left_semi")), p)
