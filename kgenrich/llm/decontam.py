"""Benchmark decontamination with a distributed positional inverted index.

Training tokens become postings (term, document, position), stored once for
every term that the test set has. A test window starts from the postings of its
rarest term, moved by the term's offset to the window's start; the other terms'
lists, moved likewise, are intersected with it, second rarest first. DataFrame
operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, broadcast_if, materialise

# What stands between words: every ASCII character but digits and letters.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WINDOW = 13
BROADCAST_TERMS = 1_000_000
BROADCAST_WINDOWS = 1_000_000
BROADCAST_DOCS = 1_000_000      # keys of 8 bytes


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased (null: none). One pass turns what stands
    between words into blanks, which is a third of the work of matching words."""
    plain = F.trim(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)))
    return F.when(plain != "", F.split(plain, " +")).otherwise(F.array().cast("array<string>"))


def test_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(windows, members)``: the distinct windows ``(w, len, terms)`` of all
    test items, and which items hold them ``(w, item_id)``. A window is ``size``
    consecutive words; an item with fewer words, but not none, is one window."""
    t = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + 1))
    each = t.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, size))).alias("terms"))
    each = each.withColumn("w", F.xxhash64("terms")).distinct()
    windows = each.groupBy("w").agg(F.first("terms").alias("terms")).select("w", F.size("terms").alias("len"), "terms")
    return windows, each.select("w", "item_id").distinct()


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Postings ``(term, doc_id, row_key, pos)``, one per training token whose
    term is in ``terms`` (all tokens when None), plus one posting per row with the
    empty term and ``pos`` = number of words. ``row_key`` tells rows apart when
    ids repeat. Written once as a table."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"),
                    F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit("")))).alias("pos", "term"))
    if terms is not None:
        have = terms.select("term").distinct().union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
        d = d.join(broadcast_if(have, BROADCAST_TERMS), "term")
    return materialise(d, "postings")


def exact_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct ``(row_key, start, len, w)``: occurrences of the windows."""
    terms = windows.select("w", "len", F.posexplode("terms").alias("off", "term"))
    in_test = terms.select("term").distinct()
    counts = index.join(broadcast_if(in_test, BROADCAST_TERMS), "term", "left_semi") \
        .groupBy("term").agg(F.count("*").alias("n"))
    ranked = materialise(terms.join(counts, "term", "left").withColumn(
        "r", F.row_number().over(Window.partitionBy("w").orderBy(F.coalesce("n", F.lit(0)), "off")))
        .select("w", "len", "off", "term", "r", F.coalesce("n", F.lit(0)).alias("n")), "windows")
    # a term that never occurs rules its windows out
    dead = ranked.where("n = 0").select("w").distinct()
    ranked = ranked.join(dead, "w", "left_anti")
    hits = None
    for r in (1, 2, 3):
        want = ranked.where(F.col("r") == r).select("term", "w", "len", "off")
        lists = index.join(broadcast_if(want, BROADCAST_WINDOWS), "term") \
            .select("row_key", (F.col("pos") - F.col("off")).alias("start"), "w", "len").where("start >= 0").distinct()
        if hits is None:
            hits = lists
        else:       # windows of fewer than r words have nothing to intersect here
            short = hits.where(F.col("len") < r)
            hits = hits.where(F.col("len") >= r).join(lists, ["row_key", "start", "w", "len"], "left_semi").union(short)
    hits = materialise(hits, "hits")
    rest = ranked.where("r > 3").select("w", "off", "term")
    asked = hits.where("len > 3").join(broadcast_if(rest, BROADCAST_WINDOWS), "w") \
        .select("row_key", "w", "start", "len", (F.col("start") + F.col("off")).alias("pos"), "term")
    # few documents are left to ask: only their postings are moved
    docs = broadcast_if(hits.where("len > 3").select("row_key").distinct(), BROADCAST_DOCS)
    there = index.where("term <> ''").select("row_key", "pos", "term").join(docs, "row_key", "left_semi").distinct()
    met = asked.join(there, ["row_key", "pos", "term"]) \
        .groupBy("row_key", "start", "len", "w").agg(F.count("*").alias("k")).where("k = len - 3").drop("k")
    return hits.where("len <= 3").select("row_key", "start", "len", "w").union(met.select("row_key", "start", "len", "w"))


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """``queries(q, terms array<string>)`` -> distinct ``(q, row_key, pos)``: all
    distinct terms of the query lie at most ``span`` positions from an occurrence
    ``pos`` of its rarest term, in any order. Queries without terms match nothing."""
    t = queries.select("q", F.explode(F.array_distinct("terms")).alias("term"))
    n = t.groupBy("q").agg(F.count("*").alias("terms"))
    counts = index.join(broadcast_if(t.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi") \
        .groupBy("term").agg(F.count("*").alias("n"))
    ranked = t.join(counts, "term", "left").withColumn(
        "r", F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)), "term")))
    anchors = index.join(broadcast_if(ranked.where("r = 1").select("q", "term"), BROADCAST_WINDOWS), "term") \
        .select("q", "row_key", "pos").distinct()
    # one row per position that could hold a partner: an equi-join on the position
    near = anchors.withColumn("at", F.explode(F.sequence(F.col("pos") - span, F.col("pos") + span))) \
        .join(index.select("row_key", F.col("pos").alias("at"), "term").distinct(), ["row_key", "at"]) \
        .join(broadcast_if(t, BROADCAST_WINDOWS), ["q", "term"])
    got = near.groupBy("q", "row_key", "pos").agg(F.count_distinct("term").alias("have"))
    return got.join(broadcast_if(n, BROADCAST_TERMS), "q").where("have = terms").select("q", "row_key", "pos")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per input row of ``docs``: ``(doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated)``.

    A word is hit when it lies in an occurrence of a test window; ``n_items``
    counts the items with occurring windows, and ``items_sha256`` digests their
    ids (sorted as strings, comma-joined). A document is contaminated when
    ``n_hit > 0`` and ``share * n_hit >= n_words``. Null and empty texts have no
    words; null ids are kept; an item with a null id counts no item, but its
    words are hit. Rows that repeat in full get equal answers. Without test items
    nothing is contaminated."""
    windows, members = test_windows(items, size)
    windows, members = materialise(windows, "test-windows"), materialise(members, "test-members")
    index = build_index(docs, windows.select(F.explode("terms").alias("term")))
    hits = materialise(exact_matches(index, windows), "matches")
    spans = hits.groupBy("row_key", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    seen = F.coalesce(F.max(end).over(before), F.lit(0))
    n_hit = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), seen))) \
        .groupBy("row_key").agg(F.sum("new").cast("long").alias("n_hit"))
    held = hits.select("row_key", "w").distinct().join(
        broadcast_if(members, BROADCAST_WINDOWS), "w").where("item_id is not null") \
        .select("row_key", F.col("item_id").cast("string").alias("item")).distinct() \
        .groupBy("row_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per = n_hit.join(held, "row_key", "left")
    rows = index.where("term = ''").select("doc_id", "row_key", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(per, "row_key", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"), "row_key")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without its contaminated rows."""
    bad = contamination(docs, items, size, share).where("contaminated").select(F.col("row_key").alias("__bad")).distinct()
    key = F.xxhash64("doc_id", "text")
    return docs.withColumn("__key", key).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
