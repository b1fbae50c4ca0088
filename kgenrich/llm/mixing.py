"""Mixing sources to target weights.

The words of each source are packed, in a pseudorandom document order, into
blocks of a fixed length. A source's target gives its number of output slots;
a multinomial draw deals them to the output shards. Slot ``g`` maps to a block
through a pseudorandom permutation of the source's block indices (one
permutation per pass over the source), and slots meet blocks in an equi-join on
(source, block index).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import WS_WORD, materialise, with_running_sum, word_count

BLOCK_WORDS = 256
SLOT_CHUNK = 50_000
ROUNDS = 4


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size)`` -> adds ``target``: ``share`` times all words,
    split by weight (``weights`` repeat over the sources in code-point order,
    null last); a target stops at ``cap`` times its source's size and the excess
    is shared again by weight until none is above. Works on the table of sources."""
    w = Window.orderBy(F.col("source").asc_nulls_last())       # one row per source
    wt = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("n", F.row_number().over(w) - 1) \
        .withColumn("weight", F.element_at(wt, (F.col("n") % len(weights) + 1).cast("int"))).drop("n")
    t = materialise(t.withColumn("most", F.col("source_size") * cap), "mix-sources")
    total = float(t.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None                                              # target = weight * level
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= F.col("most")
        r = t.agg(F.sum(F.when(full, F.col("most"))).alias("m"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r["w"]:
            break
        new = max(0.0, total - (r["m"] or 0.0)) / r["w"]
        if level is not None and new <= level:
            break
        level = new
    target = F.least(F.col("most"), F.col("weight") * F.lit(level)) if level is not None else F.lit(0.0)
    return t.select("source", "source_size", "weight", target.alias("target"))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at the points ``i``: a balanced
    Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)

    def walk(x):
        a, b = x >> h, x & mask
        for r in (range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)):
            key = np.uint64((seed * 1_000_003 + r * 7919 + 1) % (1 << 63))
            if inverse:
                a, b = b ^ (_mix64(a + key) & mask), a
            else:
                a, b = b, a ^ (_mix64(b + key) & mask)
        return (a << h) | b

    with np.errstate(over="ignore"):
        x = walk(i.astype(np.uint64))
        out = x >= n
        while out.any():
            x[out] = walk(x[out])
            out = x >= n
    return x.astype(np.int64)


def source_seed(source: str | None, seed: int) -> int:
    """A seed from the whole name; null has one of its own."""
    return int.from_bytes(hashlib.sha256(repr(source).encode("utf-8", "surrogatepass")).digest()[:7], "little") + seed


def _slot_plan(n_shards: int, seed: int, block: int):
    """Per source: the slots of its target as chunks of consecutive slot numbers."""
    def run(batches):
        for pdf in batches:
            for src, size, want in zip(pdf["source"], pdf["source_size"], pdf["want"]):
                if want <= 0 or size <= 0:
                    continue
                src = None if src is None or (isinstance(src, float) and np.isnan(src)) else src
                s = source_seed(src, seed)
                blocks = -(-size // block)
                last = size - (blocks - 1) * block          # words of the last block
                full, rem = divmod(int(want), int(size))
                n = full * blocks
                cut = 0                                     # words of the last slot of a part pass
                if rem:
                    at = int(permute(np.array([blocks - 1]), blocks, s + full, inverse=True)[0])
                    cum = lambda g: g * block - (g > at) * (block - last)  # noqa: E731  words before slot g
                    g = -(-rem // block)
                    while cum(g) < rem:
                        g += 1
                    while g > 1 and cum(g - 1) >= rem:
                        g -= 1
                    cut = rem - cum(g - 1)
                    n += g
                counts = np.random.default_rng(s).multinomial(n, np.full(n_shards, 1 / n_shards))
                ends = np.cumsum(counts)
                rows = [(max(a, start), min(a + SLOT_CHUNK, end), j) for j, (start, end) in
                        enumerate(zip(ends - counts, ends)) for a in range(start, end, SLOT_CHUNK)]
                yield pd.DataFrame({"source": pd.Series([src] * len(rows), dtype=object), "seed": s, "blocks": blocks, "slots": n,
                                    "cut": cut, "last": last,
                                    "lo": [r[0] for r in rows], "hi": [r[1] for r in rows], "shard": [r[2] for r in rows]})
    return run


def _expand(block: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                g = np.arange(r.lo, r.hi)
                turn = g // r.blocks
                b = np.empty(len(g), np.int64)
                for t in np.unique(turn):
                    m = turn == t
                    b[m] = permute(g[m] % r.blocks, int(r.blocks), int(r.seed + t))
                take = np.where(b == r.blocks - 1, r.last, block)
                if r.cut:
                    take[g == r.slots - 1] = r.cut
                src = None if r.source is None or (isinstance(r.source, float) and np.isnan(r.source)) else r.source
                yield pd.DataFrame({"source": pd.Series([src] * len(g), dtype=object), "shard": r.shard, "turn": turn, "block": b, "take": take})
    return run


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK_WORDS,
         n_shards: int = 16, seed: int = 17, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)``. ``rows``: every document with ``row_key``, ``size``,
    ``source``, ``source_size``, ``target``. ``pieces``: what the mix takes --
    ``(row_key, shard, turn, at, words)``: ``words`` words of the document from
    its word number ``at``, in pass ``turn`` over its source, in an output shard.

    Taken words of a source add up to its target rounded to whole words. A pass
    takes each block at most once, so no word is taken more often than the
    number of passes (``cap`` rounded up). Rows that repeat in full are packed
    one after another. Null text has no words; null source is a source."""
    tie = F.xxhash64(F.col(id_col).cast("string"), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    base = materialise(docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
                                   tie.alias("row_key")), "mix-rows")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, cap), "mix-targets")
    placed = with_running_sum(base.where("size > 0"), ["source"], "row_key", "size", "start", order=["doc_id"])
    first = F.expr(f"start div {block}")
    seg = placed.withColumn("block", F.explode(F.sequence(first, F.expr(f"(start + size - 1) div {block}"))))
    seg = seg.select("row_key", "source", "start", "size", "block",
                     F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("at"))
    slots = targets.select("source", "source_size", F.round("target").cast("long").alias("want")) \
        .mapInPandas(_slot_plan(n_shards, seed, block),
                     "source string, seed long, blocks long, slots long, cut long, last long, lo long, hi long, shard int") \
        .repartition("source", "lo") \
        .mapInPandas(_expand(block), "source string, shard int, turn int, block long, take long")
    s = slots.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("k"), "block", "shard", "turn", "take")
    d = seg.withColumn("k", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    # words of the block that this document gives: [at, at + ..) cut by the slot's take
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    words = end - (F.col("start") + F.col("at"))
    # slots grow with the corpus, whatever the size estimate of the small table they come from
    pieces = d.join(s.hint("merge"), ["k", "block"]).select("row_key", "shard", "turn", "at", words.cast("long").alias("words")) \
        .where("words > 0")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rows = base.join(F.broadcast(t) if t.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("t_source"))) \
        .drop("t_source")
    return rows, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``(doc_id, size, source_size, target, taken)``.
    Fully repeated rows (same id, source and text) report the mean of what their
    copies give, rounded down; an empty table gives no rows."""
    rows, pieces = plan(docs, **options)
    per = pieces.groupBy("row_key").agg(F.sum("words").alias("words"))
    copies = rows.groupBy("row_key").agg(F.count("*").alias("copies"))
    per = per.join(copies, "row_key").select("row_key", F.expr("words div copies").alias("taken"))
    return rows.join(per, "row_key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per document and pass over its source, with
    the columns of ``docs``; ``text`` holds the words taken (the untouched text
    when all of them are), ``n_chars``, if there, its new length. Documents of
    which nothing is taken are gone; null and empty texts have no words and go.
    Fully repeated rows give the words of one of them."""
    rows, pieces = plan(docs, **options)
    cols = docs.columns
    runs = pieces.groupBy("row_key", "turn", "at").agg(F.max("words").alias("words")) \
        .groupBy("row_key", "turn").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("runs"),
                                        F.sum("words").alias("sum"))
    tie = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    runs = runs.select(F.col("row_key").alias("__key"), F.col("runs").alias("__runs"), F.col("sum").alias("__sum"))
    j = docs.withColumn("__key", tie).dropDuplicates(["__key"]).join(runs, "__key")
    words = F.regexp_extract_all("text", F.lit(f"({WS_WORD})"), 1)
    some = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(words, (r["at"] + 1).cast("int"),
                                                                        r["words"].cast("int")))), " ")
    text = F.when(F.col("__sum") >= word_count(F.col("text")), F.col("text")).otherwise(some)
    j = j.withColumn("text", text)
    if "n_chars" in cols:
        j = j.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return j.select(*cols)
