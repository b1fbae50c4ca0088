"""Sharding by a k-d tree over document metadata.

Every node is split at a weighted median (by bytes) along its widest metadata
dimension, until there are as many leaves as shards. Medians are found by
refining byte histograms of all rows; the driver sees nodes x bins sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, with_running_sum

BINS = 512
TIE_BITS = 32


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def default_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions as numbers in [0, 2^31): source and language (by
    hash, so equal values stay together), and the text's size."""
    dims = {}
    for c in ("source", "lang"):
        if c in docs.columns:
            dims[c] = F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)).cast("long") / 2
    dims["size"] = F.least(F.log2(F.col("size") + 1) * (1 << 25), F.lit((1 << 31) - 1))
    return {k: F.floor(v).cast("long") for k, v in dims.items()}


def _cuts(rows: DataFrame, open_nodes: dict[int, int], dims: list[str]) -> dict[int, tuple]:
    """For each open node (id -> number of shards below it): the widest
    dimension and the cut key; keys below the cut go left."""
    ext = rows.where(F.col("node").isin(*open_nodes)).groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    found, search = {}, {}
    for r in ext.collect():                               # one row per open node
        d = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"], d))
        parts = open_nodes[r["node"]]
        target = r["bytes"] * (parts // 2) / parts
        search[r["node"]] = {"dim": d, "lo": r[f"lo_{d}"], "hi": r[f"hi_{d}"] + 1, "below": 0, "target": target}
    while search:
        case = lambda f: F.coalesce(*[F.when(F.col("node") == n, f(s)) for n, s in search.items()])
        key = case(lambda s: F.col(s["dim"]))
        width = {n: -(-(s["hi"] - s["lo"]) // BINS) for n, s in search.items()}
        lo, hi = case(lambda s: F.lit(s["lo"])), case(lambda s: F.lit(s["hi"]))
        w = F.coalesce(*[F.when(F.col("node") == n, F.lit(width[n])) for n in search])
        hist = rows.where(F.col("node").isin(*search)) \
            .select("node", "size", key.alias("key"), lo.alias("lo"), hi.alias("hi"), w.alias("w")) \
            .where("key >= lo and key < hi").selectExpr("node", "size", "(key - lo) div w as bin")
        sums: dict[int, list] = {n: [] for n in search}
        for r in hist.groupBy("node", "bin").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            sums[r["node"]].append((r["bin"], r["b"], r["n"]))      # nodes x bins at most
        for n in list(search):
            s, below = search[n], search[n]["below"]
            for i, b, cnt in sorted(sums[n]):
                if below + b >= s["target"]:
                    break
                below += b
            start = s["lo"] + i * width[n]
            end = min(start + width[n], s["hi"])
            if cnt <= 1 or width[n] == 1:       # one row (or one key) crosses the target: nearer side
                left = below + b - s["target"] <= s["target"] - below
                found[n] = (s["dim"], end if left else start)
                del search[n]
            else:
                s.update(lo=start, hi=end, below=below)
    return found


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None,
              dimensions: dict[str, Column] | None = None, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, size, text_crc32, shard, slot)``.

    ``size`` is the UTF-8 length plus 8 (null text: 8). Give the number of
    shards or the bytes a shard should hold (shards = total / target, rounded
    up). Equal metadata never blocks a cut: within one value rows are ordered by
    a hash of id and text, so a source with most rows is cut like any other and
    shards differ by about one document per level. ``slot`` numbers the rows of
    a shard from 0 without gaps. Fully repeated rows are rows of their own (they
    share a key, so they stay together). Empty input: no rows."""
    size = (utf8_bytes(F.col(text_col)) + 8).alias("size")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32")
    tie = F.xxhash64(F.col(id_col).cast("string"), F.coalesce(text_col, F.lit(""))).alias("tie")
    meta = [c for c in ("source", "lang") if c in docs.columns] if dimensions is None else []
    base = docs.select(F.col(id_col).alias("doc_id"), size, crc, tie, *meta,
                       *[c.alias(f"__d_{k}") for k, c in (dimensions or {}).items()])
    dims = {k: F.col(f"__d_{k}") for k in dimensions} if dimensions else default_dimensions(base)
    low = F.expr(f"tie & {(1 << TIE_BITS) - 1}")
    rows = materialise(base.select("doc_id", "size", "text_crc32", "tie", *[
        (F.shiftleft(c.cast("long"), TIE_BITS) + low).alias(f"k_{k}") for k, c in dims.items()], F.lit(0).alias("node")), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    keys = [f"k_{k}" for k in dims]
    # node -> (first shard, number of shards below)
    open_nodes, first, nxt = {0: n_shards}, {0: 0}, 1
    while total and any(p > 1 for p in open_nodes.values()):
        cuts = _cuts(rows, {n: p for n, p in open_nodes.items() if p > 1}, keys)
        cond, new_open = [], {n: p for n, p in open_nodes.items() if p == 1 or n not in cuts}
        for n in [n for n, p in open_nodes.items() if p > 1 and n not in cuts]:
            new_open[n] = 1                 # no rows there: nothing to split
        for n, (d, cut) in cuts.items():
            a = open_nodes[n] // 2
            left, right = nxt, nxt + 1
            nxt += 2
            cond.append((n, d, cut, left, right))
            new_open[left], new_open[right] = a, open_nodes[n] - a
            first[left], first[right] = first[n], first[n] + a
        spark = rows.sparkSession
        t = spark.createDataFrame(cond, "node int, dim string, cut long, l int, r int")
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in keys])
        rows = rows.join(F.broadcast(t), "node", "left").withColumn(     # at most n_shards rows
            "node", F.when(F.col("dim").isNull(), F.col("node")).when(key < F.col("cut"), F.col("l"))
            .otherwise(F.col("r"))).drop("dim", "cut", "l", "r")
        open_nodes = new_open
    shard_of = rows.sparkSession.createDataFrame([(n, first[n]) for n in open_nodes], "node int, shard int")
    out = rows.join(F.broadcast(shard_of), "node").select("doc_id", "size", "text_crc32", "tie", "shard",
                                                         F.lit(1).alias("one"))
    out = materialise(out, "kd-shards")
    return with_running_sum(out, ["shard"], "tie", "one", "slot", order=["doc_id", "text_crc32"]) \
        .select("doc_id", "size", "text_crc32", "shard", "slot", "tie")


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write the documents of ``kd_shards`` (joined back by id and text) as one
    folder per shard, each shard split over several tasks by slot."""
    tie = F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    s = shards.select("tie", "shard").distinct()
    docs.withColumn("tie", tie).join(s, "tie").drop("tie") \
        .repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))) \
        .write.partitionBy("shard").parquet(path)
