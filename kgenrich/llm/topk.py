"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks; every (candidate block, query
block) pair is scored in full. Rounds of score histograms, summed over all
blocks, narrow the score range that holds each query's kth highest score until
it is one value; a last pass keeps the scores above it and as many ties as are
still needed, smallest id first. Scores are never stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

BINS = 1024


def quantised(vec: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as long."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def valid_vector(vec: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _blocks(df: DataFrame, size: int, extra: list[str] = ()) -> DataFrame:
    """Rows ``(dim, blk, rows array<struct<id, v, extra…>>)``; a block holds
    about ``size`` vectors of one dimension, dealt by a hash of id and vector."""
    n = max(1, -(-df.count() // size))
    b = F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    return df.select(F.size("v").alias("dim"), b.alias("blk"), F.struct("id", "v", *extra).alias("r")) \
        .groupBy("dim", "blk").agg(F.collect_list("r").alias("rows"))


def _pairs(cand: DataFrame, query: DataFrame) -> DataFrame:
    """Every candidate block beside every query block of its dimension, as an
    equi-join on (dim, candidate block, query block)."""
    cb = cand.groupBy("dim").agg(F.collect_set("blk").alias("cbs"))
    qb = query.groupBy("dim").agg(F.collect_set("blk").alias("qbs"))
    c = cand.join(F.broadcast(qb), "dim").select("dim", F.col("blk").alias("c"), F.explode("qbs").alias("q"),
                                                 F.col("rows").alias("crows"))
    q = query.join(F.broadcast(cb), "dim").select("dim", F.explode("cbs").alias("c"), F.col("blk").alias("q"),
                                                  F.col("rows").alias("qrows"))
    return c.join(q, ["dim", "c", "q"]).select("crows", "qrows")


def _scores(crows, qrows):
    """(candidate ids, query ids, exact integer score matrix, own-row mask)."""
    ci = np.fromiter((r["id"] for r in crows), np.int64, len(crows))
    qi = np.fromiter((r["id"] for r in qrows), np.int64, len(qrows))
    c = np.array([r["v"] for r in crows], np.int64).reshape(len(ci), -1)
    q = np.array([r["v"] for r in qrows], np.int64).reshape(len(qi), -1)
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    if top < 2 ** 53:       # exact in float64, where matrix products are fast
        s = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        s = q @ c.T
    return ci, qi, s, qi[:, None] == ci[None, :]


def _count_bins(k: int):
    def run(batches):
        for pdf in batches:
            for crows, qrows in zip(pdf["crows"], pdf["qrows"]):
                ci, qi, s, own = _scores(crows, qrows)
                lo = np.array([r["lo"] for r in qrows], np.int64)
                width = np.array([r["width"] for r in qrows], np.int64)
                b = (s - lo[:, None]) // width[:, None]
                np.clip(b, -1, BINS, out=b)     # -1: below the range, BINS: above it
                b[own] = -1
                # Bins under the block's own kth best cannot hold the global kth.
                if b.shape[1] > k:
                    kth = np.partition(b, b.shape[1] - k, axis=1)[:, b.shape[1] - k]
                    b = np.where(b >= kth[:, None], b, -1)
                row, col = np.nonzero(b >= 0)
                key, n = np.unique(row * (BINS + 1) + b[row, col], return_counts=True)
                yield pd.DataFrame({"query_id": qi[key // (BINS + 1)], "bin": key % (BINS + 1), "n": n})
    return run


def _take(batches):
    for pdf in batches:
        for crows, qrows in zip(pdf["crows"], pdf["qrows"]):
            ci, qi, s, own = _scores(crows, qrows)
            kth = np.array([r["lo"] for r in qrows], np.int64)
            need = np.array([r["need"] for r in qrows], np.int64)
            row, col = np.nonzero((s > kth[:, None]) & ~own)
            out = [(row, col)]
            trow, tcol = np.nonzero((s == kth[:, None]) & ~own)
            if len(trow):       # the block's smallest ids among ties, as many as needed
                o = np.lexsort((ci[tcol], trow))
                trow, tcol = trow[o], tcol[o]
                first = np.searchsorted(trow, trow)
                keep = np.arange(len(trow)) - first < need[trow]
                out.append((trow[keep], tcol[keep]))
            row, col = (np.concatenate(x) for x in zip(*out))
            yield pd.DataFrame({"query_id": qi[row], "vec_id": ci[col], "score": s[row, col]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: int = 256, candidate_block: int = 2048,
          query_block: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its
    ``k`` highest integer inner products over ``vectors``, its own id left out;
    ties to the smaller id; all, if there are fewer than ``k``.

    Rows with a null id, a null vector or a null or non-finite component take
    no part; vectors meet those of the same length. Fully repeated ids count as
    rows: a repeated candidate is listed as often as it occurs, a repeated query
    id is answered once (its smallest vector). Empty tables give no rows."""
    def ready(df):
        return df.where(F.col(id_col).isNotNull() & valid_vector(F.col(vec_col))) \
            .select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"))

    cand = materialise(_blocks(ready(vectors), candidate_block), "topk-candidates")
    q = ready(queries).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    far = cand.select(F.explode("rows").alias("r")).select("r.v").agg(F.max(norm).alias("m")).first()["m"]
    if far is None:
        far = 0.0
    # |score| <= |q| |c|: the first range holds every score of the query.
    bound = (F.floor(norm * far) + 2).cast("long")
    state = q.withColumn("lo", -bound).withColumn("width", F.floor((2 * bound) / BINS).cast("long") + 1) \
        .withColumn("need", F.lit(k).cast("long"))
    state = materialise(state, "topk-state")
    while state.where("width > 0").limit(1).count():        # width 0: lo is the kth score
        pairs = _pairs(cand, _blocks(state.where("width > 0"), query_block, ["lo", "width"]))
        bins = pairs.mapInPandas(_count_bins(k), "query_id long, bin long, n long") \
            .groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        cum = bins.withColumn("cum", F.sum("n").over(w)).where(F.col("cum") >= k) \
            .groupBy("query_id").agg(F.max("bin").alias("bin"))
        nxt = state.join(cum, state.id == cum.query_id, "left")
        lo = F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + F.col("bin") * F.col("width"))
        # fewer than k scores in all: keep the lowest bound, everything is above it
        width = F.when(F.col("bin").isNull() | (F.col("width") == 1), F.lit(0)).otherwise(
            F.expr(f"(width - 1) div {BINS} + 1"))
        state = materialise(nxt.select("id", "v", lo.alias("lo"), width.cast("long").alias("width"), "need"),
                            "topk-state")
    found = _pairs(cand, _blocks(state, query_block, ["lo", "need"])) \
        .mapInPandas(_take, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
