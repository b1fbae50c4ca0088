"""MinHash near-duplicates by a chosen-path set similarity join.

Each document's shingle set is embedded into MinHash values. Independent trees
branch the documents: a node picks some of the minwise positions at random
(seeded by its own path) and sends every document down by its value there, so
documents follow the paths they choose by their own minwise tokens. Nodes with
few documents are compared exhaustively, larger ones branch again.

Because only groups are asked for, pairs inside a group are never asked again:

1. Every node offers the links to one of its documents (a star). In a large node
   that is the most central one, whose root values are the commonest.
2. In small nodes, and large ones that are one group but for a bounded rest, every
   document is compared with all others of the node; over all its nodes it asks
   for its closest few outside its group.
3. Documents that had such a partner come back once: finer sketches are made of
   them, and all pairs still in different groups that pass are confirmed. A pair
   that meets in several nodes is asked in the first of them.

Links are always confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_folder, stage_run
from .common import broadcast_if, materialise
from .components import connected_components, merge_components
from .shingles import mix64, shingles_of, text_slices, words_of

COORDS = 256            # MinHash positions of the sketch, a byte each
TREES = 8
ROOT_COORDS = 2         # positions a root picks: 1/similarity, rounded up
SMALL_NODE = 256        # documents compared exhaustively
REST = 2048             # documents outside the largest group that are compared with the whole of a large node
HEADS = 3               # orders that the heads of nodes are taken from, per round
CLOSEST = 2             # documents outside its group that a document asks for first
FEW_IDS = 200_000       # ids (with a key 16 bytes each) that may be broadcast to pick texts
MAX_DEPTH = 12          # beyond it large nodes are compared block by block
SLACK = 0.11            # over 4 standard deviations of a COORDS-position estimate
FINE_COORDS = 1024      # positions of the finer sketch of documents whose coarse one left a doubt
FINE_SLACK = 0.055      # 4 standard deviations of a FINE_COORDS-position estimate
SLICE = 1 << 18         # bytes of text sketched at a time: their shingles stay in the CPU's cache
_rng = np.random.default_rng(75)
_MUL = _rng.integers(1, 2 ** 32, COORDS, dtype=np.uint32) | np.uint32(1)
_FINE_MUL = np.random.default_rng(7575).integers(1, 2 ** 32, FINE_COORDS, dtype=np.uint32) | np.uint32(1)
ROOTS = TREES * ROOT_COORDS         # positions of the roots, whole 64-bit values, besides the sketch
_ROOT_MUL = _rng.integers(1, 2 ** 63, ROOTS, dtype=np.uint64) | np.uint64(1)


def _minwise(u: np.ndarray, at: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """A byte of the minimum of every position, of the sets that begin at ``at`` in ``u``."""
    half = (u >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), len(mul)), np.uint8)
    for k in range(len(mul)):
        low = np.minimum.reduceat(half * mul[k], at).astype(np.uint64)
        out[:, k] = mix64(low + np.uint64(k)).astype(np.uint8)
    return out


def _sketch(shingle_words: int):
    def run(batches):
        for batch in batches:
            n, s1, s2, sigs, roots = [], [], [], [], []
            for _, texts in text_slices(batch, limit=SLICE):
                sets = [shingles_of(w, shingle_words) for w in words_of(texts)]
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                sig = np.zeros((len(sets), COORDS), np.uint8)
                root = np.zeros((len(sets), ROOTS), np.uint64)
                a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(full):
                    u = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    sig[full] = _minwise(u, at, _MUL)
                    for k in range(ROOTS):
                        root[full, k] = mix64(np.minimum.reduceat(u * _ROOT_MUL[k], at) + np.uint64(k))
                    a[full] = np.add.reduceat(u, at)
                    b[full] = np.add.reduceat(mix64(u), at)
                n.append(size)
                s1.append(a)
                s2.append(b)
                sigs += [row.tobytes() for row in sig]
                roots.append(root)
            if not n:
                continue
            tops = np.concatenate(roots).view(np.int64).ravel()
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep]
                + [pa.array(np.concatenate(n), pa.int64())]
                + [pa.array(np.concatenate(x).view(np.int64)) for x in (s1, s2)]
                + [pa.array(sigs, pa.binary()),
                   pa.ListArray.from_arrays(np.arange(0, len(tops) + 1, ROOTS, dtype=np.int32), pa.array(tops))],
                names=[batch.schema[i].name for i in keep] + ["n_shingles", "s1", "s2", "sig", "roots"])
    return run


def _fine(shingle_words: int):
    """``(cid, text)`` of texts with words -> ``(cid, sig)``, the finer sketch."""
    def run(batches):
        for batch in batches:
            sigs = []
            for _, texts in text_slices(batch, limit=SLICE):
                sets = [shingles_of(w, shingle_words) for w in words_of(texts)]
                at = np.cumsum([0] + [len(s) for s in sets])[:-1]
                sigs += [row.tobytes() for row in _minwise(np.concatenate(sets), at, _FINE_MUL)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sigs, pa.binary())], names=["cid", "sig"])
    return run


def _linked(similarity: float, shingle_words: int):
    """Pairs with both whole texts -> the pairs whose sets' Jaccard reaches the threshold.

    Texts travel rather than sets of hashes: they are smaller and compress well."""
    num = round(similarity * 100)

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            known: tuple = (None, None)         # rows come sorted by a: its set is made once
            for i, tb in text_slices(batch, "tb"):
                for j, wb in enumerate(words_of(tb), i):
                    if known[0] != a[j]:
                        ta = batch.column("ta")[j].as_py() or ""
                        known = (a[j], shingles_of(words_of([ta.encode()])[0], shingle_words))
                    x, y = known[1], shingles_of(wb, shingle_words)
                    if 100 * min(len(x), len(y)) < num * max(len(x), len(y)):
                        continue
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok[j] = 100 * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])
    return run


def _sketches(column: list) -> np.ndarray:
    """Sketches (bytes of one length) as the rows of a matrix."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _near(ra: list, rb: list) -> np.ndarray:
    """Equal sketch positions of every pair of rows."""
    sa, sb = (_sketches([r["sig"] for r in x]) for x in (ra, rb))
    return np.stack([np.count_nonzero(sb == one, axis=1) for one in sa])


def _close(least: int):
    """Pairs with both sketches -> the pairs that agree in ``least`` positions."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (_sketches(batch.column(c).to_pylist()) for c in ("x", "y"))
            ok = pa.array(np.count_nonzero(x == y, axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])
    return run


def _node_members(least: int):
    """The members of small nodes whose sketch is close to another's."""
    def run(batches):
        for pdf in batches:
            for rows in pdf["rows"]:
                near = _near(rows, rows)
                np.fill_diagonal(near, -1)
                ids = np.array([r["cid"] for r in rows], np.int64)
                yield pd.DataFrame({"cid": ids[(near >= least).any(1)]})
    return run


def _apart(rows, other):
    """Both sides of a meeting (one node, or a part of it with another part) and
    their equal positions, -1 inside a group."""
    two = other is not None and len(other) > 0
    ra, rb = list(rows), (list(other) if two else list(rows))
    ca, cb = (np.array([r["comp"] for r in x], np.int64) for x in (ra, rb))
    near = _near(ra, rb)
    near[ca[:, None] == cb[None, :]] = -1
    return two, ra, rb, near


def _node_asks(least: int, closest: int):
    """Meetings -> ``(node, a, b, near)``: the closest few of every document of the
    first side, and ``b = a`` for those of the second side that are close to any."""
    def run(batches):
        for pdf in batches:
            for node, rows, other in zip(pdf["node"], pdf["rows"], pdf["other"]):
                two, ra, rb, near = _apart(rows, other)
                ia, ib = (np.array([r["cid"] for r in x], np.int64) for x in (ra, rb))
                few = min(closest, len(ib))
                top = np.argpartition(-near, few - 1, axis=1)[:, :few]
                value = np.take_along_axis(near, top, 1)
                i, k = np.nonzero(value >= least)
                j = np.flatnonzero((near >= least).any(0)) if two else np.empty(0, np.int64)
                yield pd.DataFrame({"node": np.int64(node), "a": np.concatenate([ia[i], ib[j]]),
                                    "b": np.concatenate([ib[top[i, k]], ib[j]]),
                                    "near": np.concatenate([value[i, k], near[:, j].max(0)]).astype(np.int64)})
    return run


def _node_pairs(least: int):
    """Meetings -> all pairs of different groups that agree in ``least`` positions,
    asked in the first of the nodes (``own``) that both are in."""
    def run(batches):
        for pdf in batches:
            for node, rows, other in zip(pdf["node"], pdf["rows"], pdf["other"]):
                _, ra, rb, near = _apart(rows, other)
                own = [set(r["own"]) for r in rb]
                found = set()
                for i, j in np.argwhere(near >= least):
                    if next(x for x in ra[i]["own"] if x in own[j]) == node:
                        x, y = ra[i]["cid"], rb[j]["cid"]
                        found.add((min(x, y), max(x, y)))
                yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype=np.int64)
    return run


def _children(rows: DataFrame, similarity: float) -> DataFrame:
    """``(node, cid, comp, sig)`` -> the rows of the child nodes. A node picks 1/s
    positions on average, by a hash of its path."""
    more = int((1 / similarity - 1) * 1000)
    picks = F.when(F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(1000)) < more, 2).otherwise(1)

    def child(j):
        coord = F.pmod(F.xxhash64("node", j), F.lit(COORDS)).cast("int")
        return F.xxhash64("node", j, F.substring("sig", coord + 1, F.lit(1)))

    return rows.select("cid", "comp", F.transform(F.sequence(F.lit(1), picks), child).alias("nodes")) \
        .select("cid", "comp", F.explode("nodes").alias("node")).distinct()


def _roots(classes: DataFrame) -> DataFrame:
    """The children of every tree's root."""
    return classes.select("cid", F.explode("roots").alias("node"))


def _with_size(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of nodes with two documents or more, with the node's size, its head and,
    when groups are known (``comp``), the head's group. The head is the first document
    in one of HEADS orders, which differ by depth, so that a large group is tried
    against several of its documents. Of small nodes with the same documents one is
    kept: a group of copies meets in most trees, and comparing it once is enough."""
    order = F.xxhash64("cid", F.pmod("node", F.lit(HEADS)) + HEADS * depth)
    heads = [F.min_by("cid", order).alias("head")]
    if "comp" in rows.columns:
        heads.append(F.min_by("comp", order).alias("head_comp"))
    n = rows.groupBy("node").agg(F.count("*").alias("n"), *heads, F.bit_xor(F.xxhash64("cid")).alias("x"),
                                 F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("n > 1")
    same = F.when(F.col("n") > SMALL_NODE, F.col("node"))
    kept = F.struct("node", *n.columns[2:2 + len(heads)])
    n = n.withColumn("same", same).groupBy("n", "x", "y", "same").agg(F.min(kept).alias("k")).select("n", "k.*")
    # written out, so that the join below gets an exchange of its own, which Spark can split
    return rows.join(materialise(n, "nd-sizes"), "node")


def _star(nodes: DataFrame, apart: str = "cid <> head") -> DataFrame:
    """The pairs of every node's head with its other documents (``apart``)."""
    return nodes.where(apart).select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).distinct()


def _central_heads(nodes: DataFrame) -> DataFrame:
    """The rows of large nodes, with the most central document as the head: the one
    that most documents share a large node with. The text that a group of
    near copies was made from differs least from all of them."""
    large = nodes.where(f"n > {SMALL_NODE}").drop("head")
    weight = large.groupBy("cid").agg(F.sum("n").alias("weight"))
    heads = large.join(weight, "cid").groupBy("node") \
        .agg(F.max(F.struct("weight", F.xxhash64("cid").alias("tie"), "cid")).alias("top")).select("node", F.col("top.cid").alias("head"))
    return large.join(materialise(heads, "nd-heads"), "node")


def _meetings(nodes: DataFrame, *columns: str) -> DataFrame:
    """``(node, cid, comp, main, rest, all, ...)`` -> ``(node, rows, other)``: who is
    compared with whom. A small node is compared within itself. Of a large one with
    a bounded rest outside its largest group (``main``) the rest meets the whole node
    in blocks. Otherwise every two blocks meet."""
    item = F.struct("cid", "comp", *columns)
    wide = nodes.where(f"all > {SMALL_NODE} and rest > {REST}")
    led = nodes.where(f"all > {SMALL_NODE} and rest <= {REST}")

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        last = F.expr(f"cast(ceil(all / {size}) as bigint)")
        return rows.withColumn("blk", F.pmod(F.xxhash64("cid", F.lit(3)), last)) \
            .groupBy("node", "blk").agg(F.collect_list(item).alias(name), F.first(last).alias("last"))

    small = nodes.where(f"all <= {SMALL_NODE}").groupBy("node").agg(F.collect_list(item).alias("rows"))
    few = led.where("comp <> main").groupBy("node").agg(F.collect_list(item).alias("rows"))
    led = few.join(blocks(led, REST, "other"), "node").select("node", "rows", "other")
    g = blocks(wide, SMALL_NODE, "rows")
    left = g.withColumn("to", F.explode(F.expr("sequence(blk, last - 1)")))
    right = g.select("node", F.col("blk").alias("to"), F.col("rows").alias("other"))
    wide = left.join(right, ["node", "to"]).select("node", "rows", F.when(F.col("blk") != F.col("to"), F.col("other")).alias("other"))
    return small.withColumn("other", F.lit(None).cast(small.schema["rows"].dataType)).union(led).union(wide)


def near_duplicate_groups(classes: DataFrame, docs: DataFrame, similarity: float = 0.75,
                          shingle_words: int = 5) -> DataFrame:
    """``(v, comp)``: classes with a link and the smallest class they reach.

    ``classes(cid, sig, roots, tkey)``: one row per distinct set, with the key of one
    row that has it; ``docs(tkey, text)``. The tables made on the way are deleted."""
    outer = stage_folder(docs.sparkSession)
    with stage_run(docs.sparkSession):
        return materialise(_groups(classes, docs, similarity, shingle_words), "nd-groups", outer)


def _groups(classes: DataFrame, docs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    spark = docs.sparkSession
    folder = stage_folder(spark)
    least = int(np.floor((similarity - SLACK) * COORDS))
    least_fine = int(np.floor((similarity - FINE_SLACK) * FINE_COORDS))
    sig = classes.select("cid", "sig")

    def close(pairs: DataFrame, sig: DataFrame) -> DataFrame:
        p = pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("x")), "a") \
            .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("y")), "b")
        return p.select("a", "b", "x", "y").mapInArrow(_close(least), "a long, b long")

    nodes = materialise(_with_size(_roots(classes), 0), "nd-nodes")
    heads = nodes.where(f"n <= {SMALL_NODE}").unionByName(_central_heads(nodes))
    first = materialise(close(_star(heads), sig), "nd-star")
    lone = nodes.where(f"n between 3 and {SMALL_NODE}").join(sig, "cid") \
        .groupBy("node").agg(F.collect_list(F.struct("cid", "sig")).alias("rows"))
    # every class that any later comparison can ask for
    asked = first.select(F.col("a").alias("cid")).union(first.select("b")) \
        .union(lone.select("rows").mapInPandas(_node_members(least), "cid long")) \
        .union(nodes.where(f"n > {SMALL_NODE}").select("cid")).distinct()
    want = materialise(classes.select("cid", "tkey").join(asked, "cid", "left_semi"), "nd-want")
    texts = materialise(docs.join(broadcast_if(want, FEW_IDS), "tkey").dropDuplicates(["tkey", "cid"]).select("cid", "text"), "nd-texts")

    def only(table: DataFrame, ids: DataFrame) -> DataFrame:
        """The rows of ``ids``; few ids are broadcast, so that only those rows are moved."""
        return table.join(broadcast_if(materialise(ids.distinct(), "nd-ids"), FEW_IDS), "cid", "left_semi")

    def confirm(pairs: DataFrame) -> DataFrame:
        t = only(texts, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")))
        p = pairs.join(t.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b") \
            .join(t.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
        return p.select("a", "b", "ta", "tb").mapInArrow(_linked(similarity, shingle_words), "a long, b long")

    def closest(asks: DataFrame) -> DataFrame:
        best = F.slice(F.sort_array(F.collect_set(F.struct("near", "b")), asc=False), 1, CLOSEST)
        p = asks.where("a <> b").groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))
        return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def in_doubt(rows: DataFrame) -> DataFrame:
        own = rows.groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("own"))
        fine = only(texts, rows.select("cid")).mapInArrow(_fine(shingle_words), "cid long, sig binary")
        full = rows.join(materialise(own.join(fine, "cid"), "nd-fine"), "cid")
        return _meetings(full, "sig", "own").mapInPandas(_node_pairs(least_fine), "a long, b long").distinct()

    tried = first
    comp = connected_components(materialise(confirm(first), "nd-links"))
    nodes = nodes.where("n > 2").select("node", "cid", F.lit(False).alias("asked"))
    depth = 1
    while True:
        with stage_run(spark):
            named = nodes.join(comp.withColumnRenamed("v", "cid"), "cid", "left") \
                .select("node", "cid", "asked", F.coalesce("comp", "cid").alias("comp"))
            named = materialise(named, "nd-named")
            groups = named.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node") \
                .agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
            split = materialise(groups.where("top.c < all").select("node", "all", F.col("top.comp").alias("main"),
                                                                   F.expr("all - top.c").alias("rest")), "nd-split")
            still = materialise(named.join(split, "node"), "nd-open")
            again, once = still.where("asked"), still.where("not asked")
            open_sig = only(sig, once.select("cid"))
            branch = F.lit(depth < MAX_DEPTH) & (F.col("all") > SMALL_NODE) & (F.col("rest") > REST)
            asks = _meetings(once.where(~branch).join(open_sig, "cid"), "sig") \
                .mapInPandas(_node_asks(least, CLOSEST), "node long, a long, b long, near long")
            asks = materialise(asks, "nd-asks")
            pairs = closest(asks)
            left = asks.select("node", F.col("a").alias("cid")).distinct().withColumn("asked", F.lit(True))
            if again.limit(1).count():
                pairs = pairs.union(in_doubt(again))
            large = once.where(branch)
            if large.limit(1).count():
                below = materialise(_with_size(_children(large.join(open_sig, "cid"), similarity), depth), "nd-nodes")
                pairs = pairs.union(close(_star(below, "comp <> head_comp"), open_sig))
                left = left.union(below.where("n > 2").select("node", "cid", F.lit(False)))
            new = materialise(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "nd-pairs", folder)
            found = materialise(confirm(new), "nd-links", folder)
            nodes = materialise(left, "nd-left", folder)
        if found.limit(1).count():
            comp = merge_components(comp, found)
        if nodes.limit(1).count() == 0:
            return comp
        tried = tried.union(new)
        depth += 1


def near_duplicates(docs: DataFrame, similarity: float = 0.75, shingle_words: int = 5,
                    id_col: str = "doc_id", text_col: str = "text", with_class: bool = False) -> DataFrame:
    """One row per input row: ``(doc_id, n_shingles, component_id, kept)`` and, on
    request, ``tkey`` (hash of id and text) and ``class`` (null without a set).

    Words are runs of characters other than space and tab to CR, A-Z
    lower-cased; a set holds the distinct shingles of ``shingle_words`` words, or
    the whole sequence when there are fewer. Texts are linked when their sets'
    Jaccard similarity reaches ``similarity``; ``component_id`` is the smallest
    id reachable and ``kept`` marks that row. Equal sets are one class and cost
    one comparison, however many copies there are. Null, empty and blank texts
    have no set: they are their own component. Rows with a null id follow the
    smallest id of their component (null if there is none); of fully repeated
    ids every row is returned with the same answer."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("tkey"),
                      F.col(text_col).alias("text"))
    made = src.mapInArrow(_sketch(shingle_words),
                          "doc_id long, tkey long, n_shingles long, s1 long, s2 long, sig binary, roots array<bigint>")
    made = materialise(made.withColumn("cid", F.xxhash64("n_shingles", "s1", "s2")), "nd-sketch")
    classes = materialise(made.where("n_shingles > 0").groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.min("tkey").alias("tkey"), F.first("sig").alias("sig"),
        F.first("roots").alias("roots")), "nd-classes")
    comp = near_duplicate_groups(classes, src.select("tkey", "text"), similarity, shingle_words)
    named = classes.select("cid", "rep").join(comp.withColumnRenamed("v", "cid"), "cid", "left") \
        .select("cid", "rep", F.coalesce("comp", "cid").alias("comp"))
    low = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.join(low, "comp").select("cid", "component_id", F.col("comp").alias("class"))
    out = made.select("doc_id", "n_shingles", "tkey", "cid").join(of, "cid", "left")
    cid = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, F.lit(False)).alias("kept"),
                      *(["tkey", "class"] if with_class else []))
