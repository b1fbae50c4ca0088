"""Removal of repeated byte strings by distributed prefix doubling.

Ranking every byte position at every doubled length would shuffle the corpus
many times over, so the suffix array is sparse: of each ``size``-byte string only
one position is ranked, its anchor (the place of the smallest hash of a short
gram inside the string; equal strings have equal anchors). Anchors are ranked by
the gram at their place, then by longer and longer strings around them: Spark
groups position rank pairs (rank so far, next string), positions that became
unique leave, and so do classes whose longest string is shared as a whole. What
is left at ``size`` bytes is repeated. Ranks are 64-bit hashes of the strings, so
growing a rank needs no sort of the text itself.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .shingles import mix64, powers, text_slices

SIZE = 200              # bytes of a repeated string
GRAM = 32               # bytes that an anchor is chosen and first ranked by
STEPS = (32, 8, 1)      # how finely string starts are told apart, round by round
PIECE = 1 << 18         # string starts handled at a time
_rng = np.random.default_rng(200)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)


class _Hashes:
    """Hashes of any substring of one buffer."""

    def __init__(self, raw):
        b = np.frombuffer(raw, np.uint8)
        self.n = len(b)
        p, self.back = powers(self.n + 1)
        self.cum = np.empty(self.n + 1, np.uint64)
        self.cum[0] = 0
        np.cumsum(_BYTE[b] * p[:self.n], out=self.cum[1:])

    def __call__(self, s, e):
        return (self.cum[e] - self.cum[s]) * self.back[s]


def _anchors(raw: bytes, ends: np.ndarray, size: int):
    """Runs of string starts with the same anchor in a buffer of whole texts (or
    of one piece of a long text): (text number, anchor, first start, last start,
    gram rank, rank of the string that covers all of them)."""
    h = _Hashes(raw)
    gram = min(GRAM, size)
    if h.n < size:
        return None
    s = np.arange(h.n - gram + 1)
    g = mix64(h(s, s + gram))
    low = (g & np.uint64(0xFFFFFFFF00000000)) | s.astype(np.uint64)     # hash first, then leftmost
    span, have = size - gram + 1, 1
    while have < span:          # minimum over the grams of a string, by doubling
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)             # of the string that starts here
    inside = np.ones(len(anchor), np.int8)
    for e in ends[:-1]:         # strings may not cross texts
        inside[max(0, e - size + 1):e] = 0
    start = np.flatnonzero(inside)
    if not len(start):
        return None
    a = anchor[start]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = start[np.concatenate([[0], cut])], start[np.concatenate([cut, [len(start)]]) - 1]
    a = anchor[first]
    cover = mix64(h(first, last + size) + ((a - last) * 1024 + (a - first)).astype(np.uint64))
    return np.searchsorted(ends, first, side="right"), a, first, last, g[a], cover


def _scan(size: int, full: bool):
    """Anchors of every text: gram ranks only, or with place and cover."""
    def rows(batch):
        keys = batch.column("row_key")
        for i, texts in text_slices(batch, limit=PIECE):
            ends = np.cumsum([len(t) for t in texts])
            if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
                t = texts[0]
                for a in range(0, len(t), PIECE):
                    part = t[a:a + PIECE + size - 1]
                    yield keys, i, a, _anchors(part, np.array([len(part)]), size), np.zeros(1, np.int64)
            else:
                yield keys, i, 0, _anchors(b"".join(texts), ends, size), np.concatenate([[0], ends[:-1]])

    def run(batches):
        for batch in batches:
            for keys, i, shift, got, begin in rows(batch):
                if got is None:
                    continue
                doc, a, first, last, g, cover = got
                out = {"gram": g.view(np.int64)}
                if full:
                    base = begin[doc]
                    out |= {"row_key": keys.take(pa.array(doc + i)), "anchor": (a - base + shift),
                            "lo": (a - last).astype(np.int16), "hi": (a - first).astype(np.int16), "cover": cover.view(np.int64)}
                yield pa.RecordBatch.from_pydict(out)
    return run


def _contexts(size: int):
    """(row_key, text, units) -> the bytes around every unit's anchor."""
    def run(batches):
        for batch in batches:
            units = batch.column("units").to_pylist()
            for i, texts in text_slices(batch):
                out = {"unit": [], "n": [], "lo": [], "hi": [], "off": [], "ctx": []}
                for t, us in zip(texts, units[i:i + len(texts)]):
                    for u in us:
                        s = max(0, u["anchor"] - size)
                        out["unit"].append(u["unit"])
                        out["n"].append(u["n"])
                        out["lo"].append(u["lo"])
                        out["hi"].append(u["hi"])
                        out["off"].append(u["anchor"] - s)
                        out["ctx"].append(t[s:u["anchor"] + size])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("unit", pa.int64()), ("n", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()),
                    ("off", pa.int16()), ("ctx", pa.binary())]))
    return run


def _ranks(size: int, step: int, coarse: int):
    """Ranks of the next round. For starts ``at … at + step - 1`` bytes before the
    anchor: the string all of them share (``core``) and the one that covers those
    the unit really has (``cover``)."""
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("unit", "at", "core", "cover", "n")}
            cols = [batch.column(c) for c in ("unit", "n", "lo", "hi", "off", "ctx")]
            todo = batch.column("todo") if coarse else None
            u, n, lo, hi, off = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols[:5])
            for i in range(len(u)):
                if coarse:
                    at = np.concatenate([np.arange(t, t + coarse, step) for t in todo[i].as_py()])
                else:
                    at = np.arange(lo[i] // step * step, hi[i] + 1, step)
                at = at[(at + step > lo[i]) & (at <= hi[i])]
                if not len(at):
                    continue
                h = _Hashes(cols[5][i].as_buffer())
                core = h(off[i] - at, off[i] - (at + step - 1) + size)
                a, b = np.maximum(at, lo[i]), np.minimum(at + step - 1, hi[i])
                cover = mix64(h(off[i] - b, off[i] - a + size) + (b * 1024 + a).astype(np.uint64))
                out["unit"].append(np.full(len(at), u[i]))
                out["at"].append(at.astype(np.int16))
                out["core"].append(mix64(core + at.astype(np.uint64)).view(np.int64))
                out["cover"].append(cover.view(np.int64))
                out["n"].append(np.full(len(at), n[i]))
            if out["unit"]:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})
    return run


def _cut(size: int):
    """(row_key, text, starts) -> removed bytes, runs and the digest of the rest."""
    def run(batches):
        for batch in batches:
            ids, spans = batch.column("doc_id"), batch.column("spans").to_pylist()
            for i, texts in text_slices(batch):
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                for t, sp in zip(texts, spans[i:i + len(texts)]):
                    runs, kept, at = [], hashlib.sha256(), 0
                    for s, e in sorted((x["s"], x["e"]) for x in sp or []):
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], e)
                        else:
                            runs.append([s, e])
                    for s, e in runs:
                        kept.update(t[at:s])
                        at = e
                    kept.update(t[at:])
                    out["n_bytes"].append(len(t))
                    out["n_removed"].append(sum(e - s for s, e in runs))
                    out["n_spans"].append(len(runs))
                    out["kept_sha256"].append(kept.hexdigest())
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(texts)), *map(pa.array, out.values())], names=["doc_id", *out])
    return run


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs(row_key, text)``, one row per key -> ``(row_key, s, e)``: byte ranges
    covered by strings of ``size`` bytes that start in more than one place.
    Ranges may touch and overlap."""
    grams = docs.select("row_key", "text").mapInArrow(_scan(size, False), "gram long") \
        .groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    grams = materialise(grams, "sd-grams")      # the join gets an exchange of its own: hot grams can be split
    found = docs.select("row_key", "text").mapInArrow(
        _scan(size, True), "gram long, row_key long, anchor long, lo smallint, hi smallint, cover long")
    # first rank: the gram; unique grams leave
    found = materialise(found.join(grams, "gram", "left_semi"), "sd-anchors")
    place = F.struct("row_key", "anchor", "lo", "hi")
    units = found.groupBy("gram", "cover").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    units = materialise(units.select("gram", "cover", "n", "p.*"), "sd-units")
    # whole cover shared: all its starts are repeated
    whole = found.join(units.where("n > 1").select("gram", "cover"), ["gram", "cover"], "left_semi") \
        .select("row_key", F.expr(f"anchor - hi").alias("s"), F.expr(f"anchor - lo + {size}").alias("e"))
    # several covers around one gram: tell their starts apart
    mixed = units.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    unit = F.xxhash64("gram", "cover").alias("unit")
    todo = units.join(mixed, "gram", "left_semi").select("row_key", F.struct(unit, "n", "anchor", "lo", "hi").alias("u"))
    todo = todo.groupBy("row_key").agg(F.collect_list("u").alias("units"))      # bounded by the text's own length
    ctx = docs.select("row_key", "text").join(todo, "row_key").select("text", "units") \
        .mapInArrow(_contexts(size), "unit long, n long, lo smallint, hi smallint, off smallint, ctx binary")
    ctx = materialise(ctx, "sd-contexts")
    got, left, coarse = [], None, 0
    for step in [x for x in STEPS if x == 1 or 4 * x <= size]:
        src = ctx if left is None else ctx.join(left, "unit")
        ranks = materialise(src.mapInArrow(_ranks(size, step, coarse),
                                           "unit long, at smallint, core long, cover long, n long"), "sd-ranks")
        classes = ranks.groupBy("core").agg(F.sum("n").alias("c"), F.min("cover").alias("a"), F.max("cover").alias("b"))
        one = F.lit(True) if step == 1 else F.col("a") == F.col("b")
        state = classes.where("c > 1").select("core", one.alias("one"))
        named = ranks.join(state, "core")
        named = materialise(named.select("unit", "at", "n", "one"), "sd-state")
        # units that stand for several places are in ``whole`` already
        got.append(named.where("one and n = 1").select("unit", F.col("at").cast("long").alias("at"), F.lit(step).alias("step")))
        left = named.where("not one").groupBy("unit").agg(F.collect_list("at").alias("todo"))
        coarse = step
    part = reduce(DataFrame.union, got).join(
        units.where("n = 1").select(unit, "row_key", "anchor", "lo", "hi"), "unit")
    b = F.least(F.col("at") + F.col("step") - 1, F.col("hi"))
    a = F.greatest("at", "lo")
    part = part.select("row_key", (F.col("anchor") - b).alias("s"), (F.col("anchor") - a + size).alias("e"))
    return whole.union(part)


def suffix_dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``.

    Texts are UTF-8 bytes (null: empty). Every byte covered by a ``size``-byte
    string that starts anywhere else too -- in any text, the same one included,
    overlaps count -- is removed; all strings are judged on the input, and none
    crosses two texts. ``n_spans`` counts maximal removed runs. Texts shorter
    than ``size`` lose nothing. Rows with the same id and text are rows of their
    own, so they repeat each other; null ids are ids."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    F.xxhash64(id_col, text_col).alias("row_key"))
    spans = repeated_spans(d.where(F.octet_length("text") >= size), size)
    per = spans.groupBy("row_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return d.join(per, "row_key", "left").select("doc_id", "text", "spans") \
        .mapInArrow(_cut(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
