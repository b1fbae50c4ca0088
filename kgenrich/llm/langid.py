"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (lower-cased
letters, everything else a blank). Every language has several centroids, found
by spherical k-means on a bounded sample of labelled texts; a text takes the
language of the centroid with the highest cosine, and is rejected when that
cosine lies far below what the centroid's own texts reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

DIM = 1 << 13
CHUNK = 1 << 20         # bytes of text hashed at a time
_LUT = np.full(256, 32, np.uint8)
_LUT[65:91] = np.arange(97, 123)
_LUT[97:123] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)


def _counts(texts: list[bytes]) -> np.ndarray:
    """n-gram counts (rows x DIM) of a few texts: grams of 2 and 3 bytes that
    start and end inside a text and hold more than blanks. Long texts are
    counted piece by piece, so memory follows CHUNK."""
    out = np.zeros((len(texts), DIM), np.int64)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        part = texts[start:end]
        if size > CHUNK:                    # one long text, pieces overlap by a gram
            pieces = [(part[0][i:i + CHUNK + 2], 2 if i else 0) for i in range(0, size, CHUNK)]
        else:
            pieces = [(b"".join(part), 0)]
        for raw, lead in pieces:
            b = _LUT[np.frombuffer(raw, np.uint8)].astype(np.uint32)
            if len(b) < 2:
                continue
            who = np.repeat(np.arange(start, end, dtype=np.uint32), [len(t) for t in part]) \
                if size <= CHUNK else np.full(len(b), start, np.uint32)
            two = (b[:-1] << 8) | b[1:]
            for gram, w in ((two, 2), ((two[:-1] << 8) | b[2:], 3)):
                n = len(gram)
                blank = 0x2020 if w == 2 else 0x202020
                ok = (who[:n] == who[w - 1:]) & (gram != blank)
                if size > CHUNK:
                    ok[CHUNK:] = False      # grams that start in the next piece
                h = ((gram + np.uint32(w << 26)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
                key = (who[:n] - np.uint32(start)).astype(np.int64) * DIM + h
                out[start:end] += np.bincount(key[ok], minlength=(end - start) * DIM).reshape(-1, DIM)
        start = end
    return out


def _groups(batch: pa.RecordBatch, rows: int = 64):
    text = batch.column(batch.schema.get_field_index("__text")).cast(pa.large_binary())
    for i in range(0, batch.num_rows, rows):
        yield i, [x or b"" for x in text.slice(i, rows).to_pylist()]


def _document_frequency(batches):
    df = np.zeros(DIM, np.int64)
    n = 0
    for batch in batches:
        for _, texts in _groups(batch):
            df += (_counts(texts) > 0).sum(0)
            n += len(texts)
    if n:
        yield pa.RecordBatch.from_pydict({"gram": np.arange(-1, DIM, dtype=np.int32), "n": np.concatenate([[n], df])})


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _vectors(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            for i, texts in _groups(batch):
                part = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "pick": part.column("pick"),
                                                  "x": [v.tobytes() for v in _unit(_counts(texts), idf)]})
    return run


def _fit_language(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pick")
        x = np.stack([np.frombuffer(v) for v in pdf["x"]])
        centres = [x[0]]
        for _ in range(1, min(k, len(x))):      # farthest first
            centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
        c = np.array(centres)
        for _ in range(15):
            near = np.argmax(x @ c.T, axis=1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        best = (x @ c.T).max(1)
        near = np.argmax(x @ c.T, axis=1)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": list(c),
                             "usual": [float(np.median(best[near == j])) if (near == j).any() else 0.0
                                       for j in range(len(c))]})
    return run


class Model:
    """``langs[i]`` belongs to centroid row ``i``; ``idf`` weighs grams."""

    def __init__(self, langs, centres, usual, idf):
        self.langs, self.centres, self.usual, self.idf = langs, centres, usual, idf


def fit(labelled: DataFrame, sample: int = 400, centroids: int = 4, text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """Learn from all rows of ``labelled`` with a text and a language: gram
    document frequencies over every row; centroids from at most ``sample``
    distinct texts per language, chosen by a hash of the text, whatever their
    length (a task holds vectors, not texts). None when there is nothing to learn.

    Languages with fewer texts get fewer centroids. The model holds
    ``centroids`` x languages vectors of DIM numbers: its size does not depend
    on the number of documents."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    df = rows.select(F.col("text").alias("__text")).mapInArrow(_document_frequency, "gram int, n long") \
        .groupBy("gram").agg(F.sum("n").alias("n")).collect()          # DIM + 1 sums
    if not df:
        return None
    n = {r["gram"]: r["n"] for r in df}
    idf = np.log((1 + n[-1]) / (1 + np.array([n.get(i, 0) for i in range(DIM)]))) + 0.05
    # A hash threshold per language keeps about twice the sample before the exact cut.
    # Copies pass it together, so it follows the number of distinct texts.
    rows = rows.withColumn("pick", F.xxhash64("text", F.lit(7)))
    once = rows.select("lang", "pick").distinct()
    counts = {r["lang"]: r["count"] for r in once.groupBy("lang").count().collect()}     # one row per language
    limit = F.coalesce(*[F.when(F.col("lang") == g, F.lit(int(min(1.0, (2 * sample + 50) / c) * (2 ** 53)))) for g, c in counts.items()])
    w = Window.partitionBy("lang").orderBy("pick")
    near = once.where(F.shiftrightunsigned("pick", 11) <= limit) \
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).drop("r")
    picked = rows.join(F.broadcast(near), ["lang", "pick"]).dropDuplicates(["lang", "pick"])    # sample x languages keys
    vectors = picked.select("lang", "pick", F.col("text").alias("__text")) \
        .mapInArrow(_vectors(idf), "lang string, pick long, x binary")
    got = vectors.groupBy("lang").applyInPandas(_fit_language(centroids),
                                                "lang string, centre array<double>, usual double").collect()
    got.sort(key=lambda r: (r["lang"], -r["usual"]))
    return Model([r["lang"] for r in got], np.array([r["centre"] for r in got]),
                 np.array([r["usual"] for r in got]), idf)


def _predict(model: Model, reject: float):
    c = model.centres.T.copy()

    def run(batches):
        for batch in batches:
            best, score = [], []
            for _, texts in _groups(batch):
                sim = _unit(_counts(texts), model.idf) @ c
                best.append(sim.argmax(1))
                score.append(np.clip(sim.max(1), 0, 1))
            if not best:
                continue
            best, score = np.concatenate(best), np.concatenate(score)
            letters = batch.column("__letters").to_numpy(zero_copy_only=False).astype(bool)
            und = ~letters
            lang = [("und" if u else model.langs[b]) for u, b in zip(und, best)]
            score = np.where(und, 0.0, score)
            rejected = und | (score < reject * model.usual[best])
            keep = [i for i, f in enumerate(batch.schema) if f.name not in ("__text", "__letters")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                names=[batch.schema[i].name for i in keep] + ["lang_pred", "score", "rejected"])
    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], reject: float = 0.1,
            text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score`` (cosine, 0 to 1) and
    ``rejected``. ``und`` with score 0, rejected, when the text is null, empty or
    holds no letter (also when there is no model). A text is rejected as well
    when its cosine is under ``reject`` times the median cosine of the texts its
    centroid was made from. Each row is judged by itself, whatever its length;
    repeated rows get equal answers."""
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    src = docs.select(*keep, F.col(text_col).alias("__text"), letters.alias("__letters"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name[:2] != "__")
    return src.mapInArrow(_predict(model, reject),
                          f"{types}, lang_pred string, score double, rejected boolean")
