"""Exact integer k-means over subvector dictionaries (operator 11).

Every component becomes floor(scale * x). A vector is cut into blocks of
``block`` components, and a chunk of vectors (one Arrow batch, at most
``CHUNK``) is stored losslessly as one dictionary of distinct subvectors a
block plus a code per vector and block. The chunks are written once. A round
reads them, computes the exact squared distance of every dictionary entry to
every centroid's block once, adds the distances up by code, takes the
nearest centroid, and sums the subvectors of a cluster by counting codes. A
dictionary belongs to a chunk, so a round shuffles nothing but
``k * (dims + 2)`` sums a task, and copies of a vector, however many, are
spread like any other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

CHUNK = 10_000      # vectors in one chunk at most
LIMIT = 2**27       # components are held to +-LIMIT, so that a distance of 128 dimensions fits a long
COUNT, INERTIA = -1, -2


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` (long) and ``q`` (integers) of the vectors with exactly ``dims``
    components, none null or non-finite."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale))).cast("int")
    return vectors.where((F.size(vec_col) == dims) & whole) \
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, held).alias("q"))


def encode(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """One row per chunk: ``ids``, and per block the flat dictionary of distinct
    subvectors and the code of every vector."""
    cuts = range(0, dims, block)

    def chunks(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                part = whole.slice(at, CHUNK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                words, codes = [], []
                for b in cuts:
                    d, code = np.unique(x[:, b:b + block], axis=0, return_inverse=True)
                    words.append(d.ravel().astype(np.int32))
                    codes.append(code.ravel().astype(np.int32))
                nested = pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([words], nested), pa.array([codes], nested)], names=["ids", "words", "codes"])

    return vectors.mapInArrow(chunks, "ids array<bigint>, words array<array<int>>, codes array<array<int>>")


def decoded(batches):
    """(ids, dictionaries, codes) of every chunk of an encoded table."""
    for batch in batches:
        ids, words, codes = batch.columns
        for r in range(batch.num_rows):
            yield ids[r].values, [np.asarray(w.values) for w in words[r]], [np.asarray(c.values) for c in codes[r]]


def nearest(words, codes, centroids: np.ndarray, block: int):
    """Cluster and squared distance of a chunk's vectors: exact distances of the
    dictionary entries, summed by code. Ties go to the smaller number."""
    total = np.zeros((len(codes[0]), len(centroids)), np.int64)
    for b, (word, code) in enumerate(zip(words, codes)):
        c = centroids[:, b * block:(b + 1) * block]
        d = word.reshape(-1, c.shape[1]).astype(np.int64)
        partial = np.empty((len(d), len(c)), np.int64)
        for j in range(len(c)):
            partial[:, j] = ((d - c[j]) ** 2).sum(axis=1)
        total += partial[code]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def cluster_sums(encoded: DataFrame, centroids: np.ndarray, block: int) -> dict[tuple[int, int], int]:
    """Exact sums of a round, {(cluster, component): sum}; component COUNT holds
    the number of vectors, INERTIA the sum of distances. A task sends
    ``k * (dims + 2)`` rows, Spark adds them up, and as many reach the driver."""
    k, dims = centroids.shape

    def sums(batches):
        out = np.zeros((k, dims + 2), np.int64)
        for _, words, codes in decoded(batches):
            best, dist = nearest(words, codes, centroids, block)
            for b, (word, code) in enumerate(zip(words, codes)):
                w = min(block, dims - b * block)
                d = word.reshape(-1, w).astype(np.int64)
                n = np.bincount(best * len(d) + code, minlength=k * len(d)).reshape(k, len(d))
                out[:, b * block:b * block + w] += n @ d
            out[:, dims] += np.bincount(best, minlength=k)
            for j in range(k):
                out[j, dims + 1] += dist[best == j].sum()
        at = np.array([*range(dims), COUNT, INERTIA])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims + 2), pa.int32()),
                                          pa.array(np.tile(at, k), pa.int32()), pa.array(out.ravel())],
                                         names=["cluster", "at", "s"])

    rows = encoded.mapInArrow(sums, "cluster int, at int, s bigint") \
        .groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return {(r.cluster, r.at): int(r.s) for r in rows}


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64,
                      k: int = 8, rounds: int = 10, scale: int = 1024, block: int = 8, seed: str = "3:") -> DataFrame:
    """Cluster of every kept vector: id, cluster (int), distance (long, squared),
    cluster_inertia, inertia (long), centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite
    component give no row; of other columns only the two named are read. Every
    row is a vector: repeated rows and ids count and return as often as they
    stand. The first centroids are the ``k`` vectors with the smallest
    sha256(seed || id), a null id as the empty string, equal hashes by
    components; fewer than ``k`` vectors give as many clusters, none an empty
    result. Equal distances go to the smaller cluster number, a cluster without
    vectors keeps its centroid. Components are held to +-2^27 after scaling;
    an inertia beyond a long is null.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, id_col, vec_col, dims, scale)
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    schema = f"`{id_col}` bigint, cluster int, distance bigint"
    if not first:
        return spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    encoded = materialise(encode(kept, dims, block), "vector-chunks")
    centroids = np.array([r.q for r in first], np.int64)
    for _ in range(rounds):
        s = cluster_sums(encoded, centroids, block)
        centroids = np.array([[s[j, i] // s[j, COUNT] for i in range(dims)] if s[j, COUNT] else row
                              for j, row in enumerate(centroids.tolist())], np.int64)
    s = cluster_sums(encoded, centroids, block)

    def assign(batches):
        for ids, words, codes in decoded(batches):
            best, dist = nearest(words, codes, centroids, block)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(dist)],
                                             names=[id_col, "cluster", "distance"])

    fits = lambda n: n if n < 2**63 else None
    inertia = [s[j, INERTIA] for j in range(len(centroids))]
    model = spark.createDataFrame(
        [(j, fits(inertia[j]), ",".join(map(str, c))) for j, c in enumerate(centroids.tolist())],
        "c int, cluster_inertia bigint, c_text string")     # k rows
    return encoded.mapInArrow(assign, schema).join(F.broadcast(model), F.col("cluster") == F.col("c")) \
        .select(f"`{id_col}`", "cluster", "distance", "cluster_inertia",
                F.lit(fits(sum(inertia))).cast("long").alias("inertia"), F.sha2("c_text", 256).alias("centroid_sha256"))
