"""Embedding whitening by incremental eigendecomposition (operator 12).

Every partition of the distinct vectors keeps the eigendecomposition of its
scatter matrix and updates it with each vector: a centred rank-one change,
solved through the secular equation with deflation. Two partitions' spectra
are combined by one rank-one update per eigenpair of the smaller-numbered one
plus one for the difference of the means, in a tree over the partitions. The
result is the basis of a last Rayleigh-Ritz step: the exact mean is known
then, the covariance is projected on the basis in one distributed pass, and
the small projected matrix turns the basis into eigenvectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

EPS = np.finfo(float).eps
FAN = 16            # partitions' results that one task combines
LIMIT = 2**31       # entries are held to +-LIMIT before the offset


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Matrix ``d[i] - root[j]`` for the roots of 1 + sum(z2 / (d - root)) = 0,
    ``d`` rising and distinct, ``z2`` positive. Root j lies right of d[j]. Every
    root is sought as the distance to its nearest pole, by rational steps that
    keep the two neighbouring poles, inside a bracket that only shrinks."""
    k = len(d)
    gap = np.append(np.diff(d), z2.sum())
    mid = d + gap / 2
    at_mid = 1 + (z2[:, None] / (d[:, None] - mid)).sum(axis=0)
    right = (at_mid < 0) & (np.arange(k) < k - 1)           # the root is nearer to the next pole
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    delta = d[:, None] - origin
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where((at_mid < 0), gap, gap / 2))
    low = np.where(~right & (at_mid < 0), gap / 2, low)      # the last root, beyond its middle
    tau = (low + high) / 2
    below = np.arange(k)[:, None] <= np.arange(k)
    for _ in range(60):
        diff = delta - tau
        t = z2[:, None] / diff
        f = 1 + t.sum(axis=0)
        noise = 4 * EPS * k * (1 + np.abs(t).sum(axis=0))
        if (np.abs(f) <= noise).all():
            break
        low, high = np.where(f < 0, tau, low), np.where(f > 0, tau, high)
        slope = t / diff
        psi, phi = np.where(below, slope, 0).sum(axis=0), np.where(below, 0, slope).sum(axis=0)
        d1 = np.diagonal(diff)
        d2 = np.append(np.diagonal(diff, -1), np.inf)
        with np.errstate(all="ignore"):
            a = (d1 + d2) * f - d1 * d2 * (psi + phi)
            b, c = d1 * d2 * f, f - d1 * psi - d2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = d1[-1] + d1[-1] ** 2 * psi[-1] / (f[-1] - d1[-1] * psi[-1])   # one pole only
            new = tau + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(inside, new, (low + high) / 2)
        new = np.where(np.abs(f) <= noise, tau, new)
        if (new == tau).all():
            break
        tau = new
    return delta - tau


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of ``q diag(d) q' + v v'`` (``d`` rising).

    Deflation: a direction that ``v`` has no part in keeps its pair, and of
    equal eigenvalues a rotation leaves one with all of ``v``'s part. The
    eigenvectors come from the part of ``v`` that the computed roots belong to
    exactly, so they stay orthogonal however close the eigenvalues are.
    """
    z = q.T @ v
    norm = float(z @ z)
    if norm == 0:
        return d, q
    tol = 8 * EPS * max(abs(d[-1]), norm)
    small = np.abs(z) * np.sqrt(norm) <= tol
    active = np.flatnonzero(~small)
    if len(active) > 1 and (np.diff(d[active]) <= tol).any():
        q, z, kept = q.copy(), z.copy(), []
        for j in active:
            if kept and d[j] - d[kept[-1]] <= tol:
                i = kept.pop()
                r = float(np.hypot(z[i], z[j]))
                c, s = z[j] / r, z[i] / r
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                z[i], z[j] = 0.0, r
            kept.append(j)
        active = np.array(kept)
    if not len(active):
        return d, q
    da, za = d[active], z[active]
    diff = secular_roots(da, za * za)                       # d_i - root_j
    k = len(da)
    if k == 1:
        u = np.ones((1, 1))
    else:
        # part i squared: product over j of (root_j - d_i) / (d_j - d_i), the poles paired with the roots around them
        i, j = np.arange(k)[:, None], np.arange(k - 1)
        poles = da[np.where(j < i, j, j + 1)] - da[:, None]
        part = np.sqrt(np.abs(-diff[:, -1] * (-diff[:, :-1] / poles).prod(axis=1)))
        u = np.copysign(part, za)[:, None] / diff
        u /= np.sqrt((u * u).sum(axis=0))
    d, q = d.copy(), q.copy()
    d[active] = da + -np.diagonal(diff)                     # root_j = d_j + (root_j - d_j)
    q[:, active] = q[:, active] @ u
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Vectors seen: their number, sums (exact integers), mean and the
    eigendecomposition of their scatter matrix."""

    def __init__(self, m: int):
        self.n, self.sums, self.mean = 0, np.zeros(m, np.int64), np.zeros(m)
        self.d, self.q = np.zeros(m), np.eye(m)

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one change by its distance from the mean so far."""
        away = x - self.mean
        if self.n:
            self.d, self.q = rank_one(self.d, self.q, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.sums += x
        self.mean = self.mean + away / self.n

    def combine(self, n: int, sums: np.ndarray, d: np.ndarray, q: np.ndarray) -> None:
        """Another spectrum: a rank-one change for each of its eigenpairs, and one
        for the difference of the means."""
        for j in np.flatnonzero(d > 0):
            self.d, self.q = rank_one(self.d, self.q, np.sqrt(d[j]) * q[:, j])
        if self.n and n:
            away = sums / n - self.sums / self.n
            self.d, self.q = rank_one(self.d, self.q, away * np.sqrt(self.n * n / (self.n + n)))
        self.n, self.sums = self.n + n, self.sums + sums
        self.mean = self.sums / max(1, self.n)

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [self.sums], "d": [self.d], "q": [self.q.ravel()]})


SPECTRUM = "part bigint, n bigint, sums array<bigint>, d array<double>, q array<double>"


def matrix(batch: pa.RecordBatch, column: str, m: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def in_tree(parts: DataFrame, combine, schema: str):
    """The one row left after combining groups of FAN rows by ``part``, level by
    level: a task never holds more than FAN rows."""
    left = parts.agg(F.max("part")).first()[0]
    while left:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")) \
            .groupBy("part").applyInPandas(combine, schema)
        left //= FAN
    return parts.first()


def spectrum(fit: DataFrame, m: int) -> Spectrum:
    """Mean and eigendecomposition of all rows' ``x``."""
    def update(batches):
        s = None
        for batch in batches:
            for x in matrix(batch, "x", m):
                s = s or Spectrum(m)
                s.add(x)
        if s:
            yield pa.RecordBatch.from_pandas(s.frame(_partition()), preserve_index=False)

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable", ascending=False)
        s = Spectrum(m)
        first = rows.iloc[0]
        s.n, s.sums = int(first["n"]), np.array(first["sums"], np.int64)
        s.d, s.q = np.array(first["d"], float), np.array(first["q"], float).reshape(m, m)
        for r in rows.iloc[1:].itertuples():
            s.combine(int(r.n), np.array(r.sums, np.int64), np.array(r.d, float), np.array(r.q, float).reshape(m, m))
        return s.frame(int(first["part"]))

    r = in_tree(materialise(fit.mapInArrow(update, SPECTRUM), "spectra"), combine, SPECTRUM)
    s = Spectrum(m)
    s.n, s.sums = r.n, np.array(r.sums, np.int64)
    s.d, s.q = np.array(r.d), np.array(r.q).reshape(m, m)
    return s


def _partition() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def sum_of(fit: DataFrame, size: int, of_rows, m: int) -> np.ndarray:
    """Sum over all rows' ``x`` of what ``of_rows`` gives for a matrix of them, ``size`` doubles."""
    def add(batches):
        total = None
        for batch in batches:
            got = of_rows(matrix(batch, "x", m))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"part": [_partition()], "v": [total]}), preserve_index=False)

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "v": [np.sum(np.stack(rows["v"]), axis=0)]})

    schema = "part bigint, v array<double>"
    return np.array(in_tree(materialise(fit.mapInArrow(add, schema), "sums"), combine, schema).v)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row per kept vector and component: id, component (int, from 1), n
    (distinct vectors), deviation (long), whitened, explained, identity_error.

    Kept are vectors without null or non-finite entries that have the commonest
    length (of equally common ones the longest; an empty vector is not kept).
    Entries become floor(scale * c) + offset, the first term held to +-2^31.
    Repeated vectors count once in the fit and return a row per copy; null ids
    stay; other columns are not read. Directions without variance (rounding
    included) have no component, so fewer than ``components`` rows come from
    few or flat vectors, and none from a single or no vector. A deviation
    beyond a long is null. Of a component's two signs the one whose largest
    entry is positive is taken.
    """
    spark = vectors.sparkSession
    out_schema = (f"`{id_col}` bigint, component int, n bigint, deviation bigint, whitened double, "
                  "explained double, identity_error double")
    c = F.transform(vec_col, lambda e: e.cast("double"))
    whole = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(e * scale))) + offset
    kept = vectors.where(whole & (F.size(vec_col) > 0)) \
        .select(F.col(id_col).cast("long").alias("id"), F.transform(c, held).alias("x"))
    common = kept.groupBy(F.size("x").alias("m")).count().orderBy(F.desc("count"), F.desc("m")).first()
    if common is None:
        return spark.createDataFrame([], out_schema)
    m = common.m
    kept = kept.where(F.size("x") == m)
    fit = materialise(kept.select("x").distinct(), "distinct-vectors")
    s = spectrum(fit, m)
    n, sums = s.n, s.sums

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n           # the numerator is exact

    basis = np.linalg.qr(s.q)[0]

    def projected(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ basis
        return (y.T @ y).ravel()

    ritz = sum_of(fit, m * m, projected, m).reshape(m, m) / n
    e, w = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz))
    top = [j for j in np.argsort(-e, kind="stable")[:components] if e[j] > 16 * m * EPS * max(e.max(), 0)]
    if not top:
        return spark.createDataFrame([], out_schema)
    e, q = e[top], basis @ w[:, top]
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(top))])
    explained, k = e / trace, len(top)
    turn = q / np.sqrt(e)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ turn
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    got = sum_of(fit, k * k + k, moments, m) / n
    error = float(np.abs(got[:k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:]) - np.eye(k)).max())

    def apply(batches):
        for batch in batches:
            x = matrix(batch, "x", m)
            off = n * x - sums
            if not len(x) or np.abs(off).max() < 2**28 and m <= 128:
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = [v if v < 2**63 else None for v in (sum(int(a) ** 2 for a in row) for row in off)]
            y = off / n @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n)),
                 pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                 pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(apply, out_schema)
