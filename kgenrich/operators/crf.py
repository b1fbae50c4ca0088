"""Linear-chain CRF (2 labels) trained and applied on Spark.

Features are hashed into ``2**18`` buckets (``pmod(xxhash64(f), 2**18)``),
so the model is a dense ``(2**18, 2)`` state-weight matrix plus a 2x2
transition matrix (4 MB). Training is L-BFGS on the driver over a
distributed objective: every evaluation broadcasts the weights and a
``mapInArrow`` pass runs batched log-space forward-backward per partition;
the partitions' sparse gradients (one row a feature present) are summed by a
``groupBy`` on the feature, so the driver gets one vector whatever the number
of partitions. The hashed training sentences are checkpointed (lineage cut in
the shared ``spark.checkpoint.dir``) so a lost executor recomputes nothing
upstream. Tagging (I6) is a ``mapInPandas`` Viterbi + marginals pass with
broadcast weights, in batches of sentences of about one length.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import CRF_ITERATIONS
from ..session import checkpoint_dir
from .extract import token_labels, with_window_features

N_BITS = 18
N_FEATURES = 1 << N_BITS
N_LABELS = 2


def hash_features(feats: Column, n_features: int = N_FEATURES) -> Column:
    """``array<array<string>>`` -> ``array<array<int>>`` hashed ids."""
    return F.transform(feats, lambda fs: F.transform(
        fs, lambda f: F.pmod(F.xxhash64(f), F.lit(n_features)).cast("int")))


def prepare(sentences: DataFrame, with_labels: bool, n_features: int = N_FEATURES,
            use_parse: bool = False) -> DataFrame:
    """Adds ``fids`` (and ``labels`` from ``values`` when training)."""
    df = with_window_features(sentences, "words", "__feats", use_parse=use_parse)
    df = df.withColumn("__h", hash_features(F.col("__feats"), n_features)).drop("__feats")
    # flattened ids plus per-token counts: one Arrow nesting level, so the
    # numpy side batches sentences without per-token Python work
    df = df.withColumn("fids", F.flatten("__h")) \
        .withColumn("flens", F.transform("__h", F.size)).drop("__h")
    if with_labels:
        df = df.withColumn("labels", token_labels(F.col("words"), F.col("values")))
    return df


# --- numpy kernels (run inside executors) -------------------------------------

def _lse(a, axis):
    m = np.max(a, axis=axis, keepdims=True)
    return np.squeeze(m, axis=axis) + np.log(np.sum(np.exp(a - m), axis=axis))


def _batch(fids_col, flens_col):
    """Flat ids per sentence + per-token counts -> flat ids, flat token index
    into (B*L), mask, lengths -- vectorised over the batch."""
    B = len(flens_col)
    lens = np.fromiter((len(x) for x in flens_col), dtype=np.int64, count=B)
    L = int(lens.max()) if B else 0
    if B == 0 or L == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((B, L), bool), lens, B, L
    counts = np.concatenate([np.asarray(x, dtype=np.int64) for x in flens_col])
    ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in fids_col])
    sent = np.repeat(np.arange(B, dtype=np.int64), lens)
    first = np.repeat(np.cumsum(lens) - lens, lens)
    t_in_sent = np.arange(len(sent), dtype=np.int64) - first
    tok = np.repeat(sent * L + t_in_sent, counts)
    mask = np.arange(L)[None, :] < lens[:, None]
    return ids, tok, mask, lens, B, L


def _emissions(W, ids, tok, B, L):
    E = np.zeros((B * L, N_LABELS))
    for y in range(N_LABELS):
        E[:, y] = np.bincount(tok, weights=W[ids, y], minlength=B * L)
    return E.reshape(B, L, N_LABELS)


def _forward_backward(E, T, mask):
    B, L, K = E.shape
    alpha = np.zeros_like(E)
    beta = np.zeros_like(E)
    alpha[:, 0] = E[:, 0]
    for t in range(1, L):
        nxt = _lse(alpha[:, t - 1, :, None] + T[None], axis=1) + E[:, t]
        alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
    for t in range(L - 2, -1, -1):
        nxt = _lse(T[None] + (E[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(mask[:, t + 1, None], nxt, 0.0)
    logz = _lse(alpha[:, L - 1], axis=1)
    gamma = np.exp(alpha + beta - logz[:, None, None]) * mask[:, :, None]
    return alpha, beta, logz, gamma


def _loss_grad_batch(W, T, fids_col, flens_col, labels_col, n_feat):
    ids, tok, mask, lens, B, L = _batch(fids_col, flens_col)
    if B == 0 or L == 0:
        return 0.0, np.zeros((n_feat, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    Y = np.zeros((B, L), dtype=np.int64)
    for b, lab in enumerate(labels_col):
        Y[b, :len(lab)] = np.asarray(lab, dtype=np.int64)
    return _loss_grad_core(W, T, ids, tok, mask, lens, B, L, Y, n_feat)


def _loss_grad_core(W, T, ids, tok, mask, lens, B, L, Y, n_feat):
    E = _emissions(W, ids, tok, B, L)
    alpha, beta, logz, gamma = _forward_backward(E, T, mask)
    gold = np.take_along_axis(E, Y[:, :, None], axis=2)[:, :, 0]
    gold = (gold * mask).sum(axis=1)
    pair_mask = mask[:, 1:]
    gold += (T[Y[:, :-1], Y[:, 1:]] * pair_mask).sum(axis=1)
    loss = float((logz - gold).sum())
    onehot = np.eye(N_LABELS)[Y] * mask[:, :, None]
    D = (gamma - onehot).reshape(B * L, N_LABELS)
    gW = np.zeros((n_feat, N_LABELS))
    for y in range(N_LABELS):
        gW[:, y] = np.bincount(ids, weights=D[tok, y], minlength=n_feat)
    # transitions: expected minus observed pair counts
    if L > 1:
        xi = np.exp(alpha[:, :-1, :, None] + T[None, None] + (E[:, 1:] + beta[:, 1:])[:, :, None, :]
                    - logz[:, None, None, None]) * pair_mask[:, :, None, None]
        exp_pairs = xi.sum(axis=(0, 1))
        obs = np.zeros((N_LABELS, N_LABELS))
        np.add.at(obs, (Y[:, :-1][pair_mask], Y[:, 1:][pair_mask]), 1.0)
        gT = exp_pairs - obs
    else:
        gT = np.zeros((N_LABELS, N_LABELS))
    return loss, gW, gT


def _arrow_batch(rb, pc):
    """Arrow record batch (``fids``, ``flens``, ``labels`` list columns) ->
    the same arrays as ``_batch``, zero-copy for the flat id buffers."""
    fids, flens = rb.column("fids"), rb.column("flens")
    B = rb.num_rows
    lens = pc.list_value_length(flens).to_numpy(zero_copy_only=False).astype(np.int64)
    L = int(lens.max()) if B else 0
    if B == 0 or L == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((B, L), bool), lens, B, L
    counts = flens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = fids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sent = np.repeat(np.arange(B, dtype=np.int64), lens)
    first = np.repeat(np.cumsum(lens) - lens, lens)
    tok = np.repeat(sent * L + (np.arange(len(sent), dtype=np.int64) - first), counts)
    mask = np.arange(L)[None, :] < lens[:, None]
    return ids, tok, mask, lens, B, L


def _loss_grad_arrow(W, T, rb, n_feat, pc):
    ids, tok, mask, lens, B, L = _arrow_batch(rb, pc)
    if B == 0 or L == 0:
        return 0.0, np.zeros((n_feat, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    flat_labels = rb.column("labels").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    Y = np.zeros((B, L), dtype=np.int64)
    Y[mask] = flat_labels
    return _loss_grad_core(W, T, ids, tok, mask, lens, B, L, Y, n_feat)


def _viterbi_batch(W, T, fids_col, flens_col):
    ids, tok, mask, lens, B, L = _batch(fids_col, flens_col)
    if B == 0 or L == 0:
        return [[] for _ in range(B)], [[] for _ in range(B)]
    E = _emissions(W, ids, tok, B, L)
    _, _, _, gamma = _forward_backward(E, T, mask)
    delta = E[:, 0].copy()
    back = np.zeros((B, L, N_LABELS), dtype=np.int64)
    for t in range(1, L):
        cand = delta[:, :, None] + T[None]
        best = cand.argmax(axis=1)
        nd = cand.max(axis=1) + E[:, t]
        delta = np.where(mask[:, t, None], nd, delta)
        back[:, t] = np.where(mask[:, t, None], best, np.arange(N_LABELS)[None, :])
    # beyond a sentence's end ``back`` keeps the label, so all sentences go back together
    y = np.zeros((B, L), dtype=np.int64)
    y[:, L - 1] = delta.argmax(axis=1)
    for t in range(L - 1, 0, -1):
        y[:, t - 1] = back[np.arange(B), t, y[:, t]]
    p = np.take_along_axis(gamma, y[:, :, None], axis=2)[:, :, 0]
    ends = np.cumsum(lens)[:-1]
    return ([r.tolist() for r in np.split(y[mask], ends)], [r.tolist() for r in np.split(p[mask], ends)])


# --- model ----------------------------------------------------------------------

@dataclass
class CRFModel:
    W: np.ndarray          # (n_features, 2) state weights
    T: np.ndarray          # (2, 2) transitions
    n_features: int = N_FEATURES

    def save(self, spark, path: str):
        nz = np.nonzero(self.W)
        pdf = pd.DataFrame({"attr_id": nz[0].astype("int32"), "label": nz[1].astype("int32"),
                            "w": self.W[nz]})
        spark.createDataFrame(pdf).write.mode("overwrite").parquet(os.path.join(path, "weights"))
        tr = [(int(i), int(j), float(self.T[i, j])) for i in range(2) for j in range(2)]
        spark.createDataFrame(tr, "src int, dst int, w double").write.mode("overwrite") \
            .parquet(os.path.join(path, "transitions"))

    @staticmethod
    def load(spark, path: str, n_features: int = N_FEATURES) -> "CRFModel":
        W = np.zeros((n_features, N_LABELS))
        w = spark.read.parquet(os.path.join(path, "weights")).toPandas()
        W[w.attr_id.values, w.label.values] = w.w.values
        T = np.zeros((N_LABELS, N_LABELS))
        for r in spark.read.parquet(os.path.join(path, "transitions")).collect():
            T[r.src, r.dst] = r.w
        return CRFModel(W, T, n_features)


def _objective(data: DataFrame, n_feat: int, l2: float, batch: int):
    spark = data.sparkSession
    sc = spark.sparkContext
    size = n_feat * N_LABELS

    def fg(x):
        bc = sc.broadcast(x)

        def part(it):
            import pyarrow as pa
            import pyarrow.compute as pc
            v = bc.value
            W = v[:size].reshape(n_feat, N_LABELS)
            T = v[size:size + 4].reshape(N_LABELS, N_LABELS)
            loss, gW, gT = 0.0, np.zeros((n_feat, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
            for rb in it:
                for s in range(0, rb.num_rows, batch):
                    chunk = rb.slice(s, batch)
                    l_, w_, t_ = _loss_grad_arrow(W, T, chunk, n_feat, pc)
                    loss += l_
                    gW += w_
                    gT += t_
            g = np.concatenate([gW.ravel(), gT.ravel(), [loss]])
            # sparse: only the features present in this partition are nonzero
            idx = np.flatnonzero(g).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(g[idx])], names=["i", "v"])

        total = data.mapInArrow(part, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        bc.unpersist()
        vec = np.zeros(size + 5)
        vec[total.column("i").to_numpy()] = total.column("v").to_numpy()
        g = vec[:size + 4] + l2 * x
        f = vec[size + 4] + 0.5 * l2 * float(x @ x)
        return f, g

    return fg


def lbfgs(fg, x0: np.ndarray, m: int = 6, max_iter: int = 100, tol: float = 1e-5):
    """Limited-memory BFGS with Armijo backtracking (driver side, numpy)."""
    steps = lbfgs_steps(x0, m, max_iter, tol)
    x = next(steps)
    while True:
        try:
            x = steps.send(fg(x))
        except StopIteration as end:
            return end.value


def lbfgs_steps(x0: np.ndarray, m: int = 6, max_iter: int = 100, tol: float = 1e-5):
    """The solver as a generator: it yields points and is sent ``(loss, gradient)``
    there, so that many solvers can share one pass over the data."""
    x = x0.copy()
    f, g = yield x
    S, Y = [], []
    for _ in range(max_iter):
        q = g.copy()
        hist = []
        for s, y in reversed(list(zip(S, Y))):
            rho = 1.0 / float(y @ s)
            a = rho * float(s @ q)
            q -= a * y
            hist.append((rho, a))
        gamma = float(S[-1] @ Y[-1]) / float(Y[-1] @ Y[-1]) if S else 1.0 / max(np.linalg.norm(g), 1.0)
        r = gamma * q
        for (s, y), (rho, a) in zip(zip(S, Y), reversed(hist)):
            b = rho * float(y @ r)
            r += s * (a - b)
        d = -r
        gd = float(g @ d)
        if gd >= 0:
            d, gd, S, Y = -g, -float(g @ g), [], []
        step = 1.0
        while True:
            xn = x + step * d
            fn, gn = yield xn
            if fn <= f + 1e-4 * step * gd or step < 1e-8:
                break
            step *= 0.5
        s, y = xn - x, gn - g
        if float(s @ y) > 1e-10:
            S.append(s)
            Y.append(y)
            if len(S) > m:
                S.pop(0)
                Y.pop(0)
        rel = abs(f - fn) / max(abs(f), abs(fn), 1.0)
        x, f, g = xn, fn, gn
        if rel < tol:
            break
    return x


def train(positives: DataFrame, l2: float = 1.0, max_iter: int = CRF_ITERATIONS, tol: float = 1e-5,
          n_features: int = N_FEATURES, batch: int = 1024, use_parse: bool = False,
          rows_per_partition: int = 1250) -> CRFModel:
    """I4: fit on ``(words, values)`` training sentences."""
    spark = positives.sparkSession
    checkpoint_dir(spark)
    # training sentences are bounded by the training cap: partitions follow size
    n = positives.count()
    data = prepare(positives.select("words", "values"), True, n_features, use_parse) \
        .select("fids", "flens", "labels").repartition(max(1, n // rows_per_partition + 1)) \
        .checkpoint(eager=True)
    fg = _objective(data, n_features, l2, batch)
    x = lbfgs(fg, np.zeros(n_features * N_LABELS + 4), max_iter=max_iter, tol=tol)
    W = x[:n_features * N_LABELS].reshape(n_features, N_LABELS)
    T = x[n_features * N_LABELS:].reshape(N_LABELS, N_LABELS)
    return CRFModel(W, T, n_features)


def _objective_many(data: DataFrame, n_feat: int, l2: float, batch: int):
    """Like ``_objective`` for several models at once: ``data`` has ``models``, the
    numbers of the models that a sentence trains. One job gives the loss and
    gradient of every model asked for; rows are keyed by (model, feature)."""
    sc = data.sparkSession.sparkContext
    size = n_feat * N_LABELS

    def fg(points: dict[int, np.ndarray]):
        bc = sc.broadcast(points)

        def part(it):
            import pyarrow as pa
            import pyarrow.compute as pc
            sums = {m: np.zeros(size + 5) for m in bc.value}
            for rb in it:
                for at in range(0, rb.num_rows, batch):
                    chunk = rb.slice(at, batch)
                    row = np.repeat(np.arange(chunk.num_rows), pc.list_value_length(chunk.column("models")).to_numpy(zero_copy_only=False))
                    of = chunk.column("models").flatten().to_numpy(zero_copy_only=False)
                    for m, v in bc.value.items():
                        mine = chunk.take(pa.array(row[of == m]))
                        if mine.num_rows:
                            W, T = v[:size].reshape(n_feat, N_LABELS), v[size:size + 4].reshape(N_LABELS, N_LABELS)
                            loss, gW, gT = _loss_grad_arrow(W, T, mine, n_feat, pc)
                            sums[m] += np.concatenate([gW.ravel(), gT.ravel(), [loss]])
            for m, g in sums.items():
                idx = np.flatnonzero(g).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), m, np.int32)), pa.array(idx), pa.array(g[idx])],
                                                 names=["model", "i", "v"])

        total = data.mapInArrow(part, "model int, i bigint, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).toArrow()
        bc.unpersist()
        model, at, value = (total.column(c).to_numpy() for c in ("model", "i", "v"))
        out = {}
        for m, x in points.items():
            vec = np.zeros(size + 5)
            vec[at[model == m]] = value[model == m]
            out[m] = vec[size + 4] + 0.5 * l2 * float(x @ x), vec[:size + 4] + l2 * x
        return out

    return fg


def train_many(samples: DataFrame, l2: float = 1.0, max_iter: int = CRF_ITERATIONS, tol: float = 1e-5,
               n_features: int = N_FEATURES, batch: int = 1024, rows_per_partition: int = 1250) -> dict[int, CRFModel]:
    """A model for every number in ``models`` of ``(words, values, models
    array<int>)``, all solvers stepping together: a job an iteration whatever the
    number of models. Features are numbered anew among those present, so the
    weights sent along are the models' own, bounded by the samples."""
    spark = samples.sparkSession
    checkpoint_dir(spark)
    n = samples.count()
    data = prepare(samples.select("words", "values", "models"), True, n_features) \
        .select("fids", "flens", "labels", "models").repartition(max(1, n // rows_per_partition + 1)).checkpoint()
    present = np.array(sorted(r[0] for r in data.select(F.explode("fids")).distinct().collect()), np.int64)
    numbers = [r[0] for r in data.select(F.explode("models")).distinct().collect()]

    def renumber(it):
        import pyarrow as pa
        for rb in it:
            old = rb.column("fids")
            new = pa.ListArray.from_arrays(old.offsets, pa.array(np.searchsorted(present, old.values.to_numpy()).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([new, *rb.columns[1:]], names=rb.schema.names)

    compact = data.mapInArrow(renumber, data.schema).checkpoint()
    fg = _objective_many(compact, len(present), l2, batch)
    solvers = {m: lbfgs_steps(np.zeros(len(present) * N_LABELS + 4), max_iter=max_iter, tol=tol) for m in numbers}
    points, models = {m: next(s) for m, s in solvers.items()}, {}
    while points:
        told, going = fg(points), {}
        for m in points:
            try:
                going[m] = solvers[m].send(told[m])
            except StopIteration as end:
                W = np.zeros((n_features, N_LABELS))
                W[present] = end.value[:-4].reshape(-1, N_LABELS)
                models[m] = CRFModel(W, end.value[-4:].reshape(N_LABELS, N_LABELS), n_features)
        points = going
    return models


def tag(model: CRFModel, sentences: DataFrame, batch: int = 1024, use_parse: bool = False) -> DataFrame:
    """Adds ``tags array<int>`` (Viterbi) and ``probs array<double>``
    (marginal probability of each chosen label)."""
    spark = sentences.sparkSession
    bc = spark.sparkContext.broadcast((model.W, model.T))
    df = prepare(sentences, False, model.n_features, use_parse)
    schema = df.drop("fids", "flens").schema.add("tags", T.ArrayType(T.IntegerType())) \
        .add("probs", T.ArrayType(T.DoubleType()))
    cols = [c for c in df.columns if c not in ("fids", "flens")]

    def part(it):
        W, T = bc.value
        for pdf in it:
            pdf = pdf.iloc[np.argsort([len(x) for x in pdf.flens], kind="stable")]      # little padding
            for s in range(0, len(pdf), batch):
                chunk = pdf.iloc[s:s + batch]
                tags, probs = _viterbi_batch(W, T, list(chunk.fids), list(chunk.flens))
                out = chunk[cols].copy()
                out["tags"] = tags
                out["probs"] = probs
                yield out

    return df.mapInPandas(part, schema)


def most_informative(model: CRFModel, training: DataFrame, n: int = 100,
                     use_parse: bool = False) -> DataFrame:
    """Top ``n`` attributes for label 1 by weight (names recovered by
    hashing the training attributes again)."""
    spark = training.sparkSession
    feats = with_window_features(training.select("words"), use_parse=use_parse) \
        .select(F.explode_outer(F.flatten("feats")).alias("attr")).where(F.col("attr").isNotNull()).distinct()
    feats = feats.withColumn("attr_id", F.pmod(F.xxhash64("attr"), F.lit(model.n_features)).cast("int"))
    nz = np.nonzero(model.W[:, 1])[0]
    w = spark.createDataFrame(pd.DataFrame({"attr_id": nz.astype("int32"), "w": model.W[nz, 1]}))
    return feats.join(w, "attr_id").orderBy(F.desc("w"), "attr").limit(n).select("attr", "w")
