import itertools

import numpy as np

from kgenrich.operators import crf


def _problem(seed=0, n_sent=4, n_feat=16):
    rng = np.random.default_rng(seed)
    fids, flens, labels = [], [], []
    for _ in range(n_sent):
        L = int(rng.integers(1, 6))
        k = list(rng.integers(1, 4, size=L))
        flens.append(k)
        fids.append(list(rng.integers(0, n_feat, size=sum(k))))
        labels.append(list(rng.integers(0, 2, size=L)))
    W = rng.normal(size=(n_feat, 2))
    T = rng.normal(size=(2, 2))
    return (fids, flens), labels, W, T, n_feat


def _brute_logz(E, T):
    L = E.shape[0]
    scores = []
    for ys in itertools.product([0, 1], repeat=L):
        s = sum(E[t, ys[t]] for t in range(L)) + sum(T[ys[t - 1], ys[t]] for t in range(1, L))
        scores.append(s)
    return np.logaddexp.reduce(scores)


def test_logz_and_marginals_against_brute_force():
    fids, labels, W, T, n = _problem()
    ids, tok, mask, lens, B, L = crf._batch(*fids)
    E = crf._emissions(W, ids, tok, B, L)
    _, _, logz, gamma = crf._forward_backward(E, T, mask)
    for b in range(B):
        assert np.isclose(logz[b], _brute_logz(E[b, :lens[b]], T))
        assert np.allclose(gamma[b, :lens[b]].sum(axis=1), 1.0)


def test_gradient_matches_finite_differences():
    fids, labels, W, T, n = _problem(seed=3)
    loss, gW, gT = crf._loss_grad_batch(W, T, *fids, labels, n)
    eps = 1e-6
    for (f, y) in [(0, 0), (3, 1), (7, 0)]:
        W2 = W.copy()
        W2[f, y] += eps
        l2, _, _ = crf._loss_grad_batch(W2, T, *fids, labels, n)
        assert np.isclose((l2 - loss) / eps, gW[f, y], atol=1e-4)
    for (i, j) in [(0, 1), (1, 1)]:
        T2 = T.copy()
        T2[i, j] += eps
        l2, _, _ = crf._loss_grad_batch(W, T2, *fids, labels, n)
        assert np.isclose((l2 - loss) / eps, gT[i, j], atol=1e-4)


def test_viterbi_is_best_path():
    fids, _, W, T, n = _problem(seed=5)
    tags, probs = crf._viterbi_batch(W, T, *fids)
    ids, tok, mask, lens, B, L = crf._batch(*fids)
    E = crf._emissions(W, ids, tok, B, L)
    for b in range(B):
        Lb = lens[b]
        best = max(itertools.product([0, 1], repeat=Lb),
                   key=lambda ys: sum(E[b, t, ys[t]] for t in range(Lb))
                   + sum(T[ys[t - 1], ys[t]] for t in range(1, Lb)))
        assert tuple(tags[b]) == best
        assert all(0.0 <= p <= 1.0 for p in probs[b])


def test_lbfgs_quadratic():
    A = np.diag([1.0, 10.0, 100.0])
    x = crf.lbfgs(lambda v: (0.5 * v @ A @ v - v.sum(), A @ v - 1.0), np.zeros(3), tol=1e-12, max_iter=200)
    assert np.allclose(x, 1.0 / np.diag(A), atol=1e-4)


def test_distributed_training_learns_separable_tags(spark):
    rows = []
    for i in range(60):
        ws = [("in", "in", "ign", ""), (f"Town{i % 5}", f"Town{i % 5}", "ign", ""), ("x", "x", "ign", "")]
        rows.append((ws, [f"Town{i % 5}"]))
    df = spark.createDataFrame(rows, "words array<struct<segment:string,lemma:string,tag:string,parse:string>>, values array<string>")
    model = crf.train(df, max_iter=30, n_features=1 << 10)
    tagged = crf.tag(model, df.select("words")).collect()
    assert all(r.tags == [0, 1, 0] for r in tagged)


def test_arrow_batch_matches_list_batch():
    import pyarrow as pa
    import pyarrow.compute as pc
    (fids, flens), labels, W, T, n = _problem(seed=7, n_sent=6)
    rb = pa.RecordBatch.from_arrays(
        [pa.array(fids, pa.list_(pa.int32())), pa.array(flens, pa.list_(pa.int32())),
         pa.array(labels, pa.list_(pa.int32()))], names=["fids", "flens", "labels"])
    a = crf._loss_grad_arrow(W, T, rb.slice(1, 4), n, pc)
    b = crf._loss_grad_batch(W, T, fids[1:5], flens[1:5], labels[1:5], n)
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1]) and np.allclose(a[2], b[2])


def test_gradient_is_the_same_over_1_and_50_partitions(spark):
    (fids, flens), labels, W, T, n = _problem(seed=11, n_sent=60, n_feat=32)
    rows = [([int(x) for x in f], [int(x) for x in k], [int(x) for x in y]) for f, k, y in zip(fids, flens, labels)]
    df = spark.createDataFrame(rows, "fids array<int>, flens array<int>, labels array<int>")
    x = np.concatenate([W.ravel(), T.ravel()])
    loss, gW, gT = crf._loss_grad_batch(W, T, fids, flens, labels, n)
    want = np.concatenate([gW.ravel(), gT.ravel()]) + 0.5 * x
    for parts in (1, 50):
        f, g = crf._objective(df.repartition(parts), n, 0.5, 16)(x)
        assert np.isclose(f, loss + 0.25 * x @ x) and np.allclose(g, want)


def test_tagging_with_given_weights_is_exact(spark):
    """Sentences of many lengths, an empty one included, against all label paths."""
    rng = np.random.default_rng(2)
    rows = [(i, [(w, w, "ign", "") for w in rng.choice(["a", "B", "7", "c"], rng.integers(0, 8)).tolist()]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, words array<struct<segment:string,lemma:string,tag:string,parse:string>>")
    model = crf.CRFModel(rng.normal(size=(64, 2)), rng.normal(size=(2, 2)), 64)
    feats = {r.id: (r.fids, r.flens) for r in crf.prepare(df, False, 64).collect()}
    for r in crf.tag(model, df, batch=7).collect():
        ids, lens = feats[r.id]
        at, E = 0, []
        for k in lens:
            E.append(model.W[ids[at:at + k]].sum(axis=0))
            at += k
        paths = {ys: sum(E[t][y] for t, y in enumerate(ys)) + sum(model.T[a, b] for a, b in zip(ys, ys[1:]))
                 for ys in itertools.product([0, 1], repeat=len(E))}
        assert tuple(r.tags) == max(paths, key=paths.get)
        total = np.logaddexp.reduce(list(paths.values()))
        for t, p in enumerate(r.probs):
            mass = np.logaddexp.reduce([s for ys, s in paths.items() if ys[t] == r.tags[t]])
            assert np.isclose(p, np.exp(mass - total))


def test_models_fitted_together_equal_models_fitted_alone(spark):
    """Nested samples as the learning curve makes them: every sentence once, with its models."""
    rows = [([("in", "in", "ign", ""), (f"Town{i % 7}", f"Town{i % 7}", "ign", ""), (f"x{i % 3}", "x", "ign", "")],
             [f"Town{i % 7}"], [m for m, cap in enumerate((5, 20, 40)) if i < cap]) for i in range(40)]
    W = "words array<struct<segment:string,lemma:string,tag:string,parse:string>>, values array<string>"
    df = spark.createDataFrame(rows, f"{W}, models array<int>")
    many = crf.train_many(df.repartition(3), max_iter=25, tol=1e-9, n_features=1 << 10, rows_per_partition=15)
    assert sorted(many) == [0, 1, 2]
    for m, cap in enumerate((5, 20, 40)):
        alone = crf.train(spark.createDataFrame([r[:2] for r in rows[:cap]], W), max_iter=25, tol=1e-9, n_features=1 << 10)
        assert np.allclose(many[m].W, alone.W, atol=1e-3) and np.allclose(many[m].T, alone.T, atol=1e-3)
