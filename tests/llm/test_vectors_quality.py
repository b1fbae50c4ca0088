"""Operators 11 to 13 against brute force, with nulls, odd vectors, repeated
rows, ties, long texts, clashing columns and empty tables."""

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pytest

from kgenrich.llm import centroids, quality, whitening

VECTORS = "vec_id long, embedding array<float>, label int, id long, q string, x int, cluster int, c double, part int, n int"


def vector_rows(dims):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, dims) * np.linspace(0.5, 1.5, dims)]) for i in range(240)]
    rows += [(240 + i, rows[3][1]) for i in range(90)]              # one vector holds a third of the rows
    rows += [(7, rows[9][1]), (11, rows[11][1]), (11, rows[11][1]), (None, rows[20][1])]
    rows += [(900, None), (901, []), (902, [0.5] * (dims - 1)), (903, [math.nan] * dims),
             (904, [0.1] * (dims - 1) + [math.inf]), (905, [None] + [0.1] * (dims - 1)), (906, [0.0] * dims)]
    return [(i, v, 1, 2, "x", 3, 4, 0.5, 6, 7) for i, v in rows]


def good(rows, dims):
    return [(r[0], np.array(r[1], np.float32).astype(float)) for r in rows
            if r[1] is not None and len(r[1]) == dims and all(v is not None and math.isfinite(v) for v in r[1])]


def plain_kmeans(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x in good(rows, dims)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [list(q) for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cs = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    told = [(i, *near(q)[::-1]) for i, q in kept]
    part = {j: sum(d for _, c, d in told if c == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, c, d, part[c], sum(part.values()), sha[c]) for i, c, d in told]


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("block", [8, 5])
def test_centroid_clusters(spark, block):
    rows = vector_rows(16)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = centroids.centroid_clusters(df, dims=16, block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_kmeans(rows, 16, 8, 10), key=key)


def test_centroid_clusters_few_and_none(spark):
    rows = [(i, [0.25 * (i % 2)] * 4) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.centroid_clusters(df, dims=4)
    assert sorted(map(tuple, got.collect())) == sorted(plain_kmeans(rows, 4, 3, 10))     # ties, empty clusters
    none = centroids.centroid_clusters(df.where("false"), dims=4)
    assert none.collect() == [] and none.columns == got.columns
    far = spark.createDataFrame([(1, [3e38] * 4), (2, [-3e38] * 4)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.distance) for r in centroids.centroid_clusters(far, dims=4).collect()} == {(1, 0), (2, 0)}


def test_dictionaries_are_lossless(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 3, (500, 10))
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "id long, q array<int>")
    seen = 0
    for r in centroids.encode(df.repartition(3), 10, 4).collect():
        words = [np.array(w).reshape(-1, min(4, 10 - 4 * b)) for b, w in enumerate(r.words)]
        assert all(len(np.unique(w, axis=0)) == len(w) for w in words)
        back = np.concatenate([w[c] for w, c in zip(words, map(np.array, r.codes))], axis=1)
        assert (back == x[r.ids]).all()
        seen += len(back)
    assert seen == 500


@pytest.mark.parametrize("m,n,spread", [(6, 60, 9.0), (24, 200, 3.0)])
def test_rank_one_updates_follow_the_scatter_matrix(m, n, spread):
    rng = np.random.default_rng(m)
    x = np.floor(rng.normal(0, spread, (n, m))).astype(np.int64)
    x[:, 1] = x[:, 2]                       # a direction without variance
    x[:, 3] = 5
    a, b = whitening.Spectrum(m), whitening.Spectrum(m)
    for i, row in enumerate(x):
        (a if i % 3 else b).add(row)
    a.combine(b.n, b.sums, b.d, b.q)
    c = x - x.mean(axis=0)
    v = c.T @ c
    assert a.n == n and (a.sums == x.sum(axis=0)).all()
    assert np.allclose(a.q.T @ a.q, np.eye(m), atol=1e-12)
    assert np.allclose(a.q @ np.diag(a.d) @ a.q.T, v, atol=1e-9 * np.abs(v).max())


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(8)
    for k in (1, 2, 3, 20):
        d = np.sort(rng.uniform(0, 1, k)) ** 8 * 1e6 + np.arange(k) * 1e-3
        z2 = rng.uniform(0, 1, k) ** 12 + 1e-14
        diff = whitening.secular_roots(d, z2)
        root = d - np.diagonal(diff)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.allclose(root, want, rtol=1e-12, atol=1e-12 * max(1, d.max()))
        assert (np.diagonal(diff) < 0).all()


def test_whitening_equals_dense_eigenvectors(spark):
    m = 20
    rows = vector_rows(m)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(6), components=8).toPandas()
    kept = [(i, np.array([math.floor(64 * v) + 1_000_000 for v in x])) for i, x in good(rows, m)]
    fit = np.unique(np.stack([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    assert len(got) == 8 * len(kept) and set(got.n) == {n} and got.identity_error.iloc[0] < 1e-10
    assert got.identity_error.nunique() == 1
    want = {}
    for i, x in kept:
        want.setdefault(-1 if i is None else i, []).append((n * x - s, int(((n * x - s) ** 2).sum())))
    got["vec_id"] = got["vec_id"].fillna(-1).astype(int)
    for comp, part in got.groupby("component"):
        v, ev = q[:, -comp], e[-comp]
        assert np.allclose(part.explained, ev / e.sum(), rtol=1e-10)
        signs = set()
        for i, each in part.groupby("vec_id"):
            assert sorted(each.deviation) == sorted(d for _, d in want[i])
            ys = sorted(float(o / n @ v / np.sqrt(ev)) for o, _ in want[i])
            for sign in (1, -1):
                if np.allclose(sorted(each.whitened), sorted(sign * y for y in ys), rtol=0, atol=1e-9):
                    signs.add(sign)
                    break
            else:
                raise AssertionError((comp, i))
        assert len(signs) == 1 or set(np.abs(part.whitened).round(9)) == {0.0}


def test_whitening_of_few_flat_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"

    def rows(data):
        return whitening.whiten(spark.createDataFrame(data, schema)).toPandas()

    assert len(rows([])) == 0
    assert len(rows([(1, [0.5, 0.25]), (2, [0.5, 0.25])])) == 0         # one distinct vector
    flat = rows([(1, [0.5, 0.25]), (2, [-0.5, 0.25]), (2, [-0.5, 0.25]), (3, [9.0])])
    assert sorted(flat.vec_id) == [1, 2, 2] and set(flat.component) == {1}
    assert sorted(flat.whitened.abs()) == [1.0, 1.0, 1.0] and set(flat.explained) == {1.0}
    many = rows([(i, [float(i), float(i % 2)]) for i in range(50)])
    assert len(many) == 100 and many.identity_error.max() < 1e-10


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def quality_corpus():
    rng = np.random.default_rng(4)
    syll = ["the", "ing", "ö", "and", "ti on", "wh", "é"]
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choice(syll, rng.integers(1, 4))) for _ in range(int(rng.integers(30, 90)))]
        bad = i % 4 == 0
        if bad and i % 8:
            words = [w + str(rng.choice(list("#$%&"))) for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words[:15]) + "\n" + " ".join(words[15:])
        rows.append((i, text))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    line = " ".join(f"w{i}" for i in range(12))
    rows += [(400, None), (401, ""), (402, " \t\n\x0b"), (403, "\n".join([line] * 3 + ["x", "x", " ", " "])),
             (404, f"{line}\r\n{line}\n{line} y\n" + " ".join(f"v{i}" for i in range(60))), (405, "a " * 30),
             (406, " ".join(f"k{i % 777}" for i in range(20000))), (407, "ß é  |<>"), (None, rows[1][1]),
             (5, rows[5][1]), (5, rows[6][1]), (408, "😀 ok".encode("utf-16", "surrogatepass").decode("utf-16"))]
    labels += [(None, 1), (9999, 0), (7, 0), (11, None), (5, 1)]        # 7 disagrees with itself
    return [(*r, 1, True, 0.5, "x", 3) for r in rows], [(*r, 0) for r in labels]


DOCS = "doc_id long, text string, n_words int, kept boolean, score double, stats string, y int"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_rules(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = quality.quality_rules(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = []
    for i, text, *_ in rows:
        n, chars, symbols, dups, repeats = plain_counts(text)
        want.append((i, n, chars, symbols, dups, repeats, n < 20 or 100 * repeats > 30 * n))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert not any(r.kept for r in got if r.base_failed)
    fresh = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 5 == 0 and r.doc_id != 5]
    right = sum(r.kept == (r.doc_id % 4 != 0) for r in fresh)
    assert right >= 0.98 * len(fresh)           # documents without labels


def test_quality_rules_without_labels_or_documents(spark):
    rows, labels = quality_corpus()
    docs, none = spark.createDataFrame(rows[:40], DOCS), spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, none).collect())
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert all(r.kept != r.base_failed for r in quality.quality_rules(docs, one).collect())
    assert quality.quality_rules(docs.where("false"), spark.createDataFrame(labels, LABELS)).collect() == []


def test_fit_bound_is_held_and_repeatable(spark):
    rows, labels = quality_corpus()
    stats = quality.statistics(spark.createDataFrame(rows, DOCS)).cache()
    told = spark.createDataFrame(labels, LABELS)
    a, b = (quality.fit(stats.repartition(p), told, fit_rows=120) for p in (3, 7))
    assert (a.value == b.value).all() and (a.cut == b.cut).all()
    assert quality.training_rows(stats, told, fit_rows=120).count() == 120
    assert 300 < quality.training_rows(stats, told).count() < 330


def test_node_arrays_equal_walking_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.2 * rng.normal(size=600) > 0.3).astype(float)
    m = quality.boost(x, y, [0, 0, 0])

    def walk(row):
        total = m.base
        for node in m.roots:
            while m.left[node] != node:
                node = m.left[node] if row[m.feature[node]] <= m.cut[node] else m.right[node]
            total += m.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x])
    assert ((m.score(x) > 0.5) == y).mean() > 0.93


def test_constrained_features_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (1500, 3))
    y = (np.sin(5 * x[:, 0]) - x[:, 1] + 0.3 * rng.normal(size=1500) > 0).astype(float)     # not monotonic in 0
    steps = np.linspace(-1, 1, 60)
    for sign in (1, -1):
        m = quality.boost(x, y, [sign, -1, 0])
        for _ in range(40):
            at = np.repeat(rng.uniform(-1, 1, (1, 3)), 60, axis=0)
            for f, way in ((0, sign), (1, -1)):
                line = at.copy()
                line[:, f] = steps
                assert (way * np.diff(m.score(line)) >= -1e-12).all()
    free = quality.boost(x, y, [0, 0, 0])
    line = np.column_stack([steps, np.zeros(60), np.zeros(60)])
    assert (np.diff(free.score(line)) < -0.05).any() and (np.diff(free.score(line)) > 0.05).any()


def test_pandas_and_texts_agree(spark):
    rows, _ = quality_corpus()
    got = quality.statistics(spark.createDataFrame(rows, DOCS)).select("id", *quality.COUNTS).toPandas()
    want = pd.DataFrame([(r[0], *plain_counts(r[1])) for r in rows], columns=["id", *quality.COUNTS])
    assert sorted(map(tuple, got[quality.COUNTS].values.tolist())) == sorted(map(tuple, want[quality.COUNTS].values.tolist()))
