import os
import tempfile

import numpy as np

from kgenrich.operators import classify, crf, supervise as sup

W = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"


def _w(*lem):
    return [(x, x, "ign", "") for x in lem]


def test_classifier_and_crf_store_roundtrip(spark):
    pos = spark.createDataFrame(
        [(f"e{i}", "V", 0, _w("capital", "city", "of", "land", "V"), ["V"]) for i in range(30)],
        f"s string, o string, sent_id int, words {W}, values array<string>")
    neg = spark.createDataFrame(
        [(f"e{i}", "V", 1, _w("river", "flows", "north", "x")) for i in range(30)],
        f"s string, o string, sent_id int, words {W}")
    vocab = sup.vocabulary(pos, 2, stop_words=[])
    clf = classify.train(pos, neg, vocab, stop_words=[])
    d = tempfile.mkdtemp(prefix="kg-models-")
    path = os.path.join(d, "svm-capital")
    got = classify.load_or_train(spark, path, lambda: clf)        # H6: trains (here: given) and saves
    again = classify.load_or_train(spark, path, lambda: 1 / 0)    # H6: loads, never retrains
    a = [r.p for r in got.score(pos.select("words"), []).collect()]
    b = [r.p for r in again.score(pos.select("words"), []).collect()]
    assert np.allclose(a, b) and min(a) > 0.5
    m = crf.CRFModel(np.random.default_rng(0).normal(size=(64, 2)), np.eye(2), 64)
    m.save(spark, os.path.join(d, "crf"))                        # B9
    m2 = crf.CRFModel.load(spark, os.path.join(d, "crf"), 64)
    assert np.allclose(m.W, m2.W) and np.allclose(m.T, m2.T)
