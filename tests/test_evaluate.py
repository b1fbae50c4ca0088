from kgenrich.operators import evaluate as J


def test_error_classes_and_scores(spark):
    ge = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "d")], "p string, entity string")
    gv = spark.createDataFrame([("r", "a", ["1", "2"]), ("r", "b", ["3"]), ("r", "c", ["4"]),
                                ("r", "z", ["9"])], "p string, entity string, values array<string>")
    pred = spark.createDataFrame([("a", "2"), ("b", "x"), ("e", "5"), ("d", "")], "entity string, value string")
    scores, table = J.evaluate(ge, gv, pred, "r")
    s = scores.first()
    # a: TP; b: wrong -> FP and FN; c: FN; e: FP (no gold); d: empty prediction ignored
    assert (s.tp, s.fp, s.fn) == (1, 2, 2)
    assert abs(s.precision - 1 / 3) < 1e-9 and abs(s.recall - 1 / 3) < 1e-9
    t = {r.entity: (r.gold, r.extracted, r.error) for r in table.collect()}
    assert t["a"] == ("1, 2", "2", "") and t["b"] == ("3", "x", "FP/FN")
    assert t["c"] == ("4", "-", "FN") and t["e"] == ("-", "5", "FP")


def test_zero_precision_gives_zero_f(spark):
    c = spark.createDataFrame([("a", None, "x", False, True, False)],
                              "entity string, values array<string>, value string, tp boolean, fp boolean, fn boolean")
    s = J.scores(c).first()
    assert s.precision == 0.0 and s.f_measure == 0.0 and s.recall == 0.0
