from kgenrich.operators import evaluate as J
from kgenrich.operators import senses as S

W = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"


def test_synsets_and_closure(spark):
    sents = spark.createDataFrame([("a", 0, [("Miasto", "miasto", "subst:sg:nom:n", ""),
                                             ("leży", "leżeć", "fin:sg:ter:imperf", ""),
                                             ("x", "x", "ign", "")])],
                                  f"title string, sent_id int, words {W}")
    senses = spark.createDataFrame([("miasto", "n", 2, "city.n.02"), ("miasto", "n", 1, "city.n.01"),
                                    ("leżeć", "v", 1, "lie.v.01"), ("x", "n", 1, "x.n.01")],
                                   "lemma string, pos string, rank int, synset string")
    r = S.with_synsets(sents, senses).first()
    assert r.synsets == ["city.n.01", "lie.v.01", "x.n.01"]
    hyp = spark.createDataFrame([("city.n.01", "municipality.n.01"), ("municipality.n.01", "region.n.01")],
                                "synset string, parent string")
    c = {(x.synset, x.ancestor): x.depth for x in S.hypernym_closure(hyp, 2).collect()}
    assert c[("city.n.01", "region.n.01")] == 2 and c[("city.n.01", "municipality.n.01")] == 1


def test_closure_of_a_ladder_with_2_to_the_20_paths(spark):
    rungs = [(f"n{i}{a}", f"n{i + 1}{b}") for i in range(20) for a in "xy" for b in "xy"]
    c = S.hypernym_closure(spark.createDataFrame(rungs, "synset string, parent string")).collect()
    assert len(c) == sum(4 * (20 - i) for i in range(20))
    assert {r.depth for r in c if r.synset == "n0x" and r.ancestor == "n20y"} == {20}


def test_closure_of_cycles_shortcuts_and_bad_rows(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("x", "y"), (None, "y"), ("x", None)]
    hyp = spark.createDataFrame(rows, "synset string, parent string")
    got = sorted((r.synset, r.ancestor, r.depth) for r in S.hypernym_closure(hyp).collect())
    assert got == [("a", "a", 2), ("a", "b", 1), ("a", "c", 1), ("b", "a", 2), ("b", "b", 3), ("b", "c", 1),
                   ("c", "a", 1), ("c", "b", 2), ("c", "c", 2), ("x", "y", 1)]
    assert all(r.depth == 1 for r in S.hypernym_closure(hyp, 1).collect())
    assert S.hypernym_closure(hyp.where("false")).collect() == []


def test_learning_curve_means(spark):
    rows = [(cap, seed, cap / 100.0, seed / 10.0) for cap in (25, 10) for seed in range(2)]
    r = J.mean_curve(spark.createDataFrame(rows, "cap int, seed int, precision double, recall double")).collect()
    assert [(x.cap, x.precision, x.recall) for x in r] == [(10, 0.1, 0.05), (25, 0.25, 0.05)]
