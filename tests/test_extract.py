from pyspark.sql import functions as F

from kgenrich.config import RelationSpec
from kgenrich.operators import extract as X

WORDS = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"


def _df(spark, lemmas, tags, probs, entity="Zzzz"):
    ws = [(l, l, "ign", "") for l in lemmas]
    return spark.createDataFrame([(entity, 0, ws, tags, probs)],
                                 f"entity string, sent_id int, words {WORDS}, tags array<int>, probs array<double>")


def test_decode_spans_rules(spark):
    df = _df(spark, ["-", "Bielsko", "-", "Biała", "x", "Nowa", "Wieś", "-", "y"],
             [0, 1, 0, 1, 0, 1, 1, 0, 0], [.9, .95, .2, .9, .1, .99, .85, .1, .1])
    r = df.select(X.decode_spans(F.col("words"), F.col("tags"), F.col("probs")).alias("s")).first().s
    # '-' forced to label 1; leading '-' skipped; trailing '-' dropped; min p
    assert [(s.value, round(s.p, 2), s.start) for s in r] == [("Bielsko-Biała", 0.9, 1),
                                                             ("Nowa_Wieś", 0.85, 5)]


def test_spans_filters_and_normalises(spark):
    df = _df(spark, ["Zzzzy", "a", "Nowa", "Wieś", "b", "12,7"], [1, 0, 1, 1, 0, 1],
             [.99, .1, .9, .95, .1, .95], entity="Zzzz_town")
    out = X.spans(df, RelationSpec("x")).orderBy("start").collect()
    # prefix rule drops 'Zzzzy'; multi-token value capitalised; numeric truncated
    assert [(r.value, r.p) for r in out] == [("Nowa_Wieś", 0.9), ("12", 0.95)]


def test_select_values_priorities(spark):
    spans = spark.createDataFrame(
        [("e", 0, 0, "Foo", 0.99), ("e", 1, 0, "Bar", 0.95), ("e", 2, 0, "Baz", 0.9),
         ("f", 0, 0, "Qux", 0.99)],
        "entity string, sent_id int, start int, value string, p double")
    catalog = spark.createDataFrame([("Bar", ["Town"]), ("Baz", ["City"])], "name string, types array<string>")
    ot = spark.createDataFrame([("City",)], "type string")
    got = {r.entity: r.value for r in X.select_values(spans, RelationSpec("x"), catalog, ot).collect()}
    assert got == {"e": "Baz"}              # right type beats any entity; f has no entity
    got = {r.entity: r.value for r in X.select_values(
        spans, RelationSpec("x", allow_unknown_value=True), catalog, None).collect()}
    assert got == {"e": "Bar", "f": "Qux"}  # any entity first, else the raw best value
    got = {r.entity: r.value for r in X.select_values(spans, RelationSpec("x", is_numeric=True)).collect()}
    assert got == {"e": "Foo", "f": "Qux"}


def test_window_features_offsets(spark):
    df = _df(spark, ["Ala", "ma", "1995"], [0, 0, 0], [1., 1., 1.])
    f = X.with_window_features(df).first().feats
    assert len(f) == 3 and all(len(x) == 3 * 15 for x in f)
    assert "2lemma=1995" in f[0] and "-2segment=Ala" in f[2]
    assert "0lemma=Ala" in f[0] and "1lemma=ma" in f[0] and "-1lemma=ma" in f[2]
    assert "0recent_year=1" in f[2] and "0segm_starts_with_capital=1" in f[0]


def test_token_labels(spark):
    df = _df(spark, ["Nowa", "wieś", "x"], [0, 0, 0], [1., 1., 1.])
    r = df.select(X.token_labels(F.col("words"), F.array(F.lit("WIEŚ"))).alias("l")).first().l
    assert r == [0, 1, 0]
