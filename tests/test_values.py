from pyspark.sql import functions as F

from conftest import one
from kgenrich.functions import values as V


def test_prepare_numeric_literals(spark):
    # expected values stated by the original author next to the normaliser
    assert one(spark, V.prepare_numeric(F.col("v")), "ok. 34,5 km") == ["34"]
    assert one(spark, V.prepare_numeric(F.col("v")), "12,1 tys.") == ["12100"]
    assert one(spark, V.prepare_numeric(F.col("v")), "0,9 mln.") == ["900000"]


def test_prepare_numeric_edge_cases(spark):
    assert one(spark, V.prepare_numeric(F.col("v")), "99 2001 Census") == ["99"]
    assert one(spark, V.prepare_numeric(F.col("v")), "a b 3") == []
    assert one(spark, V.prepare_numeric(F.col("v")), "abc") == []
    # primary parse fails on two commas; the first space part that parses wins
    assert one(spark, V.prepare_numeric(F.col("v")), "1,2 3,4,5") == ["1"]


def test_prepare_text_literal(spark):
    out = one(spark, V.prepare_text(F.col("v"), stop_words=[]), "warmińsko-mazurskie")
    assert out == ["warmińsko", "mazurskie", "warmińsko-mazurskie"]


def test_prepare_text_rules(spark):
    # one "\dpx" dropped, one-byte tokens dropped, generic nouns dropped
    assert one(spark, V.prepare_text(F.col("v"), stop_words=[]), "20px Neapol") == ["Neapol"]
    assert one(spark, V.prepare_text(F.col("v"), stop_words=[]), "a") == []
    assert one(spark, V.prepare_text(F.col("v"), stop_words=[]), "rzeka") == []
    # a two-byte single letter is kept (byte length, as the original)
    assert one(spark, V.prepare_text(F.col("v"), stop_words=[]), "ł") == ["ł"]
    assert one(spark, V.prepare_text(F.col("v"), stop_words=["of"]), "Isle of Man") == \
        ["Isle", "Man", "Isle of Man"]


def test_is_numeric(spark):
    assert one(spark, V.is_numeric(F.col("v")), "50,3") is True
    for s in ["12", "1.5", "-3", " 4 ", "1e5", ",5"]:
        assert one(spark, V.is_numeric(F.col("v")), s) is True, s
    for s in ["nan", "infinity", "abc", "1,2,3", "", "1 000"]:
        assert one(spark, V.is_numeric(F.col("v")), s) is False, s
    assert one(spark, V.truncate_numeric(F.col("v")), "34,9") == "34"
