"""Exact k-selection against sorting, and the pair draw against its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from kgenrich.operators import supervise as sup
from kgenrich.operators.selection import EDGE, first_rows
from kgenrich.plans import testkg as kg
from kgenrich.plans.oracle import pairs_ctes, with_kg

SF = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 1500, 2999, 3000, 5000])
def test_first_rows_equal_a_sort(spark, n):
    df = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("v"))
    got = [r.v for r in first_rows(df, F.md5("v"), n).collect()]
    assert sorted(got) == sorted(sorted((f"v{i}" for i in range(3000)), key=md5)[:n])


def test_ties_and_equal_rows(spark):
    """A third of the rows is one value, more often than a task may sort."""
    df = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("v"),
                                  F.when(F.col("id") < 3000, F.lit(0)).otherwise(1).alias("x"))
    order = sorted(["hot"] * 3000 + [str(i) for i in range(3000, 9000)], key=md5)
    first = order.index("hot")
    assert 3000 > EDGE
    for n in (first, first + 1, first + 1777, first + 3000, first + 3001):
        got = [r.v for r in first_rows(df, F.md5("v"), n).collect()]
        assert sorted(got) == sorted(order[:n])
    assert first_rows(df, F.md5("v"), 20000).count() == 9000
    assert first_rows(df.where("false"), F.md5("v"), 5).count() == 0


def test_equal_digests_are_cut_by_the_ties(spark):
    df = spark.range(4000).select(F.lit("same").alias("v"), "id")
    a, b = ({r.id for r in first_rows(df.repartition(p), F.md5("v"), 1234).collect()} for p in (2, 5))
    assert a == b and len(a) == 1234


def test_no_single_task_holds_a_large_draw(spark):
    neg = spark.range(300_000).select(F.concat(F.lit("s"), "id").alias("s"), F.lit("o").alias("o"),
                                      F.lit(0).alias("sent_id"))
    got = sup.undersample(neg, 150_000)
    assert got.count() == 150_000 and got.distinct().count() == 150_000
    plan = got._jdf.queryExecution().toString()
    assert "limit=150000" not in plan and "TakeOrderedAndProject(limit=150000" not in plan
    assert {r.s for r in sup.undersample(neg, 40).collect()} == {
        r.s for r in neg.orderBy(F.md5(F.concat_ws("|", "s", "o", "sent_id", F.lit("7")))).limit(40).collect()}


@pytest.mark.parametrize("limit", [3, 40, 90, 100000])
def test_training_pairs_equal_their_sql_below_the_limit(spark, limit):
    con = duckdb.connect()
    for t in kg.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(with_kg(f"with {pairs_ctes(limit)} select p, s, o from kg_pairs")).fetchall()
    t = kg.triples(spark, SF)
    ge, _ = kg.gold(spark, SF)
    got = []
    for p in ("nation", "balance"):
        pairs = sup.drop_gold(sup.training_pairs(t, kg.types(t), kg.relation(p), limit), ge.where(F.col("p") == p))
        got += [(p, r.s, r.o) for r in pairs.collect()]
    assert sorted(got) == sorted(want) and got


def test_cap_on_positives_is_a_prefix_of_the_larger_cap(spark):
    lab = spark.range(500).select(F.concat(F.lit("s"), "id").alias("s"), F.lit("v").alias("o"), F.lit(0).alias("sent_id"),
                                  F.array(F.lit("w")).alias("words"), F.array(F.lit("v")).alias("values"),
                                  F.lit("pos").alias("kind"), F.lit(1).alias("n_match"))
    sets = [{r.s for r in sup.best_positives(lab, cap).collect()} for cap in (10, 100, 499, 900)]
    assert [len(s) for s in sets] == [10, 100, 499, 500]
    assert sets[0] < sets[1] < sets[2] < sets[3]
