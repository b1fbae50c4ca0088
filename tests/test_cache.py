import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kgenrich.plans import cache
from kgenrich.session import checkpoint_dir, stage_folder, stage_path, stage_run


@pytest.fixture
def place(spark):
    d = tempfile.mkdtemp(prefix="kg-cache-")
    spark.range(5).write.parquet(f"{d}/in")
    return d


def make(spark, d, params=None, log=None):
    def build():
        log.append(1)
        return spark.read.parquet(f"{d}/in").withColumn("x", F.col("id") * 2)
    return cache.cached(spark, "t", build, [f"{d}/in"], params, f"{d}/cache")


def test_second_run_reads(spark, place):
    log = []
    a, b = (sorted(map(tuple, make(spark, place, log=log).collect())) for _ in range(2))
    assert a == b == [(i, 2 * i) for i in range(5)] and len(log) == 1


def test_changed_input_or_parameter_is_made_again(spark, place):
    log = []
    make(spark, place, {"p": 1}, log)
    make(spark, place, {"p": 2}, log)
    assert len(log) == 2
    spark.range(5, 7).write.mode("append").parquet(f"{place}/in")
    assert make(spark, place, {"p": 2}, log).count() == 7 and len(log) == 3
    assert len(os.listdir(f"{place}/cache/t")) == 1          # tables of old inputs are gone
    assert make(spark, place, {"p": 2}, log).count() == 7 and len(log) == 3
    cache.drop(spark, "t", f"{place}/cache")
    make(spark, place, {"p": 2}, log)
    assert len(log) == 4


def test_half_written_table_is_made_again(spark, place):
    log = []

    def lost():
        log.append("lost")
        return spark.range(4, numPartitions=4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(
            F.raise_error(F.lit("executor lost")).cast("long")).alias("id"))

    with pytest.raises(Exception, match="executor lost"):
        cache.cached(spark, "t", lost, [f"{place}/in"], None, f"{place}/cache")
    assert make(spark, place, log=log).count() == 5
    key = os.listdir(f"{place}/cache/t")[0]
    os.unlink(f"{place}/cache/t/{key}/{cache.MARKER}")        # all rows there, but never committed
    assert make(spark, place, log=log).count() == 5 and log.count(1) == 2


def test_stage_tables_of_a_finished_run_are_gone(spark):
    assert stage_folder(spark).startswith(checkpoint_dir(spark))
    with stage_run(spark) as folder:
        path = stage_path(spark, "a")
        spark.range(3).write.parquet(path)
        with stage_run(spark) as inner:
            spark.range(3).write.parquet(stage_path(spark, "b"))
            assert inner.startswith(folder)
        assert not os.path.exists(inner.removeprefix("file:")) and os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
    with pytest.raises(ZeroDivisionError), stage_run(spark) as folder:
        spark.range(3).write.parquet(stage_path(spark, "c"))
        1 / 0
    assert not os.path.exists(folder.removeprefix("file:"))
