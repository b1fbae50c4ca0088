"""Helpers shared by the operators: stage tables, word counts, prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, name: str = "stage", folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut and the rows survive lost executors. Inside a
    ``session.stage_run`` the table goes when the run ends; ``folder`` is that of
    an outer run, for tables that are needed longer."""
    path = f"{folder or stage_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays (unlike ``lower``)."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to CR (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WS_WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows: the check before a broadcast.
    Only ``rows + 1`` rows are counted."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows; beyond
    that Spark's shuffle join is used."""
    return F.broadcast(df) if small_enough(df, rows) else df


def with_running_sum(df: DataFrame, group: list[str], tie: str, value: str, out: str,
                     rows_per_bucket: int = 20_000, order: list[str] | None = None) -> DataFrame:
    """Exclusive running sum ``out`` of ``value`` within ``group``, ordered by
    the uniform 64-bit hash ``tie`` (then ``order``), without ever sorting a
    whole group in one task: rows go to hash-range buckets, each bucket is
    summed in its own window, and bucket offsets come from the small table of
    bucket totals. A group holding most rows spreads over all its buckets.
    ``value`` 1 gives a gapless index. Null groups are groups."""
    n = df.count()
    buckets = max(1, -(-n // rows_per_bucket))
    width = (1 << 64) // buckets + 1
    b = F.expr(f"cast(floor((cast({tie} as decimal(20,0)) + 9223372036854775808) / {width}) as int)")
    df = df.withColumn("__b", b)
    keys = [F.col(g) for g in group]
    total = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    t = total.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
                     F.col("__b").alias("__tb"), "__o")
    cond = F.col("__b") == F.col("__tb")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy(*keys, "__b").orderBy(tie, *(order or [])) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return df.join(t, cond).withColumn(
        out, (F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("__o")).cast("long")) \
        .drop("__b", "__tb", "__o", *[f"__g{i}" for i in range(len(group))])
