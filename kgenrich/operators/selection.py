"""Exact selection of the n first rows in a hash order, without a global sort.

A top-n in Spark merges n rows of every partition in one task, which fails
once n grows with the data. Here a histogram of the leading bits of the order
locates the bucket that holds the n-th row; the bucket is refined until few
rows are left in it. Rows before it pass a filter, of the bucket itself a
small top-n takes the rest. No task holds more than ``EDGE`` rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint_dir

BITS = 60           # of a key; 15 hexadecimal digits
STEP = 15           # bits a histogram resolves: 2^15 counts reach the driver
EDGE = 1000         # rows that may be sorted in one task


def key_parts(order: Column, ties: list[str]) -> list[Column]:
    """Keys of ``BITS`` bits, the first most significant: the 32 digits of the
    md5 ``order``, then a hash of ``ties``."""
    def digits(start, n):
        return F.conv(F.substring(order, start, n), 16, 10).cast("long")
    return [digits(1, 15), digits(16, 15), digits(31, 2) * F.lit(1 << (BITS - 8)),
            *([F.shiftrightunsigned(F.xxhash64(*ties), 64 - BITS)] if ties else [])]


def boundary(keys: DataFrame, n: int) -> tuple[int, int, int, int]:
    """``(low, high, before, inside)`` over the one key column: ``before`` rows lie
    under ``low``, the n-th in ``low <= key < high`` with ``inside`` rows. The
    bucket holds at most EDGE rows or a single key."""
    k = F.col(keys.columns[0])
    low, shift, before = 0, BITS, 0
    while True:
        shift -= STEP
        within = keys.where((k >= low) & (k < low + (1 << (shift + STEP))))
        counts = within.groupBy(F.shiftright(k - low, shift).alias("b")).count().orderBy("b").collect()
        for b, c in counts:
            if before + c >= n:
                break
            before += c
        low += b << shift
        if c <= EDGE or shift == 0:
            return low, low + (1 << shift), before, c


def first_rows(df: DataFrame, order: Column, n: int, ties: list[str] | None = None) -> DataFrame:
    """The ``n`` first rows of ``df`` by the md5 digest ``order``, equal digests by
    a hash of the columns ``ties`` (default: all). All rows if there are no
    more. Rows equal in everything are interchangeable: the right number of
    them is kept. ``df`` is read two or three times; persist it when it is dear."""
    if n <= 0:
        return df.limit(0)
    ties = df.columns if ties is None else ties
    if df.count() <= n:
        return df
    parts = key_parts(order, ties)
    kept, rest = [], df
    for key in parts:
        low, high, before, inside = boundary(rest.select(key.alias("k")), n)
        kept.append(rest.where(key < low))
        rest, n = rest.where((key >= low) & (key < high)), n - before
        if inside <= EDGE or inside == n:
            break
    else:       # more than EDGE rows alike: number them in a written table
        path = os.path.join(checkpoint_dir(df.sparkSession), "ties", uuid.uuid4().hex)
        rest.withColumn("__i", F.monotonically_increasing_id()).write.parquet(path)
        told = df.sparkSession.read.parquet(path)
        low, high, before, inside = boundary(told.select("__i"), n)
        kept.append(told.where(F.col("__i") < low).drop("__i"))
        rest, n = told.where((F.col("__i") >= low) & (F.col("__i") < high)).drop("__i"), n - before
    if inside != n:
        rest = rest.orderBy(*[p for p in parts]).limit(n)
    for k in kept:
        rest = k.unionByName(rest)
    return rest
