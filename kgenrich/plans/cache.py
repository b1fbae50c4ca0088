"""Stage tables that are made once and read afterwards.

A table is kept under a fingerprint of its name, its parameters and the files
of its inputs (path, length, time of change). It counts only once its commit
marker is there, which is written after the last row, so a table that a lost
job left half-written is made again. A changed input or parameter is another
fingerprint; the table of the old one is dropped then.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, hadoop_path

MARKER = "_COMMITTED"


def input_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, length, time of change)`` of every file under ``path``, markers
    and hidden files left out."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, name: str, inputs: list[str], params: dict) -> str:
    """Digest of everything that the table depends on."""
    what = [name, params, [[i, input_files(spark, i)] for i in inputs]]
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs: list[str] = (),
           params: dict | None = None, root: str | None = None) -> DataFrame:
    """The table ``name``: read when it was made from the same inputs and
    parameters, else ``build()`` written and read back."""
    folder = os.path.join(root or os.path.join(checkpoint_dir(spark), "cache"), name)
    key = fingerprint(spark, name, list(inputs), params or {})
    path = os.path.join(folder, key)
    fs, marker = hadoop_path(spark, os.path.join(path, MARKER))
    if not fs.exists(marker):
        build().write.mode("overwrite").parquet(path)
        fs.create(marker, True).close()
        for other in fs.listStatus(marker.getParent().getParent()):
            if other.getPath().getName() != key:
                fs.delete(other.getPath(), True)
    return spark.read.parquet(path)


def drop(spark: SparkSession, name: str, root: str | None = None) -> None:
    """Forget a table."""
    fs, p = hadoop_path(spark, os.path.join(root or os.path.join(checkpoint_dir(spark), "cache"), name))
    fs.delete(p, True)
