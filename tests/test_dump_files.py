"""The dump scan over several parts, and files bounded by bytes."""

import bz2
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from kgenrich.sources import dump

PAGES = "title string, page_id long, wikitext string, place long"


def versions(spark):
    """Every title stands in three places of the dump; the last is its article."""
    rows = [(f"T {i}", 1000 * v + i, f"text {v} of {i} & <b>\nmore", 100 * v + i) for i in range(60) for v in (2, 0, 1)]
    return spark.createDataFrame(rows + [("T/ 5", 1, "slash", 205), ("X:y", 2, "a\nb", 3), ("one", 3, "line", 4)], PAGES)


@pytest.mark.parametrize("files,partitions,split", [(1, None, "128m"), (5, None, "1k"), (5, 7, "128m"), (3, 2, "2k")])
def test_last_page_wins_over_files_and_partitions(spark, files, partitions, split):
    path = os.path.join(tempfile.mkdtemp(), "dump")
    dump.write_dump(versions(spark), path, "place", files=files)
    assert len(glob.glob(f"{path}/*.bz2")) >= min(files, 2) - 1
    names = spark.createDataFrame([(f"T_{i}",) for i in range(50)] + [("T/_5",)], "name string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.stored_name: (r.title, r.page_id, r.wikitext)
               for r in dump.prepare_corpus_from_dump(spark, path, names, partitions).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {f"T_{i}": (f"T_{i}", 2000 + i, f"text 2 of {i} & <b>\nmore") for i in range(50)}
    assert got == want | {"T__5": ("T/_5", 1, "slash")}


@pytest.mark.parametrize("bound,run", [(100, 1 << 28), (700, 900), (10_000_000, 500)])
def test_files_hold_their_bytes_in_order(spark, bound, run, monkeypatch):
    monkeypatch.setattr(dump, "RUN_BYTES", run)
    rows = [(i, "é" * (i * 37 % 90) + f"\nend {i}") for i in range(200)] + [(500, "x" * 3000), (501, "after"), (None, "none")]
    path = os.path.join(tempfile.mkdtemp(), "text")
    dump.write_corpus(spark.createDataFrame(rows, "page_id long, value string").repartition(6), path,
                      max_bytes=bound, compress=True)
    order = [v for _, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    files = sorted((r.folder, r.file, r.value) for r in dump.read_corpus(spark, path).collect())
    assert "".join(v for *_, v in files) == "".join(v + "\n" for v in order)
    assert all(folder == file // 100 for folder, file, _ in files)
    assert len(glob.glob(f"{path}/folder=*/file=*/*.bz2")) == len(files)        # one part a file
    for at, (_, number, text) in enumerate(files):
        last = text.rstrip("\n")[-60:]
        size = max((len(v.encode()) + 1 for v in order if v.endswith(last) or text.endswith(v + "\n")), default=0)
        assert len(text.encode()) <= bound + size
    raw = bz2.open(glob.glob(f"{path}/folder=0/file=0/*.bz2")[0]).read().decode()
    assert raw.startswith("none\n")


def test_empty_corpus(spark):
    path = os.path.join(tempfile.mkdtemp(), "text")
    none = spark.createDataFrame([], "page_id long, value string")
    dump.write_corpus(none, path)
    assert dump.file_places(none, "page_id", 10).count() == 0
    assert spark.range(3).select(F.lit(None).cast("string").alias("value"), F.col("id").alias("page_id")) \
        .transform(lambda d: dump.file_places(d, "page_id", 2)).select("file").distinct().count() == 2
