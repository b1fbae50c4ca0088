"""The pipeline's stages on a small table with edge rows."""

import corpus_pipeline
import __spark_entry__ as E

from .test_operators import ROWS, SCHEMA, items


def test_registered():
    q = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items()[1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    a = stages["language_id"](spark, docs, str(tmp_path))
    assert a.columns == docs.columns
    assert ids(docs) - ids(a) == {100, 101, 102, 103}       # no text or no letters
    b = stages["near_dedup"](spark, a, str(tmp_path))
    assert b.columns == docs.columns and None in ids(b) and ids(b) < ids(a)
    assert len([r for r in b.collect() if r.doc_id == 9]) <= 1
    c = stages["decontamination"](spark, b, str(tmp_path))
    assert not ids(c) & {3, *range(90, 100)} and 104 not in ids(c)
    d = stages["source_mixing"](spark, c, str(tmp_path))
    assert d.columns == docs.columns and ids(d) <= ids(c)
    e = stages["sharding"](spark, d, str(tmp_path))
    assert e.count() == d.count()
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == e.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_near_dedup_one_row_per_class(spark, tmp_path):
    """Ids that repeat or are null: one row per class of texts, not per id."""
    words = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (1, words("b")), (2, words("a")), (3, words("c")), (4, words("c")),
            (None, words("c")), (None, words("d")), (None, words("d")), (5, words("b")), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()
    want = [(1, words("a")), (1, words("b")), (3, words("c")), (None, words("d")), (6, "")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
