import os
import tempfile
import uuid

import pytest

from kgenrich.operators import text
from kgenrich.streaming import incremental as inc

SCHEMA = "title string, page_id long, wikitext string"
ARTICLES = [
    ("A", 1, "'''A''' is a small town in [[Big_Land]] near the river bank."),
    ("B", 2, "'''B''' is another small town in the hills of the north. River Bank is close."),
    ("C", 3, "'''C''' is a village on the coast with a long sandy beach."),
    ("D", 4, "Sandy hills and North winds are what people of '''D''' know, 100 000 of them."),
    ("E", 5, "Winds blow in '''E''' all day long, and people sail from there."),
    ("F", 6, "'''F''' has no article text worth a word but this line."),
]


@pytest.fixture
def place():
    d = tempfile.mkdtemp(prefix="kg-stream-")
    return os.path.join(d, "raw"), os.path.join(d, "out"), f"t_{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("Big_Land", ["Place"])], "name string, types array<string>")


def add(spark, raw, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(raw)


def table(spark, out):
    return sorted((r.title, r.sent_id, [tuple(w) for w in r.words]) for r in inc.read_sentences(spark, out).collect())


@pytest.fixture(scope="module")
def whole(spark, catalog):
    """All articles prepared in one batch job."""
    raw = spark.createDataFrame(ARTICLES, SCHEMA)
    return sorted((r.title, r.sent_id, [tuple(w) for w in r.words])
                  for r in text.prepare_articles(raw, catalog).collect())


def test_available_now_prepares_only_new_articles(spark, place, catalog):
    raw, out, name = place
    add(spark, raw, ARTICLES[:2])
    inc.prepare_stream(spark, raw, out, catalog, query_name=name)
    assert {t for t, *_ in table(spark, out)} == {"A", "B"}
    add(spark, raw, [ARTICLES[2], ARTICLES[0]])         # one new title, one already prepared
    inc.prepare_stream(spark, raw, out, catalog, query_name=name)
    got = table(spark, out)
    assert {t for t, *_ in got} == {"A", "B", "C"}
    assert sum(t == "A" for t, *_ in got) == 1          # not prepared twice
    assert inc.prepare_pending(spark, out, catalog) == 0
    found = text.get_articles(inc.read_sentences(spark, out), spark.createDataFrame([("C",), ("Z",)], "t string"))
    assert [r.title for r in found.collect()] == ["C"]


def test_one_batch_many_batches_and_many_runs_are_equal(spark, catalog, whole):
    tables = []
    for split, max_files in (([ARTICLES], None), ([[a] for a in ARTICLES], 1), ([ARTICLES[:4], ARTICLES[4:]], 1)):
        d = tempfile.mkdtemp(prefix="kg-stream-")
        raw, out, name = os.path.join(d, "raw"), os.path.join(d, "out"), f"t_{uuid.uuid4().hex}"
        for rows in split:
            add(spark, raw, rows)
            if len(split) == 2:                         # a run after every file
                inc.prepare_stream(spark, raw, out, catalog, query_name=name, max_files=max_files)
        inc.prepare_stream(spark, raw, out, catalog, query_name=name, max_files=max_files)
        tables.append(table(spark, out))
    assert tables[0] == tables[1] == tables[2] == whole
    lemmas = {w[0]: w[1] for _, _, words in whole for w in words}
    assert lemmas["Sandy"] == "sandy" and lemmas["Winds"] == "winds"


def test_a_failed_batch_is_replayed_to_the_same_table(spark, place, catalog, whole, monkeypatch):
    raw, out, name = place
    for rows in (ARTICLES[:3], ARTICLES[3:]):
        add(spark, raw, rows)
    real, calls = inc.write_batch, []

    def fails_once(df, root, table, batch):
        real(df, root, table, batch)
        calls.append(table)
        if len(calls) in (1, 4):                        # after the write: the query does not commit the batch
            raise RuntimeError("lost")

    monkeypatch.setattr(inc, "write_batch", fails_once)
    for _ in range(3):
        try:
            inc.prepare_stream(spark, raw, out, catalog, query_name=name, max_files=1)
        except Exception as e:
            assert "lost" in str(e)
    assert calls.count("clean") > 2 and table(spark, out) == whole


def test_a_new_checkpoint_keeps_earlier_batches(spark, place, catalog):
    raw, out, name = place
    add(spark, raw, ARTICLES[:2])
    inc.prepare_stream(spark, raw, out, catalog, query_name=name)
    before = table(spark, out)
    inc.prepare_stream(spark, raw, out, catalog, query_name=f"{name}_again")
    assert table(spark, out) == before


def test_no_files_give_no_table(spark, place, catalog):
    raw, out, name = place
    spark.createDataFrame([], SCHEMA).write.parquet(raw)
    inc.prepare_stream(spark, raw, out, catalog, query_name=name)
    assert inc.prepare_pending(spark, out, catalog) == 0
