"""Prepare only articles not prepared yet, as an incremental stream.

Two steps, both safe to repeat:

1. ``clean_new``: a Structured Streaming query (``availableNow``) picks up the
   raw files not seen yet. Every micro-batch is cleaned and written, over what
   an earlier try of the same batch may have left, to its own folder
   ``clean/batch=<query id>-<batch id>``; the counts of its word forms go to
   ``forms/batch=...`` the same way. The forms of all batches are the lexicon,
   kept up by deltas.
2. ``prepare_pending``: batches without prepared sentences, and earlier ones
   holding a form whose lemma the new batches change, are tagged with the whole
   lexicon and written to ``sentences/batch=...``, each replacing its folder.

So the sentences do not depend on how files fall into batches, on retried
batches or on the number of runs. Of several articles with one title the first
batch's wins, inside a batch the one with the smallest page id, then text digest.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import text
from ..session import checkpoint_dir

RAW_SCHEMA = "title string, page_id long, wikitext string"


def read_batches(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """A table of all batches with its ``batch`` column; None before the first."""
    try:
        df = spark.read.option("recursiveFileLookup", "false").parquet(os.path.join(root, table))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return df.withColumn("batch", F.col("batch").cast("string"))


def read_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The prepared ``sentences(title, sent_id, words)``."""
    return read_batches(spark, root, "sentences").drop("batch")


def read_lexicon(spark: SparkSession, root: str) -> DataFrame:
    """The lexicon of all cleaned batches, one row per form."""
    return text.lexicon_from_forms(read_batches(spark, root, "forms").groupBy("form").agg(F.sum("n").alias("n")))


def write_batch(df: DataFrame, root: str, table: str, batch: str) -> None:
    df.write.mode("overwrite").parquet(os.path.join(root, table, f"batch={batch}"))


def new_titles(df: DataFrame, cleaned: DataFrame | None, batch: str) -> DataFrame:
    """One article per title, without the titles of other batches."""
    first = F.min_by(F.struct("page_id", "wikitext"), F.struct("page_id", F.md5("wikitext")))
    one = df.where("title is not null").groupBy("title").agg(first.alias("a")).select("title", "a.*")
    if cleaned is None:
        return one
    return one.join(cleaned.where(F.col("batch") != batch).select("title"), "title", "left_anti")


def clean_new(spark: SparkSession, raw_dir: str, root: str, query_name: str = "prepare_articles",
              max_files: int | None = None):
    """Step 1: clean the articles of new files (starts and waits for the query)."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", query_name)
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def run(df: DataFrame, epoch: int) -> None:
        # the id of the checkpoint: a new checkpoint never writes over the batches of an old one
        query = spark.read.json(os.path.join(ckpt, "metadata")).first()["id"]
        batch = f"{query}-{epoch}"
        new = new_titles(df, read_batches(spark, root, "clean"), batch)
        write_batch(text.clean_articles(new), root, "clean", batch)
        written = spark.read.parquet(os.path.join(root, "clean", f"batch={batch}"))
        write_batch(text.form_counts(text.sentences(written)), root, "forms", batch)

    q = (reader.parquet(raw_dir).writeStream.queryName(query_name).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).foreachBatch(run).start())
    q.awaitTermination()
    return q


def stale_batches(forms: DataFrame, done: DataFrame) -> DataFrame:
    """Prepared batches with a capitalised form whose lower-case form occurs in
    pending batches only: its lemma has changed."""
    seen = forms.join(done, "batch", "left_semi")
    lower = forms.where(F.col("form") == F.lower("form"))
    fresh = lower.join(done, "batch", "left_anti").select("form").distinct() \
        .join(seen.select("form").distinct(), "form", "left_anti")
    changed = seen.where(F.col("form") != F.lower("form")) \
        .join(fresh.select(F.col("form").alias("low")), F.lower("form") == F.col("low"), "left_semi")
    return changed.select("batch").distinct()


def prepare_pending(spark: SparkSession, root: str, catalog: DataFrame, lexicon: DataFrame | None = None,
                    refresh: bool = True) -> int:
    """Step 2: tag and write the batches that need it; returns their number.
    With a ``lexicon`` of one's own no earlier batch changes."""
    clean = read_batches(spark, root, "clean")
    if clean is None:
        return 0
    all_batches = read_batches(spark, root, "forms").select("batch").union(clean.select("batch")).distinct()
    written = read_batches(spark, root, "sentences")
    if written is None:
        pending = all_batches
    else:
        done = written.select("batch").distinct()
        pending = all_batches.join(done, "batch", "left_anti")
        if refresh and lexicon is None:
            pending = pending.union(stale_batches(read_batches(spark, root, "forms"), done))
    names = [r.batch for r in pending.collect()]        # one short name per micro-batch
    if not names:
        return 0
    part = clean.where(F.col("batch").isin(names))
    lx, unique = (read_lexicon(spark, root), True) if lexicon is None else (lexicon, False)
    out = text.prepare_clean(part.drop("batch"), catalog, lx, unique)
    out.join(part.select("title", "batch"), "title").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(os.path.join(root, "sentences"))
    return len(names)


def prepare_stream(spark: SparkSession, raw_dir: str, root: str, catalog: DataFrame,
                   lexicon: DataFrame | None = None, query_name: str = "prepare_articles",
                   max_files: int | None = None, refresh: bool = True):
    """Clean the new articles of ``raw_dir`` and bring the sentences under
    ``root`` up to date; ``read_sentences`` reads them."""
    q = clean_new(spark, raw_dir, root, query_name, max_files)
    prepare_pending(spark, root, catalog, lexicon, refresh)
    return q
