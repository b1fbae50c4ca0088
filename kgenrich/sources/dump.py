"""A1-A3 encyclopedia dump scans; B2-B4 article and plain-corpus sinks; P4.

The dump is read with Spark's XML source (``rowTag=page``, explicit schema,
any Hadoop codec such as bz2). Keeping only catalog titles is a semi join;
"a later page with the same stored name overwrites an earlier one" is a
``max_by`` on the place in the dump, a partial aggregation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.text import clean_articles
from ..session import checkpoint_dir

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("ns", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("revision", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())])),
    ])),
])


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Pages ``(title, page_id, wikitext, ord)``; ``ord`` is the place in the
    dump: file, block offset, and the row's number in its task, which reads a
    block from front to back. It orders pages alike however Spark groups files
    and blocks into tasks. A single compressed file may be one split:
    ``partitions`` spreads the rows right after the scan."""
    df = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    df = df.select("title", F.col("id").alias("page_id"),
                   F.col("revision.text._VALUE").alias("wikitext"),
                   F.struct(F.col("_metadata.file_path").alias("file"),
                            F.col("_metadata.file_block_start").alias("block"),
                            F.monotonically_increasing_id().alias("row")).alias("ord"))
    return df.repartition(partitions) if partitions else df


def xml_pages(pages: DataFrame) -> Column:
    """The ``<page>`` element of ``(title, page_id, wikitext)`` rows."""
    def safe(c):
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(raw), F.lit(name))
        return c
    return F.concat(F.lit("<page><title>"), safe(pages["title"]), F.lit("</title><ns>0</ns><id>"),
                    pages["page_id"].cast("string"), F.lit('</id><revision><text xml:space="preserve">'),
                    safe(pages["wikitext"]), F.lit("</text></revision></page>"))


def write_dump(pages: DataFrame, path: str, order: str, files: int = 4) -> None:
    """A dump of about ``files`` bz2 parts, pages in ``order`` over all of them;
    every part is a whole XML document."""
    def document(batches):
        yield pa.RecordBatch.from_pydict({"value": ["<mediawiki>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</mediawiki>"]})

    pages.repartitionByRange(files, order).sortWithinPartitions(order) \
        .select(xml_pages(pages).alias("value")).mapInArrow(document, "value string") \
        .write.option("compression", "bzip2").text(path)


def articles_from_dump(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """A1: ``articles(title, page_id, wikitext, stored_name)`` for catalog
    titles (spaces -> ``_``); ``/`` -> ``_`` in the stored name; the later of
    two pages with the same stored name wins. Unlike the original, the
    article stays reachable under its own title."""
    p = pages.withColumn("title", F.replace(F.col("title"), F.lit(" "), F.lit("_")))
    p = p.join(catalog.select(F.col("name").alias("title")), "title", "left_semi")
    p = p.withColumn("stored_name", F.replace(F.col("title"), F.lit("/"), F.lit("_")))
    best = p.groupBy("stored_name").agg(F.max_by(F.struct("title", "page_id", "wikitext"), "ord").alias("a"))
    return best.select("a.title", "a.page_id", "a.wikitext", "stored_name")


def normalise_headings(text: Column) -> Column:
    """Heading lines ``== x ==`` -> ``==x==``."""
    return F.regexp_replace(text, r"(?m)^=[= ]*(.*?)[= ]*$", "==$1==")


def plain_pages(pages: DataFrame) -> DataFrame:
    """A2: namespace pages (title with ``:``) and single-line pages dropped,
    headings normalised, the text headed by ``++title++``."""
    p = pages.where(~F.col("title").contains(":") & F.col("wikitext").contains("\n"))
    return p.select("title", "page_id", F.concat(F.lit("++"), F.col("title"), F.lit("++\n"),
                                                 normalise_headings(F.col("wikitext"))).alias("wikitext"))


def requested(articles: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A3: requested titles -> (found articles, names without an article)."""
    n = names.select(F.col(names.columns[0]).alias("title")).distinct()
    return articles.join(n, "title", "left_semi"), n.join(articles.select("title"), "title", "left_anti")


def doc_url(title: Column, prefix: str) -> Column:
    """B4 URL: spaces -> ``_``, percent-quoted with ``(``, ``)``, ``/`` left raw,
    first character upper-cased."""
    q = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in [("%28", "("), ("%29", ")"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")]:
        q = F.replace(q, F.lit(a), F.lit(b))
    return F.concat(F.lit(prefix), F.upper(F.left(q, F.lit(1))), F.substring(q, 2, 1 << 30))


def doc_records(clean: DataFrame, prefix: str = "http://pl.wikipedia.org/wiki/") -> DataFrame:
    """``<doc id="N" url="U">\\ntext\\n</doc>`` text records."""
    rec = F.format_string('<doc id="%d" url="%s">\n%s\n</doc>', F.col("page_id"),
                          doc_url(F.col("title"), prefix), F.col("text"))
    return clean.select("page_id", rec.alias("value"))


FILES_A_FOLDER = 100
RUN_BYTES = 256 << 20       # records that one task puts in order


def file_places(records: DataFrame, order: str, max_bytes: int) -> DataFrame:
    """``records`` with ``file``: the number of the file that a record goes to. A
    file holds the records that start in its ``max_bytes`` of the whole text, in
    ``order``, so it exceeds the bound by less than one record. The running sum
    of bytes is taken within ranges of ``order`` (of about RUN_BYTES, cut at
    quantiles) and starts at the sum of the ranges before. ``order`` is numeric;
    equal values are ordered by their record."""
    size = F.coalesce(F.octet_length("value"), F.lit(0)) + 1
    total = records.agg(F.sum(size)).first()[0] or 0
    ranges = max(1, -(-total // RUN_BYTES))
    cuts = sorted(set(records.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(order).cast("double")))
    sized = records.withColumn("__range", at).withColumn("__size", size.cast("long"))
    sums, start = {r["__range"]: r["n"] for r in sized.groupBy("__range").agg(F.sum("__size").alias("n")).collect()}, {}
    before = 0
    for r in sorted(sums):
        start[r], before = before, before + sums[r]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("__range")) if start else F.lit(0)
    w = Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_first(), "value") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = base + F.sum("__size").over(w) - F.col("__size")
    return sized.withColumn("__begin", begin).withColumn("file", F.floor(F.col("__begin") / max_bytes).cast("long")) \
        .drop("__range", "__size")


def write_corpus(records: DataFrame, path: str, order: str = "page_id", max_bytes: int = 1 << 20,
                 compress: bool = False, mode: str = "overwrite") -> None:
    """The records in order, as text files of at most ``max_bytes`` plus a
    part of one record (before compression), 100 files a folder
    (``folder=N/file=M``), optionally bz2. ``records`` has ``value`` and
    the numeric column ``order``; every task writes whole files, one after another."""
    placed = file_places(records.select("value", order), order, max_bytes)
    last = placed.agg(F.max("file")).first()[0] or 0
    w = placed.withColumn("folder", F.floor(F.col("file") / FILES_A_FOLDER)) \
        .repartitionByRange(min(last + 1, 1 + last * max_bytes // RUN_BYTES + 8), "file") \
        .sortWithinPartitions("folder", "file", "__begin").select("folder", "file", "value") \
        .write.mode(mode).partitionBy("folder", "file")
    if compress:
        w = w.option("compression", "bzip2")
    w.text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, file, value)``: the whole text of every file of a written corpus."""
    return spark.read.text(path, wholetext=True).select("folder", "file", "value")


def write_articles(articles: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Articles as parquet, clustered by a hash of the title (no small
    files; lookups by title read one bucket folder)."""
    a = articles.withColumn("bucket", F.pmod(F.xxhash64("title"), F.lit(buckets)))
    a.repartition(buckets, "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def plain_corpus(pages: DataFrame, out: str | None = None, max_bytes: int = 1 << 20,
                 compress: bool = False) -> DataFrame:
    """Dump pages -> clean ``<doc>`` records ``(page_id, value)`` (written when ``out``)."""
    clean = clean_articles(plain_pages(pages).select("title", "page_id", "wikitext"))
    recs = doc_records(clean)
    if out:
        checkpoint_dir(recs.sparkSession)
        recs = recs.checkpoint()        # cleaned once; the sink reads the records several times
        write_corpus(recs, out, "page_id", max_bytes, compress)
    return recs


def prepare_corpus_from_dump(spark: SparkSession, path: str, catalog: DataFrame,
                             partitions: int | None = None) -> DataFrame:
    """Catalog -> dump scan -> articles of catalog entities."""
    return articles_from_dump(read_dump(spark, path, partitions), catalog)


__all__ = ["read_dump", "write_dump", "read_corpus", "articles_from_dump", "plain_pages", "requested", "doc_records",
           "write_corpus", "write_articles", "plain_corpus", "prepare_corpus_from_dump"]
