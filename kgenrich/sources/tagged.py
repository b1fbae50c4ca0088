"""A8-A10 tagged-corpus scans, B6 CoNLL sink, B7 CRF feature-file sink, F3.

A8: XCES morphosyntactic XML (``chunk type="s"`` / ``tok`` / ``orth`` /
``lex disamb``) via the XML source (``rowTag=chunk``, outermost chunks);
a token without a disambiguated reading keeps its form as lemma and tag
``ign``. A9: the same with the innermost enclosing ``group`` type as the
parse label (three nesting levels). A10: CoNLL blocks (one sentence per
blank-line-separated record, headed by a ``# sent_id = title/n`` comment that
our sink writes), joined back to sentences on (title, sent_id, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import tags as tg

LEX = T.ArrayType(T.StructType([
    T.StructField("_disamb", T.StringType()), T.StructField("base", T.StringType()),
    T.StructField("ctag", T.StringType())]))
TOK = T.ArrayType(T.StructType([T.StructField("orth", T.StringType()), T.StructField("lex", LEX)]))
SENT = T.StructType([T.StructField("_type", T.StringType()), T.StructField("tok", TOK)])
PARA_SCHEMA = T.StructType([
    T.StructField("_type", T.StringType()),
    T.StructField("chunk", T.ArrayType(SENT)),
    T.StructField("tok", TOK),
])


def _word_from_tok(t: Column, parse: Column | None = None) -> Column:
    chosen = F.get(F.filter(t["lex"], lambda x: x["_disamb"].isNotNull()), 0)
    return F.struct(t["orth"].alias("segment"),
                    F.coalesce(chosen["base"], t["orth"]).alias("lemma"),
                    F.coalesce(chosen["ctag"], F.lit("ign")).alias("tag"),
                    (parse if parse is not None else F.lit("")).alias("parse"))


def read_xces(spark: SparkSession, path: str) -> DataFrame:
    """``sentences(title, sent_id, words)``; the title is the file name.
    Sentences are numbered in document order (paragraph scan order, then
    position); a window per article is bounded by the article's length."""
    df = spark.read.format("xml").option("rowTag", "chunk").schema(PARA_SCHEMA).load(path)
    title = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)*$", 1)
    sents = df.select(title.alias("title"), F.monotonically_increasing_id().alias("para"),
                      F.posexplode_outer(F.filter("chunk", lambda c: c["_type"] == "s")).alias("si", "s")) \
        .where(F.col("s").isNotNull())
    w = Window.partitionBy("title").orderBy("para", "si")
    return sents.select("title", (F.row_number().over(w) - 1).alias("sent_id"),
                        F.transform("s.tok", _word_from_tok).alias("words"))


def conll_lines(sentences: DataFrame) -> DataFrame:
    """One record per sentence: ``# sent_id = title/n`` then
    ``id segment lemma pos pos features`` lines (tab separated)."""
    def line(w, i):
        return F.concat_ws("\t", (i + 1).cast("string"), w["segment"], w["lemma"],
                           tg.coarse_tag(w["tag"]), tg.coarse_tag(w["tag"]), tg.morph_features(w["tag"]))
    body = F.array_join(F.transform("words", line), "\n")
    return sentences.select(F.concat(F.lit("# sent_id = "), F.col("title"), F.lit("/"),
                                     F.col("sent_id").cast("string"), F.lit("\n"), body).alias("value"))


def write_conll(sentences: DataFrame, path: str) -> None:
    conll_lines(sentences).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """A10: ``(title, sent_id, pos, label)`` with the dependency label (8th column)."""
    recs = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    lines = F.split(F.trim("value"), "\n")
    head = F.regexp_extract(F.get(lines, 0), r"^# sent_id = (.*)/(\d+)$", 0)
    r = recs.select(F.regexp_extract(F.get(lines, 0), r"^# sent_id = (.*)/(\d+)$", 1).alias("title"),
                    F.regexp_extract(F.get(lines, 0), r"^# sent_id = (.*)/(\d+)$", 2).cast("int").alias("sent_id"),
                    F.when(head != "", F.slice(lines, 2, 1 << 20)).otherwise(lines).alias("rows"))
    t = r.select("title", "sent_id", F.posexplode("rows").alias("pos", "row"))
    return t.select("title", "sent_id", "pos",
                    F.coalesce(F.get(F.split("row", "\t"), 7), F.lit("")).alias("label"))


def with_parse(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """set each word's ``parse`` from ``(title, sent_id, pos, label)``."""
    per = labels.groupBy("title", "sent_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "label"))).alias("__m"))
    j = sentences.join(per, ["title", "sent_id"], "left")
    words = F.transform("words", lambda w, i: w.withField(
        "parse", F.coalesce(F.element_at(F.col("__m"), i), F.lit(""))))
    return j.select("title", "sent_id", words.alias("words"))


def feature_file_lines(sentences: DataFrame, feats_col: str = "feats",
                       labels_col: str | None = "labels") -> DataFrame:
    """One record per sentence, one line per token: the label (when given)
    then ``name=value`` features, tab separated."""
    def line(fs, i):
        body = F.array_join(fs, "\t")
        if labels_col is None:
            return body
        return F.concat_ws("\t", F.get(F.col(labels_col), i).cast("string"), body)
    return sentences.select(F.array_join(F.transform(feats_col, line), "\n").alias("value"))


def write_feature_file(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("lineSep", "\n\n").text(path)


def _parse_shallow(text: str):
    """One shallow-parse document -> [(sent_id, [(segment, lemma, tag, parse)])];
    ``parse`` is the type of the innermost enclosing ``group``."""
    import io
    import xml.etree.ElementTree as ET

    out, sentence, groups = [], [], []
    for event, el in ET.iterparse(io.StringIO(text), events=("start", "end")):
        tag = el.tag.rsplit("}", 1)[-1]
        if tag == "group":
            if event == "start":
                groups.append(el.get("type", ""))
            else:
                groups.pop()
            continue
        if event != "end":
            continue
        if tag == "chunk" and el.get("type") == "s":
            out.append((len(out), sentence))
            sentence = []
        elif tag == "tok":
            orth = el.findtext("orth") or ""
            lemma, ctag = orth, "ign"
            for lex in el.findall("lex"):
                if lex.get("disamb") is not None:
                    lemma, ctag = lex.findtext("base") or orth, lex.findtext("ctag") or "ign"
                    break
            sentence.append((orth, lemma, ctag, groups[-1] if groups else ""))
            el.clear()
    return out


SHALLOW_SCHEMA = ("title string, sent_id int, "
                  "words array<struct<segment:string,lemma:string,tag:string,parse:string>>")


def read_shallow(spark: SparkSession, path: str) -> DataFrame:
    """Shallow-parse XML (tokens nested in ``group`` elements) ->
    ``sentences(title, sent_id, words)`` with the innermost group type as
    ``parse``. Tokens and groups interleave, an order the XML source does not
    keep, so each file (one article) is parsed by a small helper on the
    executors; files are the unit of parallelism."""
    import pandas as pd

    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)*$", 1).alias("title"),
        "value")

    def parse(it):
        for pdf in it:
            rows = []
            for title, text in zip(pdf["title"], pdf["value"]):
                for sid, words in _parse_shallow(text):
                    rows.append((title, sid, [dict(zip(("segment", "lemma", "tag", "parse"), w))
                                              for w in words]))
            yield pd.DataFrame(rows, columns=["title", "sent_id", "words"])

    return files.mapInPandas(parse, SHALLOW_SCHEMA)
