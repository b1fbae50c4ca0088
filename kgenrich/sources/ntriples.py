"""A5-A7 triple scans and the B1 N-Triples sink.

``read_ntriples`` parses ``<s> <p> <o> .`` / ``<s> <p> "lit"@lang .`` /
``<s> <p> "lit"^^<dt> .`` lines with one ``regexp_extract`` per field (no
UDF), stripping the resource/property prefixes and percent-decoding names.
``write_triples`` stores parquet partitioned by ``p`` so a relation filter
prunes whole folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.iri import DATA_SOURCE, local_name, property_iri, resource_iri, strip_any_prefix

# No repeated group (Java recurses per repetition): a literal runs to the last
# quote that the rest of the line allows.
NT_RE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"(.*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
XSD_INT = "http://www.w3.org/2001/XMLSchema#int"
TRIPLES_SCHEMA = "s string, p string, o string, o_kind string, datatype string, lang string"


# Escape, character (N-Triples string escapes); the backslash itself goes first
# when written and last, through a placeholder, when read.
ESCAPES = [('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")]
_HOLD = "\x00"


def escape(value: Column) -> Column:
    v = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for esc, ch in ESCAPES:
        v = F.replace(v, F.lit(ch), F.lit(esc))
    return v


def unescape(value: Column) -> Column:
    v = F.replace(value, F.lit("\\\\"), F.lit(_HOLD))
    for esc, ch in ESCAPES:
        v = F.replace(v, F.lit(esc), F.lit(ch))
    return F.replace(v, F.lit(_HOLD), F.lit("\\"))


def rejected_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines that ``parse_ntriples`` leaves out, but for blank and comment lines."""
    return lines.where(~F.col(col).rlike(NT_RE) & ~F.col(col).rlike(r"^\s*(#.*)?$"))


def parse_ntriples(lines: DataFrame, col: str = "value", source: str = DATA_SOURCE) -> DataFrame:
    """``value`` text lines -> ``triples(s, p, o, o_kind, datatype, lang)`` (M1)."""
    x = lambda i: F.regexp_extract(F.col(col), NT_RE, i)
    ok = F.col(col).rlike(NT_RE)
    o_iri, o_lit = x(3), x(4)
    is_iri = o_iri != ""
    parsed = lines.where(ok).select(
        local_name(x(1), source).alias("s"),
        strip_any_prefix(x(2)).alias("p"),
        F.when(is_iri, local_name(o_iri, source))
         .otherwise(unescape(o_lit))
         .alias("o"),
        F.when(is_iri, "iri").otherwise("literal").alias("o_kind"),
        F.when(x(6) != "", x(6)).alias("datatype"),
        F.when(x(5) != "", x(5)).alias("lang"))
    return parsed


def read_ntriples(spark: SparkSession, path: str, source: str = DATA_SOURCE) -> DataFrame:
    """A5: N-Triples text files (any Hadoop-readable compression)."""
    return parse_ntriples(spark.read.text(path), source=source)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Parquet triples (partitioned by ``p``)."""
    return spark.read.parquet(path)


def write_triples(triples: DataFrame, path: str, mode: str = "overwrite", files: int = 16) -> None:
    """Triples as parquet partitioned by predicate (partition pruning on ``p``);
    a predicate's rows go to up to ``files`` tasks by subject."""
    triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(files))).write.mode(mode).partitionBy("p").parquet(path)


def ntriple_lines(values: DataFrame, p: str, numeric: bool, lang: str = "pl",
                  source: str = DATA_SOURCE, entity_col: str = "entity",
                  value_col: str = "value") -> DataFrame:
    """B1: ``<res> <prop> "v"^^<xsd:int> .`` for numeric relations, ``"v"@lang .``
    otherwise; empty values skipped; duplicate lines dropped."""
    v = escape(F.col(value_col))
    obj = (F.concat(F.lit('"'), v, F.lit(f'"^^<{XSD_INT}>')) if numeric
           else F.concat(F.lit('"'), v, F.lit(f'"@{lang}')))
    line = F.concat_ws(" ", F.concat(F.lit("<"), resource_iri(F.col(entity_col), source), F.lit(">")),
                       F.concat(F.lit("<"), property_iri(F.lit(p), source), F.lit(">")), obj, F.lit("."))
    return values.where(v.isNotNull() & (v != "")).select(line.alias("value")).dropDuplicates()


def write_ntriples(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)
