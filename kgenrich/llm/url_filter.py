"""URL filter by expression digests.

Every URL is expanded into host-suffix + path-prefix expressions; the
expressions meet the rules in an equi-join on the first 4 bytes of their
SHA-256 digest, full digests confirm, and the longest matching rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, broadcast_if

PREFIX_HEX = 8          # short hash prefix: 4 bytes
BROADCAST_RULES = 500_000


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (after the first ``://`` up to ``/ ? #``, A-Z lower-cased)
    and ``path`` (then up to ``? #``); both empty for a null URL or one without
    ``://``."""
    u = F.col(url)
    i = F.instr(u, "://")
    rest = F.when(i > 0, F.substring(u, i + 3, F.length(u))).otherwise(F.lit(None))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules(verdict, host, path)`` -> digests and shapes. Rules with a null
    or empty host never match and are left out; a host is lower-cased (A-Z)."""
    r = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        "verdict", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    expr = F.concat("host", "path")
    return r.select("verdict", expr.alias("rule"), F.length(expr).alias("len"),
                    F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
                    F.sha2(expr, 256).alias("digest")).distinct()


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains when the URL's path starts with
    the rule's path; the longest fitting rule wins, ``block`` before ``allow``
    on the same expression. No fitting rule: ``rule`` null, ``verdict`` the
    default. Null and odd URLs get an empty host and the default. Repeated rows
    stay repeated; input columns called like an output column are replaced.
    Only the (label count, path length) shapes that occur among the rules are
    expanded (the driver reads these distinct pairs of small numbers), so a
    host of any depth costs a bounded number of expressions."""
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    parts = with_host_path(pages, url)
    r = rule_table(rules)
    shapes = [tuple(x) for x in r.select("labels", "path_len").distinct().collect()]
    hosts = parts.where(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # one expression per (label count, path length) shape that the URL can have
    shape = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_len")) for a, b in shapes]) \
        if shapes else F.array().cast("array<struct<labels:int,path_len:int>>")
    e = hosts.withColumn("s", F.explode(shape)).select("host", "path", "s.labels", "s.path_len") \
        .where((F.size(labels) >= F.col("labels")) & (F.length("path") >= F.col("path_len")))
    expr = F.concat(F.array_join(F.slice(labels, -F.col("labels"), F.col("labels")), "."),
                    F.substring(F.col("path"), F.lit(1), F.col("path_len")))
    e = e.select("host", "path", F.sha2(expr, 256).alias("url_digest"))
    e = e.withColumn("prefix", F.substring("url_digest", 1, PREFIX_HEX))
    r = broadcast_if(r.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
                     .drop("labels", "path_len"), BROADCAST_RULES)
    hit = e.join(r, "prefix").where(F.col("url_digest") == F.col("digest"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(
        "len", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return parts.join(best, ["host", "path"], "left") \
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
