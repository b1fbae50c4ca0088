"""Line dedup over a suffix array of line-ID sequences, by prefix doubling.

Lines are numbered by a 64-bit id. The suffix starting at a line is ranked by its
first line, then by its first 2, 4, 8, ... lines: Spark groups the rank pairs
``(rank(i), rank(i + h))`` and gives every distinct pair a new rank, and positions
whose pair is unique leave. A class of positions is an interval of the suffix
array with a common prefix of a least length; a prefix of ``n`` lines, with
``h < n <= 2 h``, is the pair of the ranks of its first and of its last ``h`` lines.
Runs of such positions are the repeated line runs, and all copies but the first
are deleted.

The least length is counted in bytes: the prefix takes as many lines, from one up,
as reach it. A line has at least one byte, its newline, so ranks are doubled until
they span that many lines. Lines that lie in no such prefix of several lines are
ranked by themselves only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

MIN_LINES = 1           # a run may be one line
MIN_BYTES = 12          # bytes of a run, each line with its newline


def _run(pos: Column, n: Column) -> Column:
    return F.struct(pos.alias("pos"), n.alias("n_lines"))


def _byte_runs(min_bytes: int) -> Column:
    """The shortest runs that reach ``min_bytes`` from and up to every line: any
    run that reaches it is covered by those inside it. A line counts its newline,
    so no such run has more than ``min_bytes`` lines. A shorter text is one run,
    compared with whole texts only."""
    def reach(sizes):
        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"))
        return F.aggregate(sizes, zero, lambda a, x: F.when(a["size"] >= min_bytes, a).otherwise(
            F.struct((a["size"] + x).alias("size"), (a["n"] + 1).alias("n"))))

    def run_from(size, i):
        r = reach(F.slice("sizes", i + 1, min_bytes))
        return F.when(size >= min_bytes, _run(i, F.lit(1))).when(r["size"] >= min_bytes, _run(i, r["n"]))

    def run_to(size, i):            # without those that run_from gives as well
        low = F.greatest(i - min_bytes + 1, F.lit(0))
        r = reach(F.reverse(F.slice("sizes", low + 1, i - low + 1)))
        return F.when((size < min_bytes) & (r["size"] - size >= min_bytes), _run(i - r["n"] + 1, r["n"]))

    return F.when(F.col("whole"), F.when(F.col("inked"), F.array(_run(F.lit(0), F.size("ids"))))) \
        .otherwise(F.filter(F.concat(F.transform("sizes", run_from), F.transform("sizes", run_to)), lambda r: r.isNotNull()))


def _line_runs(docs: DataFrame, min_lines: int, min_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The lines that lie in runs of the least length, ``(doc_id, row_key, pos,
    line, single, inner)``: whether a line is such a run itself and whether it lies
    in one of several lines; and those of several lines, ``(doc_id, row_key, pos, n_lines)``."""
    lines = F.split(text_col, "\n", -1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"),
                    (F.octet_length(text_col) + 1 < min_bytes).alias("whole"), F.col(text_col).rlike(r"\S").alias("inked"),
                    F.transform(lines, lambda x: F.xxhash64(x)).alias("ids"),
                    F.transform(lines, lambda x: F.octet_length(x) + 1).alias("sizes"))
    if min_lines < 2:
        runs = _byte_runs(min_bytes)
        # the ids of a short text are its own and those of its exact copies
        ids = F.when(F.col("whole"), F.transform("ids", lambda x: F.xxhash64(x, F.size("ids")))).otherwise(F.col("ids"))
    else:
        runs = F.when(F.size("ids") >= min_lines, F.transform(
            F.sequence(F.lit(0), F.size("ids") - min_lines), lambda i: _run(i, F.lit(min_lines))))
        ids = F.col("ids")
    d = d.select("doc_id", "row_key", ids.alias("ids"), runs.alias("runs")).where(F.size("runs") > 0)
    d = d.select("doc_id", "row_key", "ids", F.filter("runs", lambda r: r["n_lines"] > 1).alias("runs"),
                 F.transform(F.filter("runs", lambda r: r["n_lines"] == 1), lambda r: r["pos"]).alias("singles"))
    inner = F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["n_lines"] - 1)))
    d = d.select("doc_id", "row_key", "ids", "runs", "singles", F.array_distinct(inner).alias("inner"))

    def line(single, inner):
        return lambda i: F.struct(i.alias("pos"), F.get("ids", i).alias("line"),
                                  F.lit(single).alias("single"), F.lit(inner).alias("inner"))

    d = d.select("doc_id", "row_key", "runs", F.concat(
        F.transform(F.array_except("singles", "inner"), line(True, False)),
        F.transform(F.array_intersect("inner", "singles"), line(True, True)),
        F.transform(F.array_except("inner", "singles"), line(False, True))).alias("lines"))
    d = materialise(d, "line-runs")
    return (d.select("doc_id", "row_key", F.explode("lines").alias("l")).select("doc_id", "row_key", "l.*"),
            d.select("doc_id", "row_key", F.explode("runs").alias("r")).select("doc_id", "row_key", "r.*"))


def _rerank(pairs: DataFrame, *pair: str) -> DataFrame:
    """The positions whose pair occurs again, with the place of the pair's first
    occurrence in the order of (doc_id, row_key, position), ``first``, which names
    its new rank. Counts are combined before the exchange, and the classes are
    written out: the join then has exchanges of its own, of which Spark splits the
    partition of a line that stands everywhere."""
    place = F.struct("doc_id", "row_key", "pos")
    classes = materialise(pairs.groupBy(*pair).agg(F.count("*").alias("n"), F.min(place).alias("first"))
                          .where("n > 1").drop("n"), "line-classes")
    return pairs.join(classes, list(pair))


def _rank(ranks: DataFrame, pos: str, name: str) -> DataFrame:
    return ranks.select("row_key", F.col("pos").alias(pos), F.struct("first.row_key", "first.pos").alias(name)).distinct()


def _paired(runs: DataFrame, ranks: DataFrame, h: int) -> DataFrame:
    """Runs of ``h`` to ``2 h`` lines with the ranks of their first and last ``h``
    lines; a run with a part that occurs once only leaves."""
    ends = runs.withColumn("tail", F.col("pos") + F.col("n_lines") - h)
    return materialise(ends.join(_rank(ranks, "pos", "left"), ["row_key", "pos"])
                       .join(_rank(ranks, "tail", "right"), ["row_key", "tail"])
                       .select("doc_id", "row_key", "pos", "n_lines", "left", "right"), "line-pairs")


def repeated_starts(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                    text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Suffixes that share a run with another one: ``(doc_id, row_key, pos,
    n_lines, first)``, ``first`` the first place of the class. The run has at
    least ``min_bytes`` bytes, or ``min_lines`` lines when those are two or more."""
    lines, runs = _line_runs(docs, min_lines, min_bytes, id_col, text_col)
    ranks = _rerank(lines, "line")
    found = ranks.where("single").select("doc_id", "row_key", "pos", F.lit(1).alias("n_lines"), "first")
    most = min_bytes if min_lines < 2 else min_lines
    if most > 1:
        ranks = materialise(ranks.where("inner").select("doc_id", "row_key", "pos", "first"), "lines")
    h = 1
    while h < most:
        due = _paired(runs.where(F.col("n_lines").between(h + 1, 2 * h)), ranks, h)
        found = found.unionByName(_rerank(due, "n_lines", "left", "right").select(*found.columns))
        if 2 * h < most:
            ranks = _doubled(ranks, h)
        h *= 2
    return found


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    """The ranks by the first ``2 h`` lines from those by the first ``h``."""
    pairs = _paired(ranks.select("doc_id", "row_key", "pos", F.lit(2 * h).alias("n_lines")), ranks, h)
    return materialise(_rerank(pairs, "left", "right").select("doc_id", "row_key", "pos", "first"), "lines")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id",
               text_col: str = "text", with_text: bool = False, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per input row: ``(doc_id, n_lines, n_removed, n_runs, kept_sha256)``
    and, on request, ``text`` without the deleted lines.

    Lines are what stands between newlines. A line is deleted when it lies in
    consecutive lines of its text, one or more, that occur earlier and have
    ``min_bytes`` bytes together (a newline counts with each line), or in a text
    under ``min_bytes`` that is not blank and an exact copy of an earlier one.
    With ``min_lines`` of two or more, runs of that many lines count instead,
    whatever their bytes. Earlier means a smaller (doc_id, hash of the row, line
    number); the first copy stays whole, and copies may overlap. Null text: no lines, null digest; empty
    text: one empty line. Rows that repeat in full are one text and are returned
    as often as they occur; null ids come first in the order."""
    starts = repeated_starts(docs, min_lines, id_col, text_col, min_bytes)
    later = starts.where((F.col("first.row_key") != F.col("row_key")) | (F.col("first.pos") != F.col("pos"))) \
        .groupBy("row_key", "pos").agg(F.max(F.col("pos") + F.col("n_lines")).alias("end"))
    w = Window.partitionBy("row_key").orderBy("pos")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new_run = (F.col("pos") > F.coalesce(before, F.lit(-1))).cast("int")
    runs = later.withColumn("run", F.sum(new_run).over(w)).groupBy("row_key", "run") \
        .agg(F.min("pos").alias("lo"), F.max("end").alias("hi"))
    spans = runs.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row_key"))
    d = d.join(spans, "row_key", "left").withColumn("lines", F.split("text", "\n", -1))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    runs = F.coalesce("runs", none)
    removed = F.aggregate(runs, F.lit(0), lambda a, r: a + (r["hi"] - r["lo"]).cast("int"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    # the kept stretches lie between the runs
    ends = F.concat(F.transform(runs, lambda r: r["lo"]), F.array(n))
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["hi"]))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(F.col("lines"), b + 1, F.greatest(e - b, F.lit(0)))))
    text = F.when(F.size(runs) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = d.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
                   removed.cast("long").alias("n_removed"), F.size(runs).cast("long").alias("n_runs"), text.alias("text"))
    out = out.withColumn("kept_sha256", F.sha2("text", 256))
    return out if with_text else out.drop("text")
