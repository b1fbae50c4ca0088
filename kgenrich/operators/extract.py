"""I1-I3 token features and labels, I7-I15 span decoding and value selection.

A sentence stays one row: window features and span decoding are
higher-order functions over its word array (no shuffle). Choosing one value
per entity is a partial aggregation (``max_by`` on a priority struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EXTRACTOR_CONFIDENCE, RECENT_YEAR, WINDOW, RelationSpec
from ..functions import tags as tg
from ..functions.values import is_numeric, truncate_numeric


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "1").otherwise("0")


def token_features(w: Column, lo: int = RECENT_YEAR[0], hi: int = RECENT_YEAR[1],
                   use_parse: bool = False, normalised: bool = False) -> Column:
    """Per-token features ``name=value``."""
    lemma = w["lemma"] if normalised else truncate_numeric(w["lemma"])
    tag = w["tag"]
    as_int = F.when(lemma.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(lemma).cast("bigint"))
    items = [
        ("segment", w["segment"]), ("tag", tg.coarse_tag(tag)), ("case", tg.case(tag)),
        ("number", tg.number(tag)), ("gender", tg.gender(tag)), ("person", tg.person(tag)),
        ("aspect", tg.aspect(tag)), ("lemma", lemma),
        ("recent_year", _flag(as_int.between(lo, hi))),
        ("alldigits", _flag(lemma.rlike(r"^[0-9]+$"))),
        ("allalpha", _flag(lemma.rlike(r"^\p{L}+$"))),
        ("starts_with_capital", _flag(lemma.rlike(r"^\p{Lu}"))),
        ("segm_starts_with_capital", _flag(w["segment"].rlike(r"^\p{Lu}"))),
        ("numeric", _flag(is_numeric(lemma))),
        ("len", F.length(lemma).cast("string")),
    ]
    if use_parse:
        items.append(("parse", w["parse"]))
    return F.array(*[F.concat(F.lit(f"{n}="), F.coalesce(v, F.lit(""))) for n, v in items])


def base_features(words: Column, use_parse: bool = False) -> Column:
    """Per-token feature arrays (materialise as a column before windowing)."""
    norm = F.transform(words, lambda w: F.struct(
        w["segment"].alias("segment"), truncate_numeric(w["lemma"]).alias("lemma"),
        w["tag"].alias("tag"), w["parse"].alias("parse")))
    return F.transform(norm, lambda w: token_features(w, use_parse=use_parse, normalised=True))


def with_window_features(df: DataFrame, words_col: str = "words", out: str = "feats",
                         window: int = WINDOW, use_parse: bool = False) -> DataFrame:
    """I1 on a DataFrame: base features as their own projection, then windows."""
    df = df.withColumn("__base", base_features(F.col(words_col), use_parse))
    return df.withColumn(out, window_of(F.col("__base"), window)).drop("__base")


def window_of(base: Column, window: int = WINDOW) -> Column:
    """Offsets -w..w of per-token feature arrays, prefixed by the offset."""
    n = F.size(base)

    def at(i):
        offs = F.filter(F.sequence(F.lit(-window), F.lit(window)),
                        lambda j: (i + j >= 0) & (i + j < n))
        return F.flatten(F.transform(offs, lambda j: F.transform(
            F.get(base, i + j), lambda f: F.concat(j.cast("string"), f))))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)) \
        .otherwise(F.array().cast("array<array<string>>"))


def window_features(words: Column, window: int = WINDOW, use_parse: bool = False) -> Column:
    """For each token, the features of tokens at offsets -w..w inside the
    sentence, prefixed by the offset (``-1lemma=...``). Single-expression
    form for small inputs; DataFrames should use ``with_window_features``."""
    return window_of(base_features(words, use_parse), window)


def token_labels(words: Column, values: Column) -> Column:
    """1 when the lemma or segment equals a value (case-insensitive)."""
    low = F.transform(values, F.lower)
    return F.transform(words, lambda w: F.when(
        F.array_contains(low, F.lower(w["lemma"])) | F.array_contains(low, F.lower(w["segment"])),
        1).otherwise(0))


# --- I7-I8: spans -------------------------------------------------------------

SPAN = "struct<v:array<string>,p:double,start:int>"


def decode_spans(words: Column, tags: Column, probs: Column) -> Column:
    """``array<struct<value, p, start>>`` of maximal runs of label 1.

    ``-`` tokens are forced to label 1 with p 1; a leading ``-`` is skipped,
    one trailing ``-`` dropped; lemmas joined by ``_`` with ``_-_`` -> ``-``;
    a span's p is the minimum token p."""
    n = F.size(words)
    init = F.struct(F.array().cast(f"array<{SPAN}>").alias("done"),
                    F.array().cast("array<string>").alias("cur"),
                    F.lit(1.0).alias("p"), F.lit(-1).alias("start"))

    def close(acc):
        cur = acc["cur"]
        cur = F.when(F.element_at(cur, -1) == "-", F.slice(cur, 1, F.size(cur) - 1)).otherwise(cur)
        span = F.struct(cur.alias("v"), acc["p"].alias("p"), acc["start"].alias("start"))
        done = F.when(F.size(cur) > 0, F.array_append(acc["done"], span)).otherwise(acc["done"])
        reset_p = F.when(F.size(cur) > 0, F.lit(1.0)).otherwise(acc["p"])
        return done, reset_p

    def step(acc, i):
        is_end = i >= n
        w = F.get(words, i)
        dash = w["lemma"] == "-"
        tag = F.when(dash, 1).otherwise(F.get(tags, i))
        p = F.when(dash, F.lit(1.0)).otherwise(F.get(probs, i))
        on = ~is_end & (tag == 1)
        skip = on & dash & (F.size(acc["cur"]) == 0)
        done, reset_p = close(acc)
        has = F.size(acc["cur"]) > 0
        return (F.when(skip, acc)
                .when(on, F.struct(acc["done"].alias("done"),
                                   F.array_append(acc["cur"], w["lemma"]).alias("cur"),
                                   F.least(acc["p"], p).alias("p"),
                                   F.when(has, acc["start"]).otherwise(i).alias("start")))
                .when(has, F.struct(done.alias("done"), F.array().cast("array<string>").alias("cur"),
                                    reset_p.alias("p"), F.lit(-1).alias("start")))
                .otherwise(acc))

    out = F.aggregate(F.sequence(F.lit(0), n), init, step)["done"]
    return F.transform(out, lambda s: F.struct(
        F.replace(F.array_join(s["v"], "_"), F.lit("_-_"), F.lit("-")).alias("value"),
        s["p"].alias("p"), s["start"].alias("start")))


def spans(tagged: DataFrame, spec: RelationSpec, entity_col: str = "entity",
          confidence: float = EXTRACTOR_CONFIDENCE) -> DataFrame:
    """I8-I11 over ``(entity, sent_id, words, tags, probs)``:
    ``(entity, sent_id, start, value, p)`` -- prefix rule (I9), confidence
    (I10), normalisation (I11)."""
    s = tagged.select(entity_col, "sent_id", F.explode_outer(
        decode_spans(F.col("words"), F.col("tags"), F.col("probs"))).alias("sp")) \
        .where(F.col("sp").isNotNull())
    s = s.select(entity_col, "sent_id", F.col("sp.start").alias("start"),
                 F.col("sp.value").alias("value"), F.col("sp.p").alias("p"))
    if not spec.allow_same_prefix:                                      # I9
        s = s.where(F.left("value", F.lit(4)) != F.left(entity_col, F.lit(4)))
    s = s.where(F.col("p") > confidence)                                 # I10
    v = F.col("value")
    norm = F.when(is_numeric(v), truncate_numeric(v)) \
        .when(v.contains("_"), F.concat(F.upper(F.left(v, F.lit(1))), F.substring(v, 2, 1 << 30))) \
        .otherwise(v)                                                    # I11
    return s.withColumn("value", norm)


def select_values(spans_df: DataFrame, spec: RelationSpec, catalog: DataFrame | None = None,
                  object_types: DataFrame | None = None, entity_col: str = "entity") -> DataFrame:
    """One value per entity.

    Numeric relations: the most probable value. Text relations: the best value
    that is a catalog entity of a predominant object type, else the best that
    is any catalog entity, else (when allowed) the best raw value. "Best" is
    p descending, then earlier sentence and position (the stable order)."""
    order = F.struct(F.col("p"), -F.col("sent_id"), -F.col("start"))
    if spec.is_numeric or catalog is None:
        best = spans_df.groupBy(entity_col).agg(F.max_by("value", order).alias("value"))
        return best.select(entity_col, "value")
    cat = catalog.select(F.col("name").alias("value"), F.lit(True).alias("in_catalog"))
    j = spans_df.join(cat, "value", "left")
    if object_types is not None:
        # catalog names holding one of the predominant object types
        right_names = catalog.select("name", F.explode("types").alias("type")) \
            .join(object_types.select("type").distinct(), "type", "left_semi") \
            .select(F.col("name").alias("value"), F.lit(True).alias("right_type")).distinct()
        j = j.join(right_names, "value", "left")
        right = F.coalesce(F.col("right_type"), F.lit(False))
    else:
        right = F.lit(False)
    prio = F.when(right, 2).when(F.coalesce(F.col("in_catalog"), F.lit(False)), 1).otherwise(0)
    j = j.withColumn("prio", prio)
    if not spec.allow_unknown_value:                                     # I14
        j = j.where(F.col("prio") > 0)
    best = j.groupBy(entity_col).agg(F.max_by("value", F.struct(F.col("prio"), order)).alias("value"))
    return best.select(entity_col, "value")
