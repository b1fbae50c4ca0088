"""Evaluation against gold data.

Gold ``full_outer`` predictions on the entity gives every error class in one
join; the scores are one global aggregate (three conditional counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def restrict_gold(gold_entities: DataFrame, gold_values: DataFrame, p: str | None = None) -> DataFrame:
    """Gold values of the listed entities only, ``(entity, values)``."""
    ge, gv = gold_entities, gold_values
    if p is not None:
        ge, gv = ge.where(F.col("p") == p), gv.where(F.col("p") == p)
    return gv.join(ge.select("entity").distinct(), "entity", "left_semi").select("entity", "values")


def classify_errors(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(entity, values, value, tp, fp, fn)``.

    A prediction matching any gold alternative is a true positive; a
    prediction that is wrong or has no gold is a false positive; a gold entity
    without a (matching) prediction is a false negative -- a wrong value is
    both FP and FN."""
    pred = predictions.where(F.col("value").isNotNull() & (F.col("value") != "")) \
        .select("entity", "value")
    j = gold.join(pred, "entity", "full_outer")
    match = F.coalesce(F.array_contains(F.col("values"), F.col("value")), F.lit(False))
    has_pred = F.col("value").isNotNull()
    has_gold = F.col("values").isNotNull()
    return j.select("entity", "values", "value",
                    (has_pred & has_gold & match).alias("tp"),
                    (has_pred & ~(has_gold & match)).alias("fp"),
                    (has_gold & ~(has_pred & match)).alias("fn"))


def scores(classified: DataFrame, p: str | None = None) -> DataFrame:
    """One row ``(p, tp, fp, fn, precision, recall, f_measure)``;
    denominators floored at 1, F = 0 when precision is 0."""
    agg = classified.agg(
        F.count(F.when(F.col("tp"), 1)).cast("bigint").alias("tp"),
        F.count(F.when(F.col("fp"), 1)).cast("bigint").alias("fp"),
        F.count(F.when(F.col("fn"), 1)).cast("bigint").alias("fn"))
    prec = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    rec = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    out = agg.withColumn("precision", prec).withColumn("recall", rec)
    f = F.when(F.col("precision") != 0, 2 * F.col("precision") * F.col("recall")
               / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f_measure", f).select(F.lit(p).alias("p"), "tp", "fp", "fn",
                                                 "precision", "recall", "f_measure")


def error_table(classified: DataFrame) -> DataFrame:
    """``(entity, gold, extracted, error)``; gold ``-`` when there is none,
    extracted ``-`` when nothing was extracted."""
    err = (F.when(F.col("fp") & F.col("fn"), "FP/FN").when(F.col("fp"), "FP")
           .when(F.col("fn"), "FN").otherwise(""))
    return classified.select(
        "entity",
        F.coalesce(F.array_join("values", ", "), F.lit("-")).alias("gold"),
        F.coalesce("value", F.lit("-")).alias("extracted"),
        err.alias("error"))


def evaluate(gold_entities: DataFrame, gold_values: DataFrame, predictions: DataFrame,
             p: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Restrict gold, classify, score -> ``(scores, error table)``."""
    c = classify_errors(restrict_gold(gold_entities, gold_values, p), predictions)
    return scores(c, p), error_table(c)


def mean_curve(scored: DataFrame) -> DataFrame:
    """Mean precision and recall per training cap over the seeds of
    ``(cap, seed, precision, recall)`` rows."""
    return scored.groupBy("cap").agg(F.avg("precision").alias("precision"),
                                     F.avg("recall").alias("recall")).orderBy("cap")


def evaluation_sample(pairs: DataFrame, articles: DataFrame, n: int = 100, seed: int = 1) -> DataFrame:
    """``n`` random pairs, values grouped per subject, subjects with an
    article only: ``(entity, values)``."""
    key = F.md5(F.concat_ws("|", F.col("s"), F.col("o"), F.lit(str(seed))))
    sample = pairs.orderBy(key).limit(n)
    grouped = sample.groupBy("s").agg(F.collect_list("o").alias("values"))
    return grouped.join(articles.select(F.col("title").alias("s")), "s", "left_semi") \
        .withColumnRenamed("s", "entity")
