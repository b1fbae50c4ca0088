"""H1-H6: sentence classifier on MLlib.

Binary bag of lemmas on a fixed vocabulary (``CountVectorizerModel``), a
linear SVM (``LinearSVC``) with the same objective as a C-SVM up to scaling
(``regParam = 1 / (C * n)``), and Platt scaling fitted on out-of-fold
margins (5 hash folds) with Platt's smoothed targets as instance weights.
Only the vocabulary (bounded by the count threshold) and model coefficients
reach the driver.
"""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..config import CLASSIFIER_CONFIDENCE
from ..session import checkpoint_dir
from .supervise import features


@dataclass
class SentenceClassifier:
    vectorizer: CountVectorizerModel
    svm: LinearSVCModel
    platt_a: float
    platt_b: float
    vocab: list

    def margins(self, sentences: DataFrame, stop_words=None) -> DataFrame:
        df = sentences.withColumn("features_list", features(F.col("words"), stop_words))
        v = self.vectorizer.transform(df)
        s = self.svm.transform(v)
        return s.withColumn("margin", vector_to_array("rawPrediction")[1]) \
            .drop("features_list", "vec", "rawPrediction", "prediction")

    def score(self, sentences: DataFrame, stop_words=None) -> DataFrame:
        """H5 (scores): adds ``p`` = Platt probability of the positive class."""
        m = self.margins(sentences, stop_words)
        z = F.lit(self.platt_a) * F.col("margin") + F.lit(self.platt_b)
        return m.withColumn("p", 1.0 / (1.0 + F.exp(-z))).drop("margin")

    def save(self, path: str):
        self.vectorizer.write().overwrite().save(os.path.join(path, "vectorizer"))
        self.svm.write().overwrite().save(os.path.join(path, "svm"))
        spark = self.svm.sparkSession if hasattr(self.svm, "sparkSession") else None
        from pyspark.sql import SparkSession
        spark = spark or SparkSession.getActiveSession()
        spark.createDataFrame([(self.platt_a, self.platt_b)], "a double, b double") \
            .write.mode("overwrite").parquet(os.path.join(path, "platt"))

    @staticmethod
    def load(spark, path: str) -> "SentenceClassifier":
        vec = CountVectorizerModel.load(os.path.join(path, "vectorizer"))
        svm = LinearSVCModel.load(os.path.join(path, "svm"))
        r = spark.read.parquet(os.path.join(path, "platt")).first()
        return SentenceClassifier(vec, svm, r.a, r.b, list(vec.vocabulary))


def _vectorizer(vocab: list) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(vocab, inputCol="features_list",
                                                outputCol="vec", binary=True)


def _svc(n: int, C: float = 1.0, max_iter: int = 100, tol: float = 1e-4) -> LinearSVC:
    return LinearSVC(featuresCol="vec", labelCol="label", regParam=1.0 / (C * max(n, 1)),
                     standardization=False, maxIter=max_iter, tol=tol)


ROWS_PER_PARTITION = 50000


def training_set(positives: DataFrame, negatives: DataFrame, stop_words=None) -> DataFrame:
    pos = positives.select("s", "sent_id", "words", F.lit(1.0).alias("label"))
    neg = negatives.select("s", "sent_id", "words", F.lit(0.0).alias("label"))
    return pos.unionByName(neg).withColumn("features_list", features(F.col("words"), stop_words))


def train(positives: DataFrame, negatives: DataFrame, vocab_df: DataFrame,
          C: float = 1.0, folds: int = 5, stop_words=None) -> SentenceClassifier:
    """H1-H3. ``vocab_df`` is G10's ``(feature, n)``."""
    vocab = [r.feature for r in vocab_df.orderBy(F.desc("n"), "feature").collect()]
    if not vocab:
        raise ValueError("empty vocabulary")
    vec = _vectorizer(vocab)
    data = vec.transform(training_set(positives, negatives, stop_words)) \
        .withColumn("fold", F.pmod(F.xxhash64("s", "sent_id", "label"), F.lit(folds)))
    counts = {r.label: r.n for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    # The training set is bounded by the training cap (positives plus as many
    # negatives), so its partition count follows its size: iterative solvers
    # then pay one task per iteration instead of one per shuffle partition.
    # A reliable checkpoint cuts the lineage: every solver iteration would
    # otherwise ship the whole upstream plan with its tasks.
    checkpoint_dir(data.sparkSession)
    # Only the solver's columns are kept: the sentences' word arrays would
    # otherwise be carried through every iteration's scan.
    data = data.select("label", "vec", "fold") \
        .repartition(max(1, n // ROWS_PER_PARTITION + 1)).checkpoint(eager=True)
    def fold_margins(k):
        tr = data.where(F.col("fold") != k)
        te = data.where(F.col("fold") == k)
        m = _svc(max(1, tr.count()), C).fit(tr)             # the fold's own row count
        return m.transform(te).select("label", vector_to_array("rawPrediction")[1].alias("margin"))

    # the final model and the out-of-fold margins for Platt scaling are
    # independent solver runs: fit them concurrently (one-partition inputs)
    with ThreadPoolExecutor(max_workers=folds + 1) as pool:
        final = pool.submit(lambda: _svc(n, C).fit(data))
        parts = list(pool.map(fold_margins, range(folds)))
        svm = final.result()
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = oof.cache()
    n_pos, n_neg = counts.get(1.0, 0), counts.get(0.0, 0)
    hi, lo = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
    target = F.when(F.col("label") == 1.0, F.lit(hi)).otherwise(F.lit(lo))
    platt = oof.select("margin", F.lit(1.0).alias("y"), target.alias("w")).unionByName(
        oof.select("margin", F.lit(0.0).alias("y"), (1.0 - target).alias("w")))
    platt = VectorAssembler(inputCols=["margin"], outputCol="m").transform(platt)
    lr = LogisticRegression(featuresCol="m", labelCol="y", weightCol="w", regParam=0.0,
                            standardization=False, maxIter=50) \
        .fit(platt.coalesce(2 * n // ROWS_PER_PARTITION + 1))       # its partitions follow its size, too
    a, b = float(lr.coefficients[0]), float(lr.intercept)
    oof.unpersist()
    if not (math.isfinite(a) and math.isfinite(b)):
        a, b = 1.0, 0.0
    return SentenceClassifier(vec, svm, a, b, vocab)


def most_informative(clf: SentenceClassifier, spark, n: int = 10, min_weight: float = 0.5) -> DataFrame:
    """H4: top ``n`` features by weight, keeping weights of at least ``min_weight``."""
    w = clf.svm.coefficients.toArray().tolist()
    df = spark.createDataFrame(list(zip(clf.vocab, w)), "feature string, weight double")
    return df.orderBy(F.desc("weight"), "feature").limit(n).where(F.col("weight") >= min_weight)


def select_sentences(clf: SentenceClassifier, sentences: DataFrame,
                     confidence: float = CLASSIFIER_CONFIDENCE, stop_words=None) -> DataFrame:
    """H5: candidate sentences with ``p > confidence`` (no grouping needed)."""
    return clf.score(sentences, stop_words).where(F.col("p") > confidence)


def load_or_train(spark, path: str, trainer) -> SentenceClassifier:
    """H6: reuse a saved model (path keyed by relation and cap) or train one when
    nothing is there; a model that cannot be read raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return SentenceClassifier.load(spark, path)
    clf = trainer()
    clf.save(path)
    return clf
