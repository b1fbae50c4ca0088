"""Secret scan: broad candidates, then a random forest against false positives.

Candidates are long runs of key-like characters and every value assigned after
a key word. The forest (Spark ML) judges each by its length, character transitions, dictionary coverage, path (the
document's source) and neighbouring words, and is trained from labelled
findings. DataFrame operations and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import WS_WORD, broadcast_if, materialise

MIN_CHARS = 12
VALUE = r"[A-Za-z0-9+/_\-]{12,}"
# Public formats that label a finding as a secret in training.
ISSUER_FORMATS = [
    r"^AKIA[0-9A-Z]{16}$",
    r"^gh[pousr]_[A-Za-z0-9]{36}$",
    r"^sk_live_[A-Za-z0-9]{24,}$",
    r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
]
KEY_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "bearer"]
KEYS = "|".join(KEY_WORDS)
# A key word at the end of a name, a sign of assignment, and what stands after it in the word.
ASSIGNED = rf"(?i)(?:{KEYS})[^\p{{L}}\p{{N}}=:]*[=:]+>?(.+)$"
KEY_SIGN = rf"(?i)(?:{KEYS})[^\p{{L}}\p{{N}}=:]*[=:]+>?[^\p{{L}}\p{{N}}]*$"   # the value is the next word
KEY_ONLY = rf"(?i)(?:{KEYS})[^\p{{L}}\p{{N}}=:]*$"                          # the sign is the next word
SIGN = r"^[=:]+>?"
NUMERIC = ["length", "digits", "uppers", "symbols", "transitions", "distinct_chars", "vowel_share", "hex_only",
           "coverage", "path_length", "path_depth"]
MAX_TRAINING = 20_000       # labelled findings the forest is fitted on, chosen by hash
WORD_BUCKETS = 64


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(doc_id, row_key, word_no, value, before, after, path)``: the key-like
    runs of 12 characters or more with at least one digit or mixed case, in every
    word of every text, and every value assigned after a key word, of any length
    and characters: what follows ``=`` or ``:`` in the word, or the next word when
    the sign ends its word or stands alone, without quotes, brackets and closing
    punctuation. A value found both ways comes once. ``before``/``after`` are what
    stands next to the value: the rest of its word and the neighbouring words.
    Null texts have none."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    keyed = F.col("text").rlike(rf"(?i)(?:{KEYS})[^\p{{L}}\p{{N}}=:]*[=:]")
    ws = F.regexp_extract_all("text", F.lit(f"({WS_WORD})"), 1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), path.alias("path"),
                    F.col(text_col).alias("text")).withColumn("keyed", keyed) \
        .where(F.col("text").rlike(VALUE) | F.col("keyed")).withColumn("ws", ws)

    def told(w, i):         # a word that may hold a value: a long run, or one after a key word
        at = lambda k: F.coalesce(F.get("ws", i - k), F.lit(""))
        after_key = w.rlike(ASSIGNED) | at(1).rlike(KEY_SIGN) | (at(1).rlike(KEY_ONLY) & w.rlike(SIGN + ".")) \
            | (at(2).rlike(KEY_ONLY) & at(1).rlike(SIGN + "$"))
        return ((F.length(w) >= MIN_CHARS) & w.rlike(VALUE)) | (F.col("keyed") & after_key)

    at = F.filter(F.transform("ws", lambda w, i: F.when(told(w, i), i)), lambda i: i.isNotNull())
    d = d.select("doc_id", "row_key", "path", "ws", F.explode(at).alias("word_no"))
    near = lambda k: F.coalesce(F.get("ws", F.col("word_no") + k), F.lit(""))
    d = d.select("doc_id", "row_key", "path", "word_no", near(0).alias("word"), near(-2).alias("b2"), near(-1).alias("b1"), near(1).alias("a1"))
    b2, b1, word = F.col("b2"), F.col("b1"), F.col("word")
    raw = F.when(word.rlike(ASSIGNED), F.regexp_extract("word", ASSIGNED, 1)) \
        .when(b1.rlike(KEY_SIGN) | (b2.rlike(KEY_ONLY) & b1.rlike(SIGN + "$")), word) \
        .when(b1.rlike(KEY_ONLY) & word.rlike(SIGN + "."), F.regexp_replace("word", SIGN, "")).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(raw, r"""^["'`(\[{<]+""", ""), r"""["'`)\]}>.,;]+$""", "")
    d = d.withColumn("assigned", bare)
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({VALUE})"), 1), lambda v: v.rlike("[0-9]") | v.rlike("[a-z][A-Z]"))
    d = d.withColumn("runs", runs)
    own = F.when((F.col("assigned") != "") & ~F.array_contains("runs", F.col("assigned")), F.array("assigned")) \
        .otherwise(F.array().cast("array<string>"))
    d = d.withColumn("value", F.explode(F.concat("runs", own)))
    lead = F.expr("substring_index(word, value, 1)")
    return d.select("doc_id", "row_key", "path", "word_no", "value",
                    F.array(F.lower("b2"), F.lower("b1"), F.lower(lead)).alias("before"), F.array(F.lower("a1")).alias("after"))


def with_coverage(cands: DataFrame, docs: DataFrame, text_col: str = "text", min_count: int = 5) -> DataFrame:
    """Adds ``coverage``: the share of a value's characters that lie in letter runs
    which the corpus uses as words (``min_count`` times or more, counted over all
    texts)."""
    runs = cands.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"([a-z]{3,})"), 1)).alias("run")).distinct()
    asked = materialise(runs.select("run").distinct(), "secret-runs")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?<![\p{L}\d])(\p{L}{3,})(?![\p{L}\d])"), 1)).alias("run"))
    known = words.join(broadcast_if(asked, 500_000), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")) \
        .where(F.col("n") >= min_count).select("run", F.lit(True).alias("known"))
    covered = runs.join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("c"))
    return cands.join(covered, "value", "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("c", F.lit(0)) / F.length("value"))).drop("c")


def with_features(cands: DataFrame) -> DataFrame:
    v = F.col("value")
    switch = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    return cands.withColumns({
        "length": F.length(v).cast("double"), "digits": _share(v, "[0-9]"), "uppers": _share(v, "[A-Z]"),
        "symbols": _share(v, r"[+/_\-]"), "transitions": _share(v, switch),
        "distinct_chars": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
        "vowel_share": _share(v, "[aeiouAEIOU]"), "hex_only": v.rlike("^[0-9a-f]+$").cast("double"),
        "path_length": F.length("path").cast("double"), "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "words": F.concat(F.transform("before", lambda w: F.concat(F.lit("b:"), F.regexp_replace(w, r"[^\p{L}_=:]", ""))),
                          F.transform("after", lambda w: F.concat(F.lit("a:"), F.substring(w, 1, 3)))),
    })


def rule_labels(cands: DataFrame) -> DataFrame:
    """Labelled findings for training, by public formats and explicit assignments:
    1 for an issuer's format or a key word right before the value, else 0."""
    v = F.col("value")
    issuer = F.lit(False)
    for p in ISSUER_FORMATS:
        issuer = issuer | v.rlike(p)
    keyed = F.exists("before", lambda w: w.rlike("(" + "|".join(KEY_WORDS) + r")\W*$"))
    assigned = F.exists("before", lambda w: w.rlike(r"[=:]\W*$"))
    return cands.withColumn("label", (issuer | (keyed & assigned)).cast("double"))


def fit(labelled: DataFrame, max_training: int = MAX_TRAINING, trees: int = 20, depth: int = 8, seed: int = 5):
    """Random forest from labelled findings (``with_features`` columns + ``label``).

    Fitted on at most ``max_training`` findings, chosen by a hash of the value (a
    value counts once). None without findings of both kinds."""
    once = labelled.withColumn("pick", F.xxhash64("value", F.lit(seed))).dropDuplicates(["value"])
    n = once.count()
    some = once if n <= max_training else once.where(
        F.shiftrightunsigned("pick", 11) < int(max_training / n * 2 ** 53))
    some = materialise(some.select("label", "words", *NUMERIC), "secret-training")
    if some.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        HashingTF(inputCol="words", outputCol="near", numFeatures=WORD_BUCKETS, binary=True),
        VectorAssembler(inputCols=[*NUMERIC, "near"], outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird"),
    ]).fit(some)


def scan(docs: DataFrame, model=None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
         path_col: str = "source") -> DataFrame:
    """One row per finding: ``(doc_id, word_no, value_sha256, length, label,
    held_out, score, is_secret)``.

    Without ``model`` a forest is trained from ``rule_labels`` of the findings
    whose value hash is not divisible by 3; the others are ``held_out``. Null and
    empty texts, and texts without a candidate, give no rows; with no labelled
    findings of both kinds the score is the label. Repeated rows give repeated
    findings; null ids and null paths are kept (an empty path)."""
    cands = materialise(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    f = materialise(rule_labels(with_features(with_coverage(cands, docs, text_col))), "secret-features")
    held = F.pmod(F.xxhash64("value", F.lit(3)), F.lit(3)) == 0
    model = model or fit(f.where(~held))
    if model is None:
        scored = f.withColumn("score", F.col("label"))
    else:
        scored = model.transform(f).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_no", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"),
                         F.col("label").cast("int").alias("label"), held.alias("held_out"), "score",
                         (F.col("score") >= threshold).alias("is_secret"))
