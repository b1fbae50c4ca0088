"""Quality rules: boosted trees over document statistics (operator 13).

One pass over the texts gives every document its counts and a vector of
statistics. Gradient-boosted trees with monotonic constraints are fitted to
labelled documents, flattened into numpy node arrays and applied to batches of
statistics, all trees and rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

WINDOW = 8                  # words of a window that may repeat
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
FIT_ROWS = 20_000           # labelled documents that the trees are fitted to, at most
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistic and its constraint: -1, the score never rises with it; 0, free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punctuation_per_word": 0, "exclaim_per_word": -1, "distinct_words": 0,
    "other_bytes": 0, "words_per_line": 0, "longest_word": 0, "stops_per_word": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that stands twice or more.
    Windows are ranked by doubling (pairs of words, pairs of pairs ...), so
    equality is exact; ``window`` is a power of two."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    step = 1
    while step < window:
        if len(rank) <= step:
            return 0
        top = int(rank.max()) + 1
        distinct, rank = np.unique(rank[:-step] * top + rank[step:], return_inverse=True)
        if len(distinct) == len(rank):
            return 0
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text (null: no words)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()                     # bytes split at exactly the six characters of SPACE
    chars = len(raw) - sum(raw.count(bytes([b])) for b in SPACE)
    points = len(text or "") - (len(raw) - chars)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    n, m, c = max(1, len(words)), max(1, len(lines)), max(1, chars)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!\"'(),-./:;?@[\\]^_`{}~+="))
    other = len(raw.translate(None, bytes(range(128))))
    return [len(words), points, symbols, dups, repeats], [
        float(np.log1p(len(words))), points / n, symbols / n, dups / m, repeats / n, upper / c, digits / c, marks / n,
        raw.count(b"!") / n, len(set(words)) / n, other / c, len(words) / m,
        float(max(map(len, words), default=0)), raw.count(b".") / n]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the five COUNTS (long) and ``stats`` (FEATURES in order) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column(1)]
            counts = np.array([g[0] for g in got], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))],
                 pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["id", *COUNTS, "stats"])

    longs = ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(id_col, text_col).mapInArrow(scan, f"id {kind}, {longs}, stats array<double>")


class Trees:
    """Boosted trees as node arrays: node i sends a row with
    ``x[feature[i]] <= cut[i]`` to ``left[i]`` and others to ``right[i]``; a leaf
    points to itself and adds ``value[i]``. ``roots`` holds the first node of
    every tree, ``depth`` the longest path."""

    def __init__(self, base: float = 0.0, depth: int = 0):
        self.base, self.depth = base, depth
        self.feature, self.cut, self.left, self.right, self.value, self.roots = ([] for _ in range(6))

    def add(self, value: float) -> int:
        i = len(self.value)
        for column, v in ((self.feature, 0), (self.cut, 0.0), (self.left, i), (self.right, i), (self.value, value)):
            column.append(v)
        return i

    def arrays(self) -> "Trees":
        out = Trees(self.base, self.depth)
        for name in ("feature", "left", "right", "roots"):
            setattr(out, name, np.array(getattr(self, name), np.int64))
        for name in ("cut", "value"):
            setattr(out, name, np.array(getattr(self, name), np.float64))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows go down all trees together."""
        total = np.full(len(x), self.base)
        if len(self.roots):
            at = np.tile(self.roots, (len(x), 1))
            row = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2,
          bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic gradient boosting on histograms of ``bins`` quantiles. With a
    constraint of +1 (-1) a split is taken only if its right side is worth at
    least (at most) its left side, and both sides' descendants are held to the
    side of the middle value they are on, so the score is monotonic."""
    n = len(y)
    rate_of_1 = (y.sum() + 0.5) / (n + 1.0)
    model = Trees(float(np.log(rate_of_1 / (1 - rate_of_1))), depth)
    if not 0 < y.sum() < n:
        return model.arrays()
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    total = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        root = model.add(0.0)
        model.roots.append(root)
        level = [(root, np.arange(n), -np.inf, np.inf)]
        for deep in range(depth + 1):
            below = []
            for node, rows, low, high in level:
                split = _split(binned[rows], g[rows], h[rows], cuts, constraints, low, high, least, ridge) \
                    if deep < depth else None
                if split is None:
                    v = rate * float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))
                    model.value[node] = v
                    total[rows] += v
                    continue
                f, b, left_value, right_value = split
                goes_left = binned[rows, f] <= b
                model.feature[node], model.cut[node] = f, float(cuts[f][b])
                model.left[node], model.right[node] = model.add(0.0), model.add(0.0)
                mid, c = (left_value + right_value) / 2, constraints[f]
                l_low, l_high = (mid, high) if c < 0 else (low, mid) if c > 0 else (low, high)
                r_low, r_high = (low, mid) if c < 0 else (mid, high) if c > 0 else (low, high)
                below += [(model.left[node], rows[goes_left], l_low, l_high),
                          (model.right[node], rows[~goes_left], r_low, r_high)]
            level = below
    return model.arrays()


def _split(binned, g, h, cuts, constraints, low, high, least, ridge):
    """Best (feature, bin, left value, right value) of a node, or None."""
    best, found = 1e-6, None

    def worth(gs, hs):
        v = np.clip(gs / (hs + ridge), low, high)
        return v, gs * v - 0.5 * (hs + ridge) * v * v

    _, whole = worth(g.sum(), h.sum())
    for f, c in enumerate(cuts):
        m = len(c) + 1
        n_l, g_l, h_l = (np.cumsum(np.bincount(binned[:, f], w, m))[:-1] for w in (None, g, h))
        left, gain_l = worth(g_l, h_l)
        right, gain_r = worth(g.sum() - g_l, h.sum() - h_l)
        gain = gain_l + gain_r - whole
        gain[(n_l < least) | (len(g) - n_l < least) | (constraints[f] * (right - left) < 0)] = 0
        if len(gain) and gain.max() > best:
            b = int(gain.argmax())
            best, found = float(gain[b]), (f, b, float(left[b]), float(right[b]))
    return found


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                  fit_rows: int = FIT_ROWS) -> DataFrame:
    """``stats`` and label ``y`` of the labelled documents, ``fit_rows`` at most:
    those with the smallest hashes of their id. Ids whose labels disagree or are
    null are left out."""
    y = F.col(label_col)
    told = labels.where(f"`{id_col}` is not null").groupBy(F.col(id_col).alias("key")) \
        .agg(F.min(y).alias("y"), F.max(y).alias("z")).where("y = z and y in (0, 1)")
    known = stats.join(told, F.col("id") == F.col("key")).select(F.xxhash64("id").alias("h"), "id", "stats", "y")
    n = known.count()
    if n > fit_rows:                        # what surely has too large a hash need not be sorted
        share = min(1.0, (1.1 * fit_rows + 1000) / n)
        known = known.where(F.col("h") <= min(2**63 - 1, int(2**64 * share) - 2**63))
    return known.orderBy("h", "id", "stats").limit(fit_rows).select("stats", "y")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        fit_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted to ``training_rows`` in one task; the bound is on its rows,
    of 14 numbers and a label each."""
    sample = training_rows(stats, labels, id_col, label_col, fit_rows)

    def learn(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame({"stats": [], "y": []})])
        if not len(rows):
            return
        m = boost(np.array(rows["stats"].tolist()), rows["y"].to_numpy(float), list(FEATURES.values()))
        yield pd.DataFrame({"base": [m.base], "feature": [m.feature], "cut": [m.cut], "left": [m.left],
                            "right": [m.right], "value": [m.value], "roots": [m.roots], "depth": [m.depth]})

    got = sample.coalesce(1).mapInPandas(
        learn, "base double, feature array<int>, cut array<double>, `left` array<int>, `right` array<int>, "
               "value array<double>, roots array<int>, depth int").collect()
    if not got:
        return Trees(base=1.0).arrays()
    m = Trees(got[0].base, got[0].depth)
    for name in ("feature", "cut", "left", "right", "value", "roots"):
        setattr(m, name, got[0][name])
    return m.arrays()


def judge(stats: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """``stats`` with score, base_failed and kept."""
    def scored(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield batch.append_column("score", pa.array(model.score(x)))

    longs = ", ".join(f"{c} bigint" for c in COUNTS)
    kind = stats.schema["id"].dataType.simpleString()
    failed = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"
    return stats.select("id", *COUNTS, "stats") \
        .mapInArrow(scored, f"id {kind}, {longs}, stats array<double>, score double") \
        .withColumn("base_failed", F.expr(failed)) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Counts and verdict of every row of ``docs``: id, COUNTS, base_failed, kept, score.

    A null or empty text has no words and fails the base rule. Repeated rows
    are judged each; null ids are judged but never learned from; columns other
    than the named ones are not read. Without usable labels (none, or one value
    only) the base rule alone decides. Empty tables give empty results.
    """
    stats = materialise(statistics(docs, id_col, text_col), "text-statistics")
    out = judge(stats, fit(stats, labels, id_col, label_col, fit_rows))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", "score")
