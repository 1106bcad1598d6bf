"""Quality classifier: Bradley-Terry ranking from preference pairs.

A document's utility is linear in features of its whole text. A pair of labelled documents, one
good and one bad, is a preference: P(good over bad) = sigmoid(u(good) - u(bad)), so the logistic
loss is on the difference of their features. The weights are fitted on a bounded sample of
labelled rows. The share q of bad labels in that sample sets the cut: the q-quantile of the
sample's utilities gets the score CUT, and a score is sigmoid(u - quantile + logit(CUT)).

Labels reach the documents by a broadcast of the sample (at most `max_labels` rows); texts are
never shuffled or sent to the driver, only the sample's feature vectors are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = 0.3
MAX_LABELS = 8000
PAIRS_PER_ROW = 8
N_BYTES = 256
#: Sentence punctuation isn't a symbol.
SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~!", np.uint8)


def _local(words: list[str], size: int = 24) -> tuple[float, float, float]:
    """The worst windows of `size` words: most words with symbols, in capitals, repeated."""
    worst = [0.0, 0.0, 0.0]
    last = max(0, len(words) - size)
    for k in [*range(0, last, size), last]:  # the last window ends at the last word
        part = words[k : k + size]
        n = max(len(part), 8)
        worst[0] = max(worst[0], sum(not w.strip(".,;:?'\"()-").isalnum() for w in part) / n)
        worst[1] = max(worst[1], sum(w.isupper() for w in part) / n)
        worst[2] = max(worst[2], (len(part) - len(set(part))) / n)
    return tuple(worst)


def features(text: str | None) -> list[float]:
    """The feature vector of a text; null and empty texts have no words and counts of zero."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=N_BYTES).astype(float)
    n = max(1.0, float(len(raw)))
    words, lines = text.split(), text.split("\n")
    nw = max(1, len(words))
    pairs = set(zip(words, words[1:], strict=False))
    upper, lower, digit = hist[65:91].sum(), hist[97:123].sum() + hist[128:].sum(), hist[48:58].sum()
    symbols, capital, same = _local(words)
    return [
        math.log1p(len(words)), 1.0 if not words else 0.0, len(raw) / nw if words else 0.0,
        hist[SYMBOLS].sum() / n, math.log1p(100 * hist[SYMBOLS].sum() / n), hist[33] / n, hist[124] / n,
        upper / n, upper / (upper + lower + 1), digit / n, hist[10] / n, hist[[44, 46, 58, 59, 63]].sum() / n,
        len(set(words)) / nw, len(pairs) / nw, len(set(lines)) / max(1, len(lines)),
        sum(map(len, words)) / nw, max(map(len, words), default=0) / 100.0,
        symbols, capital, same, symbols**2, capital**2, same**2,
    ]


def fold(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class Model:
    """Standardised linear utility and its cut."""

    def __init__(self, mean, scale, weights, at):
        self.mean, self.scale, self.weights, self.at = mean, scale, weights, at

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.utility(x) - self.at + math.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on rows x with labels y; where a class is missing all scores are equal and pass the cut."""
    if not len(y) or y.min() == y.max():
        width = x.shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -2.0)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(PAIRS_PER_ROW * len(y), 60_000)
    diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(z.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        grad = -(diff * p[:, None]).mean(0) + ridge * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    u = z @ w
    return Model(mean, scale, w, float(np.quantile(u, float((y == 0).mean()))))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, doc: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5) -> Model:
    """Fit on at most max_labels labelled documents outside fold 0, drawn by a hash of the id."""
    chosen = (
        labels.select(F.col(doc).alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("k"), folds) != 0))
        .orderBy(F.xxhash64("k"), "k", "y").limit(max_labels)
    )

    @F.pandas_udf("array<double>")
    def features_of(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    texts = docs.select(F.col(doc).alias("k"), F.col(text).alias("t"))
    rows = texts.join(F.broadcast(chosen), "k").select("k", "y", features_of("t").alias("x")).orderBy("k", "y").limit(2 * max_labels).toPandas()
    width = len(features(""))
    return fit(np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), width), rows["y"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, doc: str = "doc_id", text: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: its id, held_out, score and predicted.

    Null and empty texts are scored like any other, as texts without words. Only id and text of
    docs are read, whatever other columns it has. Null ids are held out (their id is the empty
    text). Repeated documents keep a row each; repeated labels count as often as they come. Without
    labels of both kinds every score is equal and predicted is 1. Empty tables give no rows.
    """
    model = train(docs, labels, max_labels, doc, text, folds=folds)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), model.weights.size)
        return pd.Series(model.score(x))

    rows = docs.select(F.col(doc), (fold(F.col(doc), folds) == 0).alias("held_out"), score_of(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
