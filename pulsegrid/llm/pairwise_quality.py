"""Document quality by pairwise ranking.

Scores are learned from preference pairs (a document marked good over one marked bad) by the Bradley-Terry
model: logistic loss on the difference of their features. A quantile of the training scores is the
threshold, and scores are scaled so that it stands at 0.3.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import with_columns_from_batches
from pulsegrid.llm.learning import agreed, bounded_sample, fold, logistic, sigmoid

#: Labelled rows that pairs are made of, and preference pairs for each row.
SAMPLE_ROWS, PAIRS = 10_000, 4
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

#: Classes of bytes whose shares are features.
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b".", b",", b"!?", b"|", b"%", b"#", b"$", b"&", b"*", b"@/:;=_+<>~^\\[]{}", b"\"'()-`"]
_class = np.full(256, len(_GROUPS), np.uint8)
_class[128:] = len(_GROUPS) + 1
for _k, _g in enumerate(_GROUPS):
    _class[list(_g)] = _k
_N = len(_GROUPS) + 2
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False


def features(column) -> np.ndarray:
    """A row of features for each text: shares of byte classes, repetition of words and lines, lengths."""
    out = []
    for _, _, buf, at in tc.chunks(column):
        n = len(at)
        size = np.diff(np.append(at, len(buf)))
        doc = np.repeat(np.arange(n), size)
        counts = np.bincount(doc * _N + _class[buf], minlength=n * _N).reshape(n, _N).astype(float)
        counts[:, 3] -= 1  # the added blank
        total = np.maximum(size - 1, 1)[:, None]
        share = counts / total
        word, first = tc.text_words(buf, at, tc.SPACED)
        start, end = tc.words(buf, _LINE)
        line, lines = tc.codes(buf, start, end), np.concatenate((np.searchsorted(start, at), [len(start)]))
        rest = np.zeros((n, 6))
        for i in range(n):
            w, ln = word[first[i] : first[i + 1]], line[lines[i] : lines[i + 1]]
            distinct = len(np.unique(w))
            three = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else w[:0]
            rest[i] = (
                np.log1p(len(w)),
                distinct / max(1, len(w)),
                1 - len(np.unique(three)) / max(1, len(three)),
                1 - len(np.unique(ln)) / max(1, len(ln)),
                (size[i] - 1) / max(1, len(w)) / 10,
                distinct / np.sqrt(max(1, len(w))) / 10,
            )
        out.append(np.column_stack((np.sqrt(share), np.minimum(share * 20, 1), rest)))
    return np.concatenate(out) if out else np.zeros((0, 2 * _N + 6))


class Model:
    def __init__(self, weights, shift: float, scale: float, mean, spread):
        self.weights, self.shift, self.scale, self.mean, self.spread = weights, shift, scale, mean, spread

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread @ self.weights
        return sigmoid((z - self.shift) * self.scale + np.log(THRESHOLD / (1 - THRESHOLD)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Bradley-Terry weights from pairs of rows with unlike labels; with one class only, every score is alike."""
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float(np.clip(y.mean() if len(y) else 1.0, 0.01, 0.99))
        shift = np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(share / (1 - share))
        return Model(np.zeros(x.shape[1]), shift, 1.0, mean, spread)
    z = (x - mean) / spread
    rng = np.random.default_rng(11)
    n = PAIRS * len(y)
    won = rng.integers(0, 2, n)
    difference = z[good[rng.integers(0, len(good), n)]] - z[bad[rng.integers(0, len(bad), n)]]
    weights = logistic(difference * (2 * won - 1)[:, None], won, ridge=1e-4)[:-1]
    s = z @ weights
    # the quantile at which most rows fall on the right side, the bad ones counting as much as the good
    places = np.quantile(s, np.linspace(0.002, 0.998, 499))
    gain = [(s[bad] < t).mean() + (s[good] >= t).mean() for t in places]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)
    shift = float(places[best[len(best) // 2]])
    a, _ = logistic(((s - shift) / s.std())[:, None], y.astype(float), ridge=1e-4)
    return Model(weights, shift, max(0.05, float(a / s.std())), mean, spread)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents of each class outside the held-out fold. Documents whose labels
    disagree teach nothing."""
    known = agreed(labels, "quality").where(fold("doc_id", FOLDS) != HELD_OUT)
    picked = [bounded_sample(known.where(F.col("label") == k), "doc_id", rows) for k in (0, 1)]
    # At most 2 * rows ids are broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")

    def make(batches):
        for batch in batches:
            yield batch, [features(batch.column(batch.schema.get_field_index("text"))).tolist()]

    described = with_columns_from_batches(joined, make, [T.StructField("x", T.ArrayType(T.DoubleType()))]).select("doc_id", "x", "label")
    got = bounded_sample(described, "doc_id", 2 * rows).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), 2 * _N + 6)
    return train(x, np.array([r["label"] for r in got]))


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (higher: likelier good) and ``predicted``. Null and empty texts are scored by the
    features of an empty text; whole texts are read; repeated rows are alike; an empty table gives no rows; columns
    named score or predicted are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for batch in batches:
            score = shared.value.score(features(batch.column(batch.schema.get_field_index(text))))
            yield batch, [score, (score >= THRESHOLD).astype(np.int32)]

    return with_columns_from_batches(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
