"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on text of toxic documents and on ordinary text. Each window of a
text is compressed with the ordinary dictionary alone and with the toxic one beside it; how much shorter the
toxic dictionary makes the windows is what a text is judged by: how many of its windows, and what share of them,
gain at least as much as each of a few thresholds, calibrated into a score on labelled rows.

A toxic document is mostly ordinary text. So of the toxic documents' text the dictionary is trained on the words
that stand in significantly more contexts there than in ordinary ones, or whose beginning does so in longer words;
the test is a likelihood ratio over all words and beginnings at once, so that rare words that seem telling by
chance stay out (contexts are pairs of the word before and the word: copies of one document add none). Both
compressions share the ordinary dictionary, and where the toxic one would stand the other has bytes that no text
holds, so that the difference comes from toxic text alone. Texts are compared as their words, in lower case: signs
between and around words would break the matches.

What is counted, cut and measured on the labelled sample is so in tasks; the driver trains from samples of windows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import give_back, text_batches, with_columns_from_batches, written
from pulsegrid.llm.learning import agreed, bounded_sample, fold, logistic, sigmoid

#: Labelled rows that dictionaries and calibration learn from, of each class, and windows of each class that the
#: dictionaries are trained on, from anywhere in these rows.
SAMPLE_ROWS, SAMPLES = 4000, 30_000
WINDOW = 80
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 2_048
MIN_MATCH = 5
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Letters of a word, and of a beginning of one.
SHORTEST, LEAST, LONGEST = 2, 4, 10
#: How many times as many contexts as expected, and by what margin the log likelihood ratio must pass a test of all.
TIMES, MARGIN = 5.0, 10.0
#: Bytes by which a window may gain.
GAINS = (1, 2, 3, 4, 6)

_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str | None) -> bytes:
    """The words of a text in lower case, a blank on each side of every one."""
    words = _WORD.findall((text or "").lower())
    return f" {' '.join(words)} ".encode("utf-8", "replace") if words else b""


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """Windows of about ``size`` bytes that begin and end between words; all of the text, in order."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + size)
        if end < n:
            cut = max(raw.rfind(b" ", at + size // 2, end + 1), raw.rfind(b"\n", at + size // 2, end + 1))
            end = cut if cut > at else end
        out.append(raw[at:end])
        at = end
    return out


class Model:
    """Dictionaries and calibration; sent to the tasks as bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._made = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def compressors(self):
        if self._made is None:
            filler = bytes(np.random.default_rng(7).integers(1, 8, len(self.toxic), dtype=np.uint8))
            made = []
            # what is told apart stands last, where offsets are short; every place of it can match
            for raw in (self.ordinary + filler, self.ordinary + self.toxic):
                d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                p = zstd.ZstdCompressionParameters.from_level(
                    6, source_size=WINDOW, dict_size=len(raw), min_match=MIN_MATCH, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=0
                )
                d.precompute_compress(compression_params=p)
                made.append(zstd.ZstdCompressor(dict_data=d, compression_params=p).compress)
            self._made = made
        return self._made

    def features(self, text: str | None) -> np.ndarray:
        plain, toxic = self.compressors()
        d = np.array([len(plain(w)) - len(toxic(w)) for w in windows(lowered(text))] or [0], float)
        n = len(d)
        counts = [(d >= g).sum() for g in GAINS]
        return np.array([x for c in counts for x in (math.sqrt(c), math.sqrt(c / n), c / n * math.log(n))] + [min(d.max(), 8), math.log(n)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.weights[:-1] + self.weights[-1])


N_FEATURES = 3 * len(GAINS) + 2


def units(word: str) -> list[str]:
    """A word, and its beginnings, marked as such, that more letters follow."""
    return [f"{word[:n]}-" for n in range(LEAST, min(len(word), LONGEST + 1))] + ([word] if len(word) >= SHORTEST else [])


def stem(word: str, telling: dict[str, int]) -> str:
    """What is telling in a word: the longest of its telling units that is nearly as widespread as the shortest."""
    found = [u for u in units(word) if u in telling]
    return max((u for u in found if telling[u] >= 0.8 * telling[found[0]]), key=lambda u: len(u.rstrip("-")), default="").rstrip("-")


def telling_units(rows: DataFrame) -> dict[str, int]:
    """Contexts in toxic text of the words and beginnings that are significantly more widespread there, from rows
    (text, label)."""

    def contexts(batches):
        for batch in batches:
            label, before, word = [], [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall((t or "").lower())
                pairs = set(zip(["", *words], words, strict=False))
                label += [y] * len(pairs)
                before += [a for a, _ in pairs]
                word += [b for _, b in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(before, pa.string()), pa.array(word, pa.string())], names=["label", "before", "word"])
            give_back()

    seen = rows.select("text", "label").mapInArrow(contexts, "label int, before string, word string").distinct()
    toxic = F.sum("label").cast("double")
    per_word = seen.groupBy("word").agg(toxic.alias("toxic"), (F.count("*") - toxic).alias("plain"))
    begin = F.when(
        F.length("word") > LEAST,
        F.transform(F.sequence(F.lit(LEAST), F.least(F.length("word") - 1, F.lit(LONGEST))), lambda n: F.concat(F.substring("word", F.lit(1), n), F.lit("-"))),
    ).otherwise(F.array().cast("array<string>"))
    unit = F.explode(F.concat(begin, F.when(F.length("word") >= SHORTEST, F.array("word")).otherwise(F.array().cast("array<string>")))).alias("unit")
    counts = written(per_word.select("toxic", "plain", unit).groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "units")
    n, in_toxic, in_plain = counts.agg(F.count(F.when(F.col("toxic") > 0, 1)), F.sum("toxic"), F.sum("plain")).first()
    if not n or not in_plain:
        return {}
    expected = (F.col("plain") + 1) * F.lit(in_toxic / in_plain)
    gain = F.col("toxic") * F.log(F.col("toxic") / expected) - (F.col("toxic") - expected)
    found = counts.where((F.col("toxic") > TIMES * expected) & (gain >= math.log(n) + MARGIN))
    return {r.unit: int(r.toxic) for r in found.select("unit", "toxic").collect()}


def samples(rows: DataFrame, telling: dict[str, int], size: int = SAMPLES) -> tuple[list[bytes], list[bytes]]:
    """Windows of ordinary text, and of what is telling in toxic text, from rows (doc_id, text, label): at most ``size``
    of each, the same ones every time."""

    def cut(batches):
        for batch in batches:
            out = []
            for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if y:
                    stems = [x for w in _WORD.findall((t or "").lower()) if (x := stem(w, telling))]
                    mine = [f" {' '.join(stems[k : k + 8])} ".encode() for k in range(0, len(stems), 8)]
                else:
                    mine = windows(lowered(t), 256)
                out += [(w, y, i, k) for k, w in enumerate(mine)]
            kinds = [pa.binary(), pa.int32(), pa.string(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["window", "label", "doc_id", "place"])

    slim = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label")
    made = written(slim.mapInArrow(cut, "window binary, label int, doc_id string, place int"), "windows")
    # windows that recur are as many in the sample as they are among all
    spread = F.xxhash64("doc_id", "place", "window")
    return tuple([bytes(r[0]) for r in made.where(F.col("label") == k).orderBy(spread, "window").limit(size).select("window").collect()] for k in (0, 1))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents of each class outside the held-out fold, whole texts of them.
    Documents whose labels disagree teach nothing. With few of a class every text gets the share of toxic rows."""
    text_batches(docs.sparkSession)
    known = agreed(labels, "toxic").where(fold("doc_id", FOLDS) != HELD_OUT)
    picked = [bounded_sample(known.where(F.col("label") == k), "doc_id", rows) for k in (0, 1)]
    # At most 2 * rows ids are broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id").where(F.col("text").isNotNull())
    mine = written(joined.select("doc_id", "text", F.col("label").cast("int").alias("label")).repartition(32, "doc_id"), "labelled")
    count = {r[0]: r[1] for r in mine.groupBy("label").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    constant = np.zeros(N_FEATURES + 1)
    constant[-1] = math.log((share + 1e-3) / (1 - share + 1e-3))
    if min(count.get(k, 0) for k in (0, 1)) < 10:
        return Model(b"", b"", constant)
    plain, toxic = samples(mine, telling_units(mine))
    model = Model(_dictionary(plain, ORDINARY_BYTES), _dictionary(toxic, TOXIC_BYTES))
    del plain, toxic
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        for batch in batches:
            x = [shared.value.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = mine.select("text", "label").mapInArrow(describe, "x array<double>, label int").orderBy("x", "label").limit(4 * rows).collect()
    x = np.array([r[0] for r in got], float).reshape(len(got), N_FEATURES)
    model.weights = logistic(x, np.array([r[1] for r in got], float), ridge=1e-4)
    return model


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (higher: likelier toxic) and ``predicted``. Null and empty texts are scored as
    texts without windows; whole texts are read; repeated rows are alike; an empty table gives no rows; columns
    named score or predicted are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            score = shared.value.score(np.array([shared.value.features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros(0)
            yield batch, [score, (score >= THRESHOLD).astype(np.int32)]

    return with_columns_from_batches(docs, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    slim = docs.select("doc_id", "text")
    scored = with_scores(slim, fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
