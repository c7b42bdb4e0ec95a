"""Language of words by a linear-chain conditional random field, and of documents by their words.

A word's features are its code (the lexicon) and the n-grams of its bytes with marks for its beginning and
end (affixes and inner n-grams), hashed into one table of weights per language. Transitions between the
languages of neighbouring words are learned with them, from labelled texts and from sequences that switch
between such texts. Forward-backward gives each word its distribution; a document's is the mean of its
words', weighted by their lengths.

Forward-backward runs over all words of a text, however long: blocks of ``BLOCK`` words become transfer
matrices, the vectors at block borders follow from these, and all blocks are then filled in at once.

A model always finds some language likeliest. How much of a text is of known make-up (the share of its words'
longest n-grams that the labelled texts hold) tells whether any of them fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import give_back, text_batches, with_columns_from_batches
from pulsegrid.llm.learning import fold

#: Labelled rows that the model learns from, shared between their languages; pieces taken from anywhere in each,
#: sequences drawn from these, and the words of a piece or sequence.
SAMPLE_ROWS, PIECES, SEQUENCES, LENGTH = 3000, 2, 4000, 40
SLOTS, GRAMS = 1 << 17, (1, 2, 3, 4)
#: Places of the table of known n-grams of the largest length.
WIDE = 1 << 22
EPOCHS, RATE, RIDGE = 40, 0.08, 1e-5
BLOCK = 64
#: A text is of no known language below this share of what nearly every labelled piece (all but this part) has; so many
#: n-grams are taken for known in any text, as a few words tell little.
FAMILIAR, ODD, LENIENT = 0.5, 0.005, 8
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the features of words, where each word's begin (with the end), places of their n-grams of the
    largest length, and the word of each of these."""
    size = end - start
    marked = size + 2
    first = np.concatenate(([0], np.cumsum(marked)))
    text = np.full(first[-1], 94, np.uint64)
    inner = np.repeat(start - first[:-1] - 1, size) + (np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)) + 1, size))
    text[np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)) + 1, size)] = tc._lower[buf[inner]]
    text[first[1:] - 1] = 36
    slots, owner = [(code >> np.uint64(47)).astype(np.int64)], [np.arange(len(size))]
    word = np.repeat(np.arange(len(size)), marked)
    gram = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        gram = gram[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :]
        if n in GRAMS:
            whole = word[: len(gram)] == word[n - 1 :]
            mixed = tc.mix(gram[whole] + np.uint64(n << 40))
            slots.append((mixed >> np.uint64(47)).astype(np.int64))
            owner.append(word[: len(gram)][whole])
    wide, of_wide = (mixed >> np.uint64(42)).astype(np.int64), owner[-1]
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return slots[by], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(size))))), wide, of_wide


def forward_backward(emit: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of each word; ``emit``: log scores of all words, ``first``: each text's first word (with the end)."""
    k = emit.shape[1]
    if not len(emit):
        return emit
    a = np.exp(transition - transition.max())
    size = np.diff(first)
    blocks = -(-size // BLOCK)
    base = np.concatenate(([0], np.cumsum(blocks)))
    nb = int(base[-1])
    # A place in a block holds a word, or an identity step behind a text's last word.
    e = np.ones((BLOCK, nb, k))
    real = np.zeros((BLOCK, nb), bool)
    inside = np.arange(len(emit)) - np.repeat(first[:-1], size)
    at, b = inside % BLOCK, np.repeat(base[:-1], size) + inside // BLOCK
    e[at, b] = np.exp(emit - emit.max(1, keepdims=True))
    real[at, b] = True
    whole = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        step = (whole.reshape(-1, k) @ a).reshape(nb, k, k) * e[t][:, None, :]
        whole = np.where(real[t][:, None, None], step, whole)
        whole /= whole.max((1, 2), keepdims=True)
    ahead, behind = np.full((nb, k), 1 / k), np.ones((nb, k))
    live = np.flatnonzero(blocks > 1)
    order = live[np.argsort(-blocks[live], kind="stable")]
    for j in range(1, int(blocks.max(initial=1))):
        order = order[: np.searchsorted(-blocks[order], -j, "left")]
        v = np.einsum("ni,nij->nj", ahead[base[order] + j - 1], whole[base[order] + j - 1])
        ahead[base[order] + j] = v / v.sum(1, keepdims=True)
        last = base[order + 1] - 1 - j
        v = np.einsum("nij,nj->ni", whole[last + 1], behind[last + 1])
        behind[last] = v / v.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, nb, k))
    v = ahead
    for t in range(BLOCK):
        step = (v @ a) * e[t]
        v = np.where(real[t][:, None], step / np.maximum(step.sum(1, keepdims=True), 1e-300), v)
        alpha[t] = v
    v = behind
    for t in range(BLOCK - 1, -1, -1):
        alpha[t] *= v
        step = (e[t] * v) @ a.T
        v = np.where(real[t][:, None], step / np.maximum(step.sum(1, keepdims=True), 1e-300), v)
    out = alpha[at, b]
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


class Model:
    """Weights and transitions; ``known``: which n-grams labelled texts have, ``least``: the share of known ones
    below which a text is of none of the languages."""

    def __init__(self, langs: list[str], weights: np.ndarray, transition: np.ndarray, known: np.ndarray | None = None, least: float = 0.0):
        self.langs, self.weights, self.transition, self.known, self.least = langs, weights, transition, known, least

    def emissions(self, buf, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of words, and how many n-grams of the largest length each has and the model knows."""
        code = tc.codes(buf, start, end)
        _, pick, back = np.unique(code, return_index=True, return_inverse=True)
        slots, first, wide, of = word_features(buf, start[pick], end[pick], code[pick])
        grams = _counts(wide, of, len(pick), self.known)
        return np.add.reduceat(self.weights[slots], first[:-1], axis=0)[back].astype(float), grams[back]

    def words(self, column):
        """Per chunk: (first row, end row, bytes, word starts, word ends, each text's first word, marginals, n-grams)."""
        for lo, hi, buf, at in tc.chunks(column):
            start, end = tc.words(buf, _LETTER)
            first = np.concatenate((np.searchsorted(start, at), [len(start)]))
            marginals, grams = np.zeros((0, len(self.langs))), np.zeros((0, 2), np.int64)
            if len(start):
                emit, grams = self.emissions(buf, start, end)
                marginals = forward_backward(emit, first, self.transition)
            yield lo, hi, buf, start, end, first, marginals, grams

    def texts(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether any language fits it."""
        langs, scores, fits = [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        if not self.langs:
            return langs, scores, fits
        for lo, hi, buf, start, end, first, marginals, grams in self.words(column):
            ascii_ = np.concatenate(([0], np.cumsum(_LETTER[buf] & (buf < 128))))
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                if a == b:
                    continue
                if ascii_[end[b - 1]] == ascii_[start[a]] and not any(map(str.isalpha, column[lo + i].as_py())):
                    continue
                weight = (end - start)[a:b].astype(float)
                share = weight @ marginals[a:b] / weight.sum()
                best = int(share.argmax())
                langs[lo + i], scores[lo + i] = self.langs[best], min(1.0, share[best])
                every, known = grams[a:b].sum(0)
                fits[lo + i] = known + LENIENT >= self.least * (every + LENIENT)
        return langs, scores, fits


def _counts(wide: np.ndarray, of: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """For each of ``n`` words, its n-grams of the largest length and how many of them are known."""
    return np.stack((np.bincount(of, minlength=n), np.bincount(of, known[wide], n).astype(np.int64)), 1)


def train(rows: list[tuple[str, str]]) -> Model:
    """Learn from (text, language) rows; without any, every text is of unknown language."""
    langs = sorted({lang for _, lang in rows})
    k = len(langs)
    transition = np.zeros((k, k))
    weights = np.zeros((SLOTS, k), np.float32)
    column = pa.array([t for t, _ in rows], pa.large_string())
    spans, codes, total = [], [], 0
    for lo, hi, buf, at in tc.chunks(column):
        start, end = tc.words(buf, _LETTER)
        first = np.concatenate((np.searchsorted(start, at), [len(start)]))
        spans += [(total + first[i], total + first[i + 1]) for i in range(hi - lo)]
        codes.append(tc.codes(buf, start, end))
        total += len(start)
    of_lang: dict[int, list[tuple[int, int]]] = {}
    for (a, b), (_, lang) in zip(spans, rows, strict=True):
        if b - a >= 3:
            of_lang.setdefault(langs.index(lang), []).append((a, b))
    if not of_lang:
        return Model([], weights, transition)
    rng = np.random.default_rng(5)
    words, gold = np.zeros((SEQUENCES, LENGTH), np.int64), np.zeros((SEQUENCES, LENGTH), np.int64)
    have = sorted(of_lang)
    for q in range(SEQUENCES):
        filled, y = 0, have[rng.integers(len(have))]
        while filled < LENGTH:
            # half of the sequences stay in one language, the others switch after 3 to 20 words
            want = LENGTH - filled if q % 2 else min(LENGTH - filled, int(rng.integers(3, 21)))
            a, b = of_lang[y][rng.integers(len(of_lang[y]))]
            n = min(want, b - a)
            s = int(rng.integers(a, b - n + 1))
            words[q, filled : filled + n] = np.arange(s, s + n)
            gold[q, filled : filled + n] = y
            filled += n
            if not q % 2:
                y = have[rng.integers(len(have))]
    # Features of each distinct word that is drawn, once.
    code = np.concatenate(codes)
    used, where = np.unique(code[words], return_inverse=True)
    where = where.reshape(words.shape)
    done = np.zeros(len(used), bool)
    slots, order, counts, total = [], [], [], 0
    odd = np.zeros(len(code), bool)
    for a, b in spans[1::2]:
        odd[a:b] = True
    known, grams = np.zeros(WIDE, bool), np.zeros(WIDE, bool)
    for _, _, buf, _ in tc.chunks(column):
        start, end = tc.words(buf, _LETTER)
        mine = code[total : total + len(start)]
        _, _, wide, of = word_features(buf, start, end, mine)
        grams[wide] = True
        known[wide[~odd[total : total + len(start)][of]]] = True
        at = np.minimum(np.searchsorted(used, mine), len(used) - 1)
        new, pick = np.unique(np.where((used[at] == mine) & ~done[at], at, -1), return_index=True)
        new, pick = new[new >= 0], pick[new >= 0]
        if len(new):
            found, first, _, _ = word_features(buf, start[pick], end[pick], mine[pick])
            slots.append(found.astype(np.int32))
            counts.append(np.diff(first))
            order.append(new)
            done[new] = True
        total += len(start)
    share, total = [], 0
    for lo, hi, buf, _ in tc.chunks(column):
        start, end = tc.words(buf, _LETTER)
        _, _, wide, of = word_features(buf, start, end, code[total : total + len(start)])
        got = _counts(wide, of, len(start), known).cumsum(0)
        got = np.concatenate((np.zeros((1, 2), np.int64), got))
        for i in range(lo + (lo + 1) % 2, hi, 2):
            every, some = got[spans[i][1] - total] - got[spans[i][0] - total]
            if every:
                share.append(some / every)
        total += len(start)
    least = FAMILIAR * float(np.quantile(share, ODD)) if len(share) >= 1 / ODD else 0.0
    place = np.empty(len(used), np.int64)
    place[np.concatenate(order)] = np.arange(len(used))
    where = place[where]
    live, at = np.unique(np.concatenate(slots), return_inverse=True)
    count = np.concatenate(counts)
    del slots, codes, code
    head = np.concatenate(([0], np.cumsum(count)))
    at = at.astype(np.int32)
    owner = np.repeat(np.arange(len(used), dtype=np.int32), count)
    w = np.zeros((len(live), k))
    m1, m2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(transition), np.zeros_like(transition)
    hot = np.eye(k)[gold]
    for epoch in range(1, EPOCHS + 1):
        score = np.stack([np.add.reduceat(w[at, c], head[:-1]) for c in range(k)], 1)[where]
        gw, gt = _gradient(score, hot, transition)
        grad = np.empty_like(w)
        for c in range(k):
            per = np.bincount(where.ravel(), gw[..., c].ravel(), len(used))
            grad[:, c] = np.bincount(at, per[owner], len(live)) / SEQUENCES + RIDGE * w[:, c]
        gt = gt / SEQUENCES + RIDGE * transition
        for p, g, a, b in ((w, grad, m1, m2), (transition, gt, t1, t2)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= RATE * (a / (1 - 0.9**epoch)) / (np.sqrt(b / (1 - 0.99**epoch)) + 1e-8)
    weights[live] = w
    return Model(langs, weights, transition, grams, least)


def _gradient(score: np.ndarray, hot: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood: for the scores of the words and for the transitions."""
    n, length, k = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    a = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    v = np.full((n, k), 1 / k)
    for t in range(length):
        v = (v @ a) * e[:, t]
        v /= v.sum(1, keepdims=True)
        alpha[:, t] = v
    for t in range(length - 2, -1, -1):
        v = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = v / v.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    right = e[:, 1:] * beta[:, 1:]
    norm = np.einsum("nti,ij,ntj->nt", alpha[:, :-1], a, right)
    expected = np.einsum("nti,ntj->ij", alpha[:, :-1] / norm[..., None], right) * a
    seen = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    # a sequence's first word follows any language alike, which weighs the transitions into its own
    first = (p[:, 0] - hot[:, 0]).sum(0)
    return p - hot, expected - seen + a / a.sum(0, keepdims=True) * first


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` documents with a language, outside the held-out fold: the languages take turns
    by the order of a hash, so that rare ones are learned too. Of each document, pieces from anywhere in its whole
    text travel to the driver, however long it is."""
    text_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    # Of a language with many rows, those with small hashes, a few times as many as can be taken: no task ranks more.
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("place")
    few = known.select("doc_id", "lang", place).join(F.broadcast(counts), "lang").where(F.col("place") * F.col("count") < 3.0 * rows * (1 << 40))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    picked = few.withColumn("turn", turn).where(F.col("turn") <= rows)
    picked = picked.orderBy("turn", "place", "doc_id").limit(rows).select("doc_id", "lang").distinct()

    def cut(batches):
        for batch in batches:
            texts, langs = [], []
            for lo, hi, buf, at in tc.chunks(batch.column(0)):
                start, end = tc.words(buf, _LETTER)
                first = np.concatenate((np.searchsorted(start, at), [len(start)]))
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    step = max(LENGTH, -(-(b - a) // PIECES))
                    for s in range(a, b, step):
                        # from the middle of each of the parts that the words are dealt into
                        s += max(0, (min(step, b - s) - LENGTH) // 2)
                        e = min(s + LENGTH, b)
                        texts.append(b" ".join(buf[start[w] : end[w]].tobytes() for w in range(s, e)).decode("utf-8", "replace"))
                        langs.append(batch.column(1)[lo + i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.string())], names=["text", "lang"])
            give_back()

    # At most ``rows`` ids are broadcast.
    mine = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).select("text", "lang")
    got = mine.mapInArrow(cut, "text string, lang string").orderBy(F.xxhash64("text"), "text", "lang").limit(rows * PIECES)
    model = train([(r[0], r[1]) for r in got.collect()])
    give_back()
    return model


def with_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (mean probability of that language over the words) and ``fits``
    (whether the text is made up as labelled texts are).

    Null and empty texts, and texts without letters, are of language ``und`` with score 0; whole texts are
    read; repeated rows are alike; an empty table gives no rows; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for batch in batches:
            langs, scores, fits = shared.value.texts(batch.column(batch.schema.get_field_index(text)))
            yield batch, [pa.array(langs, pa.string()), scores, fits]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())]
    return with_columns_from_batches(docs, make, fields)


def word_languages(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text."""
    out = []
    for _, _, buf, start, end, _, p, _ in model.words(pa.array([text], pa.large_string())):
        out += [(buf[s:e].tobytes().decode("utf-8", "replace"), model.langs[int(x.argmax())], float(x.max())) for s, e, x in zip(start, end, p, strict=True)]
    return out


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = with_languages(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
