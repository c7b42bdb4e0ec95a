"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns the documents it reads into shards of word codes and sorts every suffix of a shard
(prefix doubling, to the order of as many words as a window has at least). Every suffix of every benchmark item is then
binary-searched in the shard's array; the equal range lists all its occurrences, and occurrences on one
diagonal join into the longest verbatim matches with their places in item and document. No document
leaves its task and nothing is shuffled.

The benchmark is a stated query set: it is dealt into blocks of at most ``BLOCK_BYTES`` of text, and each
block is one broadcast and one map over the documents. After ``BLOCKS`` of them what was found is written as a
table, and their broadcasts go, so that those alive at once don't grow with the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import set_aside, with_columns_from_batches, written

WINDOW = 10
#: Benchmark text in one broadcast.
BLOCK_BYTES = 8_000_000
#: Blocks whose broadcasts are alive at once.
BLOCKS = 8

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.LongType()),
        T.StructField("doc_start", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``matches`` (item_id as text, item_start, doc_start, n_words).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A match is a longest run of
    ``window`` words or more that stands in an item and a document; an item of fewer words matches as a
    whole. ``n_hit`` counts document words inside a match. Null or empty texts have no words and no match, on
    either side; an empty benchmark or table gives zeros or no rows; repeated rows each get their result;
    very long texts are read whole; columns of ``docs`` named like a new one are replaced.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    out, alive = docs, []
    for k in range(blocks):
        if len(alive) == BLOCKS:
            out = written(out, "matches")
            for done in alive:
                done.destroy()
            alive = []
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()
        queries = docs.sparkSession.sparkContext.broadcast(_queries([(r[0], r[1] or "") for r in rows], window))
        alive.append(queries)
        out = _scan(out, text, queries, window, k == 0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any benchmark item, unchanged."""
    docs, own = set_aside(docs, ("n_words", "n_hit", "matches"))
    return find_matches(docs, benchmark, **options).where("n_hit = 0").select(*own)


def _queries(items: list[tuple[str, str]], window: int) -> dict:
    """The suffixes of the items that are ``window`` words or more, and whole items of fewer words."""
    ids, words, start, length, item, place = [], [], [], [], [], []
    total = 0
    for name, body in items:
        (_, _, buf, at), *_ = tc.chunks(pa.array([body], pa.large_string()))
        w, _ = tc.text_words(buf, at, tc.ALNUM)
        if not len(w):
            continue
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            start.append(total + i)
            length.append(n)
            item.append(len(ids))
            place.append(i)
        ids.append(name)
        words.append(w)
        total += len(w)
    return {
        "ids": ids,
        "words": np.concatenate(words) if words else np.zeros(0, np.uint64),
        **{
            k: np.array(v, np.int64)
            for k, v in (("start", start), ("length", length), ("item", item), ("place", place))
        },
    }


def suffix_array(seq: np.ndarray, reach: int = 16) -> np.ndarray:
    """Places of ``seq`` in the order of the ``reach`` or more values from there on (beyond the end: 0)."""
    rank, k = seq, 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - k] = rank[k:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key)
        if 2 * k >= reach:
            return order
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) + 1
        if rank.max(initial=0) == len(rank):
            return order
        k *= 2


def _below(seq, order, at, query, length, upper: bool) -> np.ndarray:
    """How many suffixes are smaller than each query (with ``upper``: or begin with it), by binary search."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order))
    width = query.shape[1]
    reach = np.arange(width)
    inside = reach < length[:, None]
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        got = seq[np.minimum(order[np.minimum(mid, len(order) - 1)][:, None] + reach, len(seq) - 1)]
        differs = (got != query) & inside
        first = differs.argmax(1)
        any_ = differs[at, first]
        less = np.where(any_, got[at, first] < query[at, first], upper)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def _shard(word: np.ndarray, first: np.ndarray, q: dict, window: int) -> list[tuple[int, int, int, int, int]]:
    """Matches in a chunk of texts: (text, item, place in item, place in text, words)."""
    if not len(word) or not len(q["start"]):
        return []
    distinct, inverse = np.unique(word, return_inverse=True)
    found = np.searchsorted(distinct, q["words"])
    code = np.where(distinct[np.minimum(found, len(distinct) - 1)] == q["words"], found + 1, -1)
    n_texts = len(first) - 1
    text = np.repeat(np.arange(n_texts), np.diff(first))
    seq = np.zeros(len(word) + n_texts + window, np.int64)
    seq[np.arange(len(word)) + text] = inverse + 1
    order = suffix_array(seq, window)
    reach = np.minimum(q["start"][:, None] + np.arange(window), len(code) - 1)
    query = code[reach]
    known = ((query >= 0) | (np.arange(window) >= q["length"][:, None])).all(1)
    pick = np.flatnonzero(known)
    if not len(pick):
        return []
    query, length, at = query[pick], q["length"][pick], np.arange(len(pick))
    low = _below(seq, order, at, query, length, False)
    count = _below(seq, order, at, query, length, True) - low
    which = np.repeat(at, count)
    if not len(which):
        return []
    place = order[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(which))]
    start_of = first[:-1] + np.arange(n_texts)
    t = np.searchsorted(start_of, place, "right") - 1
    item, inside, n = q["item"][pick][which], q["place"][pick][which], length[which]
    there = place - start_of[t]
    by = np.lexsort((there, there - inside, item, t))
    t, item, inside, there, n = t[by], item[by], inside[by], there[by], n[by]
    new = np.ones(len(t), bool)
    new[1:] = (
        (t[1:] != t[:-1])
        | (item[1:] != item[:-1])
        | ((there - inside)[1:] != (there - inside)[:-1])
        | (there[1:] != there[:-1] + 1)
    )
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(t)))
    return list(zip(*(x.tolist() for x in (t[begin], item[begin], inside[begin], there[begin], n[begin] + run - 1)), strict=True))


def _covered(matches: list[dict]) -> int:
    total, end = 0, -1
    for s, e in sorted((m["doc_start"], m["doc_start"] + m["n_words"]) for m in matches):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def _scan(docs: DataFrame, text: str, queries, window: int, fresh: bool) -> DataFrame:
    def make(batches):
        q = queries.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found = [[] for _ in range(batch.num_rows)] if fresh else batch.column(batch.schema.get_field_index("matches")).to_pylist()
            n_words = np.zeros(batch.num_rows, np.int64)
            for lo, hi, buf, at in tc.chunks(column):
                word, first = tc.text_words(buf, at, tc.ALNUM)
                n_words[lo:hi] = np.diff(first)
                for t, item, inside, there, n in _shard(word, first, q, window):
                    found[lo + t].append({"item_id": q["ids"][item], "item_start": inside, "doc_start": there, "n_words": n})
            yield batch, [n_words, [_covered(m) if m else 0 for m in found], found]

    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("matches", T.ArrayType(MATCH)),
    ]
    return with_columns_from_batches(docs, make, fields)


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col("text").alias("text"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return find_matches(slim, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
