"""Jaccard join of word n-gram sets with signature trees.

1. Every text becomes the set of its shingles' codes; equal sets are one class.
2. A set's codes are dealt into P parts by a hash, with P fixed for a class of sizes. Sets with J >= t differ in
   at most (a + b)(1 - t)/(1 + t) codes and so in no more parts. Each set gives one key for each of its filled
   parts, from the first part on until they outnumber that by ``NEED``: so many keys any two linked sets have
   in common, whichever of them gives fewer. Sets near a border give keys of the class below as well.
3. Keys that two sets share make the candidate graph (each set to the smallest set of its key), whose
   components are the groups that can hold a link. The graph has a part for each pair of neighbouring bands of
   sizes: linked sets meet in one of them, and unlike sizes don't chain. Sets that share fewer keys than a link
   takes are left out of it, such as those with only a passage in common. Keys travel once.
   A set's keys that are too common to be needed join nothing, and a group of more than ``WHOLE`` sets is split by
   the shingles that are rare in it: lines that many texts have don't chain groups.
4. Sets meet in their group, a group larger than ``BLOCK`` sets in blocks: each block is joined within itself
   and with the group's first one. Only the sets that are then outside the group's largest class meet all its
   blocks, so that a large group of near copies is not joined pair by pair of its blocks. In a task, a tree's
   nodes hold the OR of their sets' bitmaps and their range of sizes; a dual traversal drops node pairs whose
   largest possible overlap is too small, or that are joined already, and compares the rest exactly.
5. Joined sets give few edges (a spanning forest of each task), and components give the classes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import bitmap, connected_components, give_back, in_bitmap, text_batches, with_columns_from_batches, written

WORDS, PERCENT = 3, 90
#: Sets that one task holds of each side, and their codes, both on average.
BLOCK, BLOCK_CODES = 512, 2_000_000
#: Sets of a group that is not split.
WHOLE = 64
#: Keys that linked sets share, at most, and the codes that one of them takes.
NEED, PER_NEED = 32, 3
BITS = 2048
LEAF, FAN = 8, 8
#: Ratio of the sizes that bound a class.
STEP = 0.6


#: Odd factors of a shingle's words.
_FACTORS = tc.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _runs(word: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of ``n`` words, in their order."""
    out = np.zeros(len(word) - n + 1, np.uint64)
    for k in range(n):
        if k and k % len(_FACTORS) == 0:
            out = tc.mix(out)
        out += word[k : len(word) - n + 1 + k] * _FACTORS[k % len(_FACTORS)]
    return tc.mix(out) + np.uint64(n)


def _distinct(code: np.ndarray) -> np.ndarray:
    code = np.sort(code)
    return code[np.concatenate(([True], code[1:] != code[:-1]))]


def shingles(word: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of ``n`` consecutive words, ascending; of fewer words, the whole sequence as one."""
    return _distinct(_runs(word, min(n, len(word)))) if len(word) else word


def _bounds(percent: int) -> np.ndarray:
    """Upper sizes of the classes, from the smallest size that can link with another size."""
    low = -(-percent // (100 - percent))
    out = [low]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] / STEP) + 1)
    return np.array(out)


def _needed(size: np.ndarray) -> np.ndarray:
    """Keys that a set of so many codes has beyond those that can differ."""
    return np.clip(size // PER_NEED, 1, NEED)


def _reach(size: np.ndarray, target: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The parts of ``parts`` of which at least ``target`` are filled by ``size`` codes, by four deviations."""
    filled = -np.expm1(size * np.log1p(-1.0 / parts))
    side = 4 * np.sqrt(filled * (1 - filled))
    return np.ceil(((side + np.sqrt(side * side + 4 * filled * target)) / (2 * filled)) ** 2).astype(np.int64)


def _differ(size: np.ndarray, partner: np.ndarray, percent: int) -> np.ndarray:
    return (size + partner) * (100 - percent) // (100 + percent)


@functools.cache
def _parts(lower: int, upper: int, percent: int) -> int:
    """Parts for sets of ``lower`` to ``upper`` codes: nearly all fill as many of them as their keys take."""
    size = np.array([lower, upper])
    target = _differ(size, size * 100 // percent, percent) + _needed(size)
    p = int(target.max()) + 1
    while (_reach(size, target, np.array([p, p])) > p).any() and p < 16 * upper + 64:
        p += 1 + p // 16
    return p


def keys(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """``(set, key)`` pairs: two sets of a similarity of ``percent`` or more have a key in common or are equal."""
    return keys_and_needs(sets, percent)[:2]


def keys_and_needs(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(set, key, need)``: if a set links with another by a class, at least half of ``need``, rounded down, of its
    keys of this class are keys of that set too; an odd ``need`` marks keys of the class below the set's own.

    Of sets A and B, both give keys of the parts up to the lesser of their reaches. In these the set with that
    reach fills as many parts as can differ and its needed ones besides. Where chance fills too few parts, a set
    gives keys for all, also for empty ones."""
    bounds = _bounds(percent)
    size = np.array([len(s) for s in sets], np.int64)
    which, out, needs = [], [], []
    own = np.searchsorted(bounds, size)
    for level in (0, -1):
        c = own + level
        can = (c >= 0) & (size >= bounds[0])  # smaller sets link with equal ones only
        if level:
            can &= size * percent <= bounds[np.maximum(c, 0)] * 100
        for_class = np.flatnonzero(can)
        if not len(for_class):
            continue
        made = {k: _parts(int(bounds[k - 1]) + 1 if k else int(bounds[0]), int(bounds[k]), percent) for k in set(c[for_class].tolist())}
        parts = np.array([made[k] for k in c[for_class].tolist()], np.int64)
        base = np.concatenate(([0], np.cumsum(parts)))
        every = np.concatenate([sets[i] for i in for_class])
        mine = size[for_class]
        owner = np.repeat(np.arange(len(for_class)), mine)
        mixed = tc.mix(every)
        part = (((mixed >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        # Equal parts hold equal codes in the same order, so their sums round alike.
        total = np.bincount(base[owner] + part, (mixed & np.uint64((1 << 53) - 1)).astype(np.float64) + 1, base[-1])
        filled = total > 0
        of = np.repeat(np.arange(len(for_class)), parts)
        index = np.arange(base[-1]) - base[of]
        differ = _differ(mine, bounds[c[for_class]] if level else mine * 100 // percent, percent)
        target = differ + _needed(mine)
        reach = parts if level else np.minimum(_reach(mine, target, parts), parts)
        use = filled & (index < reach[of])
        lacking = np.bincount(of, use, len(for_class)).astype(np.int64) < target
        use |= lacking[of]
        # the smallest partner needs the fewest
        need = np.where(lacking, np.minimum(_needed(mine), np.maximum(1, parts - differ)), _needed(mine))
        need = np.minimum(need, _needed(mine * percent // 100))
        used = np.flatnonzero(use)
        of = of[used]
        tag = tc.mix(c[for_class][of].astype(np.uint64) * np.uint64(1 << 40) + index[used].astype(np.uint64))
        which.append(for_class[of])
        out.append(tc.mix(tag + tc.mix(total[used].view(np.uint64)) + filled[used].astype(np.uint64)))
        needs.append((2 * need - level)[of].astype(np.int32))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(which), np.concatenate(out), np.concatenate(needs)


def _sets(column, words: int):
    for lo, _, buf, at in tc.chunks(column):
        code, first = tc.text_words(buf, at, tc.SPACED)
        run = _runs(code, words) if len(code) >= words else code[:0]
        spans = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
        yield lo, [_distinct(run[i : j - words + 1]) if j - i >= words else shingles(code[i:j], words) for i, j in spans]


def set_code(s: np.ndarray) -> int:
    """One code for a set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        a = tc.mix(s + np.uint64(77)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(tc.mix(np.array([a]))[0].view(np.int64)) or 1


class Tree:
    """Rows of sorted code sets; levels of nodes with OR bitmaps, ranges of sizes and slack."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s & np.uint64(BITS - 1)).astype(np.int64)] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        self.order = np.lexsort((words[:, 0], size))
        self.sets = sets
        self.size, self.words = size[self.order], words[self.order]
        slack = self.size - np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.slack = slack
        #: A level: (first row, end row, OR, smallest size, largest size, largest slack) of each node.
        self.levels = []
        first = np.arange(0, len(sets), LEAF)
        while True:
            end = np.append(first[1:], len(sets))
            self.levels.append(
                (
                    first,
                    end,
                    np.bitwise_or.reduceat(self.words, first, axis=0),
                    np.minimum.reduceat(self.size, first),
                    np.maximum.reduceat(self.size, first),
                    np.maximum.reduceat(slack, first),
                )
            )
            if len(first) == 1:
                break
            first = first[::FAN]

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))


class Joined:
    """Union-find of the rows of a task."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def find(self, i: int) -> int:
        while self.to[i] != i:
            self.to[i] = self.to[self.to[i]]
            i = self.to[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.to[self.to]
            if (up == self.to).all():
                return up
            self.to = up


def join(left: Tree, right: Tree | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between two trees, or within one (``right`` None), as pairs of rows of
    ``left.sets`` and ``right.sets``."""
    same = right is None
    right = left if same else right
    shift = 0 if same else len(left.sets)
    joined = Joined(shift + len(right.sets))
    out = []

    def possible(common, small_a, large_a, slack_a, small_b, large_b, slack_b):
        """The largest possible overlap reaches what the smallest sizes need, and the sizes can meet."""
        most = np.minimum(np.minimum(slack_a, slack_b) + common, np.minimum(large_a, large_b))
        fits = (100 * np.asarray(large_a) >= percent * np.asarray(small_b)) & (100 * np.asarray(large_b) >= percent * np.asarray(small_a))
        return fits & ((100 + percent) * most >= percent * (small_a + small_b))

    top = len(left.levels) - 1, len(right.levels) - 1
    stack = [(top[0], 0, top[1], 0)]
    while stack:
        la, a, lb, b = stack.pop()
        fa, ea, ora, sa, ga, ka = (x[a] for x in left.levels[la])
        fb, eb, orb, sb, gb, kb = (x[b] for x in right.levels[lb])
        if not possible(int(np.bitwise_count(ora & orb).sum()), sa, ga, ka, sb, gb, kb):
            continue
        roots = joined.roots()
        ra, rb = roots[left.order[fa:ea]], roots[right.order[fb:eb] + shift]
        if ra.min() == ra.max() == rb.min() == rb.max():
            continue
        if la == 0 and lb == 0:
            common = np.bitwise_count(left.words[fa:ea, None] & right.words[None, fb:eb]).sum(2, dtype=np.int64)
            ok = possible(
                common,
                left.size[fa:ea, None], left.size[fa:ea, None], left.slack[fa:ea, None],
                right.size[None, fb:eb], right.size[None, fb:eb], right.slack[None, fb:eb],
            )
            if same and a == b:
                ok = np.triu(ok, 1)
            for i, j in np.argwhere(ok & (ra[:, None] != rb[None, :])):
                x, y = int(left.order[fa + i]), int(right.order[fb + j])
                p, q = joined.find(x), joined.find(y + shift)
                if p == q:
                    continue
                s, t = left.sets[x], right.sets[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    joined.to[max(p, q)] = min(p, q)
                    out.append((x, y))
        elif la >= lb and la > 0:
            stack += [(la - 1, c, lb, b) for c in left.children(la, a)] if not (same and la == lb and a == b) else [
                (la - 1, c, la - 1, d) for c in left.children(la, a) for d in left.children(la, a) if c <= d
            ]
        else:
            stack += [(la, a, lb - 1, c) for c in right.children(lb, b)]
    return out


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Words stand between ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has is one
    shingle; null and empty texts, and texts without words, have none and link with nothing. Very long texts
    are read whole. Equal texts and repeated rows are linked; rows that share a doc_id and not the text are
    sets of their own; a null doc_id is kept, and is its own class where no other is reachable; an empty table
    gives no rows. Other columns are not read.
    """
    return _labelled(docs, doc_id, text, words, percent).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Per document: doc_id, n_shingles, code of its set, root (a code that names its class), component_id (null: it
    has no words, or no id is in its class)."""
    if not 0 < percent < 100:
        raise ValueError("percent must be between 0 and 100")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # what a row is found by again: its id and text, as ids may be null or shared
    slim = slim.withColumn("row", F.xxhash64("doc_id", "text"))
    text_batches(docs.sparkSession)

    def describe(batches):
        for batch in batches:
            n, code = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo, sets in _sets(batch.column(1), words):
                for i, s in enumerate(sets):
                    n[lo + i], code[lo + i] = len(s), set_code(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(code)], names=["doc_id", "row", "n_shingles", "code"])
            give_back()

    seen = written(slim.mapInArrow(describe, "doc_id long, row long, n_shingles long, code long"), "sets")
    groups = written(connected_components(_candidates(slim, words, percent), "groups"), "groups")
    links = _links(slim, seen, groups, words, percent)
    root = connected_components(links, "links")
    classes = seen.where("n_shingles > 0").groupBy("code").agg(F.min("doc_id").alias("first"))
    rooted = classes.join(root.withColumnRenamed("node", "code"), "code", "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(rooted.join(smallest, "root").select("code", "root", "component_id"), "labels")
    return seen.join(labels, "code", "left").select("doc_id", "n_shingles", "code", "root", "component_id")


def _keyed(slim: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (key, code, mark) of all sets, each set once in a task; ``mark``: band of the size, then ``need`` in 8 bits."""

    def show(batches):
        done = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), words):
                new = []
                for s in sets:
                    if len(s) and (code := set_code(s)) not in done:
                        done.add(code)
                        new.append((code, s))
                row, key, need = keys_and_needs([s for _, s in new], percent)
                code = np.array([c for c, _ in new], np.int64)[row]
                band = _band(np.array([len(s) for _, s in new], np.int64), percent)[row].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "code": pa.array(code), "mark": pa.array(need + (band << 8))})
            give_back()

    return slim.select("text").mapInArrow(show, "key long, code long, mark int")


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    """Bands of sizes: the sizes of two linked sets are in one band or in neighbouring ones."""
    return np.floor(np.log(size) / np.log(100 / percent) + 1e-6).astype(np.int64)


def _node(code: str, pair) -> Column:
    """A set in a pair of neighbouring bands, which the lower one names."""
    return F.xxhash64(code, pair)


def _candidates(slim: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that join each set, in a pair of bands, to the other sets that it may link with there.

    A set with fewer shared keys than it needs for any link leaves first, so that sets that have only a passage
    in common do not chain groups together.
    """
    band, need = F.shiftright("mark", 8), F.col("mark").bitwiseAND(255)
    keyed = _shared(_keyed(slim, words, percent).select("key", "code", band.alias("band"), need.alias("need"))).drop("low", "times")
    # The pair of bands from a set's own one up is for links within it and with the next one, the pair from the one
    # below for links with that one only.
    near = Window.partitionBy("key").orderBy("band")
    own, above, below = (near.rangeBetween(k, k) for k in (0, 1, -1))
    up = (F.min("code").over(own) < F.max("code").over(own)) | (F.count("*").over(above) > 0)
    shared = keyed.withColumns({"up": up.cast("int"), "down": (F.count("*").over(below) > 0).cast("int")}).where("up + down > 0")
    mine = Window.partitionBy("code", "need")
    least = F.shiftright("need", 1)
    counted = shared.withColumns({"n_up": F.sum("up").over(mine), "n_down": F.sum("down").over(mine)})
    pair = F.explode(
        F.concat(
            F.when((F.col("up") > 0) & (F.col("n_up") >= least), F.array("band")).otherwise(F.array().cast("array<int>")),
            F.when((F.col("down") > 0) & (F.col("n_down") >= least), F.array(F.col("band") - 1)).otherwise(F.array().cast("array<int>")),
        )
    ).alias("pair")
    paired = counted.select("key", "code", "need", pair)
    left = _shared(paired.select(F.xxhash64("key", "pair").alias("key"), _node("code", F.col("pair")).alias("code"), "need"))
    return _edges(left, least)


def _edges(shared: DataFrame, least: Column) -> DataFrame:
    """Pairs (a, b) of sets that join those with a key in common which is not among the ``least`` - 1 commonest of
    either. Sets that share ``least`` keys or more have such a key: the rarest of those they share."""
    rank = F.dense_rank().over(Window.partitionBy("code", "need").orderBy(F.desc("times"), "key"))
    able = shared.withColumn("rank", rank).where(F.col("rank") >= least).select("key", "code")
    return _shared(able).where("code <> low").select(F.col("code").alias("a"), F.col("low").alias("b"))


def _shared(shown: DataFrame) -> DataFrame:
    """The rows of ``shown`` whose key several sets have, with ``low``, the smallest of these sets' codes, and how many
    ``times`` the key comes."""
    same = Window.partitionBy("key")
    both = shown.withColumns({"low": F.min("code").over(same), "high": F.max("code").over(same), "times": F.count("*").over(same)})
    return both.where("low < high").drop("high")


def _texts(slim: DataFrame, members: DataFrame) -> DataFrame:
    """(row, text) of the rows of ``members``, and a few others."""
    wanted = bitmap(members, "row")

    def those(batches):
        for batch in batches:
            hit = pa.array(in_bitmap(wanted.value, batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns], names=["row", "text"])

    # Texts travel rather than sets, which are larger; of repeated rows one does.
    return slim.select("row", "text").mapInArrow(those, "row long, text string").groupBy("row").agg(F.first("text").alias("text"))


def _split(slim: DataFrame, named: DataFrame, words: int, percent: int) -> DataFrame:
    """``named`` with its groups of more than ``WHOLE`` sets split: into sets that share one of their rarest shingles.

    Lines that many texts have chain such groups together. A linked set has ``percent`` of a set's shingles, so the
    two share one that is not among the set's commonest within the group. Sets that share none with any have no link.
    """
    large = written(named.join(named.groupBy("group").count().where(F.col("count") > WHOLE), "group", "left_semi"), "large")
    if large.isEmpty():
        return named

    def show(batches):
        for batch in batches:
            codes = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, sets in _sets(batch.column(2), words):
                right = [i for i, s in enumerate(sets) if set_code(s) == codes[lo + i]]
                if not right:
                    continue
                size = np.array([len(sets[i]) for i in right], np.int64)
                row = np.repeat(np.array(right, np.int64) + lo, size)
                key = np.concatenate([sets[i] for i in right]).view(np.int64)
                least = np.repeat(-(-size * percent // 100), size)
                yield pa.RecordBatch.from_pydict({"group": batch.column(0).take(pa.array(row)), "key": pa.array(key), "code": pa.array(codes[row]), "need": pa.array(least)})
            give_back()

    texts = large.join(_texts(slim, large), "row").select("group", "code", "text")
    shown = texts.mapInArrow(show, "group long, key long, code long, need long")
    node = F.xxhash64("code", "group")
    shared = _shared(shown.select(F.xxhash64("key", "group").alias("key"), node.alias("code"), "need"))
    root = connected_components(_edges(shared, F.col("need")), "split")
    parts = large.withColumn("node", node).join(root, "node").select(F.col("root").alias("group"), "code", "row", "n")
    return named.join(large.select("group").distinct(), "group", "left_anti").unionByName(parts)


def _links(slim: DataFrame, seen: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Links found in the groups, as pairs (a, b) of set codes."""
    # A set's text comes from one of its rows.
    of_row = seen.where("code <> 0").groupBy("code").agg(F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + 1e-6).cast("int")
    nodes = of_row.select("code", "row", "n", F.explode(F.array(band, band - 1)).alias("pair")).select("code", "row", "n", _node("code", F.col("pair")).alias("node"))
    named = written(groups.withColumnRenamed("root", "group").join(nodes, "node").select("group", "code", "row", "n"), "named")
    named = _split(slim, named, words, percent)
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_CODES))).cast("int")
    sizes = named.groupBy("group").agg(blocks.alias("blocks"))
    dealt = named.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    dealt = written(dealt, "members")
    texts = _texts(slim, dealt)

    def compare(table: pa.Table, within: bool) -> pa.Table:
        code, side, *place = (table.column(c).to_numpy() for c in ("code", "side", "j", "i", "group"))
        text = table.column("text").cast(pa.large_string()).combine_chunks()
        order = np.lexsort(place)
        ends = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in place], axis=0)) + 1
        a, b = [], []
        for rows in np.split(order, ends):
            sides = []
            for k in (0, 1):
                of = rows[side[rows] == k]
                sets = [x for _, some in _sets(text.take(pa.array(of)), words) for x in some]
                mine = {c: s for c, s in zip(code[of].tolist(), sets, strict=True) if set_code(s) == c}
                own = sorted(mine)
                sides.append((own, Tree([mine[c] for c in own]) if own else None))
            (of_left, left), (of_right, right) = sides
            found = [(of_right, of_right, join(right, None, percent))] if within and right else []
            if left and right:
                found.append((of_left, of_right, join(left, right, percent)))
            a += [x[i] for x, _, pairs in found for i, _ in pairs]
            b += [y[j] for _, y, pairs in found for _, j in pairs]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # Groups of one block go to a task many at a time.
    small = dealt.where("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-small[0] // BLOCK), -(-small[1] // BLOCK_CODES))

    def joined(places: DataFrame, within: bool, name: str) -> DataFrame:
        bin_ = F.when(F.col("blocks") > 1, F.xxhash64("group", "i", "j")).otherwise(F.pmod(F.xxhash64("group"), F.lit(bins)))
        tasks = places.withColumn("bin", bin_).drop("blocks").join(texts, "row").groupBy("bin")
        return written(tasks.applyInArrow(lambda table: compare(table, within), "a long, b long").where("a <> b"), name)

    # Each block meets itself and, as the right side, the first block of its group.
    to = F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("j")
    first = dealt.select("group", "code", "row", "blocks", "block", to).withColumns({"i": F.lit(0), "side": (F.col("block") == F.col("j")).cast("int")})
    links = joined(first, True, "links")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return links
    root = connected_components(links.join(large.select(F.col("code").alias("a")), "a", "left_semi"), "blocks")
    placed = large.join(root.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    largest = placed.groupBy("group", "root").count().groupBy("group").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = written(placed.join(largest, "group").where("root <> main").select("group", "code", "row", "n", "blocks"), "rest")
    if rest.isEmpty():
        return links
    others = rest.groupBy("group").agg(blocks.alias("others"))
    i = F.pmod(F.xxhash64(F.lit(1), "code"), F.col("others")).cast("int").alias("i")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(others, "group").select("group", "code", "row", "blocks", i, count("blocks").alias("j"), F.lit(0).alias("side"))
    right = large.join(others, "group").select("group", "code", "row", "blocks", count("others").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    return links.union(joined(left.union(right), False, "links"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id. Where rows of a class share that id,
    the one whose set has the smallest code stays, and one of those with equal sets. Documents without words, and rows
    without doc_id, all stay."""
    found = written(_labelled(docs, "doc_id", "text", words, percent).where("doc_id is not null and n_shingles > 0"), "classes")
    several = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    gone = found.join(several, "doc_id", "left_anti").where("doc_id <> component_id").select("doc_id")
    single = docs.join(gone.union(several), "doc_id", "left_anti")

    def coded(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for lo, sets in _sets(batch.column(batch.schema.get_field_index("text")), words):
                code[lo : lo + len(sets)] = [set_code(s) for s in sets]
            yield batch, [code]

    again = with_columns_from_batches(docs.join(several, "doc_id", "left_semi"), coded, [T.StructField("__code", T.LongType())])
    stay = found.join(several, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "root").agg(F.min("code").alias("__code"))
    marked = again.where("__code <> 0").join(stay, ["doc_id", "__code"], "left_semi").dropDuplicates(["doc_id", "__code"])
    return single.unionByName(marked.drop("__code")).unionByName(again.where("__code = 0").drop("__code")).select(*docs.columns)
