"""Best-fit packing by linear grouping.

Documents become pieces of at most ``capacity`` tokens. How many pieces there are of each length is all
that the plan needs, at most ``capacity`` numbers however many documents there are. From them the driver
makes the plan: large lengths are dealt into groups of equal cardinality and rounded up to the largest of
their group; configurations of these few sizes are chosen, fullest first; actual lengths take the places
of the rounded ones; small ones then go where the least room is left. The plan is a short list of
runs (so many sequences of one make-up). Spark numbers the pieces of each length, a length being split
into as many salted parts as its count asks for, and a join with the runs places every piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import give_back, text_batches, written
from pulsegrid.llm.tokens import default_path, ids_of

CAPACITY = 1024
GROUPS = 384
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 8
#: Pieces of one length that are numbered together, and parts of them whose counts are summed together.
NUMBERED, PARTS = 500, 10_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokenise: per piece doc_id, piece, start, length, ids_crc32 (and ids). A null text is an empty one,
    whose only token is the end id; repeated rows and equal ids each give their pieces; a longer document
    is cut into pieces of ``capacity`` tokens, the first one shorter."""
    path = path or default_path()
    text_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches):
        ids = ids_of(path)
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            for lo, _, buf, at in tc.chunks(column):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, x in enumerate(ids.encode(buf, at)):
                    n = -(-len(x) // capacity)
                    s = 0
                    for k in range(n):
                        e = len(x) - (n - 1 - k) * capacity
                        row.append(lo + i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(x[s:e].astype("<u4").tobytes()))
                        s = e
                    if keep_ids:
                        kept.append(x.astype(np.int32))
                out = [names.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                out += [pa.array(c, pa.int64()) for c in (start, length, crc)]
                if keep_ids:
                    edges = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])
            give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


Run = tuple[int, tuple[int, ...]]  # sequences, lengths in each


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs that hold exactly ``counts`` pieces of each length."""
    runs: list[Run] = [(counts[capacity], (capacity,))] if counts.get(capacity) else []
    large = [(n, c) for n, c in sorted(counts.items(), reverse=True) if capacity * SMALL < n < capacity and c]
    small = [(n, c) for n, c in sorted(counts.items(), reverse=True) if n <= capacity * SMALL and c]
    grouped = _groups(large, groups)
    free: dict[int, list[list]] = defaultdict(list)
    for n, make_up in _configurations([(g[0][0], sum(c for _, c in g)) for g in grouped], capacity):
        while n:
            step = min([n, *(grouped[g][0][1] // make_up.count(g) for g in set(make_up))])
            if step:
                lengths = tuple(grouped[g][0][0] for g in make_up)
                for g in make_up:
                    _take(grouped[g], step)
            else:  # the next sequence holds two lengths of one group
                step, lengths = 1, tuple(_take(grouped[g], 1) for g in make_up)
            n -= step
            free[capacity - sum(lengths)].append([step, lengths])
    room = sorted(free)
    for length, n in small:
        while n:
            i = bisect_left(room, length)
            if i == len(room):
                new = -(-n // (capacity // length))
                free[capacity].append([new, ()])
                room.append(capacity)
                continue
            left = room[i]
            have, lengths = free[left].pop()
            if not free[left]:
                del free[left], room[i]
            each = left // length
            used = min(have, n // each)
            add = [(have - used, lengths), (used, lengths + (length,) * each)] if used else [(have - 1, lengths), (1, lengths + (length,) * n)]
            n -= used * each if used else n
            for h, x in add:
                if h:
                    f = capacity - sum(x)
                    if f not in free:
                        insort(room, f)
                    free[f].append([h, x])
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for has in free.values():
        for n, lengths in has:
            if lengths:
                merged[tuple(sorted(lengths, reverse=True))] += n
    return runs + [(n, x) for x, n in merged.items()]


def _groups(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Lengths from the largest on, in groups of equal cardinality: lists of [length, count]."""
    total = sum(c for _, c in large)
    out: list[list[list[int]]] = []
    done, edge = 0, 0
    for length, c in large:
        while c:
            if done == edge:
                out.append([])
                edge = -(-total * len(out) // max(1, min(groups, total)))
            n = min(c, edge - done)
            out[-1].append([length, n])
            c -= n
            done += n
    return out


def _take(group: list[list[int]], n: int) -> int:
    length = group[0][0]
    group[0][1] -= n
    if not group[0][1]:
        group.pop(0)
    return length


def _configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """(sequences, groups in each): the largest size left, with the sizes that fill its sequence best."""
    left = [c for _, c in sizes]
    out = []
    for g, (size, _) in enumerate(sizes):
        while left[g]:
            left[g] -= 1
            fill = _fullest([(s, left[k]) for k, (s, _) in enumerate(sizes)], capacity - size)
            left[g] += 1
            make_up = [g, *fill]
            n = min(left[k] // make_up.count(k) for k in set(make_up))
            for k in make_up:
                left[k] -= n
            out.append((n, make_up))
    return out


def _fullest(sizes: list[tuple[int, int]], room: int) -> list[int]:
    """Indexes of sizes, each at most as often as it is there, whose sum is the largest up to ``room``."""
    by = [None] * (room + 1)
    by[0] = ()
    reached = [0]
    for k, (s, c) in enumerate(sizes):
        if not c or s > room:
            continue
        new = []
        for v in reached:
            x, got = v, by[v]
            for _ in range(min(c, (room - v) // s)):
                x, got = x + s, (*got, k)
                if by[x] is None:
                    by[x] = got
                    new.append(x)
        reached += new
        if by[room] is not None:
            break
    return list(by[max(reached)])


def place(parts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, any others) with sequence_id and offset; read several
    times, so a table. Full pieces are sequences by themselves; the others are numbered within salted parts of their
    length, whose places a second aggregate and a sum over at most ``PARTS`` of them give."""
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for n, lengths in plan({k: v for k, v in counts.items() if k != capacity}, capacity, groups):
        at = 0
        for x in lengths:
            rows.append((x, used[x], used[x] + n, base - used[x], at))
            used[x] += n
            at += x
        base += n
    slots = spark.createDataFrame(rows, "length long, first long, past long, shift long, offset long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    # Parts of a length, and groups of parts: neither a part nor a window over one level grows with the table.
    of_parts = F.array(*[F.lit(-(-counts.get(n, 0) // NUMBERED) or 1).cast("long") for n in range(1, capacity)])
    part = F.pmod(key, F.element_at(of_parts, F.col("length").cast("int")))
    rest = parts.where(F.col("length") < capacity).withColumn("part", part).withColumn("group", F.expr(f"part div {PARTS}"))
    per_part = rest.groupBy("length", "group", "part").agg(F.count("*").alias("n"))
    per_group = per_part.groupBy("length", "group").agg(F.sum("n").alias("in_group"))
    up_to = lambda n, by, on: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups_at = per_group.select("length", "group", up_to("in_group", ["length"], "group").alias("group_at"))
    offsets = per_part.withColumn("part_at", up_to("n", ["length", "group"], "part")).join(groups_at, ["length", "group"])
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = (
        rest.withColumn("rank", F.row_number().over(order) - 1)
        .join(offsets.select("length", "part", (F.col("group_at") + F.col("part_at")).alias("before")), ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    # At most a few rows for each of the capacity's lengths and groups, however many pieces there are.
    on = [numbered["length"] == slots["length"], F.col("rank") >= F.col("first"), F.col("rank") < F.col("past")]
    own = [c for c in parts.columns]
    placed = numbered.join(F.broadcast(slots), on).select(*[numbered[c] for c in own], (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
    # A full piece needs no place among others: any number of its own will do, from its row's place in the table.
    full = parts.where(F.col("length") == capacity).select(*own, (F.monotonically_increasing_id() + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full)


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, with ``keep_ids`` the ids, sequence_id, offset.

    A null text is an empty one, whose only token is the end id; very long ones are tokenised whole and cut;
    repeated rows each give their pieces; a doc_id that is no number is null; other columns are not read; an
    empty table gives no rows."""
    return place(written(pieces(docs, capacity=capacity, path=path, keep_ids=keep_ids), "pieces"), capacity, groups)
