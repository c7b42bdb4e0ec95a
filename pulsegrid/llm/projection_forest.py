"""Embedding near-duplicates with a forest of random-projection trees.

Trees are fitted on a bounded sample: at each level of a tree a random direction splits every node at its
median, and vectors close to the split go to both sides (spill). Levels beyond what the sample can tell apart
split every node at the direction's overall median, so that trees are as deep as the table asks for. There are
as many trees as it takes for made-up pairs at the threshold to share a leaf (``ENOUGH`` of them); vectors of each
length have a forest of their own. Every vector is routed down every tree, and vectors that share a leaf are
compared in double precision. A leaf with more than ``BLOCK`` vectors is compared block by block, so that no task
holds more than two blocks and no vector is left out. A pair that shares several leaves counts in the first of
them, which both vectors' leaf lists tell.

Equal vectors are one class, compared once; a class weighs as many vectors as it has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import connected_components, written

COSINE = 0.95
#: Numbers in the sample of distinct vectors that the trees are fitted on, and its rows at most; the share of a
#: node that goes to both sides.
NUMBERS, SAMPLE, SPILL = 4_000_000, 20_000, 0.16
LEAF = 300
#: Made-up pairs, the share of them that must meet, and the most trees.
PAIRS, ENOUGH, TREES = 2000, 0.997, 24
#: Vectors of a length that the sample needs for a forest; rarer lengths are one leaf each.
LEAST = 8
#: Vectors of one side of a comparison.
BLOCK = 1500


class Forest:
    """Directions of each level of each tree, and the lower and upper edge of each node's overlap."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, spill: float = SPILL, cosine: float = COSINE, trees: int = TREES, enough: float = ENOUGH, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.depth = max(0, math.ceil(math.log2(max(1, rows / leaf)) - 1e-9))
        fitted = min(self.depth, int(math.log2(max(1, len(sample) / 8))))
        one = sample[rng.integers(0, len(sample), PAIRS)]
        aside = rng.normal(size=one.shape)
        aside -= (aside * one).sum(1, keepdims=True) * one
        other = cosine * one + math.sqrt(1 - cosine * cosine) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        self.trees = []
        apart = np.ones(PAIRS, bool)
        while not self.trees or (len(self.trees) < trees and apart.mean() > 1 - enough):
            directions = rng.normal(size=(self.dim, max(1, self.depth)))
            low, high = [], []
            shown = sample @ directions
            at = np.zeros(len(sample), np.int64)
            cuts = [0.5 - spill / 2, 0.5, 0.5 + spill / 2]
            for level in range(self.depth):
                lo, mid, hi = (np.full(1 << min(level, fitted), q) for q in np.quantile(shown[:, level], cuts))
                if level < fitted:
                    order = np.argsort(at, kind="stable")
                    edge = np.searchsorted(at[order], np.arange((1 << level) + 1))
                    for node in np.flatnonzero(np.diff(edge)):
                        lo[node], mid[node], hi[node] = np.quantile(shown[order[edge[node] : edge[node + 1]], level], cuts)
                    at = 2 * at + (shown[:, level] > mid[at])
                else:
                    lo, hi = lo[:1], hi[:1]
                low.append(lo)
                high.append(hi)
            self.trees.append((directions, low, high))
            (r, a), (q, b) = self._leaves(one, len(self.trees) - 1), self._leaves(other, len(self.trees) - 1)
            same = np.intersect1d((r << 44) + a % (1 << 44), (q << 44) + b % (1 << 44))
            apart[same >> 44] = False

    def _leaves(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        directions, low, high = self.trees[t]
        shown = x @ directions
        row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            v = shown[row, level]
            node = np.minimum(at, len(low[level]) - 1)
            left, right = v <= high[level][node], v >= low[level][node]
            row, at = np.concatenate((row[left], row[right])), np.concatenate((2 * at[left], 2 * at[right] + 1))
        return row, at

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf of every tree that a row reaches."""
        found = [self._leaves(x, t) for t in range(len(self.trees))]
        return np.concatenate([r for r, _ in found]), np.concatenate([a + (t << 44) for t, (_, a) in enumerate(found)])


def unit(vectors) -> np.ndarray:
    """Vectors of one length as rows of length 1; large and small components are scaled first."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(code: np.ndarray, weight: np.ndarray, x: np.ndarray, leaves: list, leaf: int, split: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of one leaf, the first ``split`` of which are one block and the rest another (0: all are
    one): the vectors each is linked to and not in an earlier leaf, and the smallest code it is joined to."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if split:
        near[:split, :split] = near[split:, split:] = False
    linked = near.any(1)
    n, root = np.zeros(len(code), np.int64), code.copy()
    if not linked.any():
        return n, root
    some = np.flatnonzero(linked)
    earlier = [[v for v in leaves[i] if v < leaf] for i in some]
    known = {v: k for k, v in enumerate(sorted({v for e in earlier for v in e}))}
    held = np.zeros((len(some), max(1, len(known))), np.float32)
    for k, e in enumerate(earlier):
        held[k, [known[v] for v in e]] = 1
    part = near[np.ix_(some, some)]
    n[some] = (part & (held @ held.T == 0)) @ weight[some]
    r = code[some]
    while True:
        low = np.minimum(r, np.where(part, r[None, :], np.iinfo(np.int64).max).min(1))
        if (low == r).all():
            break
        r = low
    root[some] = r
    return n, root


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; those of unlike lengths
    don't link with one another. Repeated rows are vectors of their own, linked with each other. Very long vectors
    are compared whole. An empty table gives no rows; a null vec_id is its own component if none is reachable;
    other columns are not read."""
    spark = vectors.sparkSession
    kept = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kept).alias("v"))
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    # The code of a vector: its components and their number.
    rows = rows.withColumn("code", F.when(F.col("v").isNotNull() & fine, F.xxhash64("v", F.size("v"))))
    classes = written(
        rows.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("v").alias("v")), "vectors"
    )
    n, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    sample = classes.orderBy(F.hash("code"), "code").limit(max(1, min(SAMPLE, NUMBERS // (longest or 1)))).select("v").toArrow().column(0)
    length = np.asarray(pc.list_value_length(sample))
    forests = {}
    for dim in np.unique(length).tolist():
        mine = sample.filter(pa.array(length == dim))
        if len(mine) >= LEAST:
            flat = pc.list_flatten(mine).to_numpy().astype(np.float64).reshape(-1, dim)
            forests[dim] = Forest(unit(flat), math.ceil(n * len(mine) / len(sample)), LEAF, cosine=cosine)
    shared = spark.sparkContext.broadcast(forests)

    def route(batches):
        for every in batches:
            size = every["v"].map(len)
            for dim, pdf in every.groupby(size.to_numpy()):
                forest = shared.value.get(dim)
                row, leaf = forest.leaves(unit(pdf["v"].tolist())) if forest else (np.arange(len(pdf)), np.zeros(len(pdf), np.int64))
                by = np.lexsort((leaf, row))
                parts = np.split(leaf[by], np.flatnonzero(np.diff(row[by])) + 1)
                yield pd.DataFrame({"code": pdf["code"], "n": pdf["n"], "v": pdf["v"], "dim": dim, "leaves": parts})

    routed = classes.select("code", "n", "v").mapInPandas(route, f"code long, n long, v {kept}, dim int, leaves array<long>")
    routed = written(routed, "routed")
    placed = routed.select("code", "n", "v", "dim", "leaves", F.explode("leaves").alias("leaf"))
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["dim", "leaf"]).withColumn("block", F.pmod(F.hash("code"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = dealt.select("dim", "leaf", "code", "n", "v", "leaves", "block", other).select(
        "dim", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "code", "n", "v", "leaves"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "code"])
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        split = 0 if i == j else int((pdf["block"] == i).sum())
        code = pdf["code"].to_numpy()
        if i != j and split in (0, len(pdf)):
            return pd.DataFrame({"code": [], "n_links": [], "root": []}, dtype="int64")
        n, root = links(code, pdf["n"].to_numpy(), unit(pdf["v"].tolist()), pdf["leaves"].tolist(), int(pdf["leaf"].iloc[0]), split, cosine)
        some = (n > 0) | (root != code)
        return pd.DataFrame({"code": code[some], "n_links": n[some], "root": root[some]})

    found = written(tasks.groupBy("dim", "leaf", "i", "j").applyInPandas(compare, "code long, n_links long, root long"), "near")
    counts = found.groupBy("code").agg(F.sum("n_links").alias("others"))
    root = connected_components(found.select(F.col("code").alias("a"), F.col("root").alias("b")), "near")
    described = (
        classes.select("code", "n", "first")
        .join(counts, "code", "left")
        .join(root.withColumnRenamed("node", "code"), "code", "left")
        .select("code", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "code").alias("root"))
    )
    described = written(described, "classes")
    smallest = described.groupBy("root").agg(F.min("first").alias("smallest"))
    labels = written(described.join(smallest, "root").select("code", "n_links", F.col("smallest").alias("component_id")), "labels")
    out = rows.select("vec_id", "code").join(labels, "code", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
