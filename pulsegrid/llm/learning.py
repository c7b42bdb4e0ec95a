"""Logistic regression for the few features that the classifiers collect, and folds by document id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def agreed(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the documents all of whose labels, of those that are 0 or 1, are the same."""
    of_doc = labels.where(F.col(name).isin(0, 1)).groupBy("doc_id").agg(F.min(name).alias("label"), F.max(name).alias("other"))
    return of_doc.where("label = other").select("doc_id", "label")


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at most, by the order of a hash of ``key``: the same ones every time, spread over the table."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the intercept last) by Newton steps with a ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    s = np.ones(len(x)) if weight is None else weight
    damp = ridge * np.eye(x.shape[1]) * len(x)
    damp[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s * (p - y)) + damp @ w
        hess = (x * (s * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + damp + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
