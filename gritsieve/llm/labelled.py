"""Bounded samples of labelled rows, to which classifiers are fitted.

``MOST_ROWS`` is the documented bound: of the distinct (id, label) pairs of the training rows,
those with the least hashes are taken, about that many at most.  A pair counts once however
often it is repeated, and an id that several documents share stands for the one whose text
has the least hash, so that no much repeated id can outgrow the bound.  Everything else
covers all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import held_out

MOST_ROWS = 20_000


def sample(labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, y)`` of about ``most`` labelled training ids at the most; rows without a label don't count."""
    rows = labels.filter(~held_out(5) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    n = rows.count()
    if n > most:
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "y"), 33) < int(most / n * 2**31))
    return rows


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(doc_id, y, text)``, a row for each of the chosen; the sample is broadcast, for its size is bounded."""
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "y", "t.text")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, intercept: bool, rounds: int = 30) -> np.ndarray:
    """Weights (the intercept last, if any) by Newton's method; ``y`` may be fractional."""
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    if intercept:
        ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        big = np.abs(step).max(initial=0)
        w -= step * min(1.0, 4.0 / max(big, 1e-12))
        if big < 1e-6:
            break
    return w
