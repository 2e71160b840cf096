"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text (shares of characters, words,
lines and their repetition, and of the words themselves, hashed to ``CELLS``).  Labelled rows give preference pairs, a good one over a bad
one; the weights minimize the logistic loss of the feature differences.  The threshold is
the quantile of the sample's strengths that separates its labels best, and strengths are
shifted so that a document at the threshold has the score ``CUT``.

Fitted to a bounded sample (see ``labelled``), in which every row stands in ``PARTNERS``
pairs or more.  Defined cases: null and empty texts have the features of no words and get
a score.  With labels of one kind only, all weights are 0 and every score is ``CUT``.  Rows
that repeat an id are scored each; labels that repeat an id and a value count once.  Texts
of any length are read whole; ties in strength share a score.  Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gritsieve.llm.common import pieces
from gritsieve.llm.labelled import MOST_ROWS, logistic, sample, sigmoid, with_texts

CUT = 0.3
PARTNERS = 12
L2 = 2.0
#: Cells of hashed words, and how much their scale is reduced: single words only decide with much evidence.
CELLS, REDUCED = 64, 20.0
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: bytes | None) -> np.ndarray:
    text = text or b""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    chars, count = max(len(text), 1), max(len(words), 1)
    upper, lower, digits = n[65:91].sum(), n[97:123].sum(), n[48:58].sum()
    letters = max(upper + lower + n[128:].sum(), 1)
    marks = n[list(_MARKS)]
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    runs = np.zeros(max(len(of) - 3, 0), np.uint64)
    for k in range(4 if len(runs) else 0):
        runs = (runs ^ of[k : k + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(32)
    cells = np.bincount([zlib.crc32(w.lower()) % CELLS for w in number] if number else [], np.bincount(of.astype(np.int64), minlength=len(number)) if number else [], CELLS)
    ends = sum(w[-1] in b".!?" for w in words)
    marked = sum(not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or w[-1] >= 97) for w in words)
    shares = [
        upper / letters, digits / chars, n[128:].sum() / chars, n[10] / chars, n[32] / chars, marks.sum() / chars,
        1 - len(number) / count, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(np.unique(runs)) / max(len(runs), 1),
        ends / count, marked / count, sum(w.isupper() for w in words) / count, sum(len(w) == 1 for w in words) / count, sum(len(w) > 12 for w in words) / count,
        n[n > 0].max(initial=0) / chars,
    ]
    shares = np.concatenate([np.array(shares, float), marks / count])
    sizes = np.array([np.log1p(len(words)), np.log1p(len(lines)), np.log1p(chars / count), np.log1p(count / max(len(lines), 1)), np.log1p(count / max(ends, 1))])
    return np.concatenate([shares, np.sqrt(shares), sizes, sizes**2 / 10, np.sqrt(cells / count)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        f = [features(x.as_py()) for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], names=["y", "f"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, f: np.ndarray) -> np.ndarray:
        z = (f - self.mean) / self.scale @ self.weights - self.threshold
        return sigmoid(z + np.log(CUT / (1 - CUT)))


def fit(f: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    mean = f.mean(axis=0) if len(f) else np.zeros(f.shape[1])
    scale = np.maximum(f.std(axis=0), 1e-6) if len(f) else np.ones(f.shape[1])
    scale[-CELLS:] *= REDUCED
    x = np.clip((f - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(f.shape[1]), 0.0)
    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * 2 + PARTNERS * min(len(good), len(bad))
    pick = lambda a: np.concatenate([rng.permutation(a) for _ in range(-(-n // len(a)))])[:n]  # noqa: E731  each row equally often
    difference = x[pick(good)] - x[pick(bad)]
    w = logistic(difference, np.ones(n), L2, intercept=False)
    s = np.sort(x @ w)
    order = np.argsort(x @ w, kind="stable")
    # errors of each cut between sorted strengths, labels weighed as they come
    wrong = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([np.cumsum((y[order] == 0)[::-1])[::-1], [0]])
    q = int(wrong.argmin())
    threshold = s[0] - 1 if q == 0 else s[-1] + 1 if q == len(s) else (s[q - 1] + s[q]) / 2
    return Model(mean, scale, w, float(threshold))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    rows = with_texts(docs, sample(labels, "quality", most)).select("y", "text").mapInArrow(_features, "y int, f array<double>").toPandas()
    rows = rows.iloc[np.lexsort(np.array([list(x) for x in rows["f"]]).T)] if len(rows) else rows
    f = np.array([list(x) for x in rows["f"]]) if len(rows) else np.zeros((0, len(features(b""))))
    return fit(f, rows["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches, 1):
            s = m.score(np.clip(np.array([features(x.as_py()) for x in batch.column(1).cast(pa.binary())]), m.mean - 8 * m.scale, m.mean + 8 * m.scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
