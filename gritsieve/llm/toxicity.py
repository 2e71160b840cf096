"""Toxicity by weak supervision.

Voters: words and word beginnings that labelled training rows tie to toxic texts (each a
lexicon entry that votes toxic or abstains; ``MOST_VOTERS`` at most, the strongest), and
patterns over them (how many hits, how dense, none at all).  An entry must stand after many different words, so that the wording
of one much-copied text is none.  A generative label model estimates by expectation
maximization how often each voter votes what given the hidden label, weighing each vote
down by the voter's correlations with others given that label, so that entries that always
vote together count once.  A linear (logistic) classifier is trained on its posterior labels; the slope
and offset of its scores are then set by the sample's own labels.

Voters and classifier are fitted to a bounded sample (see ``labelled``).  Defined cases:
null and empty texts have no hits and get a score.  With no toxic training row there are no
voters and every score is the share of toxic labels.  Rows that repeat an id are scored
each; labels that repeat an id and a value count once.  Texts of any length are read whole;
voters that tie are taken by code point.  Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.llm.common import pieces
from gritsieve.llm.labelled import MOST_ROWS, logistic, sample, sigmoid, with_texts

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Size of the lexicon and what an entry needs: log odds, toxic rows, different words before it.
MOST_VOTERS, LEAST_ODDS, LEAST_ROWS, LEAST_SHARE, LEAST_BEFORE = 400, 2.5, 5, 0.004, 5
MEMORY = 200_000
ROUNDS = 40


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(3))], names=["term", "toxic", "clean", "before"])

    seen: dict[str, list[int]] = {}
    for batch in pieces(batches, 1):
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own: dict[str, int] = {}
            last = ""
            for w in WORD.findall((text.as_py() or "").lower()):
                bit = 1 << zlib.crc32(last.encode()) % 62 if y else 0
                for t in terms(w):
                    own[t] = own.get(t, 0) | bit
                last = w
            for t, bits in own.items():
                v = seen.setdefault(t, [0, 0, 0])
                v[1 - y] += 1
                v[2] |= bits
            if len(seen) > 400_000:
                yield out()
                seen = {}
    yield out()


@dataclass
class Lexicon:
    terms: list[str]

    def ready(self) -> None:
        index = {t: k for k, t in enumerate(self.terms)}

        class Hits(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > MEMORY:
                    self.clear()
                out = self[word] = tuple(index[t] for t in terms(word) if t in index)
                return out

        self.hits = Hits()

    def features(self, text: str | None) -> np.ndarray:
        """Presence of each term, then the patterns."""
        words = WORD.findall(text.lower()) if text else []
        hits = [h for h in map(self.hits.__getitem__, words) if h]
        out = np.zeros(len(self.terms) + 5)
        for h in hits:
            out[list(h)] = 1
        kinds = len(set(hits))
        out[-5:] = len(hits) >= 2, kinds >= 2, len(hits) >= 4, not hits, np.log1p(100 * len(hits) / max(len(words), 1))
        return out


def votes(f: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains: of each term, and of four patterns."""
    v = f[:, :-1].copy()
    v[:, -1] = np.where(f[:, -2] > 0, -1, 0)
    return v


def redundancy(cast: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """A weight for each voter: 1, or less for those whose votes go together beyond what the label explains.

    Correlations are taken around each voter's expected vote given the posterior, so that two
    voters that merely both follow the label keep their weights.
    """
    p = np.column_stack([posterior, 1 - posterior])
    expected = p @ ((p.T @ cast) / (p.sum(axis=0)[:, None] + 1e-9))
    spread = cast - expected
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    near = np.clip(spread.T @ spread / norm[:, None] / norm[None, :], 0, 1)
    np.fill_diagonal(near, 1)
    return 1 / np.where(near > 0.3, near, 0).sum(axis=0)


def label_model(v: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior toxicity of each row, and each voter's weight after its correlations."""
    n, m = v.shape
    cast = (v != 0).astype(float)
    posterior = np.where((v[:, :-1] > 0).any(axis=1), 0.9, 0.02)
    for _ in range(ROUNDS):
        weight = redundancy(cast, posterior)
        p, q = posterior.sum(), n - posterior.sum()
        like = np.zeros(n)
        for vote in (-1, 0, 1):
            at = (v == vote).astype(float)
            a, b = (posterior @ at + 0.5) / (p + 1.5), ((1 - posterior) @ at + 0.5) / (q + 1.5)
            like += at @ (weight * np.log(a / b))
        new = sigmoid(like + np.log(prior / (1 - prior)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior, weight


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  #: the intercept last

    def score(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(f @ self.weights[:-1] + self.weights[-1])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    chosen = sample(labels, "toxic", most)
    rows = with_texts(docs, chosen).select("y", "text")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (toxic + 0.5) / (n + 1)
    mined = rows.mapInArrow(_mine, "term string, toxic long, clean long, before long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("before").alias("before"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (n - toxic + 1))
    least = max(LEAST_ROWS, LEAST_SHARE * toxic)
    best = mined.withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= least) & (F.bit_count("before") >= LEAST_BEFORE)).orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(MOST_VOTERS).select("term").collect()
    lexicon = Lexicon([r.term for r in best])
    if not lexicon.terms:
        return Model(lexicon, np.append(np.zeros(5), np.log(share / (1 - share))))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.ready()
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.features(x.as_py()) for x in batch.column(1)], pa.list_(pa.float32()))], names=["y", "f"])

    got = rows.select("y", "text").mapInArrow(run, "y int, f array<float>").toPandas()
    f, y = np.stack([np.asarray(x, np.float64) for x in got["f"]]), got["y"].to_numpy(np.float64)
    order = np.lexsort(np.vstack([y, f.T]))
    f, y = f[order], y[order]
    posterior, _ = label_model(votes(f), share)
    weights = logistic(f, posterior, 1.0, intercept=True)
    # the votes leave the level open: slope and offset of the scores by the sample's labels
    slope, offset = logistic((f @ weights[:-1] + weights[-1])[:, None], y, 1e-3, intercept=True)
    if slope > 0:
        weights = weights * slope
        weights[-1] += offset
    return Model(lexicon, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.lexicon.ready()
        for batch in pieces(batches, 1):
            s = m.score(np.stack([m.lexicon.features(x.as_py()) for x in batch.column(1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
