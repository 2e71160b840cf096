"""Markov clustering of words by shared tokens.

Matrices are tables (i, j, v).  Words that share no token have similarity 0, so the matrix
falls into blocks, one for each connected component, and a block's clusters don't depend on
the others: blocks are clustered in parallel, each to its own fixed point.  Blocks of up to
``MOST_WORDS`` words are clustered as dense matrices in a task each; larger ones by the same
steps on tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.functions import profile
from gritsieve.plans.graph import components
from gritsieve.plans.storage import materialize

#: Fixed value: tokens are runs of two word characters or more.
TOKEN = r"(?U)\b\w\w+\b"
#: Largest block, in words, that is clustered in one task: four dense matrices of it must fit.
MOST_WORDS = 3000
#: Bytes of feature rows that all tasks may hold.
MOST_BYTES = 256 << 20


def vocabulary(rows: DataFrame, col: str) -> DataFrame:
    """``(id, word, n)``: distinct non-null values in sorted order, and how often each occurs."""
    return numbered(rows.select(F.col(col).cast("string").alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("n")))


def numbered(words: DataFrame) -> DataFrame:
    """``(id, word, n)``: distinct words (word, n) numbered in sorted order, without sorting them in one task."""
    return profile.numbered(words, F.col("word")).select("id", "word", "n")


def tf_vectors(words: DataFrame) -> DataFrame:
    """``(id, token, w)``: token counts of each word, scaled to length 1."""
    tokens = words.select("id", F.explode(F.regexp_extract_all(F.lower("word"), F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("c"))
    norms = tokens.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return tokens.join(norms, "id").select("id", "token", (F.col("c") / F.col("norm")).alias("w"))


def cosine_similarity(words: DataFrame, bias: float = 1.0) -> DataFrame:
    """``(i, j, v)``: bias minus cosine distance, where not 0; the diagonal is the bias."""
    v = tf_vectors(words)
    a, b = v.select(F.col("id").alias("i"), "token", F.col("w").alias("a")), v.select(F.col("id").alias("j"), "token", F.col("w").alias("b"))
    dots = a.join(b, "token").filter("i <> j").groupBy("i", "j").agg((F.sum(F.col("a") * F.col("b")) + F.lit(bias - 1)).alias("v"))
    return dots.unionByName(words.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(bias).alias("v")))


def feature_similarity(features: DataFrame, ids: DataFrame, metric: str = "cosine", bias: float = 1.0) -> DataFrame:
    """``(i, j, v)``: bias minus the distance of feature rows (id, token, w), where not 0.

    Cosine needs only rows that share a token; under ``euclidean`` and ``manhattan`` every
    two rows have a distance, so the features are a stated query set: their size is checked,
    then they are held against themselves, row by row.
    """
    if metric == "cosine":
        norms = features.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        unit = features.join(norms, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("w"))
        a, b = unit.select(F.col("id").alias("i"), "token", F.col("w").alias("a")), unit.select(F.col("id").alias("j"), "token", F.col("w").alias("b"))
        dots = a.join(b, "token").filter("i <> j").groupBy("i", "j").agg((F.sum(F.col("a") * F.col("b")) + F.lit(bias - 1)).alias("v"))
        return dots.unionByName(ids.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(bias).alias("v")))
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(metric)
    wide = features.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("row"))
    size = features.agg(F.coalesce(F.sum(F.octet_length(F.col("token").cast("string")) + 64), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"features of {size} bytes are too many to compare with each other under the {metric} metric")
    names = np.array(sorted(r.id for r in ids.select("id").toLocalIterator()), np.int64)
    tokens: dict = {}
    cells = [(np.searchsorted(names, r.id), tokens.setdefault(t, len(tokens)), w) for r in wide.toLocalIterator() for t, w in r.row.items()]
    shared = features.sparkSession.sparkContext.broadcast((names, len(tokens), *(np.array(x) for x in (zip(*cells) if cells else ((), (), ())))))

    def run(pdfs):
        """Dense rows of the asked ids against blocks of dense rows of all."""
        every, width, row, column, w = shared.value
        row, column = row.astype(np.int64), column.astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, column, w = row[order], column[order], w[order]
        height = max(1, (8 << 20) // max(1, 8 * width))
        for pdf in pdfs:
            at = np.searchsorted(every, pdf["id"].to_numpy())
            for lo in range(0, len(every), height):
                hi = min(lo + height, len(every))
                i, j = np.searchsorted(row, [lo, hi])
                block = np.zeros((hi - lo, width))
                block[row[i:j] - lo, column[i:j]] = w[i:j]
                for k in at:
                    x = np.zeros(width)
                    i, j = np.searchsorted(row, [k, k + 1])
                    x[column[i:j]] = w[i:j]
                    gap = np.abs(block - x)
                    yield pd.DataFrame({"i": every[k], "j": every[lo:hi], "v": bias - (gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1)))})

    return ids.select("id").repartition(max(1, len(names) // 64)).mapInPandas(run, "i long, j long, v double").filter("v <> 0")


def self_loops(m: DataFrame, weight: float = 0.01) -> DataFrame:
    nodes = m.select(F.col("i").alias("n")).unionByName(m.select(F.col("j").alias("n"))).distinct()
    return m.unionByName(nodes.select(F.col("n").alias("i"), F.col("n").alias("j"), F.lit(weight).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def normalize(m: DataFrame) -> DataFrame:
    """Rows scaled to a sum of 1."""
    sums = m.groupBy("i").agg(F.sum(F.abs("v")).alias("s"))
    return m.join(sums, "i").select("i", "j", (F.col("v") / F.col("s")).alias("v"))


def expand(m: DataFrame, p: int = 2) -> DataFrame:
    """The p-th power of the matrix."""
    out = m
    for _ in range(p - 1):
        a, b = out.select("i", F.col("j").alias("k"), F.col("v").alias("a")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
        out = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    return out


def inflate(m: DataFrame, p: float = 2, th: float = 1e-10) -> DataFrame:
    """Entries to the p-th power; those below ``th`` vanish."""
    return m.filter(F.col("v") >= th).select("i", "j", F.pow("v", F.lit(float(p))).alias("v"))


def fixed_point(t: np.ndarray, inflation_power: float = 2, inflation_threshold: float = 1e-10, self_loops_weight: float = 0.01, expansion_power: int = 2, iteration_limit: int = 100) -> np.ndarray:
    """Dense Markov clustering of one block."""
    t = t + self_loops_weight * np.eye(len(t))
    for _ in range(iteration_limit):
        before = t
        sums = np.abs(t).sum(axis=1, keepdims=True)
        t = np.linalg.matrix_power(t / np.where(sums == 0, 1, sums), expansion_power)
        t = np.where(t < inflation_threshold, 0.0, t) ** inflation_power
        if np.array_equal(t, before):
            break
    return t


def support_labels(t: np.ndarray) -> np.ndarray:
    """Rows with the same non-zero columns share a label: the least of them."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(np.flatnonzero(row).tobytes(), k) for k, row in enumerate(t)])


def fixed_point_table(t: DataFrame, inflation_power: float = 2, inflation_threshold: float = 1e-10, self_loops_weight: float = 0.01, expansion_power: int = 2, iteration_limit: int = 100) -> DataFrame:
    """What :func:`fixed_point` does, on tables."""
    check = lambda m: m.agg(F.count("*"), F.sum(F.xxhash64("i", "j", "v").cast("decimal(38,0)"))).first()
    t = materialize(self_loops(t, self_loops_weight))
    before = check(t)
    for _ in range(iteration_limit):
        t = materialize(inflate(expand(normalize(t), expansion_power), inflation_power, inflation_threshold).filter("v <> 0").withColumn("v", F.round("v", 14)))
        now = check(t)
        if now == before:
            break
        before = now
    return t


def support_labels_table(t: DataFrame) -> DataFrame:
    """``(id, label)``: rows with the same non-zero columns share the least of their ids."""
    support = t.filter("v <> 0").groupBy("i").agg(F.count("*").alias("n"), F.sum(F.xxhash64("j").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("j", F.lit(1)).cast("decimal(38,0)")).alias("g"))
    least = support.groupBy("n", "h", "g").agg(F.min("i").alias("label"))
    return support.join(least, ["n", "h", "g"]).select(F.col("i").cast("long").alias("id"), F.col("label").cast("long").alias("label"))


def cluster(m: DataFrame, nodes: DataFrame, **params) -> DataFrame:
    """``(id, label)`` for each of ``nodes`` (id): the label is the cluster's least id."""
    m = materialize(m)
    blocks = components(m.filter("i <> j and v <> 0").select(F.col("i").alias("a"), F.col("j").alias("b")))
    sizes = blocks.groupBy("component").agg(F.count("*").alias("words"))
    large = blocks.join(sizes.filter(F.col("words") > MOST_WORDS).select("component"), "component", "left_semi")
    inside = m.join(blocks.join(sizes.filter(F.col("words") <= MOST_WORDS).select("component"), "component", "left_semi").withColumnRenamed("node", "i"), "i").select("component", "i", "j", "v")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        t = np.zeros((len(ids), len(ids)))
        t[np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])] = pdf["v"]
        return pd.DataFrame({"id": ids, "label": ids[support_labels(fixed_point(t, **params))]})

    labelled = inside.groupBy("component").applyInPandas(one, "id long, label long")
    if large.take(1):
        own = m.join(large.select(F.col("node").alias("i")), "i", "left_semi")
        labelled = labelled.unionByName(support_labels_table(fixed_point_table(own.select("i", "j", "v"), **params)))
    return nodes.select(F.col("id").cast("long").alias("id")).join(labelled, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def clusters(labels: DataFrame) -> DataFrame:
    """``(label, members)``."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members"))


def word_clusters(words: DataFrame, **params) -> DataFrame:
    """``(label, id, word, n)`` of a vocabulary."""
    return cluster(cosine_similarity(words), words, **params).join(words.withColumn("id", F.col("id").cast("long")), "id").select("label", "id", "word", "n")


class MarkovClustering:
    """The steps on one matrix, in the order in which they are called.

    ``metric`` None takes rows (i, j, v) as they are; else the rows are features (id, token,
    w), whose similarities are the matrix.
    """

    def __init__(self, matrix: DataFrame, metric: str | None = "cosine", bias: float = 1.0):
        ids = matrix.select("id").distinct() if metric else matrix.select(F.col("i").alias("id")).unionByName(matrix.select(F.col("j").alias("id"))).distinct()
        self.nodes = materialize(ids)
        self.matrix = materialize(feature_similarity(matrix, self.nodes, metric, bias) if metric else matrix.select("i", "j", "v"))
        self.labels: DataFrame | None = None

    def fit(self, **params) -> MarkovClustering:
        self.labels = materialize(cluster(self.matrix, self.nodes, **params))
        return self

    def extract_labels(self) -> DataFrame:
        if self.labels is None:
            raise RuntimeError("fit comes first")
        return self.labels

    def clusters(self, words: DataFrame | None = None) -> DataFrame:
        """``(label, members)``: ids, or the words (id, word) in their place."""
        labels = self.extract_labels()
        if words is None:
            return clusters(labels)
        return labels.join(words.select("id", "word"), "id").groupBy("label").agg(F.array_sort(F.collect_list("word")).alias("members"))


def typo_correction(rows: DataFrame, col: str, **params) -> DataFrame:
    """``(_idx, word, suggestion)``: rows whose word is rarer than its cluster's commonest, which is suggested.

    Empty if every row is a cluster of its own.
    """
    from gritsieve.plans.ledger import IDX

    words = materialize(vocabulary(rows, col))
    c = materialize(word_clusters(words, **params))
    found = c.agg(F.count_distinct("label")).first()[0]
    if found == rows.filter(F.col(col).isNotNull()).count():
        return rows.select(IDX, F.col(col).alias("word"), F.col(col).alias("suggestion")).limit(0)
    best = c.groupBy("label").agg(F.max("n").alias("top"), F.max_by("word", F.struct("n", F.negative("id"))).alias("suggestion"))
    rare = c.join(best, "label").filter(F.col("n") < F.col("top")).select("word", "suggestion")
    return rows.select(IDX, F.col(col).cast("string").alias("word")).join(rare, "word").select(IDX, "word", "suggestion")
