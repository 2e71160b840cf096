"""Typing errors: rare words in clusters of similar words.

Exemplar clustering needs the similarities of all words with each other.  A column's
vocabulary of up to ``MAX_VOCAB`` words is clustered as a whole.  A larger one is first
parted into blocks of words that a single edit, or a few in a row, connects (they share a
form with one letter left out); each block is clustered by itself, with the preference that
the whole vocabulary would have: the median similarity, taken over ``SAMPLE`` words.  Blocks
beyond ``MAX_VOCAB`` are dealt out in sorted order.  So no vocabulary is refused, no word is
left out, and no task holds more than a bounded matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gritsieve.functions.profile import Roles
from gritsieve.operators import mcl
from gritsieve.operators.duplicates import deduplicated
from gritsieve.plans.graph import components
from gritsieve.plans.ledger import IDX, empty, finding
from gritsieve.plans.storage import materialize

#: Most words that are clustered by exemplars at once: dense matrices must fit a task.
MAX_VOCAB = 3000
#: Words of a larger vocabulary over which its median similarity is taken.
SAMPLE = 400
#: Rows of similarity matrices that a task computes.
ROWS_EACH = 64
#: Bytes of a vocabulary that all tasks may hold.
MOST_BYTES = 256 << 20


def similarity(first: str, second: str) -> float:
    """Ratcliff and Obershelp's ratio; not symmetric."""
    return SequenceMatcher(None, first, second).ratio()


def string_similarity(words: DataFrame) -> DataFrame:
    """``(i, j, s)`` for all words (id, word): row i is the second argument, column j the first.

    The vocabulary is a stated query set: its size is checked, then it is held against
    itself in rows that are dealt out over all tasks.
    """
    n, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()
    if size > MOST_BYTES:
        raise ValueError(f"{n} words are too many to compare with each other")
    shared = words.sparkSession.sparkContext.broadcast([(r.id, r.word) for r in words.orderBy("id").toLocalIterator()])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.array([j for j, _ in shared.value])
        for pdf in pdfs:
            for i, w in zip(pdf["id"], pdf["word"]):
                yield pd.DataFrame({"i": i, "j": ids, "s": similarity_row(w, [v for _, v in shared.value])})

    return words.select("id", "word").repartition(max(1, -(-n // ROWS_EACH))).mapInPandas(run, "i long, j long, s double")


def similarity_row(word: str, others: list[str]) -> np.ndarray:
    """The similarity of each of the others with a word."""
    m = SequenceMatcher(None)
    m.set_seq2(word)  # what the matcher learns of its second text is kept for the row
    out = np.empty(len(others))
    for j, v in enumerate(others):
        m.set_seq1(v)
        out[j] = m.ratio()
    return out


def similarity_matrix(words: list[str]) -> np.ndarray:
    return np.array([similarity_row(w, words) for w in words]).reshape(len(words), len(words))


def affinity_propagation(s: np.ndarray, damping: float = 0.5, most_rounds: int = 200, patience: int = 15, preference: float | None = None, random_state: int | None = None) -> np.ndarray:
    """Exemplar clustering (Frey and Dueck, 2007): a label for each row; all 0 without convergence.

    Preferences are the median similarity.  Ties are broken by noise at the limit of
    precision from a fixed seed.
    """
    n = len(s)
    if not 0.5 <= damping < 1:
        raise ValueError("damping must be at least 0.5 and below 1")
    if n < 2:
        return np.zeros(n, int)
    s = s.astype(float).copy()
    pref = np.median(s) if preference is None else preference
    apart = s[~np.eye(n, dtype=bool)]
    if (apart == apart[0]).all():
        return np.arange(n) if pref >= apart[0] else np.zeros(n, int)
    np.fill_diagonal(s, pref)
    info = np.finfo(float)
    s += (info.eps * s + info.tiny * 100) * np.random.default_rng(random_state or 0).standard_normal((n, n))
    own = np.arange(n)
    available, responsible = np.zeros((n, n)), np.zeros((n, n))
    history = np.zeros((n, patience), bool)
    settled = False
    for k in range(most_rounds):
        both = available + s
        top = both.argmax(axis=1)
        best = both[own, top]
        both[own, top] = -np.inf
        second = both.max(axis=1)
        new = s - best[:, None]
        new[own, top] = s[own, top] - second
        responsible = damping * responsible + (1 - damping) * new
        support = np.maximum(responsible, 0)
        support[own, own] = responsible[own, own]
        total = support.sum(axis=0)
        new = np.minimum(total[None, :] - support, 0)
        new[own, own] = total - support[own, own]
        available = damping * available + (1 - damping) * new
        exemplar = available[own, own] + responsible[own, own] > 0
        history[:, k % patience] = exemplar
        if k >= patience and exemplar.any():
            seen = history.sum(axis=1)
            if ((seen == patience) | (seen == 0)).all():
                settled = True
                break
    centers = np.flatnonzero(available[own, own] + responsible[own, own] > 0)
    if not settled or not len(centers):
        return np.zeros(n, int)
    member = s[:, centers].argmax(axis=1)
    member[centers] = np.arange(len(centers))
    for c in range(len(centers)):  # the best exemplar of each cluster as it is now
        group = np.flatnonzero(member == c)
        centers[c] = group[s[np.ix_(group, group)].sum(axis=0).argmax()]
    member = s[:, centers].argmax(axis=1)
    member[centers] = np.arange(len(centers))
    return np.unique(centers[member], return_inverse=True)[1]


def exemplar_labels(words: list[str], affinity: str = "precomputed", damping: float = 0.5, random_state: int | None = None, matrix: np.ndarray | None = None, **kwargs) -> np.ndarray:
    s = similarity_matrix(words) if matrix is None else matrix
    if affinity == "euclidean":
        sq = (s * s).sum(axis=1)
        s = -np.maximum(sq[:, None] + sq[None, :] - 2 * s @ s.T, 0)
    elif affinity != "precomputed":
        raise ValueError(affinity)
    return affinity_propagation(s, damping, random_state=random_state, **kwargs)


def variants(word: Column) -> Column:
    """A word and its forms with one letter left out; long words by their first 40 letters."""
    head = F.substring(word, 1, 40)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(head)), lambda k: F.when(k == 0, head).otherwise(F.concat(F.substring(head, F.lit(1), k - 1), F.substring(head, k + 1, F.lit(40))))))


def blocked(vocab: DataFrame) -> DataFrame:
    """``(column, block, word, n)``: the parts of each column's vocabulary (column, word, n) that are clustered at once."""
    large = vocab.groupBy("column").agg(F.count("*").alias("_words")).filter(F.col("_words") > MAX_VOCAB).select("column")
    many = vocab.join(F.broadcast(large), "column")  # a few column names
    whole = vocab.join(F.broadcast(large), "column", "left_anti").select("column", F.lit("").alias("block"), "word", "n")
    if not large.take(1):
        return whole
    many = materialize(many.withColumn("id", F.monotonically_increasing_id()))
    forms = many.select("id", F.explode(variants(F.col("word"))).alias("form"), "column")
    least = forms.groupBy("column", "form").agg(F.min("id").alias("b"))
    linked = components(forms.join(least, ["column", "form"]).select(F.col("id").alias("a"), "b"))
    parted = many.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("_c", F.coalesce("component", "id"))
    # words that nothing connects would each be a block, so small blocks share a task, not a matrix
    sizes = parted.groupBy("column", "_c").agg(F.count("*").alias("_n"))
    placed = parted.join(sizes, ["column", "_c"])
    nth = F.row_number().over(W.partitionBy("column", "_c").orderBy("word")) - 1
    oversized = placed.filter(F.col("_n") > MAX_VOCAB).withColumn("_part", F.floor(nth / MAX_VOCAB))
    both = placed.filter(F.col("_n") <= MAX_VOCAB).withColumn("_part", F.lit(0).cast("long")).unionByName(oversized)
    return whole.unionByName(both.select("column", F.concat_ws(":", F.col("_c").cast("string"), F.col("_part").cast("string")).alias("block"), "word", "n"))


def _preferences(vocab: DataFrame, columns: list[str], affinity: str) -> dict[str, float]:
    """The median similarity of each column's words, over those with the least hashes."""
    out = {}
    for c in columns:  # a few column names
        words = [r.word for r in vocab.filter(F.col("column") == c).orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
        s = similarity_matrix(words)
        if affinity == "euclidean":
            sq = (s * s).sum(axis=1)
            s = -np.maximum(sq[:, None] + sq[None, :] - 2 * s @ s.T, 0)
        out[c] = float(np.median(s))
    return out


def clustered(vocab: DataFrame, method: str = "affinity_propagation", affinity: str = "precomputed", damping: float = 0.5, random_state: int | None = None, **kwargs) -> DataFrame:
    """``(column, label, word, n)`` of vocabularies (column, word, n), each column on its own."""
    if method == "affinity_propagation":
        parts = materialize(blocked(vocab))
        large = [r.column for r in parts.filter("block <> ''").select("column").distinct().collect()]  # a few column names
        preferences = _preferences(parts, large, affinity)
        wholes = {r.column: sorted(r.words) for r in parts.filter("block = ''").groupBy("column").agg(F.collect_list("word").alias("words")).collect()}  # MAX_VOCAB words each
        shared = vocab.sparkSession.sparkContext.broadcast(wholes)

        def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                yield pdf.assign(row=[similarity_row(w, shared.value[c]).tobytes() for c, w in zip(pdf["column"], pdf["word"])])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("word").reset_index(drop=True)
            column = pdf["column"][0]
            matrix, own = None, dict(kwargs)
            if pdf["block"][0] == "":
                matrix = np.stack([np.frombuffer(x) for x in pdf["row"]])
            else:
                own.setdefault("preference", preferences[column])
            label = exemplar_labels(list(pdf["word"]), affinity, damping, random_state, matrix, **own)
            return pdf.assign(label=label)[["column", "block", "label", "word", "n"]]

        n = sum(map(len, wholes.values()))
        dealt = parts.filter("block = ''").repartition(max(1, -(-n // ROWS_EACH)), "word").mapInPandas(rows, "column string, block string, word string, n long, row binary")
        every = dealt.unionByName(parts.filter("block <> ''").withColumn("row", F.lit(None).cast("binary")))
        labelled = every.groupBy("column", "block").applyInPandas(one, "column string, block string, label long, word string, n long")
        # labels of several blocks must differ; a whole vocabulary keeps its own
        number = F.when(F.col("block") == "", F.col("label")).otherwise(F.xxhash64("block", "label"))
        return labelled.select("column", number.alias("label"), "word", "n")
    if method == "MCL":
        out = None
        for c in [r.column for r in vocab.select("column").distinct().collect()]:  # a few column names
            words = mcl.numbered(vocab.filter(F.col("column") == c).select("word", "n"))
            part = mcl.word_clusters(words, **kwargs).select(F.lit(c).alias("column"), "label", "word", "n")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else vocab.select("column", F.lit(0).cast("long").alias("label"), "word", "n").limit(0)
    raise ValueError("method must be 'affinity_propagation' or 'MCL'")


def rare_words(clusters: DataFrame, thresh: int = 10) -> DataFrame:
    """``(column, label, word, n)``: words at most ``thresh`` times, in clusters of two words or more.

    A column whose words form a single cluster has none.
    """
    sizes = clusters.groupBy("column", "label").agg(F.count("*").alias("_size"))
    many = sizes.groupBy("column").agg(F.count("*").alias("_clusters"))
    return clusters.join(sizes.filter("_size > 1"), ["column", "label"]).join(many.filter("_clusters > 1"), "column").filter(F.col("n") <= thresh).select("column", "label", "word", "n")


def vocabularies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, word, n)`` of several columns, counted in one pass."""
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "word")
    return texts.filter("word is not null").groupBy("column", "word").agg(F.count("*").alias("n"))


def check_typo(df: DataFrame, roles: Roles, uniq: dict[str, float], tresh_unique: float = 0.005, tresh_typo_frequency: int = 10, method: str = "affinity_propagation", affinity: str = "precomputed", damping: float = 0.5, random_state: int | None = None, rows: DataFrame | None = None, **kwargs) -> DataFrame:
    columns = [c for c in roles.strings if uniq[c] <= tresh_unique]
    if not columns:
        return empty(df.sparkSession)
    rows = deduplicated(df) if rows is None else rows
    vocab = materialize(vocabularies(rows, columns))
    rare = rare_words(materialize(clustered(vocab, method, affinity, damping, random_state, **kwargs)), tresh_typo_frequency).select("column", "word")
    texts = rows.select(IDX, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([IDX], columns, "column", "word")
    return finding(texts.join(rare, ["column", "word"]), "typo", "typo", F.col("column"), value1=F.col("word"))


def typo_rows(rows: DataFrame, col: str, thresh: int = 10, method: str = "affinity_propagation", **kwargs) -> DataFrame:
    """``(_idx, word)`` of the rare words of one column."""
    rare = rare_words(materialize(clustered(vocabularies(rows, [col]), method, **kwargs)), thresh).select("word")
    return rows.select(IDX, F.col(col).cast("string").alias("word")).join(rare, "word").select(IDX, "word")


def typo_suggestions(rows: DataFrame, col: str, nb_suggestion: int = 1, min_occurrence: int = 10, **kwargs) -> DataFrame:
    """``(_idx, word, suggestions)``: rare words with the commonest words of their clusters.

    A word may suggest itself; a cluster with fewer words suggests all it has.
    """
    c = materialize(clustered(vocabularies(rows, [col]), "affinity_propagation", **kwargs))
    top = c.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), F.desc("word")))).filter(F.col("_r") <= nb_suggestion)
    top = top.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "word"))), lambda x: x["word"]).alias("suggestions"))
    rare = rare_words(c, min_occurrence).join(top, "label").select("word", "suggestions")
    return rows.select(IDX, F.col(col).cast("string").alias("word")).join(rare, "word").select(IDX, "word", "suggestions")
