"""Word vectors of cells: a column is one sentence whose words are its cells."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.plans.ledger import IDX

#: Cells of a column that make one sentence at the most; a longer column becomes several sentences.
SENTENCE = 100_000


def word_vectors(rows: DataFrame, columns: list[str], size: int = 100, window: int = 2, min_count: int = 0, seed: int = 0) -> DataFrame:
    """``(word, vector)``: vectors of all cell values of the columns; null counts as ``Nan``."""
    cells = rows.select(IDX, *(F.coalesce(F.col(c).cast("string"), F.lit("Nan")).alias(c) for c in columns)).unpivot([IDX], columns, "column", "word")
    part = F.floor(F.col(IDX) / SENTENCE)
    sentences = cells.groupBy("column", part.alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct(IDX, "word"))), lambda x: x["word"]).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol="words", outputCol="v", maxSentenceLength=SENTENCE)
    return model.fit(sentences).getVectors()


def embedded(rows: DataFrame, columns: list[str], **params) -> DataFrame:
    """``(_idx, column, word, vector)``: every cell with its vector, as an array of doubles."""
    from pyspark.ml.functions import vector_to_array

    vectors = word_vectors(rows, columns, **params).select("word", vector_to_array("vector").alias("vector"))
    cells = rows.select(IDX, *(F.coalesce(F.col(c).cast("string"), F.lit("Nan")).alias(c) for c in columns)).unpivot([IDX], columns, "column", "word")
    return cells.join(vectors, "word").select(IDX, "column", "word", "vector")
