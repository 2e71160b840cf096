"""Duplicate rows.  Rows are compared by two 64-bit hashes of all columns but the row id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gritsieve.functions.profile import data_columns, uniqueness
from gritsieve.functions.scalar import row_key
from gritsieve.plans.ledger import IDX, finding


def global_rank(df: DataFrame, by: str = IDX) -> DataFrame:
    """``df`` with ``rank``, 0, 1, ... in the order of the distinct longs in ``by``.

    Ranks are counted inside ranges of ``by`` and added to the rows before each range, so no
    task sorts the whole table.
    """
    binned = df.withColumn("_bin", F.shiftright(by, 16))
    before = F.coalesce(F.sum("n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = binned.groupBy("_bin").agg(F.count("*").alias("n")).select("_bin", before.alias("_start"))
    within = F.row_number().over(W.partitionBy("_bin").orderBy(by)) - 1
    return binned.withColumn("_within", within).join(starts, "_bin").withColumn("rank", F.col("_start") + F.col("_within")).drop("_bin", "_start", "_within")


def copies(df: DataFrame) -> DataFrame:
    """``(_idx, first, last, n)``: of each row's group of equal rows, its ends and its size."""
    keyed = df.select(IDX, *row_key(data_columns(df)))
    groups = keyed.groupBy("_k1", "_k2").agg(F.min(IDX).alias("first"), F.max(IDX).alias("last"), F.count("*").alias("n"))
    return keyed.join(groups, ["_k1", "_k2"]).select(IDX, "first", "last", "n")


def duplicated(df: DataFrame, keep: str | bool = "first") -> DataFrame:
    """``(_idx, duplicated)``: all but the first (or last) of equal rows, or with False all of them."""
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    flag = F.col("n") > 1 if keep is False else F.col(IDX) != F.col(keep)
    return copies(df).select(IDX, flag.alias("duplicated"))


def repeated(df: DataFrame) -> DataFrame:
    """:func:`copies` of the rows that occur more than once; in most tables they are few."""
    return copies(df).filter("n > 1")


def deduplicated(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The first row of each group of equal rows; ``groups``: what :func:`repeated` has found.

    Later copies may be almost the whole table.  Row ids pack into small files, by whose size
    Spark would broadcast them, so the join is a sorted one by demand.
    """
    later = (repeated(df) if groups is None else groups).filter(F.col(IDX) != F.col("first")).select(IDX)
    return df.join(later.hint("merge"), IDX, "left_anti")


def split_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First rows, and their later copies."""
    later = copies(df).filter(F.col(IDX) != F.col("first")).select(IDX)
    return df.join(later, IDX, "left_anti"), df.join(later, IDX, "left_semi")


def check_duplication(df: DataFrame, semantics: str = "reference", groups: DataFrame | None = None) -> DataFrame:
    """Later copies, each with a first row.

    ``strict`` pairs each copy with its own first row.  ``reference`` pairs the sorted list of
    later copies with that of repeated first rows, position by position, up to the shorter.
    """
    c = repeated(df) if groups is None else groups
    if semantics == "strict":
        pairs = c.filter(F.col(IDX) != F.col("first")).select(IDX, "first")
    else:
        later = global_rank(c.filter(F.col(IDX) != F.col("first")).select(IDX))
        firsts = global_rank(c.filter(F.col(IDX) == F.col("first")).select(IDX)).select(F.col(IDX).alias("first"), "rank")
        pairs = later.join(firsts, "rank").select(IDX, "first")
    return finding(pairs, "duplication", "duplication", F.lit("ALL"), value1=F.col(IDX), value2=F.col("first"), num1=F.col(IDX), num2=F.col("first"))


def non_unique(df: DataFrame, col: str, thresh_1: float = 0.99, thresh_2: float = 0.001, clean_dup: bool = True) -> DataFrame:
    """Rows with a repeated value in an almost unique column, or with a lone value in an almost constant one."""
    rows = deduplicated(df) if clean_dup else df
    ratio = uniqueness(rows, [col])[col]
    if not (ratio > thresh_1 or ratio < thresh_2):
        return df.limit(0)
    n = rows.groupBy(col).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1 if ratio > thresh_1 else F.col("_n") == 1)
    n = n.withColumnRenamed(col, "_v")
    return rows.join(n, rows[col].eqNullSafe(n["_v"]), "left_semi")
