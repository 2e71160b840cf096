"""Rows and columns that are mostly empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.profile import data_columns, null_fractions
from gritsieve.operators.duplicates import deduplicated
from gritsieve.plans.ledger import IDX, finding


def empty_rows(df: DataFrame, thresh_row_1: float = 0.7, thresh_row_2: float = 0.5, thresh_col: float = 0.8, rows: DataFrame | None = None) -> DataFrame:
    """``(_idx, fraction)`` of first rows whose share of nulls reaches both bounds.

    The first bound is on all columns, the second on those with a share of nulls below
    ``thresh_col`` among first rows; if there are none, no row is returned.
    """
    columns = data_columns(df)
    rows = deduplicated(df) if rows is None else rows
    full = [c for c, f in null_fractions(rows, columns).items() if f is not None and f < thresh_col]
    if not full:
        return df.select(IDX, F.lit(0.0).alias("fraction")).limit(0)
    share = lambda cs: sum((F.col(c).isNull().cast("int") for c in cs), F.lit(0)) / F.lit(len(cs))
    return rows.select(IDX, share(columns).alias("fraction"), share(full).alias("_full")).filter((F.col("fraction") >= thresh_row_1) & (F.col("_full") >= thresh_row_2)).select(IDX, "fraction")


def empty_columns(df: DataFrame, thresh_col: float = 0.99, clean_dup: bool = False) -> list[str]:
    rows = deduplicated(df) if clean_dup else df
    return [c for c, f in null_fractions(rows, data_columns(df)).items() if f is not None and f >= thresh_col]


def check_completeness(df: DataFrame, thresh_row_1: float = 0.7, thresh_row_2: float = 0.5, thresh_col: float = 0.8, rows: DataFrame | None = None) -> DataFrame:
    return finding(empty_rows(df, thresh_row_1, thresh_row_2, thresh_col, rows), "completeness", "empty", F.lit("All"))
