"""Extreme values and broken orders of number columns."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.profile import CHUNK, Roles, numeric_view
from gritsieve.operators.duplicates import deduplicated
from gritsieve.plans.ledger import IDX, empty, finding


def beyond(x: Column, mean: Column, std: Column, times: float, semantics: str = "reference") -> Column:
    """Whether x isn't strictly within ``times`` deviations of the mean.

    Without a deviation, ``reference`` flags every value and ``strict`` none.
    """
    inside = F.coalesce((x > mean - times * std) & (x < mean + times * std), F.lit(False))
    return ~inside if semantics == "reference" else ~inside & F.coalesce(std > 0, F.lit(False))


def z_score(df: DataFrame, column: str, uniqueness_ratio: float, thresh_std: float = 6, thresh_unique1: float = 0.99, thresh_unique2: float = 0.0001, semantics: str = "reference") -> DataFrame:
    """``(_idx, value)`` of the extreme values of one number column; none if its uniqueness is out of bounds."""
    rows = df.select(IDX, F.col(column).cast("double").alias("value")).filter("value is not null")
    if uniqueness_ratio > thresh_unique1 or uniqueness_ratio < thresh_unique2:
        return rows.limit(0)
    stats = rows.agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    return rows.crossJoin(F.broadcast(stats)).filter(beyond(F.col("value"), F.col("_mean"), F.col("_std"), thresh_std, semantics)).select(IDX, "value")  # one row of statistics


def check_extreme_value(df: DataFrame, roles: Roles, uniq: dict[str, float], thresh_std: float = 6, thresh_unique1: float = 0.99, thresh_unique2: float = 0.0001, semantics: str = "reference", rows: DataFrame | None = None) -> DataFrame:
    """Extreme values of all number columns: one aggregate for the statistics, one pass for the values."""
    columns = [c for c in roles.numbers if thresh_unique2 <= uniq[c] <= thresh_unique1]
    if not columns:
        return empty(df.sparkSession)
    view = numeric_view(deduplicated(df) if rows is None else rows, roles, columns)
    stats = view.agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"))))
    flagged = F.array(*(F.when(F.col(c).isNotNull() & beyond(F.col(c), F.col(f"_m{i}"), F.col(f"_s{i}"), thresh_std, semantics), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for i, c in enumerate(columns)))
    found = view.crossJoin(F.broadcast(stats)).select(IDX, F.explode(F.filter(flagged, lambda x: x.isNotNull())).alias("f")).select(IDX, "f.*")  # one row of statistics
    return finding(found, "extreme_value", "extreme", F.col("column"), value1=F.col("value"), num1=F.col("value"))


def ordered_pairs(view: DataFrame, columns: list[str], thresh: float = 0.999) -> list[tuple[str, str]]:
    """Pairs (a, b) with a < b in more than ``thresh`` of all rows, nulls included, and a > b in some."""
    pairs = list(permutations(columns, 2))
    out = []
    for k in range(0, len(pairs), CHUNK):
        part = pairs[k : k + CHUNK]
        row = view.agg(F.count("*").alias("n"), *(x for i, (a, b) in enumerate(part) for x in (F.count_if(F.col(a) < F.col(b)).alias(f"l{i}"), F.count_if(F.col(a) > F.col(b)).alias(f"g{i}")))).first()
        out += [p for i, p in enumerate(part) if row["n"] and row[f"l{i}"] / row["n"] > thresh and row[f"g{i}"] > 0]
    return out


def check_tendency(df: DataFrame, roles: Roles, tresh_order: float = 0.999) -> DataFrame:
    """Rows that break an order of two columns that nearly all rows keep."""
    view = numeric_view(df, roles)
    pairs = ordered_pairs(view, roles.numbers, tresh_order)
    if not pairs:
        return empty(df.sparkSession)
    broken = F.array(*(F.when(F.col(a) > F.col(b), F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).alias("v1"), F.col(b).alias("v2"))) for a, b in pairs))
    rows = view.select(IDX, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("f")).select(IDX, "f.*")
    return finding(rows, "tendency", "Logic error", F.col("c1"), F.col("c2"), F.col("v1"), F.col("v2"), F.col("v1"), F.col("v2"))
