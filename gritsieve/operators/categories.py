"""Rare pairs of category values, and extremes inside categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.profile import Roles, numeric_view, string_correlation
from gritsieve.operators.numeric import beyond
from gritsieve.plans.ledger import IDX, empty, finding


def correlated(df: DataFrame, roles: Roles, uniq: dict[str, float], threshold: float = 0.5, thresh_unique: float = 0.001) -> dict[str, list[str]]:
    """Of each string column, those whose shared codes correlate with its own."""
    columns = [c for c in roles.strings if uniq[c] <= thresh_unique]
    out: dict[str, list[str]] = {c: [] for c in roles.strings}
    for r in string_correlation(df, columns).collect():  # a row for each pair of columns
        if r.corr is not None and abs(r.corr) >= threshold:
            out[r.column1].append(r.column2)
    return out


def check_logic(good: DataFrame, roles: Roles, uniq: dict[str, float], corr: dict[str, list[str]], thres_uniqueness: float = 0.001, freq_error: int = 10) -> DataFrame:
    """Rows with a pair of values that occurs fewer than ``freq_error`` times, in either order of the columns."""
    pairs = [(a, b) for a in roles.strings for b in corr.get(a, []) if uniq[a] < thres_uniqueness and uniq[b] < thres_uniqueness]
    if not pairs:
        return empty(good.sparkSession)
    text = lambda c: F.col(c).cast("string")
    each = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(a).alias("c1"), F.lit(b).alias("c2"), text(a).alias("v1"), text(b).alias("v2"))) for k, (a, b) in enumerate(pairs)))
    rows = good.select(IDX, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p")).select(IDX, "p.*")
    rare = rows.groupBy("k", "v1", "v2").agg(F.count("*").alias("_n")).filter(F.col("_n") < freq_error).select("k", "v1", "v2")
    return finding(rows.join(rare, ["k", "v1", "v2"]), "logic", "Logic error", F.col("c1"), F.col("c2"), F.col("v1"), F.col("v2"))


def check_mixed_logic(good: DataFrame, roles: Roles, uniq: dict[str, float], thres_unique_str: float = 0.0002, thres_unique_nbr: float = 0.04, thresh_std: float = 6, semantics: str = "reference") -> DataFrame:
    """Values of a number column that are extreme among the rows of one category.

    ``reference`` then flags every row that has such a value, in whatever category, once for
    each category in which it is extreme; ``strict`` flags the rows of the category.
    """
    pairs = [(a, b) for a in roles.strings if uniq[a] < thres_unique_str and uniq[a] < 0.9 for b in roles.numbers if thres_unique_nbr < uniq[b] < 0.9]
    if not pairs:
        return empty(good.sparkSession)
    texts = sorted({a for a, _ in pairs})
    view = numeric_view(good, roles, sorted({b for _, b in pairs}))
    if set(texts) & set(view.columns):
        raise ValueError("a column can't be both text and number")
    both = good.select(IDX, *(F.col(a).cast("string").alias(a) for a in texts)).join(view, IDX) if roles.dates else good.select(IDX, *(F.col(a).cast("string").alias(a) for a in texts), *(F.col(c).cast("double").alias(c) for c in view.columns if c != IDX))
    each = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).alias("v1"), F.col(b).alias("v2"))) for k, (a, b) in enumerate(pairs)))
    rows = both.select(IDX, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("p")).select(IDX, "p.*")
    stats = rows.groupBy("k", "v1").agg(F.avg("v2").alias("m"), F.stddev_samp("v2").alias("s"))
    # distinct values of a class are fewer than its rows, so these are what is held against its statistics
    out = rows.select("k", "v1", "v2").distinct().join(stats, ["k", "v1"]).filter(beyond(F.col("v2"), F.col("m"), F.col("s"), thresh_std, semantics)).select("k", "v1", "v2")
    if semantics == "strict":
        found = rows.join(out, ["k", "v1", "v2"])
    else:
        # the number is held against the outlying values of every class, whatever its own (null included)
        loose = F.array(*(F.when(F.col(b).isNotNull(), F.struct(F.lit(k).alias("k"), F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(a).alias("v1"), F.col(b).alias("v2"))) for k, (a, b) in enumerate(pairs)))
        all_rows = both.select(IDX, F.explode(F.filter(loose, lambda x: x.isNotNull())).alias("p")).select(IDX, "p.*")
        found = all_rows.join(out.drop("v1"), ["k", "v2"])
    return finding(found, "mixed_logic", "Logic error", F.col("c1"), F.col("c2"), F.col("v1"), F.col("v2"), num2=F.col("v2"))


def combined_columns(df: DataFrame, ledger: DataFrame, col1: str, col2: str) -> DataFrame:
    """Two columns, without rows that are flagged for either or as duplicates, and without nulls."""
    flagged = ledger.filter(F.col("column").isin(col1, col2) | F.col("column2").isin(col1, col2) | (F.col("errtype") == "duplication")).select(F.col("idx").alias(IDX)).distinct()
    full = df.select(IDX, col1, col2).filter(F.col(col1).isNotNull() & F.col(col2).isNotNull())
    return full.join(flagged, IDX, "left_anti")


def dual_hist(rows: DataFrame, uniq: dict[str, float], col1: str, col2: str, unique_tresh: float = 0.7) -> DataFrame:
    """Counts of value pairs, sorted; empty if either column is too unique or they are one."""
    if col1 == col2 or uniq[col1] >= unique_tresh or uniq[col2] >= unique_tresh:
        return rows.select(F.col(col1), F.col(col2).alias(col2 if col1 != col2 else f"{col2}_2"), F.lit(0).cast("long").alias("count")).limit(0)
    return rows.groupBy(col1, col2).count().orderBy(col1, col2)
