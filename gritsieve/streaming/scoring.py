"""Micro-batches held against the frozen profile of a table.

Mean and deviation of each number column, found once on the table, flag the extreme values
of a stream; rows that come again within the watermark are flagged as duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.functions.profile import Roles, numeric_view
from gritsieve.operators.duplicates import deduplicated
from gritsieve.operators.numeric import beyond
from gritsieve.plans.ledger import IDX, finding


@dataclass
class Profile:
    roles: Roles
    stats: dict[str, tuple[float, float]]


def freeze(df: DataFrame, roles: Roles, uniq: dict[str, float], thresh_unique1: float = 0.99, thresh_unique2: float = 0.0001) -> Profile:
    columns = [c for c in roles.numbers if thresh_unique2 <= uniq[c] <= thresh_unique1]
    if not columns:
        return Profile(roles, {})
    row = numeric_view(deduplicated(df), roles, columns).agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")))).first()
    return Profile(roles, {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns) if row[f"m{i}"] is not None})


def score(rows: DataFrame, profile: Profile, thresh_std: float = 6) -> DataFrame:
    """Ledger rows of a batch or a stream with ``_idx``; stateless."""
    view = numeric_view(rows, profile.roles, list(profile.stats))
    flagged = [F.when(F.col(c).isNotNull() & beyond(F.col(c), F.lit(m), F.lit(s), thresh_std), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, (m, s) in profile.stats.items()]
    out = view.select(IDX, F.explode(F.filter(F.array(*flagged), lambda x: x.isNotNull())).alias("f")).select(IDX, "f.*")
    return finding(out, "extreme_value", "extreme", F.col("column"), value1=F.col("value"), num1=F.col("value"))


def new_rows(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The stream without rows whose keys have come before, as far back as the watermark keeps state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
