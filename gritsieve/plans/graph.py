"""Connected components by large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and minima over shuffled tables; only a count and a checksum reach
the driver.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritsieve.plans.storage import materialize


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs``: (u, v) rows, v a neighbour that u deals with.  Links each to u's least one."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    out = joined.filter(F.col("v") > F.col("u") if not small else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.filter(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b): its least reachable node."""
    edges = materialize(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    check = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = check(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        edges = materialize(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small=True))
        now = check(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
