"""Exact nearest neighbours, local outlier factors and neighbour imputation.

Points are laid out along a Z-order curve of their columns' quantiles and packed into blocks,
so that a block's box is small in all columns.  A point's neighbours lie no further along any
column than its distance to the k-th of its own block, so each point asks only the blocks
whose boxes come that near; an outlier that reaches far asks many blocks, but alone.  Asks
and blocks meet by block number.  Distances are computed between packed blocks in numpy;
what leaves a task is k candidates for each point and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gritsieve.functions.profile import Roles, numeric_view
from gritsieve.operators.duplicates import deduplicated
from gritsieve.plans.ledger import IDX, empty, finding
from gritsieve.plans.storage import materialize

BLOCK = 2048
#: Columns, the widest, that the layout of blocks goes by.
CURVE = 7
#: Different rows with gaps that are held against all donors at once.
GAPS_AT_ONCE = 20_000
#: Donors in a task, and in a leaf of its tree.
DONORS, LEAF = 1 << 17, 256


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = np.abs(a[:, k, None] - b[None, :, k])
        if metric == "chebyshev":
            np.maximum(out, d, out=out)
        elif metric == "euclidean":
            out += d * d
        else:
            out += d
    return np.sqrt(out) if metric == "euclidean" else out


def _nearest(a: np.ndarray, ids_a: np.ndarray, b: np.ndarray, ids_b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(position in a, id, distance) of the k nearest other points in b, ties by id."""
    order = np.argsort(ids_b, kind="stable")
    b, ids_b = b[order], ids_b[order]
    rows, ids, dist = [], [], []
    for i in range(0, len(a), 512):
        d = _distances(a[i : i + 512], b, metric)
        d[ids_a[i : i + 512, None] == ids_b[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        own = np.take_along_axis(d, best, axis=1)
        ok = np.isfinite(own)
        rows.append(np.repeat(np.arange(i, i + len(d)), ok.sum(axis=1)))
        ids.append(ids_b[best][ok])
        dist.append(own[ok])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(dist)


def neighbours(points: DataFrame, columns: list[str], k: int = 20, metric: str = "chebyshev") -> DataFrame:
    """``(i, j, d)``: each point's k nearest others, ties by the smaller id.  Points have no nulls."""
    if metric not in ("chebyshev", "euclidean", "manhattan"):
        raise ValueError(metric)
    stats = points.agg(F.count("*").alias("n"), *(F.stddev_pop(c).alias(c) for c in columns)).first()
    k = min(k, stats["n"] - 1)
    if k < 1:
        return points.sparkSession.createDataFrame([], "i long, j long, d double")
    width = len(columns)
    curve = sorted(columns, key=lambda c: -(stats[c] or 0.0))[:CURVE]
    edges = {c: np.unique(x) for c, x in zip(curve, points.approxQuantile(curve, [q / 256 for q in range(1, 256)], 1 / 512))}

    def placed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            bins = [np.searchsorted(edges[c], pdf[c].to_numpy(np.float64)) for c in curve]
            key = np.zeros(len(pdf), np.int64)
            for bit in range(7, -1, -1):
                for x in bins:
                    key = key << 1 | (x >> bit & 1)
            yield pdf.assign(place=key)

    def pack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId(), 0, None
        for pdf in pdfs:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= BLOCK:
                yield one(held[:BLOCK], part << 32 | n)
                held, n = held[BLOCK:], n + 1
        if held is not None and len(held):
            yield one(held, part << 32 | n)

    def one(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
        x, ids = pdf[columns].to_numpy(np.float64), pdf[IDX].to_numpy(np.int64)
        rows, _, d = _nearest(x, ids, x, ids, k, metric)
        reach = np.zeros(len(x))
        np.maximum.at(reach, rows, d)
        reach[np.bincount(rows, minlength=len(x)) < k] = np.inf
        return pd.DataFrame({"block": [block], "low": [x.min(axis=0)], "high": [x.max(axis=0)], "reach": [reach.tobytes()], "ids": [ids.tobytes()], "data": [x.tobytes()]})

    numbers = ", ".join(f"`{c}` double" for c in columns)
    typed = points.select(F.col(IDX).cast("long").alias(IDX), *(F.col(c).cast("double").alias(c) for c in columns))
    parts = max(1, -(-stats["n"] // (4 * BLOCK)))
    dealt = typed.mapInPandas(placed, f"{IDX} long, {numbers}, place long").repartitionByRange(parts, "place", IDX).sortWithinPartitions("place", IDX)
    blocks = materialize(dealt.mapInPandas(pack, "block long, low array<double>, high array<double>, reach binary, ids binary, data binary"))
    boxes = blocks.select("block", "low", "high").toArrow()  # a short row for each BLOCK points
    shared = points.sparkSession.sparkContext.broadcast((boxes["block"].to_numpy(), *(np.array(boxes[c].to_pylist(), np.float64).reshape(-1, width) for c in ("low", "high"))))

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, low, high = shared.value
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                x, ids, reach = np.frombuffer(r.data).reshape(-1, width), np.frombuffer(r.ids, np.int64), np.frombuffer(r.reach)
                most = reach.max()
                near = np.flatnonzero(((low <= x.max(axis=0) + most) & (high >= x.min(axis=0) - most)).all(axis=1))
                for q in near:
                    own = (np.maximum(low[q] - x, x - high[q]).max(axis=1) <= reach) if number[q] != r.block else np.ones(len(x), bool)
                    if own.any():
                        yield pd.DataFrame({"q": [number[q]], "asks": [ids[own].tobytes()], "at": [x[own].tobytes()]})

    def compare(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                ia, ib = np.frombuffer(r.asks, np.int64), np.frombuffer(r.ids, np.int64)
                rows, j, d = _nearest(np.frombuffer(r.at).reshape(-1, width), ia, np.frombuffer(r.data).reshape(-1, width), ib, k, metric)
                yield pd.DataFrame({"i": ia[rows], "j": j, "d": d})

    asks = blocks.select("block", "reach", "ids", "data").mapInPandas(ask, "q long, asks binary, at binary")
    met = asks.join(blocks.select(F.col("block").alias("q"), "ids", "data"), "q").select("asks", "at", "ids", "data")
    found = met.repartition(max(parts, points.sparkSession.sparkContext.defaultParallelism)).mapInPandas(compare, "i long, j long, d double")
    rank = F.row_number().over(W.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def lof_scores(points: DataFrame, columns: list[str], k: int = 20, metric: str = "chebyshev") -> DataFrame:
    """``(_idx, lof)``: the local outlier factor of each point."""
    nb = materialize(neighbours(points, columns, k, metric))
    reach = nb.groupBy("i").agg(F.max("d").alias("kd"))
    to = reach.select(F.col("i").alias("j"), F.col("kd").alias("kd_j"))
    lrd = nb.join(to, "j").groupBy("i").agg((1.0 / (F.avg(F.greatest("kd_j", "d")) + 1e-10)).alias("lrd"))
    lrd = materialize(lrd)
    of = lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j"))
    return nb.join(of, "j").groupBy("i").agg(F.avg("lrd_j").alias("m")).join(lrd, "i").select(F.col("i").alias(IDX), (F.col("m") / F.col("lrd")).alias("lof"))


def complete(df: DataFrame, roles: Roles, impute_k: int = 10, rows: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The number columns without nulls: as they are, or of first rows and imputed where any is null."""
    view = numeric_view(df, roles)
    columns = roles.numbers
    if not columns:
        return view, []
    row = view.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns))).first()
    return (knn_impute(df, roles, impute_k, rows), columns) if any(row) else (view, columns)


def outlier_lof(df: DataFrame, roles: Roles, n_neighbors: int = 20, contamination: float = 0.0005, metric: str = "chebyshev", impute_k: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """``(_idx, lof, flagged, normalized)`` of every point; flagged below the percentile of negative factors."""
    points, columns = complete(df, roles, impute_k, rows)
    if not columns:
        return df.select(IDX, F.lit(0.0).alias("lof"), F.lit(False).alias("flagged"), F.lit(0.0).alias("normalized")).limit(0)
    scores = materialize(lof_scores(points, columns, n_neighbors, metric))
    cut = scores.agg(F.percentile(-F.col("lof"), F.lit(contamination)).alias("cut"))
    flagged = scores.crossJoin(F.broadcast(cut)).withColumn("flagged", -F.col("lof") < F.col("cut"))  # one row
    top = flagged.agg(F.max(F.when(F.col("flagged"), F.col("lof"))).alias("top"))
    return flagged.crossJoin(F.broadcast(top)).select(IDX, "lof", "flagged", F.when(F.col("flagged"), F.col("lof") / F.col("top")).alias("normalized"))  # one row


def check_outlier(df: DataFrame, roles: Roles, **params) -> DataFrame:
    if not roles.numbers:
        return empty(df.sparkSession)
    return finding(outlier_lof(df, roles, **params).filter("flagged"), "outlier", "Outlier", F.lit("NA"))


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of points, halved along the widest column until ``most`` are left."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if len(own) <= most:
            out.append(own)
            continue
        part = x[own]
        order = np.argpartition(part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))], len(own) // 2)
        open_ += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _first(group: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's ``k`` least by distance and id, by group."""
    order = np.lexsort((ids, d, group))
    own = group[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _donors(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, width: int) -> tuple[np.ndarray, ...]:
    """(position in x, position in y, distance) of the k nearest of y, ties by id.

    Gaps, which x has none of, are passed over and scaled up for.  Lower bounds of boxes are summed in the
    order of distances, so that rounding puts no bound above a distance.
    """
    with np.errstate(all="ignore"):
        finite = np.isfinite(np.where(np.isnan(y), 0, y)).all(axis=1)  # no distance to others is finite
    m = (~np.isnan(y)).sum(axis=1)
    use = np.flatnonzero(finite & (m > 0))
    low, high = np.where(np.isnan(y), -np.inf, y), np.where(np.isnan(y), np.inf, y)
    # gaps lie beyond all values, so that few leaves have both
    beyond = [2 * z.max(initial=0) - z.min(initial=0) + 1 for z in (c[~np.isnan(c)] for c in y[use].T)]
    tree = [use[own] for own in _leaves(np.where(np.isnan(y[use]), beyond, y[use]), LEAF)] if len(use) else []
    box = [(low[own].min(axis=0), high[own].max(axis=0), m[own].max()) for own in tree]
    lows, highs, most = (np.array([b[j] for b in box]) for j in range(3))
    found = []
    for block in _leaves(x, LEAF) if tree and len(x) else []:
        q = x[block]
        near = np.zeros(len(tree))
        for j in range(x.shape[1]):
            gap = np.maximum(np.maximum(lows[:, j] - q[:, j].max(), q[:, j].min() - highs[:, j]), 0)
            near += gap * gap
        near = np.sqrt(near * width / most)
        row, at, dist, worst = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.full(len(q), np.inf)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > worst.max():
                break
            own = tree[leaf]
            d = np.zeros((len(q), len(own)))
            for j in range(x.shape[1]):
                gap = q[:, j, None] - y[own, j][None, :]
                d += np.where(np.isnan(gap), 0, gap * gap)
            d = np.sqrt(d * width / m[own])
            least = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1]) if len(own) > k else worst
            r, c = np.nonzero((d <= least[:, None]) & np.isfinite(d))
            row, at, dist = np.concatenate([row, r]), np.concatenate([at, own[c]]), np.concatenate([dist, d[r, c]])
            keep = _first(row, dist, ids[at], k)
            row, at, dist = row[keep], at[keep], dist[keep]
            last = np.flatnonzero(np.diff(row, append=-1))
            full = np.bincount(row, minlength=len(q))[row[last]] == k
            worst[row[last][full]] = dist[last][full]
        found.append((block[row], at, dist))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def knn_impute(df: DataFrame, roles: Roles, k: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """The number columns of first rows, nulls filled with the mean of the k nearest donors.

    Distances pass over missing coordinates and are scaled up for them.  A donor has the
    column in question; ties go to the smaller id.  Columns without any value are dropped.
    Equal rows with gaps are searched for once.  A task takes ``DONORS`` donors; of those that
    are alike in what the rows with gaps have, the k of the least ids come into question.
    The others are laid out in boxes, and those that are too far are passed over.
    """
    view = materialize(numeric_view(deduplicated(df) if rows is None else rows, roles))
    counts = view.agg(F.count("*").alias("n"), *(F.count(c).alias(f"n{i}") for i, c in enumerate(roles.numbers)), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(roles.numbers))).first()
    columns = [c for i, c in enumerate(roles.numbers) if counts[f"n{i}"]]
    means = {c: counts[f"m{i}"] for i, c in enumerate(roles.numbers)}
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    view = view.select(IDX, *columns)
    if not columns:
        return view
    asked = materialize(view.filter(gap).groupBy(*columns).agg(F.min(IDX).alias("_i")))
    n, spark, width = asked.count(), df.sparkSession, len(columns)
    if not n:
        return view
    donors = view.repartition(max(1, -(-counts["n"] // DONORS)), IDX)
    filled = None
    rounds = -(-n // GAPS_AT_ONCE)
    for r in range(rounds):
        part = asked.filter(F.pmod(F.xxhash64("_i"), F.lit(rounds)) == r).toPandas()
        shared = spark.sparkContext.broadcast((part["_i"].to_numpy(np.int64), part[columns].to_numpy(np.float64)))

        def search(pdfs: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, x = shared.value
            batches = list(pdfs)  # DONORS rows, about
            if not batches:
                return
            held = pd.concat(batches)
            donor, y = held[IDX].to_numpy(np.int64), held[columns].to_numpy(np.float64)
            kinds, of = np.unique(~np.isnan(x), axis=0, return_inverse=True)
            of = of.reshape(-1)
            for number, known in enumerate(kinds):
                if not known.any():
                    continue
                asks = np.flatnonzero(of == number)
                for c in np.flatnonzero(~known):
                    own = np.flatnonzero(~np.isnan(y[:, c]))
                    z = y[own][:, known]
                    order = np.lexsort((donor[own], *z.T))
                    ranked = z[order]
                    same = ((ranked[1:] == ranked[:-1]) | np.isnan(ranked[1:]) & np.isnan(ranked[:-1])).all(axis=1)
                    group = np.cumsum(np.append(True, ~same)[: len(order)])
                    best = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
                    row, at, d = _donors(x[asks][:, known], z[best], donor[own][best], k, width)
                    at = own[best][at]
                    yield pd.DataFrame({"_i": ids[asks][row], "c": columns[c], "donor": donor[at], "d": d, "v": y[at, c]})

        found = donors.mapInPandas(search, "_i long, c string, donor long, d double, v double")
        rank = F.row_number().over(W.partitionBy("_i", "c").orderBy("d", "donor"))
        means_of = found.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy("_i", "c").agg(F.avg("v").alias("v"))
        filled = means_of if filled is None else filled.unionByName(means_of)
    wide = filled.groupBy("_i").pivot("c", columns).agg(F.first("v")).select("_i", *(F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(columns)))
    wide = asked.join(wide, "_i").select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)), *(f"_f{i}" for i in range(width)))
    alike = F.lit(True)
    for i, c in enumerate(columns):
        alike = alike & view[c].eqNullSafe(wide[f"_c{i}"])
    # without any donor a column's mean serves
    return view.join(wide, alike, "left").select(IDX, *(F.coalesce(F.col(c), F.col(f"_f{i}"), F.lit(means[c])).alias(c) for i, c in enumerate(columns)))
