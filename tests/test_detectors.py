"""Micro-fixtures with hand-computed findings."""

import math
import random
import time
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritsieve.functions import profile
from gritsieve.operators import categories, completeness, duplicates, mcl, neighbours, numeric, typos
from gritsieve.plans.engine import DataQuality
from gritsieve.plans.ledger import IDX


def quality(spark, rows, schema, **params):
    return DataQuality(spark.createDataFrame(rows, schema).coalesce(1), drop_first_col=False, **params)


def ids(df, *more):
    return sorted(tuple(r) if more else r[0] for r in df.select("idx", *more).collect())


F1 = [("A", 1), ("B", 2), ("A", 1), ("A", 1), ("B", 2), ("C", 3)]


def test_duplicates_by_position_and_strict(spark):
    q = quality(spark, F1, "k string, v int")
    assert ids(q.check_duplication(), "num2") == [(2, 0.0), (3, 1.0)]
    q = quality(spark, F1, "k string, v int", semantics="strict")
    assert ids(q.check_duplication(), "num2") == [(2, 0.0), (3, 0.0), (4, 1.0)]


@pytest.mark.parametrize(("keep", "expected"), [("first", [2, 3, 4]), ("last", [0, 1, 2]), (False, [0, 1, 2, 3, 4])])
def test_masks(spark, keep, expected):
    q = quality(spark, F1, "k string, v int")
    assert sorted(r[0] for r in duplicates.duplicated(q.data, keep).filter("duplicated").collect()) == expected
    first, later = duplicates.split_duplicates(q.data)
    assert first.count() == 3 and later.count() == 3


def test_nulls_are_equal_duplicates_but_not_shifted_ones(spark):
    q = quality(spark, [(None, None), (float("nan"), None), (None, "a"), (1.0, None)], "a double, b string")
    assert ids(q.check_duplication()) == [1]


def test_zero_deviation_flags_all_unless_strict(spark):
    rows = [(i, 5.0) for i in range(3)]
    assert ids(quality(spark, rows, "id int, v double").check_extreme_value().filter("column = 'v'")) == [0, 1, 2]
    assert ids(quality(spark, rows, "id int, v double", semantics="strict").check_extreme_value().filter("column = 'v'")) == []


def test_extreme_value_bounds(spark):
    rows = [(i, 0.0) for i in range(19)] + [(19, 100.0)]
    q = quality(spark, rows, "id int, v double")
    assert ids(q.check_extreme_value(thresh_std=4).filter("column = 'v'")) == [19]
    assert ids(q.check_extreme_value(thresh_std=6).filter("column = 'v'")) == []


def test_completeness(spark):
    rows = [(*[None] * 7, float(a), b, b) for a, b in ((1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None))]
    q = quality(spark, rows, ", ".join(f"c{i} double" for i in range(10)))
    assert ids(q.check_completeness()) == [4]


def test_tendency(spark):
    rows = [(float(i), float(i - 1 if i == 7 else i + 1)) for i in range(2000)]
    q = quality(spark, rows, "a double, b double")
    assert ids(q.check_tendency(), "column", "column2") == [(7, "a", "b")]
    rows = [(a, None if i < 5 else b) for i, (a, b) in enumerate(rows)]
    assert ids(quality(spark, rows, "a double, b double").check_tendency()) == []


def test_logic_in_both_directions(spark):
    rows = [("X" if i % 2 == 0 else "Y", "q" if i in (0, 2, 4) or i % 2 else "p") for i in range(10_000)]
    q = quality(spark, rows, "a string, b string")
    assert ids(q.check_logic(), "column") == sorted((i, c) for i in (0, 2, 4) for c in "ab")
    assert q.corr_col == {"a": ["b"], "b": ["a"]}


def test_mixed_logic_leaks_values_unless_strict(spark):
    rows = [("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 2.0)]
    assert ids(quality(spark, rows, "c string, v double").check_mixed_logic(thres_unique_str=0.6)) == [1, 3]
    assert ids(quality(spark, rows, "c string, v double", semantics="strict").check_mixed_logic(thres_unique_str=0.6)) == []


def test_dates_become_fractional_years(spark):
    q = quality(spark, [("2020-12-31",), ("2021-01-01",), ("2021-06-15",)], "d string")
    assert q.nbr_col == ["d"] and q.str_col == []
    got = [r[0] for r in profile.numeric_view(q.data, q.roles).orderBy(IDX).select("d").collect()]
    assert np.allclose(got, [2021.0849315068492, 2021.0860730593606, 2021.541095890411], rtol=0, atol=1e-12)


def test_roles(spark):
    rows = [(True, Decimal("1.5"), [1], None, datetime(2020, 1, 1), "x", 1)]
    q = quality(spark, rows, "b boolean, d decimal(5,2), a array<int>, n string, t timestamp, s string, i int")
    assert q.roles.kinds == {"b": "none", "d": "float", "a": "none", "n": "none", "t": "date", "s": "str", "i": "int"}
    assert q.str_col == ["s"] and q.nbr_col == ["d", "t", "i"]


def brute_lof(x, k):
    d = np.abs(x[:, None, :] - x[None, :, :]).max(axis=2)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    nb = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = np.take_along_axis(d, nb, axis=1)
    lrd = 1 / (np.maximum(own[:, -1][nb], own).mean(axis=1) + 1e-10)
    return lrd[nb].mean(axis=1) / lrd


def test_lof(spark):
    rows = [(float(v),) for v in [*range(30), 1000]]
    q = quality(spark, rows, "v double")
    assert ids(q.check_outlier()) == [30]
    top = q.outlier_lof().filter("flagged").first()
    assert math.isclose(top.lof, 76.438238, abs_tol=1e-5) and top.normalized == 1.0


def test_lof_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 37)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 2)), 3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], f"{IDX} long, a double, b double")
    got = np.array([r.lof for r in neighbours.lof_scores(df, ["a", "b"], 10).orderBy(IDX).collect()])
    assert np.allclose(got, brute_lof(x, 10))


def test_later_copies_are_not_broadcast(spark):
    q = DataQuality(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("w")), index_col="k")
    plan = q.first_rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r[IDX] for r in q.first_rows.collect()] == [0]


def test_imputation(spark):
    q = quality(spark, [(1, 10), (2, 20), (3, None)], "a int, b int")
    assert [r.b for r in q.imputation().orderBy(IDX).collect()] == [10.0, 20.0, 15.0]


def imputed(rows, k):
    """Plain imputation of rows (id, a, b, c)."""
    out = {}
    for i, *x in rows:
        new = list(x)
        for c in range(3):
            if x[c] is None:
                found = []
                for j, *y in rows:
                    both = [q for q in range(3) if x[q] is not None and y[q] is not None]
                    if j != i and y[c] is not None and both:
                        found.append((math.sqrt(sum((x[q] - y[q]) ** 2 for q in both) * 3 / len(both)), j, y[c]))
                own = [y[c] for _, *y in rows if y[c] is not None]
                best = sorted(found)[:k]
                new[c] = sum(v for _, _, v in best) / len(best) if best else sum(own) / len(own)
        out[i] = new
    return out


def test_imputation_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DONORS", 150, raising=False)
    monkeypatch.setattr(neighbours, "LEAF", 8, raising=False)
    rng = random.Random(3)
    rows = [(i, *(None if rng.random() < 0.15 else f(rng) for f in (lambda r: float(r.randrange(4)), lambda r: round(r.gauss(0, 10), 3), lambda r: r.random() * 5))) for i in range(500)]
    rows += [(500 + i, 2.0, None, None) for i in range(30)] + [(530 + i, None, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").withColumnRenamed("k", IDX)
    roles = profile.Roles(numbers=["a", "b", "c"])
    got = {r[IDX]: [r.a, r.b, r.c] for r in neighbours.knn_impute(df, roles, 5, rows=df).collect()}
    want = imputed(rows, 5)
    assert sorted(got) == sorted(want)
    assert all(np.allclose(got[i], want[i], rtol=1e-12) for i in want)


def test_imputation_of_many_rows_takes_no_search_for_each(spark):
    """Before, 4,000 searches through 80,000 rows; they are 50 different ones."""
    df = spark.range(80_000).select(F.col("id").alias(IDX), (F.col("id") % 50).cast("double").alias("a"), F.when(F.col("id") % 20 > 0, F.col("id") * 1.0).alias("b"))
    began = time.time()
    got = neighbours.knn_impute(df, profile.Roles(numbers=["a", "b"]), 3, rows=df)
    assert {r.b for r in got.filter(F.col("a") == 20).filter(F.col(IDX) % 20 == 0).collect()} == {(70 + 170 + 270) / 3}
    assert time.time() - began < 20


def test_good_index_and_passes(spark):
    q = quality(spark, [*F1, ("D", 4)], "k string, v int", semantics="strict")
    q.firstpass("duplication")
    assert sorted(r[0] for r in q.good_index.collect()) == [0, 1, 5, 6]
    with pytest.raises(KeyError):
        q.firstpass("nothing")
    with pytest.raises(ValueError):
        q.good_index = list(range(99))
    q.good_index = [1, 2]
    assert q.good_rows().count() == 2


def test_non_unique(spark):
    rows = [(float(v),) for v in [*range(1000), 7]]
    q = quality(spark, rows, "v double")
    assert sorted(r[IDX] for r in duplicates.non_unique(q.data, "v", clean_dup=False).collect()) == [7, 1000]


def test_column_completeness_and_histogram(spark):
    q = quality(spark, [(None, None if i else 1.0, 1.0 if i % 2 else None) for i in range(100)], "a double, b double, c double")
    assert completeness.empty_columns(q.data) == ["a", "b"]
    q = quality(spark, [("x", 1, 0), ("x", 1, 1), ("y", 2, 2), ("x", 2, 3)], "a string, b int, z int")
    assert [tuple(r) for r in q.dual_hist("a", "b").collect()] == [("x", 1, 2), ("x", 2, 1), ("y", 2, 1)]
    assert q.dual_hist("a", "z").count() == 0


def test_combined_columns_leave_flagged_rows_out(spark):
    q = quality(spark, [("x", 1.0), ("x", 1.0), ("y", None)], "a string, b double", semantics="strict")
    q.check_duplication()
    assert q.col_combined_result("a", "b").count() == 1


WORDS = ["blue gear"] * 3 + ["gear blue", "steel rod"]


def test_markov_clustering(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], f"{IDX} long, w string")
    got = mcl.clusters(mcl.word_clusters(mcl.vocabulary(df, "w")).select("label", "id")).collect()
    assert sorted(r.members for r in got) == [[0, 1], [2]]
    assert [tuple(r) for r in mcl.typo_correction(df, "w").collect()] == [(3, "gear blue", "blue gear")]
    assert sorted(r[IDX] for r in typos.typo_rows(df, "w", 10, "MCL").collect()) == [0, 1, 2, 3]


def test_blocks_cluster_as_the_whole_does():
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes = rng.integers(1, 6, 4)
        t = np.zeros((sizes.sum(), sizes.sum()))
        at = 0
        parts = []
        for n in sizes:
            b = rng.random((n, n)) * (rng.random((n, n)) < 0.7)
            b = np.maximum(b, b.T)
            np.fill_diagonal(b, 1)
            t[at : at + n, at : at + n] = b
            parts += [at + k for k in mcl.support_labels(mcl.fixed_point(b))]
            at += n
        assert list(mcl.support_labels(mcl.fixed_point(t))) == parts


def test_matrix_steps_against_numpy(spark):
    m = np.array([[1.0, 0.5, 0.0], [0.5, 1.0, 0.25], [0.0, 0.25, 1.0]])
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]], "i long, j long, v double")
    dense = lambda d: {(r.i, r.j): r.v for r in d.collect()}
    n = (m + 0.01 * np.eye(3)) / (m + 0.01 * np.eye(3)).sum(axis=1, keepdims=True)
    got = dense(mcl.normalize(mcl.self_loops(df)))
    assert all(math.isclose(v, n[k]) for k, v in got.items())
    got = dense(mcl.inflate(mcl.expand(mcl.normalize(mcl.self_loops(df)))))
    assert all(math.isclose(v, (n @ n)[k] ** 2) for k, v in got.items())


def test_clustering_object(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], f"{IDX} long, w string")
    words = mcl.vocabulary(df, "w")
    got = mcl.MarkovClustering(mcl.tf_vectors(words)).fit().clusters(words).collect()
    assert sorted(r.members for r in got) == [["blue gear", "gear blue"], ["steel rod"]]
    rows = spark.createDataFrame([(0, "x", 1.0), (1, "x", 1.5), (2, "x", 9.0)], "id long, token string, w double")
    dist = {(r.i, r.j): r.v for r in mcl.feature_similarity(rows, rows.select("id"), "euclidean").collect()}
    assert dist[0, 1] == 0.5 and dist[0, 2] == -7.0 and dist[2, 2] == 1.0
    with pytest.raises(RuntimeError):
        mcl.MarkovClustering(rows).extract_labels()


def test_affinity_propagation_finds_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (8, 2)), rng.normal(5, 0.1, (9, 2)), rng.normal((0, 9), 0.1, (7, 2))])
    labels = typos.affinity_propagation(-((x[:, None] - x[None]) ** 2).sum(axis=2), preference=-50)
    assert len(set(labels)) == 3 and len(set(labels[:8])) == 1 and len(set(labels[8:17])) == 1
    assert list(typos.affinity_propagation(np.ones((3, 3)))) == [0, 1, 2]


def test_similarity_is_not_symmetric():
    assert typos.similarity("tide", "diet") == 0.25 and typos.similarity("diet", "tide") == 0.5
    m = typos.similarity_matrix(["tide", "diet"])
    assert m[1, 0] == 0.25 and m[0, 1] == 0.5


def test_suggestions(spark, monkeypatch):
    monkeypatch.setattr(typos, "exemplar_labels", lambda words, *a, **k: np.array([0 if w in "ab" else 1 for w in words]))
    monkeypatch.setattr(typos, "clustered", lambda vocab, *a, **k: vocab.withColumn("label", F.when(F.col("word").isin("a", "b"), 0).otherwise(1).cast("long")))
    df = spark.createDataFrame([(i, w) for i, w in enumerate("aaaaabbc")], f"{IDX} long, w string")
    got = typos.typo_suggestions(df, "w", 1, 10).collect()
    assert len(got) == 7 and all(r.suggestions == ["a"] for r in got)


def test_typos_by_exemplars(spark):
    words = ["harvester"] * 40 + ["harvster"] * 2 + ["tractor"] * 40 + ["tracktor"] + ["plough"] * 40
    q = quality(spark, [(i, w) for i, w in enumerate(words)], "id int, w string")
    found = {r.value1 for r in q.check_typo(tresh_unique=0.1).collect()}
    assert found == {"harvster", "tracktor"}


def test_empty_table(spark):
    q = quality(spark, [], "a double, b string, c double")
    for name in ("duplication", "extreme_value", "completeness", "tendency", "outlier", "logic", "mixed_logic", "typo"):
        assert getattr(q, f"check_{name}")().count() == 0
    assert q.report().columns == ["idx", "column", "errtype", "value1", "value2"]


def test_global_rank_crosses_ranges(spark):
    df = spark.createDataFrame([(i * 50_000,) for i in range(40)], f"{IDX} long")
    assert [r["rank"] for r in duplicates.global_rank(df).orderBy(IDX).collect()] == list(range(40))


def test_z_score_gate(spark):
    q = quality(spark, [(i, 0.0 if i < 19 else 100.0) for i in range(20)], "id int, v double")
    assert numeric.z_score(q.data, "v", 0.1, 4).count() == 1 and numeric.z_score(q.data, "v", 0.995, 4).count() == 0


def test_correlation_of_nothing(spark):
    q = quality(spark, [("a", 1)], "s string, i int")
    assert categories.correlated(q.data, q.roles, q.uniq_col) == {"s": []}


@pytest.mark.parametrize("most", [profile.MOST_CODES, 0])
def test_correlation_against_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(profile, "MOST_CODES", most)
    rng = random.Random(5)
    rows = [(a := rng.choice(["é", "b", "", None]), rng.choice([a, "z", "b"]), rng.choice("xyz"), "same") for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(3)
    order = sorted({v for r in rows for v in r}, key=lambda v: (v is None, (v or "").encode()))
    assert {r.value: r.code for r in profile.label_codes(df, df.columns).collect()} == {v: k for k, v in enumerate(order)}
    x = np.array([[order.index(v) for v in r[:3]] for r in rows], float)
    want = np.corrcoef(x.T)
    got = {(r.column1, r.column2): r.corr for r in profile.string_correlation(df, df.columns).collect()}
    assert len(got) == 12 and all(got[p] is None for p in got if "d" in p)
    assert all(abs(got["abc"[i], "abc"[j]] - want[i, j]) < 1e-9 for i in range(3) for j in range(3) if i != j)


def test_a_large_vocabulary_is_clustered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(typos, "MAX_VOCAB", 40)
    monkeypatch.setattr(typos, "SAMPLE", 30)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(120)]
    slips = {w[:4] + w[5:]: w for w in words[:20]}
    rows = [(w, "left" if k % 2 else "right") for w in words for k in range(30)] + [(w, "left") for w in slips for _ in range(3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{IDX} long, w string, side string")
    got = typos.clustered(typos.vocabularies(df, ["w", "side"])).collect()
    assert sorted(r.word for r in got) == sorted({*words, *slips, "left", "right"})
    label = {r.word: r.label for r in got}
    assert all(label[x] == label[w] for x, w in slips.items()) and len({label[w] for w in words}) == 120
    rare = typos.rare_words(typos.clustered(typos.vocabularies(df, ["w"]))).collect()
    assert sorted(r.word for r in rare) == sorted(slips)


def test_the_first_pass_takes_large_vocabularies(spark, monkeypatch):
    monkeypatch.setattr(typos, "MAX_VOCAB", 30)
    monkeypatch.setattr(typos, "SAMPLE", 20)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(60)]
    rows = [(i, words[i % 60], float(i % 700)) for i in range(15_000)] + [(20_000 + k, words[k][1:], 1.0) for k in range(4)]
    q = DataQuality(spark.createDataFrame(rows, "id long, w string, v double"), index_col="id")
    found = q.firstpass().collect()
    assert sorted(r.idx for r in found if r.check == "typo") == [20_000 + k for k in range(4)] and {r.check for r in found} == {"typo", "duplication"}


def test_a_large_block_is_clustered_as_tables(spark, monkeypatch):
    words = [f"{a} {b}" for a in ("red", "blue", "green") for b in ("gear", "bolt", "nut")] + ["alone"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words * 2)], f"{IDX} long, w string")
    vocab = mcl.vocabulary(df, "w")
    dense_labels = sorted(tuple(r) for r in mcl.cluster(mcl.cosine_similarity(vocab), vocab).collect())
    monkeypatch.setattr(mcl, "MOST_WORDS", 3)
    assert sorted(tuple(r) for r in mcl.cluster(mcl.cosine_similarity(vocab), vocab).collect()) == dense_labels


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_dense_distances(spark, metric):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((40, 6)) < 0.4, 0.0, rng.integers(0, 9, (40, 6)).astype(float))
    rows = spark.createDataFrame([(i, f"t{k}", float(x[i, k])) for i in range(40) for k in range(6) if x[i, k]], "id long, token string, w double")
    ids = spark.range(40)
    got = {(r.i, r.j): r.v for r in mcl.feature_similarity(rows, ids, metric).collect()}
    gap = np.abs(x[:, None] - x[None])
    want = 1 - (gap.sum(axis=2) if metric == "manhattan" else np.sqrt((gap**2).sum(axis=2)))
    assert all(abs(got.get((i, j), 0.0) - want[i, j]) < 1e-9 for i in range(40) for j in range(40))


def test_numbering_of_words(spark):
    words = [f"w{k}" for k in range(500)]
    got = mcl.numbered(spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(7)).orderBy("id").collect()
    assert [(r.id, r.word) for r in got] == list(enumerate(sorted(words)))
