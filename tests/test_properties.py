"""Properties that hold for any table."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritsieve.functions import profile
from gritsieve.operators import duplicates
from gritsieve.plans.engine import DataQuality
from gritsieve.plans.ledger import IDX

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cells = st.tuples(st.one_of(st.none(), st.sampled_from("abc")), st.one_of(st.none(), st.integers(0, 2)))


@few
@given(rows=st.lists(cells, max_size=30))
def test_copies_are_rows_less_distinct_ones(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{IDX} long, a string, b int")
    later = [r[IDX] for r in duplicates.duplicated(df).filter("duplicated").collect()]
    assert len(later) == len(rows) - len(set(rows))
    assert sorted(later) == [i for i, r in enumerate(rows) if r in rows[:i]]


@few
@given(rows=st.lists(st.integers(-50, 50), min_size=3, max_size=40), scale=st.sampled_from([0.5, 2.0, 1024.0]), order=st.randoms())
def test_extremes_keep_under_scale_and_order(spark, rows, scale, order):
    def found(values):
        q = DataQuality(spark.createDataFrame(values, "id long, v double"), index_col="id")
        return sorted(r.idx for r in q.check_extreme_value(thresh_std=1.5, thresh_unique1=1.0).collect())

    base = [(i, float(v)) for i, v in enumerate(rows)]
    shuffled = base[:]
    order.shuffle(shuffled)
    assert found(base) == found(shuffled)
    assert found([(i, v * scale) for i, v in base]) == found(base)  # powers of two scale exactly


@few
@given(texts=st.lists(st.one_of(st.none(), st.sampled_from(["2021-01-05", "03/04/2020", "x", "12"])), max_size=12))
def test_a_column_is_a_date_if_all_values_are(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"{IDX} long, t string")
    known = [t for t in texts if t is not None]
    want = "none" if not known else "date" if all(t[:1] in "20" and len(t) == 10 for t in known) else "str"
    assert profile.kinds(df)["t"] == want


def test_late_counterexample(spark):
    df = spark.range(5000).select(F.col("id").alias(IDX), F.when(F.col("id") == 4999, "no date").otherwise("2020-02-02").alias("t"), F.when(F.col("id") == 4999, 1).alias("n"))
    assert profile.kinds(df.coalesce(1)) == {"t": "str", "n": "int"}
