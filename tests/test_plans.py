"""What the physical plans must and must not hold."""

import re

from gritsieve.operators import duplicates, numeric
from gritsieve.plans.engine import DataQuality


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(2000).selectExpr("id", "cast(id % 97 as double) as v", "repeat('x', 100) as wide", "cast(id % 7 as string) as c").write.parquet(path)
    return DataQuality(spark.read.parquet(path), index_col="id")


def test_scans_read_only_what_is_asked(spark, tmp_path):
    q = table(spark, tmp_path)
    p = plan(numeric.z_score(q.data, "v", 0.5))
    assert "ReadSchema" in p and "wide" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", p))
    p = plan(duplicates.copies(q.data).filter("n > 1").select("_idx"))
    for keys in re.findall(r"hashpartitioning\(([^)]*)\)", p):  # hashes are shuffled, not rows
        assert "wide" not in keys


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(2000).selectExpr("id", "cast(id % 7 as string) as c", "cast(id % 5 as string) as d").write.parquet(path)
    q = DataQuality(spark.read.parquet(path), index_col="id")
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(c\)", plan(q.col_combined_result("c", "d")))


def test_detectors_stay_in_the_jvm(spark, tmp_path):
    q = table(spark, tmp_path)
    for found in (q.check_duplication(), q.check_extreme_value(), q.check_completeness(), q.check_tendency(), q.check_logic(), q.check_mixed_logic(thres_unique_str=0.1)):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan(found))
