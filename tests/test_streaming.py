from pyspark.sql import functions as F

from gritsieve.plans.engine import DataQuality
from gritsieve.plans.ledger import IDX
from gritsieve.streaming import scoring


def test_stream_is_held_against_the_profile(spark, tmp_path):
    base = spark.createDataFrame([(i, float(i % 10)) for i in range(1000)], "id long, v double")
    q = DataQuality(base, index_col="id")
    frozen = scoring.freeze(q.data, q.roles, q.uniq_col)
    spark.createDataFrame([(1, 5.0), (2, 500.0), (3, None)], "id long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v double").parquet(str(tmp_path / "in")).withColumn(IDX, F.col("id"))
    run = scoring.score(stream, frozen).writeStream.format("memory").queryName("scored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [(r.idx, r.column, r.num1) for r in spark.table("scored").collect()] == [(2, "v", 500.0)]
