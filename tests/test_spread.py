"""Tasks follow the input."""

from pyspark.sql import functions as F

from itemloom.plans import spread as spreading


def test_spread_follows_the_input_not_row_groups(spark, tmp_path, monkeypatch):
    """One row group would be one task, whatever its size; a text's equal twin in another row goes elsewhere."""
    path = f"{tmp_path}/t.parquet"
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("txt")).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    monkeypatch.setattr(spreading, "TASK_BYTES", size // 50)
    dealt = spreading.spread(df)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() in (50, 51) and len(sizes) >= 50 and max(sizes) < 200 and sum(sizes) == 4000
    monkeypatch.setattr(spreading, "TASK_BYTES", size)
    assert spreading.spread(df).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
