from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortry.sources.tables import Materialization, from_pandas, overwrite_partition, schema_of, upsert_table
from cohortry.streaming import windows

T0 = datetime(2024, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, T0 + timedelta(minutes=7 * i), "ab"[i // 4 % 2]) for i in range(60)], "k long, ts timestamp, e string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    aggs = [F.count("*").alias("n")]
    for name, f, arg in (("t", windows.tumbling, "1 hour"), ("s", windows.sessions, "30 minutes")):
        mode = "complete" if name == "t" else "append"
        q = f(stream, "ts", arg, ["k"], aggs).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = set(map(tuple, spark.table(name).collect())), set(map(tuple, f(df, "ts", arg, ["k"], aggs).collect()))
        assert got == want if name == "t" else got <= want


def test_tables(spark, tmp_path):
    import pandas as pd

    spark.sql("DROP TABLE IF EXISTS t_part")
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    overwrite_partition(a, "t_part", "d", "2024-01-01")
    overwrite_partition(a, "t_part", "d", "2024-01-02")
    overwrite_partition(a.withColumn("v", F.lit("y")), "t_part", "d", "2024-01-02")
    assert sorted(map(tuple, spark.table("t_part").select("k", "v", "d").collect())) == [(1, "x", "2024-01-01"), (1, "y", "2024-01-02")]
    spark.sql("DROP TABLE t_part")
    Materialization().apply(a, "t_up")
    upsert_table(spark.createDataFrame([(1, "z"), (2, "w")], "k long, v string"), "t_up", ["k"])
    assert sorted(map(tuple, spark.table("t_up").collect())) == [(1, "z"), (2, "w")]
    spark.sql("DROP TABLE t_up")
    assert Materialization("temp_view").apply(a, "v_a").count() == 1
    pdf = pd.DataFrame({"a": [1.5, None], "b": [None, None], "c": ["x", None]})
    assert [f.dataType.simpleString() for f in schema_of(pdf)] == ["double", "string", "string"]
    assert from_pandas(spark, pdf).where("a is null").count() == 1
