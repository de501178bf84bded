from pyspark.sql import functions as F

from siltworks.streaming import experience


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def _source(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_bounded_buffer(spark, tmp_path):
    s = _source(spark, tmp_path, [("a", i) for i in range(10)] + [("b", 1)], "k string, v long")
    _run(experience.bounded_buffer(s, "k", "v", 4), "buf", "update")
    got = {r["k"]: (r["contents"], r["seen"]) for r in spark.table("buf").collect()}
    assert got == {"a": ([6, 7, 8, 9], 10), "b": ([1], 1)}


def test_hybrid(spark, tmp_path):
    s = _source(spark, tmp_path, [(i, f"on{i}") for i in range(400)], "id long, text string")
    stored = spark.range(10).select(F.col("id"), F.concat(F.lit("off"), "id").alias("text"), F.col("id").alias("slot"))
    _run(experience.hybrid(s, stored, 0.5, 3, "id"), "hyb", "append")
    n = {r["origin"]: r["count"] for r in spark.table("hyb").groupBy("origin").count().collect()}
    assert sum(n.values()) == 400 and 140 < n["online"] < 260


def test_windowed_counts(spark, tmp_path):
    s = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    _run(experience.windowed_counts(s, "ts", "event_type", "1 day", "1 hour"), "win", "complete")
    assert spark.table("win").agg(F.sum("events")).first()[0] == 1000
