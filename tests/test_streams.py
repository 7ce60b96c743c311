"""Streams give what their batch twins give, as far as windows are closed."""

from pyspark.sql import functions as F

from arborank.streaming import streams

DATA = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, mode="append", name="out"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def events(spark, tmp_path, stream):
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).drop("props")
    if not stream:
        return rows
    path = str(tmp_path / "events")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def test_windows(spark, tmp_path):
    for k, f in enumerate((streams.sessions, streams.hourly)):
        batch = {tuple(r) for r in f(events(spark, tmp_path, False)).collect()}
        stream = {tuple(r) for r in run(spark, f(events(spark, tmp_path, True)), tmp_path, name=f"w{k}").collect()}
        assert stream <= batch and len(stream) >= 0.98 * len(batch)


def test_duplicates_go(spark, tmp_path):
    twice = events(spark, tmp_path, True)
    got = run(spark, streams.first_of_each(twice.unionByName(twice), ["event_id"]), tmp_path, name="dd")
    assert got.count() == 1000


def test_last_items_are_state(spark, tmp_path):
    df = events(spark, tmp_path, True).select("user_id", F.col("event_id").alias("item"), "ts")
    got = {r.user_id: list(r["items"]) for r in run(spark, streams.last_items(df, 5), tmp_path, "update", "li").collect()}
    rows = events(spark, tmp_path, False).select("user_id", "event_id", "ts").collect()
    for user, items in got.items():
        assert items == [r.event_id for r in sorted((r for r in rows if r.user_id == user), key=lambda r: (r.ts, r.event_id), reverse=True)][:5]
