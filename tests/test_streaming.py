from datetime import datetime, timedelta

from spanwright.streaming.debounce import apply_changes, debounced, debounced_stream, invalidated

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def events(spark, *rows):
    return spark.createDataFrame([(i, T0 + timedelta(milliseconds=ms), u, t) for i, ms, u, t in rows], EVENTS)


ROWS = [(1, 0, 1, "m"), (2, 300, 1, "m"), (3, 800, 1, "m"), (4, 1301, 1, "m"), (5, 0, 2, "m"), (6, 100, 1, "d")]


def test_batch(spark):
    got = {(r.user_id, r.event_type, r.event_id, r.n_events) for r in debounced(events(spark, *ROWS), "500 milliseconds").collect()}
    assert got == {(1, "m", 3, 3), (1, "m", 4, 1), (2, "m", 5, 1), (1, "d", 6, 1)}
    assert debounced(events(spark, *ROWS).where("false"), "500 milliseconds").count() == 0


def test_stream_gives_the_batch_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, *ROWS).coalesce(1).write.parquet(folder)
    events(spark, (99, 60_000, 9, "z")).coalesce(1).write.mode("append").parquet(folder)  # moves the watermark on
    out = debounced_stream(spark, folder, events(spark, *ROWS).schema, "500 milliseconds", "1 second")
    q = out.writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.event_type, r.event_id, r.n_events) for r in spark.sql("select * from fired where user_id <> 9").collect()}
    assert got == {(1, "m", 3, 3), (1, "m", 4, 1), (2, "m", 5, 1), (1, "d", 6, 1)}


def test_changes_and_invalidation(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    ch = spark.createDataFrame([("a", 5, "modified", 1), ("a", 6, "modified", 2), ("b", 0, "deleted", 3), ("c", 9, "created", 1)], "path string, v int, kind string, ts int")
    assert {tuple(r) for r in apply_changes(now, ch).collect()} == {("a", 6), ("c", 9)}
    deps = spark.createDataFrame([("x", "a"), ("y", "x"), ("z", "q")], "src string, dst string")
    assert {r.node for r in invalidated(spark.createDataFrame([("a",)], "node string"), deps).collect()} == {"a", "x", "y"}
