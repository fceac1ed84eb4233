import datetime as dt

from engramlake.operators import changelog
from engramlake.streaming import streams

DAY = dt.datetime(2025, 1, 1)
SCHEMA = "session string, action string, at timestamp"


def test_windows_and_topics(spark, tmp_path):
    rows = [("u", "a", DAY), ("u", "b", DAY + dt.timedelta(minutes=5)), ("u", "a", DAY + dt.timedelta(hours=9))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.read_events(spark, str(tmp_path / "in"), SCHEMA)
    for name, plan, mode in (
        ("windows", streams.windowed_counts(events, at="at", key="action"), "complete"),
        ("sessions", streams.session_counts(events, at="at", key="session"), "append"),
        ("topics", streams.session_topics(events.withWatermark("at", "1 hour")), "append"),
    ):
        query = plan.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert {(r.action, r.n) for r in spark.table("windows").groupBy("action").agg({"n": "sum"}).toDF("action", "n").collect()} == {("a", 2), ("b", 1)}
    assert {(r.action, round(r.score, 3)) for r in spark.table("topics").collect()} == {("a", 0.447), ("b", 0.21)}


def test_change_feed_is_kept_once(spark, tmp_path):
    line = '{"entity_type":"synapse","entity_id":"e","operation":"insert","sequence":1,"payload":{}}'
    spark.createDataFrame([("r", line), ("r", line[:20])], "receipt_id string, change string").write.parquet(str(tmp_path / "in"))
    feed = streams.read_events(spark, str(tmp_path / "in"), "receipt_id string, change string")
    query = streams.apply_changes(feed, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert changelog.assemble_transactions(kept.drop("batch")).count() == 1
