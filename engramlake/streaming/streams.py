"""Structured Streaming: event windows, sessions, change feeds, buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, *, per_trigger: int = 16) -> DataFrame:
    """Event files as a stream, ``per_trigger`` files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def read_buffer(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines tool events as a stream; lines that do not parse are dropped.

    What was read is remembered in the query's checkpoint, so nothing is taken twice.
    """
    raw = spark.readStream.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda n, k: F.try_variant_get("v", f"$.{n}", k).alias(n)
    return raw.select(get("tool_name", "string"), get("session_id", "string"), get("success", "boolean"), get("duration_ms", "bigint"), F.try_to_timestamp(F.try_variant_get("v", "$.created_at", "string")).alias("created_at"))


def windowed_counts(events: DataFrame, *, at: str, key: str, width: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Tumbling counts with a watermark; later rows are dropped by the engine."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, *, at: str, key: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_topics(events: DataFrame, *, alpha: float = 0.3, expire_ms: int = 7_200_000) -> DataFrame:
    """Running exponential average of actions in a session, ``(session, action, score)`` after each batch.

    ``events(session string, action string, at timestamp)`` with a watermark on ``at``; a
    session's state is dropped two hours after its last event.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, values = state.get if state.exists else ([], [])
        score = dict(zip(names, values))
        last = None
        for frame in frames:
            for action, at in frame.sort_values("at")[["action", "at"]].itertuples(index=False):
                score = {k: v * (1 - alpha) for k, v in score.items() if v * (1 - alpha) >= 0.01}
                score[action] = score.get(action, 0.0) + alpha
                last = at
        state.update((list(score), list(score.values())))
        if last is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + expire_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session": key[0], "action": list(score), "score": list(score.values())})

    return events.groupBy("session").applyInPandasWithState(
        update, "session string, action string, score double", "names array<string>, scores array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def apply_changes(stream: DataFrame, root: str, checkpoint: str):
    """Keep a log of assembled receipts under ``root``: each batch is parsed and appended under its number.

    The batch number names the output, so a batch that is run again overwrites itself and
    counts once.  ``operators.changelog.replay`` over the log gives the current state.
    """
    from engramlake.operators.changelog import parse_changes

    def write(batch: DataFrame, number: int) -> None:
        parse_changes(batch).write.mode("overwrite").parquet(f"{root}/batch={number:010d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
