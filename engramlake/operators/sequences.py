"""Sequences, sessions and time windows over event streams and fibers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Review intervals in days by Leitner box. Fixed values.
BOXES = {1: 1, 2: 3, 3: 7, 4: 14, 5: 30}


def seconds(later: str, earlier: str):
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 1e6


def sequential_pairs(events: DataFrame, *, window_s: float = 30.0) -> DataFrame:
    """``(a, b, n, mean_gap)``: consecutive actions of a session at most ``window_s`` apart.

    ``events(session, action, at, event_id)``; a null session is one session, a null time
    is left out.  A session is split at fixed times, and what follows a split within the
    window is also seen from before it, so a session of any size is many units of work.
    """
    width = max(window_s * 16, 3600.0) * 1e6
    t = F.unix_micros(F.col("at").cast("timestamp"))
    own = events.where("at IS NOT NULL").select("session", "action", "event_id", t.alias("t")).withColumn("part", F.floor(F.col("t") / width)).withColumn("own", F.lit(True))
    ahead = own.where(F.col("t") - F.col("part") * width <= window_s * 1e6).select("session", "action", "event_id", "t", (F.col("part") - 1).alias("part"), F.lit(False).alias("own"))
    w = Window.partitionBy("session", "part").orderBy("t", "event_id")
    step = own.unionByName(ahead).select("own", "action", "t", F.lead("action").over(w).alias("next"), F.lead("t").over(w).alias("u"))
    gap = F.col("u") - F.col("t")
    kept = step.where(F.col("own") & F.col("next").isNotNull() & (gap / 1e6 <= window_s))
    mean = F.sum(gap).cast("double") / F.count("*") / 1e6  # whole microseconds, so the order of summing does not matter
    return kept.groupBy(F.col("action").alias("a"), F.col("next").alias("b")).agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean_gap"))


def habits(pairs: DataFrame, *, least: int, sessions: int) -> DataFrame:
    """Bigrams and trigrams ``(steps, n, confidence)`` of frequent pairs."""
    p = pairs.where(F.col("n") >= least).select("a", "b", "n")
    two = p.select(F.array("a", "b").alias("steps"), "n")
    three = p.alias("x").join(p.alias("y"), (F.col("x.b") == F.col("y.a")) & (F.col("y.b") != F.col("x.a"))).select(F.array("x.a", "x.b", "y.b").alias("steps"), F.least("x.n", "y.n").alias("n"))
    return two.unionByName(three).select("steps", "n", F.round(F.col("n") / sessions, 6).alias("confidence"))


def tool_pairs(events: DataFrame, *, window_s: float = 60.0, least: int = 3) -> DataFrame:
    """``(a, b, n)``: different actions of a session within ``window_s`` of each other.

    Time is cut into buckets of the window's width and an event meets its own and the next
    bucket, so the join is on equal keys.  Events of one action, session and bucket with the
    same time are one.
    """
    e = events.where("action IS NOT NULL AND at IS NOT NULL").select(F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), "action", "at")
    frequent = e.groupBy("action").agg(F.count("*").alias("uses")).where(F.col("uses") >= least).select("action")
    e = e.join(frequent, "action", "left_semi").withColumn("t", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("b", F.floor(F.col("t") / (window_s * 1e6)))
    later = e.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    both = e.alias("x").join(later.alias("y"), (F.col("x.session") == F.col("y.session")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.action") < F.col("y.action")))
    mirror = e.alias("x").join(later.alias("y"), (F.col("x.session") == F.col("y.session")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.action") > F.col("y.action")))
    forward = both.where((F.col("y.t") >= F.col("x.t")) & (F.col("y.t") - F.col("x.t") <= window_s * 1e6)).select(F.col("x.action").alias("a"), F.col("y.action").alias("b"))
    back = mirror.where((F.col("y.t") > F.col("x.t")) & (F.col("y.t") - F.col("x.t") <= window_s * 1e6)).select(F.col("y.action").alias("a"), F.col("x.action").alias("b"))
    return forward.unionByName(back).groupBy("a", "b").agg(F.count("*").alias("n"))


def temporal_links(fibers: DataFrame, *, hours: float = 24.0, k: int = 5) -> DataFrame:
    """``(fiber_id, other_id, type)``: the ``k`` most salient fibers of the brain that start within ``hours``.

    Bucketed by the window's width, so the range join is on equal keys.
    """
    width = hours * 3600e6
    f = fibers.where("time_start IS NOT NULL").select("brain_id", F.col("id").alias("fiber_id"), F.coalesce("salience", F.lit(0.0)).alias("salience"), F.unix_micros(F.col("time_start").cast("timestamp")).alias("t")).withColumn("b", F.floor(F.col("t") / width))
    near = f.select("brain_id", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("fiber_id").alias("other_id"), F.col("salience").alias("s"), F.col("t").alias("u"))
    pair = f.join(near, ["brain_id", "b"]).where((F.col("fiber_id") != F.col("other_id")) & (F.abs(F.col("t") - F.col("u")) <= width))
    rank = F.row_number().over(Window.partitionBy("fiber_id").orderBy(F.desc("s"), "other_id"))
    kind = F.when(F.col("u") < F.col("t"), "after").when(F.col("u") > F.col("t"), "before").otherwise("related_to")
    return pair.withColumn("r", rank).where(F.col("r") <= k).select("fiber_id", "other_id", kind.alias("type"))


def latest_before(left: DataFrame, right: DataFrame, *, by: str, at: str, key: str) -> DataFrame:
    """As-of join: for each left row the latest right row of its group not after it, ``(key, right_key)``.

    Both sides are cut into days.  Within a day one window finds the latest right row; what
    came on earlier days is one row a day, so a group of any size is many units of work.
    """
    both = left.select(by, F.col(at).alias("t"), F.lit(1).alias("side"), F.col(key).alias("k")).unionByName(right.select(by, F.col(at).alias("t"), F.lit(0).alias("side"), F.col(key).alias("k")))
    both = both.where("t IS NOT NULL").withColumn("day", F.to_date("t"))
    w = Window.partitionBy(by, "day").orderBy("t", "side", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("near", F.last(F.when(F.col("side") == 0, F.col("k")), ignorenulls=True).over(w)).where("side = 1")
    days = both.groupBy(by, "day").agg(F.max(F.when(F.col("side") == 0, F.struct("t", "k"))).alias("last"))
    before = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(by), "day", F.last("last", ignorenulls=True).over(before).alias("last"))
    joined = inside.alias("i").join(days.alias("d"), F.col(f"i.{by}").eqNullSafe(F.col(f"d.{by}")) & (F.col("i.day") == F.col("d.day")))
    return joined.select(F.col("i.k").alias(key), F.coalesce("i.near", "d.last.k").alias("right_key"))


def ema(events: DataFrame, *, alpha: float = 0.3, least: float = 0.01) -> DataFrame:
    """``(session, action, score)``: exponential average of each action's hits over a session's events, in closed form.

    Hits more than 64 events back add less than the rounding, so a session's last 64 events
    are enough; they are picked before the shuffle.
    """
    w = Window.partitionBy("session").orderBy(F.desc("at"), F.desc("event_id"))
    back = events.withColumn("k", F.row_number().over(w)).where(F.col("k") <= 64)
    score = F.sum(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("k") - 1))
    return back.groupBy("session", "action").agg(F.round(score, 6).alias("score")).where(F.col("score") >= least)


def sessions(events: DataFrame, *, gap: str = "2 hours") -> DataFrame:
    """Session windows of each user: start, end, events."""
    timed = events.where("at IS NOT NULL").withColumn("at", F.col("at").cast("timestamp"))
    out = timed.groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("session", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def stage(age_hours, rehearsals, days):
    """Maturation stage by age, rehearsals and distinct days."""
    return F.when(age_hours < 0.5, "stm").when(age_hours < 4.5, "working").when((age_hours >= 172.5) & ((days >= 3) | (rehearsals >= 15)), "semantic").otherwise("episodic")


def next_review(box, success):
    """``struct(box, days)`` of the next review."""
    up = F.when(success, F.least(F.lit(5), box + 1)).otherwise(F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in BOXES.items() for x in kv])
    return F.struct(up.alias("box"), F.element_at(table, up).alias("days"))
