"""Memory-level operators: beliefs and conflicts, trust, priming, routing, review, assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.functions import text as T
from engramlake.operators.graph import components
from engramlake.operators.scans import tags_of, top

# Words of sentiment, markers of question kinds, default trust by type.
POSITIVE = (
    "good great excellent amazing awesome wonderful fantastic perfect nice love loved like liked enjoy enjoyed happy glad pleased proud thankful grateful excited success successful succeeded win won works working fixed "
    "solved resolved improved improvement better best easy simple clean fast faster reliable stable robust helpful useful elegant promising impressive efficient smooth safe secure clear confident satisfied recommend beautiful brilliant"
).split()
NEGATIVE = (
    "bad terrible awful horrible worst worse poor hate hated dislike angry annoyed annoying frustrated frustrating sad disappointed disappointing upset worried afraid confused confusing fail failed fails failure broken bug buggy "
    "crash crashed error errors problem problems issue issues wrong slow slower difficult hard complex ugly messy unreliable unstable brittle fragile useless painful costly risky unsafe insecure blocked stuck stale noisy regret lost"
).split()
ROUTES = (("causal", r"\b(why|because|cause[sd]?|reason)\b"), ("temporal", r"\b(when|before|after|yesterday|today|last|during)\b"), ("comparison", r"\b(vs\.?|versus|compare|better|than)\b"), ("lookup", r"\b(what|who|where|which)\b"))
TRUST = {"decision": 0.9, "instruction": 0.9, "fact": 0.7, "reference": 0.8, "tool": 0.6, "context": 0.5}
#: Words that stand for each other, one group a line; the first of a pair of an abbreviation is short.
SYNONYMS = [
    group.split()
    for group in (
        "cost expense spending price", "revenue income earnings sales", "error bug issue failure fault defect", "auth authentication authorization login", "deploy deployment release rollout", "config cfg configuration settings preferences",
        "database db datastore", "api endpoint route interface", "test testing spec check", "perf performance speed latency", "user account profile", "log logging logger journal", "cache caching buffer", "retry retries backoff",
        "queue job task worker", "memory mem recall", "index idx lookup", "repo repository", "doc docs document documentation", "graph network", "merge combine join", "delete remove drop purge", "search find query", "plan schedule roadmap",
    )
]
#: Times a text names: pattern, unit, first and last (open) unit from the day, week, month or year of the text.
TIMES = (
    (r"\bday before yesterday\b", "day", -2, -1), (r"\bday after tomorrow\b", "day", 2, 3), (r"\byesterday\b|\blast night\b", "day", -1, 0), (r"\b(today|tonight|this (morning|afternoon|evening))\b", "day", 0, 1), (r"\btomorrow\b", "day", 1, 2),
    (r"\blast week\b", "day", -7, 0), (r"\bnext week\b", "day", 7, 14), (r"\bthis week\b", "week", 0, 1), (r"\bthird week\b", "day", -21, 0), (r"\blast month\b", "month", -1, 0), (r"\bthis month\b", "month", 0, 1), (r"\bnext month\b", "month", 1, 2),
    (r"\blast quarter\b", "quarter", -1, 0), (r"\bthis quarter\b", "quarter", 0, 1), (r"\blast year\b", "year", -1, 0), (r"\bthis year\b", "year", 0, 1), (r"\bnext year\b", "year", 1, 2), (r"\b(recently|lately|the other day)\b", "day", -7, 1),
)
#: How a decision is put: the pattern, the groups of its subject and of its value.
DECISIONS = (
    (r"(?i)\b(?:decision|choice|verdict|plan)\s+(?:on|for|about|regarding)\s+([\p{L}][\p{L}\p{N}_-]*)\s+(?:was|is|were|remains)\s+([\p{L}\p{N}_-]+)", 1, 2),
    (r"(?i)\b(?:decided|agreed|chose|opted)\s+(?:to\s+use|to\s+keep|on|for)\s+([\p{L}\p{N}_-]+)\s+(?:for|as|in)\s+([\p{L}][\p{L}\p{N}_-]*)", 2, 1),
    (r"(?i)\b(?:use|using|keep|kept|pin|pinned)\s+([\p{L}\p{N}_.-]+)\s+instead\s+of\s+([\p{L}][\p{L}\p{N}_-]*)", 2, 1),
)


def route(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, pattern in ROUTES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("associative")


def depth(text: Column) -> Column:
    """Search depth of a question: 0 instant, 1 context, 2 habit, 3 deep."""
    kind = route(text)
    return F.when(kind == "causal", 3).when(text.rlike(r"(?i)\b(usually|always|habit|pattern)\b"), 2).when(kind.isin("temporal", "comparison"), 1).otherwise(F.when(S.word_count(text) > 12, 1).otherwise(0))


def hops(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in {0: 1, 1: 3, 2: 4, 3: 4}.items() for x in kv]), level)


def sentiment(text: Column) -> Column:
    """``(positive - negative) / (positive + negative)`` of lexicon words, 0 without any."""
    w = T.words(text)
    p, n = F.size(F.filter(w, lambda x: x.isin(POSITIVE))), F.size(F.filter(w, lambda x: x.isin(NEGATIVE)))
    return F.when(p + n == 0, 0.0).otherwise((p - n) / (p + n))


def expand_terms(words: Column) -> Column:
    """Words and those of their groups of synonyms, distinct."""
    table = F.create_map(*[x for group in SYNONYMS for w in group for x in (F.lit(w), F.array(*map(F.lit, group)))])
    known = F.array_compact(F.transform(words, lambda w: F.element_at(table, w)))
    return F.array_distinct(F.concat(words, F.flatten(known)))


def time_range(text: Column, at: Column) -> Column:
    """``struct(start, end)`` of the first of ``TIMES`` that a text names, or of "N days ago"; null without one."""
    low = F.lower(text)
    unit = lambda name: F.date_trunc(name, at).cast("timestamp_ntz")

    def moved(name: str, n: int) -> Column:
        if name in ("day", "week"):
            return unit(name) + F.make_dt_interval(days=F.lit(n * (7 if name == "week" else 1)))
        return unit(name) + F.make_ym_interval(months=F.lit(n * {"month": 1, "quarter": 3, "year": 12}[name]))

    back = F.regexp_extract(low, r"\b(\d{1,3}) days? ago\b", 1)
    past = unit("day") - F.make_dt_interval(days=back.try_cast("int"))
    out = F.when(back != "", F.struct(past.alias("start"), (past + F.make_dt_interval(days=F.lit(1))).alias("end")))
    for pattern, name, a, b in TIMES:
        out = out.when(low.rlike(pattern), F.struct(moved(name, a).alias("start"), moved(name, b).alias("end")))
    return out


def citation(source: Column, created: Column, doc: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(source, F.lit("unknown")), F.lit(", "), F.coalesce(F.date_format(created, "yyyy-MM-dd"), F.lit("n.d.")), F.lit(", #"), doc.cast("string"), F.lit("]"))


def trust(own: Column, kind: Column) -> Column:
    """A memory's own trust, else its type's, else one half."""
    table = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    return F.coalesce(own, F.element_at(table, kind), F.lit(0.5))


def decisions(docs: DataFrame) -> DataFrame:
    """``(doc_id, subject, value, created_at)`` of the stated decisions of every text, by the patterns of ``DECISIONS``.

    Subject and value in lower case; a text may state several.
    """


    def stated(pattern: str, subject: int, value: int) -> Column:
        part = lambda m, i: F.lower(F.regexp_extract(m, pattern, i))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.struct(part(m, subject).alias("subject"), part(m, value).alias("value")))

    found = [stated(*d) for d in DECISIONS]
    return docs.where("text IS NOT NULL").select("doc_id", "created_at", F.explode(F.array_distinct(F.concat(*found))).alias("d")).select("doc_id", "created_at", "d.subject", "d.value")


def conflicts(claims: DataFrame) -> DataFrame:
    """``(subject, values, claims)``: subjects about which different values were stated."""
    return claims.groupBy("subject").agg(F.countDistinct("value").alias("values"), F.count("*").alias("claims")).where("values > 1")


def resolve(claims: DataFrame) -> DataFrame:
    """``(doc_id, standing)``: the newest claim of a disputed subject holds, others are superseded.

    The newest is found by an aggregate, so a subject of any size is no single task.
    """
    last = claims.groupBy("subject").agg(F.max(F.struct("created_at", "doc_id")).alias("m"), F.countDistinct("value").alias("values"))
    both = claims.join(last, "subject")
    return both.select("doc_id", F.when(F.col("values") == 1, "agreed").when(F.col("doc_id") == F.col("m.doc_id"), "holds").otherwise("superseded").alias("standing"))


def auto_resolution(confidence: Column, existing_days: Column, new_hours: Column, longer: Column, superseded: Column) -> Column:
    """Ordered rules of what to do with a conflict."""
    return F.when(existing_days.isNull(), "keep_new").when((confidence >= 0.8) & (existing_days >= 90), "keep_new").when((new_hours < 1) & longer, "keep_new").when(superseded >= 2, "keep_new").otherwise("manual")


def prime(boosts: DataFrame, *, least: float = 0.05) -> DataFrame:
    """``(session, neuron_id, boost)``: the highest boost of any source, decayed by 0.7 a query.

    ``boosts(session, neuron_id, level, age)``.
    """
    level = F.col("level") * F.pow(F.lit(0.7), F.col("age"))
    return boosts.groupBy("session", "neuron_id").agg(F.round(F.max(level), 9).alias("boost")).where(F.col("boost") >= least)


def depth_priors(outcomes: DataFrame) -> DataFrame:
    """``(arm, mean, trials)`` of Beta-Bernoulli arms from ``(arm, success)``."""
    a, n = F.count_if("success") + 1, F.count("*")
    return outcomes.groupBy("arm").agg(F.round(a / (n + 2), 6).alias("mean"), n.alias("trials"))


def allocate(items: DataFrame, *, total: int, least: int = 20) -> DataFrame:
    """``(group, id, budget)``: tokens in proportion to scores, at least ``least`` each."""
    s = items.groupBy("group").agg(F.sum("score").alias("s"))
    share = F.when(F.col("s") > 0, F.floor(F.col("score") / F.col("s") * total)).otherwise(0)
    return items.join(s, "group").select("group", "id", F.greatest(F.lit(least), share).cast("int").alias("budget"))


def hot_index(items: DataFrame, *, slots: int = 20) -> DataFrame:
    """The best scored items of each group with a shortened summary."""
    return top(items.select("group", "id", "score", F.substring("summary", 1, 80).alias("summary")), ["group"], [F.desc("score"), "id"], slots)


def recent_cooccurrence(fibers: DataFrame, *, seconds: int = 300, k: int = 3) -> DataFrame:
    """``(fiber_id, other_id, weight)``: the ``k`` most salient fibers of the brain that ran shortly before.

    The window is cut into blocks of its own width, so the join is on equal keys.
    """
    w = seconds * 1_000_000
    f = fibers.where("time_start IS NOT NULL AND time_end IS NOT NULL").select("brain_id", F.col("id").alias("fiber_id"), F.unix_micros(F.col("time_start").cast("timestamp")).alias("t"))
    past = fibers.where("time_end IS NOT NULL").select("brain_id", F.col("id").alias("other_id"), F.coalesce("salience", F.lit(0.0)).alias("s"), F.unix_micros(F.col("time_end").cast("timestamp")).alias("u"))
    left = f.withColumn("b", F.explode(F.array(F.floor(F.col("t") / w), F.floor(F.col("t") / w) - 1)))
    pair = left.join(past.withColumn("b", F.floor(F.col("u") / w)), ["brain_id", "b"]).where((F.col("fiber_id") != F.col("other_id")) & (F.col("u") <= F.col("t")) & (F.col("u") >= F.col("t") - w))
    near = top(pair, ["fiber_id"], [F.desc("s"), "other_id"], k)
    return near.select("fiber_id", "other_id", F.round(F.greatest(F.lit(0.1), 0.4 * (1 - (F.col("t") - F.col("u")) / w)), 6).alias("weight"))


def tag_drift(fibers: DataFrame, seen: DataFrame, *, limit: float = 0.6) -> DataFrame:
    """``(fiber_id, drift)``: fibers whose tags moved away from those of the recall that met them.

    ``seen(fiber_id, tags)``.
    """
    both = fibers.select(F.col("id").alias("fiber_id"), F.array_distinct(F.array_compact(tags_of(fibers))).alias("own")).join(seen, "fiber_id")
    drift = 1 - S.jaccard(F.col("own"), F.array_distinct(F.array_compact("tags")))
    return both.select("fiber_id", F.round(drift, 6).alias("drift")).where(F.col("drift") > limit)


def cluster_tags(pairs: DataFrame, neurons: DataFrame) -> DataFrame:
    """``(component, tag, size)``: groups of co-active neurons named by the most frequent word of their contents."""
    group = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    size = group.groupBy("component").agg(F.count("*").alias("size")).where("size >= 2")
    word = group.join(neurons.select(F.col("id").alias("node"), F.explode(F.array_distinct(T.words(F.col("content")))).alias("tag")), "node").groupBy("component", "tag").agg(F.count("*").alias("n"))
    best = word.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "tag")).alias("m"))
    return best.join(size, "component").select("component", F.col("m.tag").alias("tag"), "size")


def across_brains(neurons: DataFrame, brains: list[str] | None = None) -> DataFrame:
    """One neuron for each content over all or some brains: the highest priority, then the smallest id."""
    rows = neurons.where(F.trim("content") != "")
    rows = rows if brains is None else rows.where(F.col("brain_id").isin(brains))
    best = F.min(F.struct((-F.coalesce("metadata.priority", F.lit(0))).alias("p"), "id", "brain_id")).alias("m")
    return rows.groupBy(F.lower(F.trim("content")).alias("text")).agg(best, F.countDistinct("brain_id").alias("brains")).select("text", "m.id", "m.brain_id", "brains")


def answer_method(active: DataFrame) -> DataFrame:
    """``(query_id, method, node, score)``: how a recall is answered, by its best node.

    ``active(query_id, node, level, crossed boolean)``; nodes that several retrievers
    reached count half as much again.
    """
    score = F.least(F.lit(1.0), F.col("level") * F.when(F.col("crossed"), 1.5).otherwise(1.0))
    best = active.groupBy("query_id").agg(F.max(F.struct(score.alias("score"), "node")).alias("m"), F.count("*").alias("n"))
    method = F.when(F.col("m.score") > 0.8, "single").when(F.col("n") > 5, "summary").otherwise("several")
    return best.select("query_id", method.alias("method"), F.col("m.node").alias("node"), F.round("m.score", 6).alias("score"))


def chunk_active(active: DataFrame, edges: DataFrame, *, chunks: int = 5, size: int = 4) -> DataFrame:
    """``(query_id, chunk, node)``: greedy groups around the most active nodes of a query.

    The active set of a query is bounded by its recall (at most 50 nodes are grouped).
    """
    best = top(active, ["query_id"], [F.desc("level"), "node"], 50).select("query_id", "node", "level")
    inside = best.select("query_id", F.col("node").alias("a")).join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), "a").join(best.select("query_id", F.col("node").alias("b")), ["query_id", "b"])
    near = inside.groupBy("query_id", "a").agg(F.collect_list(F.struct("b", "weight")).alias("near"))  # at most 50 nodes
    rows = best.join(near.withColumnRenamed("a", "node"), ["query_id", "node"], "left")

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["level", "node"], ascending=[False, True])
        links = {n: [] if x is None else sorted(((y["weight"], y["b"]) for y in x), key=lambda p: (-p[0], p[1])) for n, x in zip(frame["node"], frame["near"])}
        taken, out = set(), []
        for node in frame["node"]:
            if node in taken or len(out) == chunks:
                continue
            mine = [node]
            taken.add(node)
            for _, other in links[node]:
                if len(mine) < size and other not in taken:
                    mine.append(other)
                    taken.add(other)
            out.append(mine)
        return pd.DataFrame([(frame["query_id"].iloc[0], i, n) for i, c in enumerate(out) for n in c], columns=["query_id", "chunk", "node"])

    kind = dict(active.dtypes)["query_id"]
    return rows.groupBy("query_id").applyInPandas(group, f"query_id {kind}, chunk int, node string")


def episodic_blocker(age_hours: Column, days: Column) -> Column:
    return F.when(age_hours < 168, "time_gate").when(days < 3, "spacing_gate").otherwise("ready")


def tool_success(events: DataFrame, *, least: int = 3) -> DataFrame:
    """``(tool, context, n, rate)``: tools that work in a context."""
    return events.groupBy("tool", "context").agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate")).where(F.col("n") >= least)


def follow_ups(sessions: DataFrame, *, window_s: float = 600.0, least: int = 3) -> DataFrame:
    """``(a, b, n)``: words of consecutive questions of a session at most ``window_s`` apart.

    ``sessions(session, at, event_id, topics array<string>)``; bounded topics a question.
    """
    w = Window.partitionBy("session", F.to_date("at")).orderBy("at", "event_id")
    step = sessions.where("at IS NOT NULL").select("topics", "at", F.lead("topics").over(w).alias("then"), F.lead("at").over(w).alias("u"))
    gap = (F.unix_micros(F.col("u").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 1e6
    pair = step.where(F.col("then").isNotNull() & (gap <= window_s)).select(F.explode("topics").alias("a"), "then").select("a", F.explode("then").alias("b")).where("a <> b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
