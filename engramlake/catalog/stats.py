"""Aggregations, health, sequences, sessions and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, age, fiber_tags, members, now, sql_tokens
from engramlake.operators import memory as B
from engramlake.operators import scans as O
from engramlake.operators import sequences as Q
from engramlake.operators import stats as A

C = Catalog()
_A = "greatest(0.0, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us({})) / 86400e6)"

C.add("stats_summary", lambda t: A.graph_summary(t.neurons, t.synapses, t.fibers),
      "{n, e, f} SELECT * FROM (SELECT count(*) AS neurons, count(*) FILTER (WHERE metadata.is_anchor) AS anchors FROM n) CROSS JOIN (SELECT count(*) AS synapses, round(avg(weight), 6) AS mean_weight FROM e) CROSS JOIN (SELECT count(*) AS fibers, min(created_at) AS first_fiber, max(created_at) AS last_fiber FROM f)")
C.add("stats_edge_types", lambda t: A.edge_type_stats(t.synapses), "{e} SELECT type, count(*) AS n, round(avg(weight), 4) AS mean_weight, sum(reinforced_count)::BIGINT AS reinforced FROM e GROUP BY 1")
C.add("stats_neuron_types", lambda t: t.neurons.groupBy("type").agg(F.count("*").alias("n")), "{n} SELECT type, count(*) AS n FROM n GROUP BY 1")
C.add("stats_density", lambda t: t.synapses.groupBy("brain_id").agg(F.count("*").alias("e")).join(t.neurons.groupBy("brain_id").agg(F.count("*").alias("n")), "brain_id").select("brain_id", F.round(F.col("e") / F.col("n"), 6).alias("density")),
      "{n, e} SELECT brain_id, round(a.k / b.k, 6) AS density FROM (SELECT brain_id, count(*) AS k FROM e GROUP BY 1) a JOIN (SELECT brain_id, count(*) AS k FROM n GROUP BY 1) b USING (brain_id)")
C.add("stats_connected", lambda t: t.raw("synapses").where("id IS NOT NULL").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "{e} SELECT source_id AS id FROM e UNION SELECT target_id FROM e")
C.add("stats_target_counts", lambda t: t.raw("synapses").where("id IS NOT NULL").groupBy("source_id").agg(F.countDistinct("target_id").alias("targets")), "{e} SELECT source_id, count(DISTINCT target_id) AS targets FROM e GROUP BY 1")
C.add("stats_activated", lambda t: t.states.agg(F.count_if(F.col("access_frequency") > 0).alias("activated")), "{st} SELECT count(*) FILTER (WHERE access_frequency > 0) AS activated FROM st")
C.add("stats_top_states", lambda t: t.states.orderBy(F.desc("access_frequency"), "neuron_id").limit(10).select("neuron_id", "access_frequency"), "{st} SELECT neuron_id, access_frequency FROM st ORDER BY access_frequency DESC, neuron_id LIMIT 10")
C.add("stats_fiber_health", lambda t: t.fibers.groupBy("brain_id").agg(F.count("*").alias("fibers"), F.count_if(age() > 90).alias("stale"), F.count_if(F.coalesce("last_conducted", "created_at") >= F.lit("2025-12-01").cast("timestamp_ntz")).alias("fresh"), F.count_if("pinned").alias("pinned")),
      f"{{f}} SELECT brain_id, count(*) AS fibers, count(*) FILTER (WHERE {_A.format('created_at')} > 90) AS stale, count(*) FILTER (WHERE coalesce(last_conducted, created_at) >= '2025-12-01') AS fresh, count(*) FILTER (WHERE pinned) AS pinned FROM f GROUP BY 1")
_CO = "FROM co WHERE neuron_a IS NOT NULL AND neuron_b IS NOT NULL AND neuron_a <> neuron_b"
C.add("stats_co_activation", lambda t: A.co_activation_counts(t.co_activations, least=3), f"{{co}} SELECT least(neuron_a, neuron_b) AS a, greatest(neuron_a, neuron_b) AS b, count(*) AS n, round(avg(binding_strength), 6) AS strength {_CO} GROUP BY 1, 2 HAVING count(*) >= 3")
C.add("stats_co_activation_window", lambda t: A.co_activation_counts(t.co_activations, since="2025-06-01", until="2025-09-01", least=2),
      f"{{co}} SELECT least(neuron_a, neuron_b) AS a, greatest(neuron_a, neuron_b) AS b, count(*) AS n, round(avg(binding_strength), 6) AS strength {_CO} AND created_at > '2025-06-01' AND created_at <= '2025-09-01' GROUP BY 1, 2 HAVING count(*) >= 2")
C.add("stats_tool", lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 0).cast("int")), 2).alias("success"), F.round(F.avg("value"), 4).alias("mean_value")).orderBy(F.desc("n"), "event_type").limit(20),
      "SELECT event_type, count(*) AS n, round(avg((value > 0)::INT), 2) AS success, round(avg(value), 4) AS mean_value FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 20")
C.add("stats_tool_by_day", lambda t: t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).orderBy(F.desc("day"), F.desc("n"), "event_type").limit(50),
      "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY 1 DESC, 3 DESC, 2 LIMIT 50")
C.add("stats_keyword_df", lambda t: _df(t), f"{{n}} SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest({sql_tokens('content')}) AS word FROM n) GROUP BY 1 HAVING count(*) >= 2")


def _df(t):
    from engramlake.functions.scalar import search_tokens

    return t.neurons.select("id", F.explode(F.array_distinct(search_tokens(F.col("content")))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df >= 2")


C.add("stats_tag_cooccurrence", lambda t: A.tag_cooccurrence(fiber_tags(t.fibers)), "{ft} SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM ft x JOIN ft y ON x.fiber_id = y.fiber_id AND x.tag < y.tag GROUP BY 1, 2 HAVING count(*) >= 2")
C.add("stats_tag_counts", lambda t: fiber_tags(t.fibers).groupBy("tag").agg(F.count("*").alias("fibers")), "{ft} SELECT tag, count(*) AS fibers FROM ft GROUP BY 1")
C.add("stats_orphans", lambda t: A.orphans(t.neurons, t.raw("synapses"), members(t.raw("fibers"))).select("id"),
      "{n, e, fm} SELECT id FROM n WHERE id NOT IN (SELECT source_id FROM e WHERE source_id IS NOT NULL UNION SELECT target_id FROM e WHERE target_id IS NOT NULL UNION SELECT neuron_id FROM fm)")
C.add("stats_health", lambda t: A.health(t.neurons, t.synapses, members(t.fibers), t.fibers, t.states, now=NOW), f"""{{st, fm}} WITH a AS (SELECT brain_id, count(*) AS n FROM n GROUP BY 1),
 b AS (SELECT brain_id, count(*) AS e, count(*) FILTER (WHERE lower(type) NOT IN {A.STRUCTURAL}) AS org, count(*) FILTER (WHERE lower(type) = 'contradicts') AS con, avg(weight) AS w FROM e GROUP BY 1),
 k AS (SELECT brain_id, type, count(*) AS k FROM e GROUP BY 1, 2), d AS (SELECT brain_id, -sum(k / b.e * ln(k / b.e)) / ln(8) AS d FROM k JOIN b USING (brain_id) GROUP BY 1),
 og AS (SELECT *, {_A.format('created_at')} * 24 AS h, coalesce(frequency, 0) AS fr FROM f WHERE NOT list_contains(list_concat(coalesce(auto_tags, []), coalesce(agent_tags, [])), 'code_index')),
 fr AS (SELECT brain_id, avg(({_A.format('coalesce(last_conducted, created_at)')} <= 7)::INT) AS fresh, avg((h >= 172.5 AND (fr / 2 >= 3 OR fr >= 15))::INT) AS sem FROM og GROUP BY 1),
 lo AS (SELECT brain_id, count(*) AS lone FROM n WHERE id NOT IN (SELECT source_id FROM e WHERE source_id IS NOT NULL UNION SELECT target_id FROM e WHERE target_id IS NOT NULL UNION SELECT neuron_id FROM fm) GROUP BY 1),
 ef AS (SELECT brain_id, avg((access_frequency > 0)::INT) AS eff FROM n JOIN st ON neuron_id = id GROUP BY 1),
 m AS (SELECT brain_id, 1 / (1 + exp(-1.5 * (coalesce(org, 0) / n - 3))) AS c, least(1.0, coalesce(d, 0)) AS d, coalesce(fresh, 0) AS fresh, coalesce(sem, 0) AS sem, coalesce(lone, 0) / n AS o, coalesce(eff, 0) AS eff, coalesce(w, 0) AS w, least(10.0, 50 * coalesce(con, 0) / n) AS pen
 FROM a JOIN fr USING (brain_id) LEFT JOIN b USING (brain_id) LEFT JOIN d USING (brain_id) LEFT JOIN lo USING (brain_id) LEFT JOIN ef USING (brain_id)),
 s AS (SELECT *, greatest(0.0, 100 * (0.25 * c + 0.20 * d + 0.15 * fresh + 0.15 * sem + 0.10 * (1 - o) + 0.10 * eff + 0.05 * greatest(0, least(1, w))) - pen) AS s FROM m)
 SELECT brain_id, round(c, 6) AS connectivity, round(d, 6) AS diversity, round(fresh, 6) AS freshness, round(sem, 6) AS consolidation, round(o, 6) AS orphan_rate, round(pen, 6) AS penalty, round(s, 4) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS grade FROM s""")
C.add("stats_evolution", lambda t: A.evolution(t.neurons, t.synapses, t.fibers, now=NOW), f"""{{n, e, f}} WITH p AS (SELECT brain_id, avg((coalesce({_A.format('created_at')} <= 7 AND created_at IS NOT NULL, false) OR coalesce({_A.format('last_activated')} <= 7 AND last_activated IS NOT NULL, false))::INT) AS plasticity FROM e GROUP BY 1),
 a AS (SELECT brain_id, avg(coalesce({_A.format('last_conducted')} <= 7 AND last_conducted IS NOT NULL, false)::INT) AS activity, 1 / (1 + exp(0.1 * ({_A.format('max(coalesce(last_conducted, created_at))')} - 30))) AS decay FROM f GROUP BY 1)
 SELECT brain_id, round(plasticity, 6) AS plasticity, round(activity, 6) AS activity, round(decay, 6) AS decay FROM (SELECT DISTINCT brain_id FROM n) LEFT JOIN p USING (brain_id) LEFT JOIN a USING (brain_id)""")
C.add("stats_freshness", lambda t: _fresh(t), f"SELECT CASE WHEN a < 7 THEN 'fresh' WHEN a < 30 THEN 'recent' WHEN a < 90 THEN 'aging' WHEN a < 365 THEN 'stale' ELSE 'ancient' END AS bucket, count(*) AS n FROM (SELECT {_A.format('created_at')} AS a FROM documents) GROUP BY 1")


def _fresh(t):
    from engramlake.functions.scalar import freshness_bucket

    return t.documents.groupBy(freshness_bucket(age()).alias("bucket")).agg(F.count("*").alias("n"))


_TM = "tm AS (SELECT brain_id, coalesce(map {" + ", ".join(f"'{k}': {v}" for k, v in B.TRUST.items()) + "}[memory_type], 0.5) AS trust, created_at + to_days(CASE memory_type WHEN 'todo' THEN 30 WHEN 'context' THEN 7 WHEN 'error' THEN 90 END) AS expires_at FROM documents)"
C.add("stats_uncertainty", lambda t: A.uncertainty(t.synapses, t.neurons, O.typed_memories(t.documents).join(t.documents.select("doc_id", B.trust(F.lit(None).cast("double"), F.col("memory_type")).alias("trust")), "doc_id"), now=NOW),
      f"""{{n, e}} WITH {_TM}, a AS (SELECT brain_id, count(*) AS contradictions FROM e WHERE type = 'contradicts' GROUP BY 1), b AS (SELECT brain_id, count(*) FILTER (WHERE trust <= 0.4) AS low_evidence, count(*) FILTER (WHERE expires_at > '{NOW}' AND expires_at <= TIMESTAMP '{NOW}' + INTERVAL 14 DAY) AS expiring FROM tm GROUP BY 1),
 c AS (SELECT brain_id, count(*) FILTER (WHERE metadata.superseded) AS superseded FROM n GROUP BY 1), g AS (SELECT brain_id, lower(tag) AS t, count(DISTINCT tag) AS k FROM (SELECT brain_id, unnest(metadata.tags) AS tag FROM n) WHERE tag IS NOT NULL GROUP BY 1, 2), d AS (SELECT brain_id, count(*) FILTER (WHERE k > 1) AS drift FROM g GROUP BY 1),
 r AS (SELECT brain_id, coalesce(contradictions, 0) AS contradictions, coalesce(low_evidence, 0) AS low_evidence, superseded, coalesce(expiring, 0) AS expiring, coalesce(drift, 0) AS drift FROM c LEFT JOIN a USING (brain_id) LEFT JOIN b USING (brain_id) LEFT JOIN d USING (brain_id))
 SELECT *, CASE WHEN contradictions > 0 OR low_evidence > 0 THEN 'high' WHEN superseded > 0 OR expiring > 0 OR drift > 0 THEN 'medium' ELSE 'low' END AS level FROM r""")
C.add("stats_calibration", lambda t: t.events.agg(F.count_if(F.col("value") > 50).alias("correct"), F.count_if(F.col("value") <= 50).alias("wrong"), F.round(F.coalesce(F.count_if(F.col("value") > 50) / F.count("value"), F.lit(0.5)), 6).alias("score")),
      "SELECT count(*) FILTER (WHERE value > 50) AS correct, count(*) FILTER (WHERE value <= 50) AS wrong, round(coalesce(count(*) FILTER (WHERE value > 50) / count(value), 0.5), 6) AS score FROM events")
C.add("stats_extrapolate", lambda t: A.extrapolate(t.events.groupBy(F.col("event_type").alias("group"), F.month("ts").alias("step")).agg(F.array(F.avg("value"), F.count("*").cast("double")).alias("values"))))


def _events(t):
    return t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("action"), F.col("ts").alias("at"), "event_id")


_EV = "ev AS (SELECT user_id AS session, event_type AS action, ts AS tm, event_id FROM events)"
_NX = _EV + ", nx AS (SELECT action, tm, lead(action) OVER w AS nxt, lead(tm) OVER w AS nat FROM ev WINDOW w AS (PARTITION BY session ORDER BY tm, event_id)), sp AS (SELECT action AS a, nxt AS b, count(*) AS n, round(sum(epoch_us(nat) - epoch_us(tm))::DOUBLE / count(*) / 1e6, 6) AS mean_gap FROM nx WHERE nxt IS NOT NULL AND (epoch_us(nat) - epoch_us(tm)) / 1e6 <= 86400 GROUP BY 1, 2)"
C.add("seq_pairs", lambda t: Q.sequential_pairs(_events(t), window_s=86400), f"WITH {_NX} SELECT * FROM sp")
C.add("seq_habits", lambda t: Q.habits(Q.sequential_pairs(_events(t), window_s=86400), least=3, sessions=100),
      f"WITH {_NX}, p AS (SELECT a, b, n FROM sp WHERE n >= 3) SELECT [a, b] AS steps, n, round(n / 100, 6) AS confidence FROM p UNION ALL SELECT [x.a, x.b, y.b], least(x.n, y.n), round(least(x.n, y.n) / 100, 6) FROM p x JOIN p y ON x.b = y.a AND y.b <> x.a")
C.add("seq_next_action", lambda t: Q.sequential_pairs(_events(t), window_s=86400).where("n >= 5").select("a", "b", "n"), f"WITH {_NX} SELECT a, b, n FROM sp WHERE n >= 5")
C.add("seq_tool_pairs", lambda t: Q.tool_pairs(_events(t), window_s=3600), f"WITH {_EV} SELECT least(x.action, y.action) AS a, greatest(x.action, y.action) AS b, count(*) AS n FROM ev x JOIN ev y ON x.session = y.session AND x.action < y.action AND abs(epoch_us(x.tm) - epoch_us(y.tm)) <= 3600e6 GROUP BY 1, 2")
C.add("seq_temporal_links", lambda t: Q.temporal_links(t.fibers), """{f} WITH g AS (SELECT brain_id, id, coalesce(salience, 0) AS s, epoch_us(time_start) AS t FROM f WHERE time_start IS NOT NULL)
 SELECT fiber_id, other_id, type FROM (SELECT x.id AS fiber_id, y.id AS other_id, CASE WHEN y.t < x.t THEN 'after' WHEN y.t > x.t THEN 'before' ELSE 'related_to' END AS type, row_number() OVER (PARTITION BY x.id ORDER BY y.s DESC, y.id) AS r FROM g x JOIN g y ON x.brain_id = y.brain_id AND x.id <> y.id AND abs(x.t - y.t) <= 86400e6) WHERE r <= 5""")
C.add("seq_asof", lambda t: Q.latest_before(t.neurons.select("brain_id", "created_at", "id"), t.fibers.select("brain_id", "created_at", "id"), by="brain_id", at="created_at", key="id"),
      "{n, f} SELECT n.id, (SELECT g.id FROM f g WHERE g.brain_id = n.brain_id AND g.created_at <= n.created_at ORDER BY g.created_at DESC, g.id DESC LIMIT 1) AS right_key FROM n WHERE n.created_at IS NOT NULL")
C.add("seq_ema", lambda t: Q.ema(_events(t)), f"WITH {_EV}, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tm DESC, event_id DESC) - 1 AS k FROM ev) SELECT session, action, round(sum(0.3 * pow(0.7, k)), 6) AS score FROM b GROUP BY 1, 2 HAVING round(sum(0.3 * pow(0.7, k)), 6) >= 0.01")
C.add("seq_sessions", lambda t: Q.sessions(_events(t), gap="24 hours"), f"""WITH {_EV}, g AS (SELECT *, CASE WHEN epoch_us(tm) - epoch_us(lag(tm) OVER w) < 86400e6 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session ORDER BY tm, event_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT session, min(tm) AS start, max(tm) + INTERVAL 24 HOUR AS "end", count(*) AS n FROM s GROUP BY session, no""")
C.add("seq_tumbling", lambda t: t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"),
      "SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1")
C.add("seq_stage", lambda t: t.fibers.select("id", Q.stage(age() * 24, F.coalesce("frequency", F.lit(0)), F.coalesce("frequency", F.lit(0)) / 2).alias("stage")),
      f"{{f}} SELECT id, CASE WHEN h < 0.5 THEN 'stm' WHEN h < 4.5 THEN 'working' WHEN h >= 172.5 AND (fr / 2 >= 3 OR fr >= 15) THEN 'semantic' ELSE 'episodic' END AS stage FROM (SELECT id, {_A.format('created_at')} * 24 AS h, coalesce(frequency, 0) AS fr FROM f)")
C.add("seq_stage_counts", lambda t: t.fibers.groupBy(Q.stage(age() * 24, F.coalesce("frequency", F.lit(0)), F.coalesce("frequency", F.lit(0)) / 2).alias("stage")).agg(F.count("*").alias("n")),
      f"{{f}} SELECT CASE WHEN h < 0.5 THEN 'stm' WHEN h < 4.5 THEN 'working' WHEN h >= 172.5 AND (fr / 2 >= 3 OR fr >= 15) THEN 'semantic' ELSE 'episodic' END AS stage, count(*) AS n FROM (SELECT {_A.format('created_at')} * 24 AS h, coalesce(frequency, 0) AS fr FROM f) GROUP BY 1")
C.add("seq_reviews", lambda t: t.fibers.select("id", Q.next_review(F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce("frequency", F.lit(1)))), F.coalesce(F.col("salience") > 0.5, F.lit(False))).alias("r")).select("id", "r.box", "r.days"),
      "{f} SELECT id, b::INT AS box, map {1: 1, 2: 3, 3: 7, 4: 14, 5: 30}[b] AS days FROM (SELECT id, CASE WHEN coalesce(salience > 0.5, false) THEN least(5, least(5, greatest(1, coalesce(frequency, 1))) + 1) ELSE 1 END::INT AS b FROM f)")
C.add("seq_timeline", lambda t: O.find_fibers(t.fibers, window=("2025-06-01", "2025-07-01")).orderBy("time_start", "id").limit(20).select("id", "time_start", "summary"),
      "{f} SELECT id, time_start, summary FROM f WHERE time_start <= '2025-07-01' AND time_end >= '2025-06-01' ORDER BY time_start, id LIMIT 20")
C.add("seq_fiber_info", lambda t: members(t.fibers).join(t.fibers.select(F.col("id").alias("fiber_id"), "created_at"), "fiber_id").groupBy("neuron_id").agg(F.min(F.struct("created_at", "fiber_id")).alias("m")).select("neuron_id", "m.fiber_id"),
      "{fm} SELECT neuron_id, fiber_id FROM (SELECT neuron_id, fiber_id, row_number() OVER (PARTITION BY neuron_id ORDER BY created_at NULLS FIRST, fiber_id) AS r FROM fm JOIN f ON f.id = fiber_id) WHERE r = 1")
