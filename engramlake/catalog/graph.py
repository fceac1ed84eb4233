"""Traversal, activation, paths and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog
from engramlake.functions import scalar as S
from engramlake.operators import graph as G
from engramlake.operators import scans

C = Catalog()
HUB, TWO = "neu-0000000000", "neu-f2dac9adc6"
_BOTH = "b AS (SELECT source_id AS src, target_id AS dst, weight FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT target_id, source_id, weight FROM e WHERE source_id <> target_id)"


def _anchors(t):
    return t.spark.createDataFrame([(1, HUB, 1.0), (2, TWO, 1.0), (3, "neu-5c371e9798", 0.9), (3, "missing", 0.5)], "query_id int, node string, level double")


_SPREAD = f"""{{e}} WITH RECURSIVE {_BOTH}, l AS (SELECT src, dst, max(weight) AS w FROM b WHERE weight >= 0.1 GROUP BY 1, 2),
 a(query_id, node, level) AS (VALUES (1, '{HUB}', 1.0::DOUBLE), (2, '{TWO}', 1.0), (3, 'neu-5c371e9798', 0.9), (3, 'missing', 0.5)),
 r AS (SELECT query_id, node, level, 0 AS hop FROM a UNION ALL SELECT query_id, dst, level * w * 0.5, hop + 1 FROM r JOIN l ON node = src WHERE hop < 4 AND level * w * 0.5 >= 0.2),
 best AS (SELECT query_id, node, max(level) AS level FROM r GROUP BY 1, 2)"""
_spread = lambda t: G.spread(G.directed(t.raw("synapses")), _anchors(t))

C.add("graph_neighbours", lambda t: G.neighbours(t.raw("synapses"), [HUB, TWO], least_weight=0.3),
      f"{{e}} SELECT DISTINCT * FROM (SELECT source_id AS neuron_id, target_id AS neighbour_id, id AS synapse_id, weight FROM e WHERE weight >= 0.3 UNION ALL SELECT target_id, source_id, id, weight FROM e WHERE weight >= 0.3) WHERE neuron_id IN ('{HUB}', '{TWO}')")
C.add("graph_neighbours_in", lambda t: G.neighbours(t.raw("synapses"), [HUB, TWO], direction="in"),
      f"{{e}} SELECT DISTINCT target_id AS neuron_id, source_id AS neighbour_id, id AS synapse_id, weight FROM e WHERE target_id IN ('{HUB}', '{TWO}') AND lower(direction) IN ('bi', 'bidirectional', 'both')")
C.add("graph_shortest_path", lambda t: G.shortest_paths(G.directed(t.raw("synapses")), t.neurons.where("type = 'intent'").select(F.lit(HUB).alias("source"), F.col("id").alias("target"))).select("source", "target", "hops"),
      f"""{{e, n}} WITH RECURSIVE {_BOTH}, l AS (SELECT DISTINCT src, dst FROM b), r AS (SELECT '{HUB}' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN l ON node = src WHERE hop < 4),
 d AS (SELECT node, min(hop) AS hops FROM r GROUP BY 1) SELECT '{HUB}' AS source, node AS target, hops FROM d JOIN n ON n.id = node WHERE n.type = 'intent'""")
C.add("graph_explain_connection", lambda t: G.shortest_paths(G.directed(t.raw("synapses")), t.neurons.where("type = 'schema'").select(F.lit(TWO).alias("source"), F.col("id").alias("target"))).select("target", F.round(S.path_confidence(F.col("hops"), F.lit(1.0)), 6).alias("confidence")),
      f"""{{e, n}} WITH RECURSIVE {_BOTH}, l AS (SELECT DISTINCT src, dst FROM b), r AS (SELECT '{TWO}' AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM r JOIN l ON node = src WHERE hop < 4),
 d AS (SELECT node, min(hop) AS hops FROM r GROUP BY 1) SELECT node AS target, round(exp(-0.4 * hops), 6) AS confidence FROM d JOIN n ON n.id = node WHERE n.type = 'schema'""")
C.add("graph_spread", lambda t: _spread(t).select("query_id", "node", F.round("level", 9).alias("level")), _SPREAD + " SELECT query_id, node, round(level, 9) AS level FROM best")
C.add("graph_spread_uses", lambda t: G.spread(G.directed(t.raw("synapses")), _anchors(t), uses=t.states.select(F.col("neuron_id").alias("node"), F.col("access_frequency").alias("frequency")), resting=t.neurons.where("metadata.superseded").select(F.col("id").alias("node"))).select("query_id", "node", F.round("level", 9).alias("level")),
      _SPREAD.replace("{e}", "{st}").replace("max(weight) AS w FROM b WHERE weight >= 0.1 GROUP BY 1, 2)", "max(weight) * (1 + least(0.15, 0.05 * ln(1 + coalesce(any_value(access_frequency), 0)))) AS w FROM b LEFT JOIN st ON st.neuron_id = dst WHERE weight >= 0.1 AND dst NOT IN (SELECT id FROM n WHERE metadata.superseded) GROUP BY 1, 2)") + " SELECT query_id, node, round(level, 9) AS level FROM best")
C.add("graph_spread_intersection", lambda t: G.intersection(_spread(t)), _SPREAD + " SELECT node, count(DISTINCT query_id) AS sets, round(sum(level), 9) AS total FROM best GROUP BY 1 HAVING count(DISTINCT query_id) > 1")
C.add("graph_spread_combined", lambda t: G.combine_sets(_spread(t)),
      _SPREAD + " SELECT node, round(list_reduce(list_prepend(0.0::DOUBLE, list(level ORDER BY query_id)), lambda s, x: CASE WHEN s = 0 THEN x ELSE least(1.0, s + 0.5 * x) END), 9) AS level, count(*) AS sets FROM best GROUP BY 1")
C.add("graph_induced", lambda t: G.induced(_spread(t), t.synapses).select("id", "source_id", "target_id"),
      _SPREAD + ", k AS (SELECT node FROM (SELECT node, max(level) AS level FROM best GROUP BY 1) WHERE level >= 0.2 ORDER BY level DESC, node LIMIT 50) SELECT id, source_id, target_id FROM e WHERE source_id IN (FROM k) AND target_id IN (FROM k)")
C.add("graph_pagerank", lambda t: G.pagerank(G.directed(t.synapses, both=False), t.spark.createDataFrame([(HUB, 1.0), (TWO, 0.5)], "node string, level double")).select("node", F.round("rank", 6).alias("rank")))
C.add("graph_trail", lambda t: G.trail(t.fibers, [HUB, TWO], now=NOW),
      f"""{{f}} WITH s AS (SELECT id, pathway, 0.9 * coalesce(conductivity, 1.0) * CASE WHEN last_conducted IS NULL THEN 0.3 + 0.4 * coalesce(salience, 0.0) ELSE greatest(0.1, 1 / (1 + exp(-((72 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_conducted)) / 3600e6) / 36)))) END AS f
 FROM f WHERE list_has_any(pathway, ['{HUB}', '{TWO}'])), p AS (SELECT id, f, unnest(pathway) AS node, generate_subscripts(pathway, 1) AS pos FROM s),
 g AS (SELECT p.node, pow(p.f, min(abs(p.pos - q.pos))) AS level FROM p JOIN p q ON p.id = q.id AND q.node IN ('{HUB}', '{TWO}') GROUP BY p.id, p.pos, p.node, p.f)
 SELECT node, round(max(level), 9) AS level FROM g WHERE level >= 0.2 AND node IS NOT NULL GROUP BY 1""")
_TRAIL = f"""s AS (SELECT id, pathway, 0.9 * coalesce(conductivity, 1.0) * CASE WHEN last_conducted IS NULL THEN 0.3 + 0.4 * coalesce(salience, 0.0) ELSE greatest(0.1, 1 / (1 + exp(-((72 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_conducted)) / 3600e6) / 36)))) END AS f
 FROM f WHERE list_has_any(pathway, ['{HUB}', '{TWO}'])), p AS (SELECT id, f, unnest(pathway) AS node, generate_subscripts(pathway, 1) AS pos FROM s),
 g AS (SELECT p.node, pow(p.f, min(abs(p.pos - q.pos))) AS level FROM p JOIN p q ON p.id = q.id AND q.node IN ('{HUB}', '{TWO}') GROUP BY p.id, p.pos, p.node, p.f), tl AS (SELECT node, round(max(level), 9) AS level FROM g WHERE level >= 0.2 AND node IS NOT NULL GROUP BY 1)"""
C.add("graph_hybrid", lambda t: G.hybrid(G.trail(t.fibers, [HUB, TWO], now=NOW), _spread(t)),
      _SPREAD.replace("{e}", "{e, f}") + f", {_TRAIL} SELECT coalesce(tl.node, o.node) AS node, round(greatest(coalesce(level, 0), coalesce(other, 0)), 9) AS level FROM tl FULL JOIN (SELECT node, max(level) * 0.6 AS other FROM best GROUP BY 1) o ON tl.node = o.node")
C.add("graph_spread_diminishing", lambda t: G.spread(G.directed(t.raw("synapses")), _anchors(t), threshold=0.02, diminishing=True).select("query_id", "node", F.round("level", 9).alias("level")))
C.add("graph_expand", lambda t: G.expand_seeds(t.raw("synapses"), t.neurons, [HUB, TWO]),
      f"{{e, n}} SELECT target_id, max(weight) AS weight FROM e WHERE source_id IN ('{HUB}', '{TWO}') AND weight >= 0.3 AND target_id NOT IN ('{HUB}', '{TWO}') AND target_id IN (SELECT id FROM n WHERE type <> 'time') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
C.add("graph_causal_chain", lambda t: G.chain(t.raw("synapses"), HUB, ["leads_to", "caused_by", "related_to"], max_depth=3).select("node", "depth"),
      f"""{{e}} WITH RECURSIVE r AS (SELECT '{HUB}' AS node, 0 AS depth UNION SELECT target_id, depth + 1 FROM r JOIN e ON source_id = node WHERE depth < 3 AND weight >= 0.1 AND type IN ('leads_to', 'caused_by', 'related_to') AND target_id IS NOT NULL)
 SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0""")
C.add("graph_event_sequence", lambda t: G.chain(t.raw("synapses"), HUB, ["before", "after", "happened_at"], max_depth=4).orderBy("depth", "node").limit(10).select("node", "depth"),
      f"""{{e}} WITH RECURSIVE r AS (SELECT '{HUB}' AS node, 0 AS depth UNION SELECT target_id, depth + 1 FROM r JOIN e ON source_id = node WHERE depth < 4 AND weight >= 0.1 AND type IN ('before', 'after', 'happened_at') AND target_id IS NOT NULL)
 SELECT node, min(depth) AS depth FROM r GROUP BY 1 HAVING min(depth) > 0 ORDER BY 2, 1 LIMIT 10""")
C.add("graph_temporal_range", lambda t: scans.unique(t.raw("fibers").where(F.expr("time_start <= TIMESTAMP_NTZ '2025-09-01' AND time_end >= TIMESTAMP_NTZ '2025-06-01'"))).orderBy("time_start", "id").limit(50).select("id", "time_start"),
      "{f} SELECT id, time_start FROM f WHERE time_start <= '2025-09-01' AND time_end >= '2025-06-01' ORDER BY time_start, id LIMIT 50")
C.add("graph_transitive_closures", lambda t: G.transitive_closures(t.raw("synapses"), "caused_by"),
      """{e} WITH x AS (SELECT source_id, target_id, max(weight) AS weight FROM e WHERE type = 'caused_by' AND source_id <> target_id GROUP BY 1, 2)
 SELECT a.source_id, b.target_id, round(max(0.5 * least(a.weight, b.weight)), 9) AS weight FROM x a JOIN x b ON a.target_id = b.source_id WHERE a.source_id <> b.target_id
 AND NOT EXISTS (SELECT 1 FROM x c WHERE c.source_id = a.source_id AND c.target_id = b.target_id) GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
# labels spread a step a round; the distances of the test graphs are far below 25
_LABELS = """u AS (SELECT source_id AS a, target_id AS b FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT target_id, source_id FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
 lab AS (SELECT DISTINCT a AS node, a AS label, 0 AS i FROM u UNION ALL SELECT u.b, min(least(x.label, y.label)), x.i + 1 FROM lab x JOIN u ON u.a = x.node JOIN lab y ON y.node = u.b WHERE x.i < 25 GROUP BY u.b, x.i),
 cc AS (SELECT node, min(label) AS component FROM lab GROUP BY 1)"""
C.add("graph_components", lambda t: G.components(G.directed(t.raw("synapses"), both=False)), f"{{e}} WITH RECURSIVE {_LABELS} SELECT node, component FROM cc")
C.add("graph_triangles", lambda t: G.triangles(G.directed(t.raw("synapses"), both=False)),
      """{e} WITH p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM e WHERE source_id <> target_id),
 d AS (SELECT x, count(*) AS d FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p) GROUP BY 1), t AS (SELECT count(*) AS triangles FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b), w AS (SELECT sum(d * (d - 1) // 2)::BIGINT AS wedges FROM d)
 SELECT triangles, wedges, round(3 * triangles / wedges, 9) AS clustering FROM t CROSS JOIN w""")
C.add("graph_largest_component", lambda t: _largest(t, t.raw("synapses")), f"{{e, n}} WITH RECURSIVE {_LABELS} SELECT max(k) AS largest, round(max(k) / (SELECT count(*) FROM n), 6) AS ratio FROM (SELECT count(*) AS k FROM cc GROUP BY component)")
C.add("graph_gromov", lambda t: G.gromov_delta(G.directed(t.raw("synapses"))))
C.add("graph_degrees", lambda t: G.degrees(t.synapses), "{e} SELECT neuron_id, count(*) AS degree FROM (SELECT source_id AS neuron_id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1")


def _largest(t, synapses):
    sizes = G.components(G.directed(synapses, both=False)).groupBy("component").agg(F.count("*").alias("k"))
    return sizes.agg(F.max("k").alias("largest")).join(F.broadcast(t.neurons.agg(F.count("*").alias("n")))).select("largest", F.round(F.col("largest") / F.col("n"), 6).alias("ratio"))
