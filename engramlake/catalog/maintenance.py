"""Maintenance passes, clusters, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, fiber_tags, members, sql_tokens
from engramlake.operators import changelog as L
from engramlake.operators import clusters as K
from engramlake.operators import maintenance as M
from engramlake.operators import merging as G
from engramlake.operators import stats as A

C = Catalog()
_A = "greatest(0.0, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us({})) / 86400e6)"
_IDLE = _A.format("coalesce(last_activated, created_at)")
_RC = "coalesce(reinforced_count, 0)"
_FADE = f"weight * greatest(0.3 + least(0.5, 0.05 * {_RC}), 1 / (1 + exp(-((1440.0 * (1 + 0.5 * {_RC}) - {_IDLE} * 24) / (1440.0 * (1 + 0.5 * {_RC}) / 2)))))"

C.add("maint_decay_states", lambda t: M.decay_states(t.states, now=NOW), f"{{st}} SELECT neuron_id, round(CASE WHEN l < 0.01 THEN 0 ELSE l END, 9) AS activation_level FROM (SELECT neuron_id, CASE WHEN last_activated IS NULL OR {_A.format('last_activated')} < 1 THEN activation_level ELSE activation_level * exp(-0.1 * {_A.format('last_activated')}) END AS l FROM st)")
C.add("maint_decay_edges", lambda t: M.decay_edges(t.synapses, now=NOW), f"{{e}} SELECT id, round({_FADE}, 9) AS weight FROM e")
C.add("maint_prune", lambda t: M.prune_candidates(t.synapses, t.neurons, t.fibers, now=NOW, least=0.25, decayed=0.2),
      f"""{{e, f}} WITH held AS (SELECT DISTINCT unnest(synapse_ids) AS id FROM f), safe AS (SELECT anchor_neuron_id AS n FROM f WHERE (coalesce(pinned, false) OR salience > 0.8) AND anchor_neuron_id IS NOT NULL),
 w AS (SELECT source_id, count(*) AS ways FROM e WHERE weight >= 0.02 GROUP BY 1)
 SELECT id, source_id, target_id, weight FROM e LEFT JOIN w USING (source_id) WHERE weight < 0.25 AND {_FADE} < 0.2 AND {_IDLE} >= 7 AND id NOT IN (SELECT id FROM held WHERE id IS NOT NULL) AND source_id NOT IN (FROM safe) AND target_id NOT IN (FROM safe) AND (weight < 0.02 OR ways > 1)""")
C.add("maint_boost_frequent", lambda t: M.boost_frequent(t.synapses, t.fibers), "{e, f} WITH b AS (SELECT DISTINCT unnest(synapse_ids) AS id FROM (SELECT * FROM f WHERE frequency >= 5 ORDER BY frequency DESC, id LIMIT 100)) SELECT id, round(least(1.0, weight + 0.03), 9) AS weight FROM e WHERE id IN (SELECT id FROM b WHERE id IS NOT NULL)")
C.add("maint_normalise_outgoing", lambda t: M.normalise_outgoing(t.synapses), "{e} WITH s AS (SELECT source_id, sum(weight) AS t FROM e GROUP BY 1 HAVING sum(weight) > 5) SELECT id, round(weight * 5 / t, 9) AS weight FROM e JOIN s USING (source_id)")
C.add("maint_infer", lambda t: M.infer_edges(A.co_activation_counts(t.co_activations), t.synapses),
      """{co, e} WITH c AS (SELECT least(neuron_a, neuron_b) AS a, greatest(neuron_a, neuron_b) AS b, count(*) AS n, round(avg(binding_strength), 6) AS s FROM co WHERE neuron_a <> neuron_b GROUP BY 1, 2 HAVING count(*) >= 3),
 x AS (SELECT a, b, n, CASE WHEN EXISTS (SELECT 1 FROM e WHERE least(source_id, target_id) = a AND greatest(source_id, target_id) = b) THEN 'reinforce' ELSE 'create' END AS action, round(least(0.8, 0.3 + 0.1 * (n - 3) * coalesce(s, 0.5)), 9) AS weight FROM c)
 SELECT a, b, n, action, weight FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY n DESC, a, b) AS r FROM x) WHERE r <= 50""")
C.add("maint_replay_salient", lambda t: M.replay_salient(t.synapses, t.fibers, members(t.fibers)),
      """{e, fm} WITH b AS (SELECT id FROM f ORDER BY salience DESC NULLS LAST, id LIMIT 20), m AS (SELECT * FROM fm WHERE fiber_id IN (FROM b)),
 k AS (SELECT id, fiber_id, weight, count(*) AS ends FROM (SELECT id, fiber_id, weight FROM e JOIN m ON m.neuron_id = source_id UNION ALL SELECT id, fiber_id, weight FROM e JOIN m ON m.neuron_id = target_id) GROUP BY ALL)
 SELECT id, round(least(1.0, any_value(weight) * pow(1.1, count(*) FILTER (WHERE ends = 2)) * pow(0.98, count(*) FILTER (WHERE ends = 1))), 9) AS weight FROM k GROUP BY 1""")
C.add("maint_dream", lambda t: M.dream(t.raw("synapses"), t.neurons, seeds=8, threshold=0.1), """{e, n} WITH RECURSIVE b AS (SELECT source_id AS src, target_id AS dst, weight FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION SELECT target_id, source_id, weight FROM e WHERE source_id <> target_id),
 l AS (SELECT src, dst, max(weight) AS w FROM b WHERE weight >= 0.1 GROUP BY 1, 2), a AS (SELECT id AS q FROM n ORDER BY md5(id), id LIMIT 8),
 r AS (SELECT q, q AS node, 1.0::DOUBLE AS level, 0 AS hop FROM a UNION ALL SELECT q, dst, level * w * 0.5, hop + 1 FROM r JOIN l ON node = src WHERE hop < 2 AND level * w * 0.5 >= 0.1),
 best AS (SELECT q, node, max(level) AS level FROM r GROUP BY 1, 2), k AS (SELECT q, node FROM best WHERE node <> q QUALIFY row_number() OVER (PARTITION BY q ORDER BY level DESC, node) <= 100),
 p AS (SELECT DISTINCT x.node, y.node AS other FROM k x JOIN k y ON x.q = y.q AND x.node < y.node)
 SELECT node, other, 0.1::DOUBLE AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(source_id, target_id) = node AND greatest(source_id, target_id) = other) ORDER BY node, other LIMIT 200""")
C.add("maint_lifecycle", lambda t: M.lifecycle(t.neurons, t.states, now=NOW), f"""{{st}} WITH x AS (SELECT id, {_IDLE} AS d, coalesce(access_frequency, 0) AS u, greatest(0, least(10, coalesce(metadata.priority, 5))) AS p FROM n LEFT JOIN st ON neuron_id = id),
 h AS (SELECT id, d, 0.4 * exp(-d / 7) + 0.4 * least(1.0, u / 20) + 0.2 * p / 10 AS h FROM x)
 SELECT id, round(h, 6) AS heat, CASE WHEN h >= 0.5 AND d >= 7 THEN 'warm' WHEN d < 7 THEN 'active' WHEN d < 30 THEN 'warm' WHEN d < 90 THEN 'cool' WHEN d < 180 THEN 'compressed' ELSE 'archived' END AS state FROM h""")
C.add("maint_compression_tiers", lambda t: M.compression_tier(t.fibers, now=NOW), f"{{f}} SELECT id, CASE WHEN coalesce(pinned, false) OR d < 7 THEN 0 WHEN d < 30 THEN 1 WHEN d < 90 THEN 2 WHEN d < 180 THEN 3 ELSE 4 END AS tier FROM (SELECT *, {_A.format('created_at')} AS d FROM f)")
C.add("maint_tier_moves", lambda t: M.tier_moves(t.fibers, now=NOW), f"""{{f}} WITH x AS (SELECT id, brain_id, frequency, CASE WHEN frequency >= 5 AND d < 30 THEN 'hot' WHEN d >= 90 THEN 'cold' WHEN d >= 30 THEN 'warm' END AS move FROM (SELECT *, {_A.format('coalesce(last_conducted, created_at)')} AS d FROM f) WHERE NOT coalesce(pinned, false))
 SELECT id, move FROM (SELECT *, row_number() OVER (PARTITION BY brain_id, move ORDER BY frequency DESC, id) AS r FROM x) WHERE move IS NOT NULL AND (move <> 'hot' OR r <= 100)""")
C.add("maint_supersede", lambda t: M.supersede(t.documents.where("memory_type = 'decision'")), """SELECT doc_id, created_at AS valid_from, lead(created_at) OVER w AS valid_until, lead(doc_id) OVER w AS superseded_by FROM documents WHERE memory_type = 'decision' AND created_at IS NOT NULL WINDOW w AS (PARTITION BY source, memory_type ORDER BY created_at, doc_id)""")
C.add("maint_beliefs", lambda t: M.belief_updates(t.events.where("value IS NOT NULL").select(F.col("event_type").alias("claim"), "event_id", F.when(F.col("value") > 50, 1).otherwise(-1).alias("sign"))))
C.add("maint_hebbian", lambda t: _hebb(t), """{st, e} SELECT e.id, round(greatest(0.0, least(1.0, weight + 0.01 * (1 + 3 * exp(-0.06 * coalesce(reinforced_count, 0))) * a.activation_level * b.activation_level * (1 - weight))), 9) AS weight
 FROM e JOIN st a ON a.neuron_id = source_id JOIN st b ON b.neuron_id = target_id""")


def _hebb(t):
    from engramlake.functions.scalar import hebbian

    s = t.states
    pre, post = s.select(F.col("neuron_id").alias("source_id"), F.col("activation_level").alias("x")), s.select(F.col("neuron_id").alias("target_id"), F.col("activation_level").alias("y"))
    rows = t.synapses.join(pre, "source_id").join(post, "target_id")
    return rows.select("id", F.round(hebbian(F.col("weight"), F.col("x"), F.col("y"), F.coalesce("reinforced_count", F.lit(0))), 9).alias("weight"))


_TAGS = "tc AS (SELECT tag, count(*) AS fibers FROM ft GROUP BY 1), tp AS (SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM ft x JOIN ft y ON x.fiber_id = y.fiber_id AND x.tag < y.tag GROUP BY 1, 2)"
C.add("cluster_tags", lambda t: K.tag_clusters(A.tag_cooccurrence(fiber_tags(t.fibers)), fiber_tags(t.fibers).groupBy("tag").agg(F.count("*").alias("fibers")), link=0.03),
      f"""{{ft}} WITH RECURSIVE {_TAGS}, l AS (SELECT a, b FROM tp JOIN tc x ON x.tag = a JOIN tc y ON y.tag = b WHERE n >= 3 AND n / (x.fibers + y.fibers - n) >= 0.03), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a AS node, a AS reach FROM u UNION SELECT node, b FROM r JOIN u ON reach = a), c AS (SELECT node AS tag, min(reach) AS c FROM r GROUP BY 1), m AS (SELECT c, arg_max(tag, (fibers, tag)) AS canonical FROM c JOIN tc USING (tag) GROUP BY 1)
 SELECT tag, canonical FROM c JOIN m USING (c)""")
C.add("cluster_fan_effect", lambda t: K.fan_effect(fiber_tags(t.fibers)), "{ft} SELECT tag, count(DISTINCT fiber_id) AS fan FROM ft GROUP BY 1 HAVING count(DISTINCT fiber_id) >= 15")
C.add("cluster_similar_fibers", lambda t: K.set_similarity(members(t.raw("fibers")).select(F.col("fiber_id").alias("set_id"), F.col("neuron_id").alias("item")), threshold=0.3).select("a", "b", F.round("jaccard", 6).alias("jaccard")),
      """{fm} WITH s AS (SELECT fiber_id, list(neuron_id ORDER BY neuron_id) AS m FROM fm GROUP BY 1), d AS (SELECT m, min(fiber_id) AS id FROM s GROUP BY 1)
 SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, round(len(list_intersect(x.m, y.m)) / (len(x.m) + len(y.m) - len(list_intersect(x.m, y.m))), 6) AS jaccard FROM d x JOIN d y ON x.id < y.id
 WHERE len(list_intersect(x.m, y.m)) >= 0.3 * (len(x.m) + len(y.m) - len(list_intersect(x.m, y.m)))""")
C.add("cluster_merge_fibers", lambda t: K.merge_fibers(members(t.raw("fibers")), threshold=0.5), """{fm} WITH RECURSIVE s AS (SELECT fiber_id, list(neuron_id ORDER BY neuron_id) AS m FROM fm GROUP BY 1), d AS (SELECT m, min(fiber_id) AS id FROM s GROUP BY 1),
 l AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.id <> y.id WHERE len(list_intersect(x.m, y.m)) >= 0.5 * (len(x.m) + len(y.m) - len(list_intersect(x.m, y.m)))),
 r AS (SELECT id AS node, id AS reach FROM d UNION SELECT node, b FROM r JOIN l ON reach = a), c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1) SELECT fiber_id, c AS merged_into FROM s JOIN d USING (m) JOIN c ON c.node = d.id""")
C.add("cluster_aliases", lambda t: t.neurons.where(F.length(F.trim("content")) > 1).groupBy(F.lower(F.trim("content")).alias("name")).agg(F.min("id").alias("canonical"), F.count("*").alias("n")).where("n > 1"),
      "{n} SELECT lower(trim(content)) AS name, min(id) AS canonical, count(*) AS n FROM n WHERE length(trim(content)) > 1 GROUP BY 1 HAVING count(*) > 1")
C.add("cluster_drift", lambda t: t.neurons.select("id", F.explode("metadata.tags").alias("tag")).where("tag IS NOT NULL").groupBy(F.lower("tag").alias("canonical")).agg(F.countDistinct("tag").alias("variants")).where("variants > 1"),
      "{n} SELECT lower(tag) AS canonical, count(DISTINCT tag) AS variants FROM (SELECT unnest(metadata.tags) AS tag FROM n) WHERE tag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT tag) > 1")
C.add("cluster_schema_candidates", lambda t: _uncovered(t), """{ft, n} WITH c AS (SELECT DISTINCT lower(content) AS name FROM n WHERE type = 'schema') SELECT tag, count(*) AS fibers FROM ft WHERE lower(tag) NOT IN (SELECT name FROM c WHERE name IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10""")
C.add("cluster_patterns", lambda t: _patterns(t), """{fm, n} SELECT content AS entity, count(DISTINCT fiber_id) AS fibers FROM fm JOIN n ON n.id = neuron_id WHERE type = 'entity' AND length(trim(content)) > 1 GROUP BY 1 HAVING count(DISTINCT fiber_id) >= 3""")
_DTOK = sql_tokens("text")
C.add("cluster_overlapping_decisions", lambda t: _decisions(t), f"""WITH d AS (SELECT DISTINCT text, list_sort(list_distinct({_DTOK})) AS w FROM documents WHERE memory_type = 'decision' AND text IS NOT NULL), s AS (SELECT min(doc_id) AS id, w FROM documents JOIN d USING (text) WHERE memory_type = 'decision' AND len(w) > 0 GROUP BY w)
 SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS score FROM s x JOIN s y ON x.id < y.id WHERE len(list_intersect(x.w, y.w)) >= 0.25 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))""")
C.add("cluster_lcs", lambda t: K.common_subsequence(t.fibers.select("id", F.col("pathway").alias("a"), F.col("neuron_ids").alias("b"))))


def _uncovered(t):
    named = t.neurons.where("type = 'schema' AND content IS NOT NULL").select(F.lower("content").alias("name")).distinct()
    return fiber_tags(t.fibers).join(named, F.lower("tag") == F.col("name"), "left_anti").groupBy("tag").agg(F.count("*").alias("fibers")).where("fibers >= 10")


def _patterns(t):
    ents = t.neurons.where((F.col("type") == "entity") & (F.length(F.trim("content")) > 1)).select(F.col("id").alias("neuron_id"), F.col("content").alias("entity"))
    return members(t.fibers).join(ents, "neuron_id").groupBy("entity").agg(F.countDistinct("fiber_id").alias("fibers")).where("fibers >= 3")


def _decisions(t):
    from engramlake.functions.scalar import search_tokens

    docs = t.documents.where("memory_type = 'decision'")
    rows = docs.select(F.col("doc_id").alias("set_id"), F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("item"))
    return K.text_set_similarity(rows, threshold=0.25).select("a", "b", F.round("jaccard", 6).alias("score"))


_SNAP = "o AS (SELECT id, type, content FROM n WHERE created_at < '2025-09-01'), w AS (SELECT id, CASE WHEN type = 'intent' THEN 'goal' ELSE type END AS type, content FROM n WHERE created_at >= '2025-02-01')"
C.add("merge_diff", lambda t: G.diff(t.neurons.where("created_at < TIMESTAMP_NTZ '2025-09-01'"), t.neurons.where("created_at >= TIMESTAMP_NTZ '2025-02-01'").withColumn("type", F.when(F.col("type") == "intent", "goal").otherwise(F.col("type"))), compare=["type", "content"]),
      f"{{n}} WITH {_SNAP} SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN w ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR o.type IS DISTINCT FROM w.type OR o.content IS DISTINCT FROM w.content")
C.add("merge_weight_changes", lambda t: M.decay_edges(t.synapses, now=NOW).withColumnRenamed("weight", "w").join(t.synapses.select("id", "weight"), "id").where(F.abs(F.col("w") - F.col("weight")) > 1e-6).select("id"), f"{{e}} SELECT id FROM e WHERE abs(round({_FADE}, 9) - weight) > 1e-6")
_FP = "concat_ws(':', type, lower(content))"
C.add("merge_snapshots", lambda t: G.merge_snapshots(t.neurons.where("created_at < TIMESTAMP_NTZ '2025-09-01'"), t.neurons.where("created_at >= TIMESTAMP_NTZ '2025-02-01'"), prefer="priority"),
      f"""{{n}} WITH p AS (SELECT {_FP} AS fingerprint, id, created_at, coalesce(metadata.priority, 0) AS pr FROM n), l AS (SELECT fingerprint, min(id) AS id, arg_min(pr, id) AS pr FROM p WHERE created_at < '2025-09-01' GROUP BY 1), q AS (SELECT fingerprint, min(id) AS id, arg_min(pr, id) AS pr FROM p WHERE created_at >= '2025-02-01' GROUP BY 1)
 SELECT coalesce(l.fingerprint, q.fingerprint) AS fingerprint, CASE WHEN l.id IS NULL OR q.pr > l.pr THEN q.id ELSE l.id END AS id, CASE WHEN l.id IS NULL OR q.pr > l.pr THEN 'right' ELSE 'left' END AS "from" FROM l FULL JOIN q ON l.fingerprint = q.fingerprint""")
C.add("merge_subgraph", lambda t: G.subgraph(t.neurons, t.synapses, types=["concept", "entity"], tags=["Sync", "ops"])[1].select("id", "source_id", "target_id"),
      "{n, e} WITH k AS (SELECT id FROM n WHERE type IN ('concept', 'entity') AND len(list_filter(metadata.tags, lambda x: lower(x) IN ('sync', 'ops'))) > 0) SELECT id, source_id, target_id FROM e WHERE source_id IN (FROM k) AND target_id IN (FROM k)")
_LEAF = "lf AS (SELECT id, sha256(concat_ws('|', id, coalesce(type, ''), coalesce(content, ''))) AS hash FROM n), l6 AS (SELECT hash[1:6] AS path, sha256(string_agg(hash, '' ORDER BY hash)) AS hash, count(*) AS leaves FROM lf GROUP BY hash[1:6]), l4 AS (SELECT path[1:4] AS path, sha256(string_agg(hash, '' ORDER BY path)) AS hash, sum(leaves) AS leaves FROM l6 GROUP BY path[1:4]), b AS (SELECT path[1:2] AS bucket, sha256(string_agg(hash, '' ORDER BY path)) AS hash, sum(leaves)::BIGINT AS leaves FROM l4 GROUP BY path[1:2])"
C.add("merge_merkle_buckets", lambda t: G.merkle_buckets(G.leaf_hashes(t.neurons, ["type", "content"])), f"{{n}} WITH {_LEAF} SELECT bucket, leaves, hash FROM b")
C.add("merge_merkle_root", lambda t: G.merkle_root(G.merkle_buckets(G.leaf_hashes(t.neurons, ["type", "content"]))), f"{{n}} WITH {_LEAF} SELECT sha256(string_agg(hash, '' ORDER BY bucket)) AS root FROM b")


def _changes(t):
    flat = L.parse_changes(t.raw("change_log"))
    return L.assemble_transactions(flat)


_TX = """whole AS (SELECT receipt_id, change::JSON AS c FROM change_log WHERE receipt_id IS NOT NULL AND json_valid(change)), fl AS (SELECT receipt_id, (c->>'sequence')::BIGINT AS sequence, c->>'entity_type' AS entity_type, c->>'entity_id' AS entity_id, lower(trim(c->>'operation')) AS operation, c->>'device_id' AS device_id FROM whole WHERE c->>'entity_id' IS NOT NULL AND c->>'sequence' IS NOT NULL),
 tx AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY sequence) = 1)"""
C.add("merge_changes", lambda t: G.merge_changes(_changes(t).where("device_id < 'dev-q'"), _changes(t).where("device_id >= 'dev-q'")), f"""WITH {_TX}, l AS (SELECT entity_type, entity_id, arg_max((sequence, operation), sequence) AS x FROM tx WHERE device_id < 'dev-q' GROUP BY 1, 2), r AS (SELECT entity_type, entity_id, arg_max((sequence, operation), sequence) AS x FROM tx WHERE device_id >= 'dev-q' GROUP BY 1, 2)
 SELECT coalesce(l.entity_type, r.entity_type) AS entity_type, coalesce(l.entity_id, r.entity_id) AS entity_id, CASE WHEN r.x IS NULL THEN 'local' WHEN l.x IS NULL THEN 'remote' WHEN l.x[2] = 'delete' THEN 'local' WHEN r.x[2] = 'delete' THEN 'remote' WHEN r.x[1] > l.x[1] THEN 'remote' ELSE 'local' END AS winner FROM l FULL JOIN r ON l.entity_type = r.entity_type AND l.entity_id = r.entity_id""")
C.add("merge_change_stats", lambda t: _changes(t).groupBy("entity_type", "operation").agg(F.count("*").alias("n"), F.max("sequence").alias("last")), f"WITH {_TX} SELECT entity_type, operation, count(*) AS n, max(sequence) AS last FROM tx GROUP BY 1, 2")
C.add("merge_changes_since", lambda t: _changes(t).where("sequence > 500").orderBy("sequence", "receipt_id").limit(100).select("receipt_id", "sequence"), f"WITH {_TX} SELECT receipt_id, sequence FROM tx WHERE sequence > 500 ORDER BY sequence, receipt_id LIMIT 100")
C.add("merge_superseded_updates", lambda t: G.superseded_updates(_changes(t).join(L.synced_receipts(t.raw("change_log")), "receipt_id")),
      f"WITH {_TX}, sy AS (SELECT receipt_id, coalesce(bool_or((c->>'synced')::BOOLEAN), false) AS synced FROM whole WHERE c->>'entity_id' IS NOT NULL AND c->>'sequence' IS NOT NULL GROUP BY 1), p AS (SELECT * FROM tx JOIN sy USING (receipt_id) WHERE operation = 'update' AND NOT synced) SELECT receipt_id FROM p x WHERE EXISTS (SELECT 1 FROM p y WHERE y.entity_type = x.entity_type AND y.entity_id = x.entity_id AND y.sequence > x.sequence)")
