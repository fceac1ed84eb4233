"""Fusion, ranking, budgets, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, age, members, now
from engramlake.functions import scalar as S
from engramlake.operators import ranking as R
from engramlake.operators import scans as O

C = Catalog()

# ranked lists: every brain is a query, retrievers rank its neurons by different keys
_RANKED = """rk AS (
 SELECT brain_id AS query_id, 'entity' AS retriever, id AS neuron_id, row_number() OVER (PARTITION BY brain_id ORDER BY created_at DESC NULLS LAST, id) AS rank FROM n WHERE type = 'entity'
 UNION ALL SELECT brain_id, 'keyword', id, row_number() OVER (PARTITION BY brain_id ORDER BY activation_level DESC, id) FROM n JOIN st ON st.neuron_id = n.id
 UNION ALL SELECT brain_id, 'graph', id, row_number() OVER (PARTITION BY brain_id ORDER BY access_frequency DESC, id) FROM n JOIN st ON st.neuron_id = n.id), r10 AS (SELECT * FROM rk WHERE rank <= 10),
 fu AS (SELECT query_id, neuron_id, round(sum(CASE retriever WHEN 'entity' THEN 0.9 WHEN 'keyword' THEN 0.7 ELSE 0.5 END / (60 + rank)), 9) AS score FROM r10 GROUP BY 1, 2)"""


def _ranked(t):
    n = t.neurons.select("brain_id", "id", "type", "created_at")
    s = n.join(t.states, F.col("id") == F.col("neuron_id")).drop("neuron_id")
    lists = (("entity", n.where("type = 'entity'"), [F.desc("created_at"), "id"]), ("keyword", s, [F.desc("activation_level"), "id"]), ("graph", s, [F.desc("access_frequency"), "id"]))
    out = None
    for name, rows, order in lists:
        part = O.top(rows, ["brain_id"], order, 10).select(F.col("brain_id").alias("query_id"), F.lit(name).alias("retriever"), F.col("id").alias("neuron_id"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


C.add("rank_anchor_union", lambda t: _ranked(t), f"{{st}} WITH {_RANKED} SELECT query_id, retriever, neuron_id, rank::INT AS rank FROM r10")
C.add("rank_fuse", lambda t: R.fuse(_ranked(t)), f"{{st}} WITH {_RANKED} SELECT * FROM fu")
C.add("rank_levels", lambda t: R.to_levels(R.fuse(_ranked(t))),
      f"{{st}} WITH {_RANKED} SELECT query_id, neuron_id, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE 0.1 + 0.9 * (score - lo) / (hi - lo) END, 9) AS level FROM fu JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM fu GROUP BY 1) USING (query_id)")

# activations: every brain is a query, its neurons' levels, their type the source
_ACT = "ac AS (SELECT brain_id AS query_id, id AS node, activation_level AS level, type AS source FROM n JOIN st ON st.neuron_id = n.id WHERE activation_level >= 0.2)"


def _active(t):
    rows = t.neurons.select("brain_id", "id", "type").join(t.states.where("activation_level >= 0.2"), F.col("id") == F.col("neuron_id"))
    return rows.select(F.col("brain_id").alias("query_id"), F.col("id").alias("node"), F.col("activation_level").alias("level"), F.col("type").alias("source"))


C.add("rank_lateral_inhibition", lambda t: R.inhibit(_active(t)), f"""{{st}} WITH {_ACT}, c AS (SELECT query_id, count(DISTINCT source) AS k FROM ac GROUP BY 1),
 r AS (SELECT ac.*, row_number() OVER (PARTITION BY query_id, source ORDER BY level DESC, node) <= ceil(10 / k) AS first FROM ac JOIN c USING (query_id)),
 g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, level DESC, node) AS q FROM r)
 SELECT query_id, node, round(CASE WHEN q <= 10 THEN level ELSE level * 0.3 END, 9) AS level, source FROM g WHERE round(CASE WHEN q <= 10 THEN level ELSE level * 0.3 END, 9) >= 0.2""")
C.add("rank_stabilise", lambda t: R.stabilise(_active(t)))
C.add("rank_deprioritise", lambda t: R.deprioritise(_active(t), t.neurons), f"""{{st}} WITH {_ACT} SELECT query_id, node, round(level * CASE WHEN coalesce(metadata.superseded, false) THEN 0.25 WHEN coalesce(metadata.disputed, false) THEN 0.5 ELSE 1.0 END, 9) AS level
 FROM ac JOIN n ON n.id = node WHERE round(level * CASE WHEN coalesce(metadata.superseded, false) THEN 0.25 WHEN coalesce(metadata.disputed, false) THEN 0.5 ELSE 1.0 END, 9) >= 0.05""")
C.add("rank_sufficiency", lambda t: R.sufficiency(_active(t)), f"""{{st}} WITH {_ACT}, t AS (SELECT query_id, sum(level) AS mass, max(level) AS top, count(*) AS nodes FROM ac GROUP BY 1),
 r AS (SELECT ac.*, mass, top, nodes, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, node) AS r FROM ac JOIN t USING (query_id)),
 s AS (SELECT query_id, any_value(nodes) AS nodes, any_value(top) AS top, -sum(level / mass * log2(level / mass)) AS entropy, sum(level) FILTER (WHERE r <= 3) / any_value(mass) AS focus FROM r GROUP BY 1)
 SELECT query_id, nodes, round(entropy, 6) AS entropy, round(focus, 6) AS focus, round(least(1.0, 0.30 * top + 0.20 * focus + 0.15), 6) AS confidence,
 CASE WHEN entropy >= 3.0 AND focus < 0.2 THEN 'ambiguous' WHEN focus >= 0.5 THEN 'focused' ELSE 'default' END AS verdict FROM s""")
_COMP = f"""hit AS (SELECT query_id, fiber_id, max(level) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level DESC, node) AS r FROM ac) JOIN fm ON fm.neuron_id = node WHERE r <= 20 GROUP BY 1, 2),
 sc AS (SELECT query_id, fiber_id, round(0.30 * activation + 0.25 * coalesce(salience, 0) + 0.20 * least(1.0, coalesce(frequency, 0) / 20) + 0.15 * coalesce(conductivity, 1.0) + 0.10 * CASE WHEN a < 7 THEN 1.0 WHEN a < 30 THEN 0.8 WHEN a < 90 THEN 0.5 WHEN a < 365 THEN 0.3 ELSE 0.1 END, 9) AS score
 FROM hit JOIN (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400e6) AS a FROM f) g ON g.id = fiber_id)"""
C.add("rank_matching_fibers", lambda t: R.matching_fibers(_active(t), members(t.fibers), t.fibers, now=NOW),
      f"{{st, fm}} WITH {_ACT}, {_COMP} SELECT query_id, fiber_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fiber_id) AS rank FROM sc) WHERE rank <= 10")
C.add("rank_context_match", lambda t: _context(t), """{ft} WITH m AS (SELECT fiber_id, list(DISTINCT tag ORDER BY tag) AS tags FROM ft GROUP BY 1)
 SELECT fiber_id, round(len(list_intersect(tags, ['sync', 'ops', 'billing']))::DOUBLE / len(list_distinct(list_concat(tags, ['sync', 'ops', 'billing']))), 6) AS score FROM m""")


def _context(t):
    tags = O.tags_of(t.fibers)
    mine = F.array(*map(F.lit, ("sync", "ops", "billing")))
    return t.fibers.select(F.col("id").alias("fiber_id"), F.array_distinct(F.array_compact(tags)).alias("tags")).where("size(tags) > 0").select("fiber_id", F.round(S.jaccard(F.col("tags"), mine), 6).alias("score"))


C.add("rank_auto_strategy", lambda t: _strategy(t), """{e, n} SELECT brain_id, CASE WHEN d < 3 THEN 'classic' WHEN d > 8 THEN 'ppr' ELSE 'hybrid' END AS strategy FROM (SELECT brain_id, count(*) / (SELECT count(*) FROM n WHERE n.brain_id = e.brain_id) AS d FROM e GROUP BY 1)""")


def _strategy(t):
    edges, nodes = t.synapses.groupBy("brain_id").agg(F.count("*").alias("e")), t.neurons.groupBy("brain_id").agg(F.count("*").alias("n"))
    d = F.col("e") / F.col("n")
    return edges.join(nodes, "brain_id").select("brain_id", F.when(d < 3, "classic").when(d > 8, "ppr").otherwise("hybrid").alias("strategy"))


_WORDS = r"len(list_filter(string_split_regex(coalesce(summary, ''), '[ \t\r\n]+'), lambda w: w <> ''))"
_COST = f"cs AS (SELECT brain_id, id AS fiber_id, greatest(10, floor({_WORDS} * 1.3)::INT + 15) AS cost, round(0.1 * coalesce(salience, 0) + 0.05 * coalesce(conductivity, 0) + least(1.0, coalesce(frequency, 0) / 20), 9) AS value FROM f)"


def _costs(t):
    return R.token_costs(t.fibers).join(t.fibers.select(F.col("id").alias("fiber_id"), "brain_id"), "fiber_id")


C.add("budget_token_costs", lambda t: R.token_costs(t.fibers), f"{{f}} WITH {_COST} SELECT fiber_id, cost, value FROM cs")
C.add("budget_greedy", lambda t: R.within_budget(_costs(t), group="brain_id", budget=200), f"""{{f}} WITH RECURSIVE {_COST}, o AS (SELECT *, row_number() OVER (PARTITION BY brain_id ORDER BY -value / cost, fiber_id) AS r FROM cs),
 g AS (SELECT brain_id, 0::BIGINT AS r, 0::BIGINT AS spent, []::VARCHAR[] AS taken FROM (SELECT DISTINCT brain_id FROM o)
 UNION ALL SELECT g.brain_id, o.r, CASE WHEN spent + cost <= 200 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 200 THEN list_append(taken, fiber_id) ELSE taken END FROM g JOIN o ON o.brain_id = g.brain_id AND o.r = g.r + 1),
 z AS (SELECT brain_id, arg_max(spent, r) AS spent, arg_max(taken, r) AS taken FROM g GROUP BY 1)
 SELECT brain_id, spent, (generate_subscripts(taken, 1) - 1)::INT AS pos, unnest(taken) AS fiber_id FROM z""")
C.add("budget_prefix", lambda t: R.prefix_budget(_costs(t).withColumnRenamed("brain_id", "group"), order=[F.desc("value"), "fiber_id"], cost="cost", budget=300).select("group", "fiber_id", "running"),
      f'{{f}} WITH {_COST} SELECT brain_id AS "group", fiber_id, running FROM (SELECT *, sum(cost) OVER (PARTITION BY brain_id ORDER BY value DESC, fiber_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM cs) WHERE running <= 300')
C.add("budget_keep_first", lambda t: R.keep_first_near(_scored(t), group="brain_id"))


def _scored(t):
    return t.neurons.select("brain_id", "id", F.coalesce("metadata.priority", F.lit(0)).alias("score"), F.col("content_hash").alias("hash"))


C.add("budget_fidelity", lambda t: t.fibers.select("id", S.fidelity_level(_fid()).alias("level")),
      f"{{f}} SELECT id, CASE WHEN s >= 0.6 THEN 'full' WHEN s >= 0.3 THEN 'summary' WHEN s >= 0.1 THEN 'essence' ELSE 'ghost' END AS level FROM (SELECT id, round(greatest(least(1.0, coalesce(salience, 0) + coalesce(conductivity, 0)) * exp(-0.01 * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 3600e6 / 24), 0.05), 9) AS s FROM f WHERE created_at <= '{NOW}') UNION ALL SELECT id, CASE WHEN least(1.0, coalesce(salience, 0) + coalesce(conductivity, 0)) >= 0.6 THEN 'full' WHEN least(1.0, coalesce(salience, 0) + coalesce(conductivity, 0)) >= 0.3 THEN 'summary' WHEN least(1.0, coalesce(salience, 0) + coalesce(conductivity, 0)) >= 0.1 THEN 'essence' ELSE 'ghost' END FROM f WHERE created_at > '{NOW}'")


def _fid():
    return F.round(S.fidelity_score(F.coalesce("conductivity", F.lit(0.0)), F.coalesce("salience", F.lit(0.0)), age() * 24, F.lit(0.01)), 9)


C.add("budget_compress_age", lambda t: t.documents.select("doc_id", F.when(age() < 7, F.length("text")).when(age() < 30, F.least(F.length("text"), F.lit(400))).when(age() < 90, F.least(F.length("text"), F.lit(200))).otherwise(F.least(F.length("text"), F.lit(100))).alias("chars")),
      f"SELECT doc_id, CASE WHEN a < 7 THEN length(text) WHEN a < 30 THEN least(length(text), 400) WHEN a < 90 THEN least(length(text), 200) ELSE CASE WHEN text IS NULL THEN 100 ELSE least(length(text), 100) END END::INT AS chars FROM (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400e6) AS a FROM documents)")
C.add("rank_evaluate", lambda t: R.evaluate(R.fuse(_ranked(t)).transform(lambda d: O.top(d, ["query_id"], [F.desc("score"), "neuron_id"], 5)).select("query_id", F.col("neuron_id").alias("id"), "rank"), t.neurons.where("metadata.is_anchor").select(F.col("brain_id").alias("query_id"), "id")),
      f"""{{st}} WITH {_RANKED}, tr AS (SELECT brain_id AS query_id, id FROM n WHERE metadata.is_anchor), rr AS (SELECT query_id, neuron_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neuron_id) AS rank FROM fu),
 h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM rr JOIN tr USING (query_id, id) WHERE rank <= 5 GROUP BY 1), w AS (SELECT query_id, count(*) AS relevant FROM tr GROUP BY 1),
 q AS (SELECT DISTINCT query_id FROM rr UNION SELECT query_id FROM w)
 SELECT query_id, round(coalesce(hits, 0) / 5, 6) AS precision, round(CASE WHEN coalesce(relevant, 0) = 0 THEN 1.0 ELSE coalesce(hits, 0) / relevant END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr,
 round(CASE WHEN coalesce(relevant, 0) = 0 THEN 0.0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 5)::BIGINT + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM q LEFT JOIN w USING (query_id) LEFT JOIN h USING (query_id)""")
