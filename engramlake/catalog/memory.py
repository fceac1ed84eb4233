"""Beliefs, trust, routing, review, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, age, sql_words
from engramlake.operators import graph as G
from engramlake.operators import memory as M
from engramlake.operators import stats as A

C = Catalog()
X = lambda: F.col("text")
_A = "greatest(0.0, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us({})) / 86400e6)"
_docs = lambda t: t.documents.where("text IS NOT NULL")
_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in M.ROUTES) + " ELSE 'associative' END"
_W = sql_words("text")
_in = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"

C.add("memory_route", lambda t: _docs(t).select("doc_id", M.route(X()).alias("kind")), f"SELECT doc_id, {_ROUTE} AS kind FROM documents WHERE text IS NOT NULL")
C.add("memory_depth", lambda t: _docs(t).select("doc_id", M.hops(M.depth(X())).alias("hops")),
      rf"SELECT doc_id, map {{0: 1, 1: 3, 2: 4, 3: 4}}[CASE WHEN k = 'causal' THEN 3 WHEN regexp_matches(text, '(?i)\b(usually|always|habit|pattern)\b') THEN 2 WHEN k IN ('temporal', 'comparison') THEN 1 WHEN len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda w: w <> '')) > 12 THEN 1 ELSE 0 END] AS hops FROM (SELECT doc_id, text, {_ROUTE} AS k FROM documents WHERE text IS NOT NULL)")
C.add("memory_sentiment", lambda t: _docs(t).select("doc_id", F.round(M.sentiment(X()), 6).alias("valence")),
      f"SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END, 6)::DOUBLE AS valence FROM (SELECT doc_id, len(list_filter({_W}, lambda x: list_contains({_in(M.POSITIVE)}, x))) AS p, len(list_filter({_W}, lambda x: list_contains({_in(M.NEGATIVE)}, x))) AS n FROM documents WHERE text IS NOT NULL)")
_SYN = "map {" + ", ".join(f"'{w}': {_in(g)}" for g in M.SYNONYMS for w in g) + "}"
C.add("memory_expand_terms", lambda t: t.neurons.where("content IS NOT NULL").select("id", F.size(M.expand_terms(F.split(F.lower("content"), " "))).alias("n")),
      f"{{n}} SELECT id, len(list_distinct(list_concat(w, flatten(list_filter(list_transform(w, lambda x: {_SYN}[x]), lambda x: x IS NOT NULL)))))::INT AS n FROM (SELECT id, string_split(lower(content), ' ') AS w FROM n WHERE content IS NOT NULL)")
_WHEN = " ".join(f"WHEN regexp_matches(low, '{p}') THEN {{'start': (date_trunc('{u}', created_at) + INTERVAL ({a * (3 if u == 'quarter' else 1)}) {'MONTH' if u == 'quarter' else u.upper()})::TIMESTAMP, 'end': (date_trunc('{u}', created_at) + INTERVAL ({b * (3 if u == 'quarter' else 1)}) {'MONTH' if u == 'quarter' else u.upper()})::TIMESTAMP}}" for p, u, a, b in M.TIMES)
C.add("memory_time_range", lambda t: _docs(t).where("created_at IS NOT NULL").select("doc_id", M.time_range(X(), F.col("created_at")).alias("r")).where("r IS NOT NULL").select("doc_id", "r.start", "r.end"),
      rf"""WITH d AS (SELECT doc_id, created_at, lower(text) AS low, regexp_extract(lower(text), '\b(\d{{1,3}}) days? ago\b', 1) AS back FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL),
 r AS (SELECT doc_id, CASE WHEN back <> '' THEN {{'start': (date_trunc('day', created_at) - to_days(try_cast(back AS INT)))::TIMESTAMP, 'end': (date_trunc('day', created_at) - to_days(try_cast(back AS INT) - 1))::TIMESTAMP}} {_WHEN} END AS r FROM d)
 SELECT doc_id, r.start AS start, r['end'] AS "end" FROM r WHERE r IS NOT NULL""")
C.add("memory_citation", lambda t: t.documents.select("doc_id", M.citation(F.col("source"), F.col("created_at"), F.col("doc_id")).alias("citation")),
      "SELECT doc_id, '[' || coalesce(source, 'unknown') || ', ' || coalesce(strftime(created_at, '%Y-%m-%d'), 'n.d.') || ', #' || doc_id || ']' AS citation FROM documents")
C.add("memory_trust", lambda t: t.documents.select("doc_id", M.trust(F.lit(None).cast("double"), F.col("memory_type")).alias("trust")),
      "SELECT doc_id, coalesce(map {" + ", ".join(f"'{k}': {v}" for k, v in M.TRUST.items()) + "}[memory_type], 0.5)::DOUBLE AS trust FROM documents")
_DEC = "dc AS (" + " UNION ".join(f"SELECT doc_id, created_at, lower(regexp_extract(m, '{p}', {i})) AS subject, lower(regexp_extract(m, '{p}', {j})) AS value FROM (SELECT doc_id, created_at, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents WHERE text IS NOT NULL)" for p, i, j in M.DECISIONS) + ")"
C.add("memory_decisions", lambda t: M.decisions(t.documents).select("doc_id", "subject", "value"), f"WITH {_DEC} SELECT doc_id, subject, value FROM dc")
C.add("memory_conflicts", lambda t: M.conflicts(M.decisions(t.documents)), f'WITH {_DEC} SELECT subject, count(DISTINCT value) AS "values", count(*) AS claims FROM dc GROUP BY 1 HAVING count(DISTINCT value) > 1')
C.add("memory_resolve", lambda t: M.resolve(M.decisions(t.documents)),
      f"WITH {_DEC}, l AS (SELECT subject, count(DISTINCT value) AS v FROM dc GROUP BY 1) SELECT doc_id, CASE WHEN v = 1 THEN 'agreed' WHEN row_number() OVER (PARTITION BY subject ORDER BY created_at DESC NULLS LAST, doc_id DESC) = 1 THEN 'holds' ELSE 'superseded' END AS standing FROM dc JOIN l USING (subject)")
C.add("memory_auto_resolution", lambda t: t.neurons.select("id", M.auto_resolution(F.coalesce("metadata.priority", F.lit(5)) / 10, age(), age() * 24, F.length("content") > 100, F.coalesce("metadata.superseded", F.lit(False)).cast("int") * 2).alias("verdict")),
      f"{{n}} SELECT id, CASE WHEN coalesce(metadata.priority, 5) / 10 >= 0.8 AND a >= 90 THEN 'keep_new' WHEN a * 24 < 1 AND length(content) > 100 THEN 'keep_new' WHEN coalesce(metadata.superseded, false) THEN 'keep_new' ELSE 'manual' END AS verdict FROM (SELECT *, {_A.format('created_at')} AS a FROM n)")
C.add("memory_prime", lambda t: M.prime(t.co_activations.where("source_anchor IS NOT NULL AND neuron_b IS NOT NULL").select(F.col("source_anchor").alias("session"), F.col("neuron_b").alias("neuron_id"), F.coalesce("binding_strength", F.lit(0.0)).alias("level"), F.floor(age() / 60).alias("age"))),
      f"{{co}} SELECT * FROM (SELECT source_anchor AS session, neuron_b AS neuron_id, round(max(coalesce(binding_strength, 0) * pow(0.7, floor({_A.format('created_at')} / 60))), 9) AS boost FROM co WHERE source_anchor IS NOT NULL AND neuron_b IS NOT NULL GROUP BY 1, 2) WHERE boost >= 0.05")
C.add("memory_depth_priors", lambda t: M.depth_priors(t.events.select(F.col("event_type").alias("arm"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("success"))),
      "SELECT event_type AS arm, round((count(*) FILTER (WHERE value > 50) + 1) / (count(*) + 2), 6) AS mean, count(*) AS trials FROM events GROUP BY 1")
C.add("memory_allocate", lambda t: M.allocate(t.fibers.select(F.col("brain_id").alias("group"), "id", F.coalesce("salience", F.lit(0.0)).alias("score")), total=4000),
      '{f} WITH s AS (SELECT brain_id, sum(coalesce(salience, 0)) AS s FROM f GROUP BY 1) SELECT brain_id AS "group", id, greatest(20, CASE WHEN s > 0 THEN floor(coalesce(salience, 0) / s * 4000) ELSE 0 END)::INT AS budget FROM f JOIN s USING (brain_id)')
C.add("memory_hot_index", lambda t: M.hot_index(t.fibers.select(F.col("brain_id").alias("group"), "id", F.coalesce("salience", F.lit(0.0)).alias("score"), "summary")).select("group", "id", "summary"),
      '{f} SELECT brain_id AS "group", id, summary[1:80] AS summary FROM f QUALIFY row_number() OVER (PARTITION BY brain_id ORDER BY coalesce(salience, 0) DESC, id) <= 20')
C.add("memory_recent_cooccurrence", lambda t: M.recent_cooccurrence(t.fibers, seconds=7200),
      """{f} WITH x AS (SELECT brain_id, id, epoch_us(time_start) AS t FROM f WHERE time_start IS NOT NULL AND time_end IS NOT NULL), y AS (SELECT brain_id, id, coalesce(salience, 0) AS s, epoch_us(time_end) AS u FROM f WHERE time_end IS NOT NULL)
 SELECT x.id AS fiber_id, y.id AS other_id, round(greatest(0.1, 0.4 * (1 - (t - u) / 7200e6)), 6) AS weight FROM x JOIN y ON x.brain_id = y.brain_id AND x.id <> y.id AND u <= t AND u >= t - 7200e6 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s DESC, y.id) <= 3""")
C.add("memory_tag_drift", lambda t: M.tag_drift(t.fibers, t.fibers.select(F.col("id").alias("fiber_id"), F.coalesce("agent_tags", F.array().cast("array<string>")).alias("tags")), limit=0.6),
      """{ft} WITH o AS (SELECT id AS fiber_id, list_distinct(list_filter(list_concat(coalesce(auto_tags, []), coalesce(agent_tags, [])), lambda x: x IS NOT NULL)) AS own, list_distinct(list_filter(coalesce(agent_tags, []), lambda x: x IS NOT NULL)) AS tags FROM f)
 SELECT fiber_id, round(1 - CASE WHEN len(own) = 0 THEN 0 ELSE len(tags) / len(own) END, 6)::DOUBLE AS drift FROM o WHERE round(1 - CASE WHEN len(own) = 0 THEN 0 ELSE len(tags) / len(own) END, 6) > 0.6""")
C.add("memory_cluster_tags", lambda t: M.cluster_tags(A.co_activation_counts(t.co_activations, least=6), t.neurons))
C.add("memory_across_brains", lambda t: M.across_brains(t.neurons),
      "{n} SELECT lower(trim(content)) AS text, arg_min(id, (-coalesce(metadata.priority, 0), id)) AS id, arg_min(brain_id, (-coalesce(metadata.priority, 0), id)) AS brain_id, count(DISTINCT brain_id) AS brains FROM n WHERE trim(content) <> '' GROUP BY 1")


def _active(t):
    s = t.states.where("activation_level >= 0.2")
    return t.neurons.select(F.col("brain_id").alias("query_id"), F.col("id").alias("neuron_id"), F.coalesce("metadata.is_anchor", F.lit(False)).alias("crossed")).join(s, "neuron_id").select("query_id", F.col("neuron_id").alias("node"), F.col("activation_level").alias("level"), "crossed")


C.add("memory_answer_method", lambda t: M.answer_method(_active(t)), """{st} WITH a AS (SELECT brain_id AS query_id, id AS node, least(1.0, activation_level * CASE WHEN coalesce(metadata.is_anchor, false) THEN 1.5 ELSE 1.0 END) AS score FROM n JOIN st ON neuron_id = id WHERE activation_level >= 0.2)
 SELECT query_id, CASE WHEN max(score) > 0.8 THEN 'single' WHEN count(*) > 5 THEN 'summary' ELSE 'several' END AS method, arg_max(node, (score, node)) AS node, round(max(score), 6) AS score FROM a GROUP BY 1""")
C.add("memory_chunks", lambda t: M.chunk_active(_active(t), G.directed(t.synapses)))
C.add("memory_episodic_blocker", lambda t: t.fibers.select("id", M.episodic_blocker(age() * 24, F.coalesce("frequency", F.lit(0))).alias("gate")),
      f"{{f}} SELECT id, CASE WHEN {_A.format('created_at')} * 24 < 168 THEN 'time_gate' WHEN coalesce(frequency, 0) < 3 THEN 'spacing_gate' ELSE 'ready' END AS gate FROM f")
C.add("memory_tool_success", lambda t: M.tool_success(t.events.select(F.col("event_type").alias("tool"), (F.col("user_id") % 10).alias("context"), (F.col("value") > 50).alias("success"))),
      "SELECT event_type AS tool, user_id % 10 AS context, count(*) AS n, round(avg((value > 50)::INT), 6) AS rate FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
C.add("memory_follow_ups", lambda t: M.follow_ups(t.events.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), "event_id", F.array("event_type").alias("topics")), window_s=86400),
      """WITH s AS (SELECT event_type AS a, ts, lead(event_type) OVER w AS b, lead(ts) OVER w AS u FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))
 SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL AND a <> b AND (epoch_us(u) - epoch_us(ts)) / 1e6 <= 86400 GROUP BY 1, 2 HAVING count(*) >= 3""")
C.add("memory_reviews_due", lambda t: t.fibers.where((age("last_conducted") > 7) & (F.col("salience") > 0.5)).orderBy(F.desc("salience"), "id").limit(100).select("id", F.coalesce("summary", F.lit("")).alias("summary")),
      f"{{f}} SELECT id, coalesce(summary, '') AS summary FROM f WHERE last_conducted IS NOT NULL AND {_A.format('last_conducted')} > 7 AND salience > 0.5 ORDER BY salience DESC, id LIMIT 100")
