"""Scans, lookups, predicates, vectors and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, age, now, sql_tokens
from engramlake.functions import scalar as S
from engramlake.operators import scans as O

C = Catalog()
HUB = "neu-0000000000"
_TOK = sql_tokens("content")


C.add("scan_get_neuron", lambda t: O.by_ids(t.neurons, [HUB]).select("id", "type", "content"), f"{{n}} SELECT id, type, content FROM n WHERE id = '{HUB}'")
C.add("scan_get_neurons_batch", lambda t: O.by_ids(t.neurons, [HUB, "neu-f2dac9adc6", "missing"]).select("id", "brain_id"), f"{{n}} SELECT id, brain_id FROM n WHERE id IN ('{HUB}', 'neu-f2dac9adc6', 'missing')")
C.add("scan_find_neurons", lambda t: O.unique(O.find_neurons(t.raw("neurons"), type="concept", contains="budget", since="2025-01-01", until="2026-12-31")).select("id", "content"),
      "{n} SELECT id, content FROM n WHERE type = 'concept' AND contains(lower(content), 'budget') AND created_at BETWEEN '2025-01-01' AND '2026-12-31'")
C.add("scan_match_tokens", lambda t: O.unique(O.match_tokens(t.raw("neurons"), "merge plan")).select("id"),
      f"{{n}} SELECT id FROM n WHERE list_has_all({_TOK}, ['merge', 'plan'])")
C.add("scan_match_script_tokens", lambda t: O.unique(O.match_tokens(t.raw("neurons"), "индекс якорей")).select("id").unionByName(O.unique(O.match_tokens(t.raw("neurons"), "索引")).select("id")).distinct(),
      f"{{n}} SELECT id FROM n WHERE list_has_all({_TOK}, ['индекс', 'якорей']) OR list_contains({_TOK}, '索引')")
_ASKED = [(1, "orphan synapses"), (2, "merge plan budget"), (3, "priming cache"), (4, "длинные трассы"), (5, "同步中心")]
C.add("scan_bm25", lambda t: O.bm25(t.neurons, t.spark.createDataFrame(_ASKED, "query_id int, query string")).select("query_id", "id", "score", "rank"),
      f"""{{n}} WITH docs AS (SELECT id, {_TOK} AS w FROM n WHERE length(content) >= 25),
 s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM docs), q(query_id, word) AS (VALUES (1, 'orphan'), (1, 'synapses'), (2, 'merge'), (2, 'plan'), (2, 'budget'), (3, 'priming'), (3, 'cache'), (4, 'длинные'), (4, 'трассы'), (5, '同步'), (5, '步中'), (5, '中心')),
 tf AS (SELECT id, len(w) AS l, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM docs) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 9) AS score FROM tf JOIN df USING (word) JOIN q USING (word) CROSS JOIN s GROUP BY 1, 2)
 SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10""")
C.add("scan_page_after", lambda t: O.page_after(t.neurons, "neu-8", limit=50).select("id"), "{n} SELECT id FROM n WHERE id > 'neu-8' ORDER BY id LIMIT 50")
C.add("scan_exact_batch", lambda t: O.exact_batch(t.raw("neurons"), ["token budget", "hot index", "none such"]), "{n} SELECT content, min(id) AS id FROM n WHERE content IN ('token budget', 'hot index', 'none such') GROUP BY 1")
C.add("scan_suggest", lambda t: O.suggest(t.neurons, t.states, "INDEX"),
      "{st} SELECT id, content, round(0.1 * access_frequency + 0.5 * activation_level, 6) AS score FROM n JOIN st ON id = neuron_id WHERE contains(lower(content), 'index') ORDER BY score DESC, id LIMIT 5")
C.add("scan_states", lambda t: t.states, "{st} SELECT * FROM st")
C.add("scan_has_hash", lambda t: t.neurons.where(F.col("content_hash") != 0).groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1"),
      "{n} SELECT content_hash, count(*) AS copies FROM n WHERE content_hash <> 0 GROUP BY 1 HAVING count(*) > 1")
C.add("scan_synapses", lambda t: O.unique(O.find_synapses(t.raw("synapses"), source=HUB, least_weight=0.5)).select("id", "target_id", "type", "weight"), f"{{e}} SELECT id, target_id, type, weight FROM e WHERE source_id = '{HUB}' AND weight >= 0.5")
C.add("scan_adjacency", lambda t: O.adjacency(t.raw("synapses"), [HUB, "neu-f2dac9adc6"], "in").distinct(), f"{{e}} SELECT target_id AS neuron_id, id AS synapse_id, type, weight FROM e WHERE target_id IN ('{HUB}', 'neu-f2dac9adc6')")
C.add("scan_dormant", lambda t: t.states.where("access_frequency = 0").select("neuron_id"), "{st} SELECT neuron_id FROM st WHERE access_frequency = 0")
C.add("scan_find_fibers", lambda t: O.unique(O.find_fibers(t.raw("fibers"), contains=HUB, window=("2025-03-01", "2025-09-01"), least_salience=0.3)).select("id", "salience"),
      f"{{f}} SELECT id, salience FROM f WHERE list_contains(neuron_ids, '{HUB}') AND time_start <= '2025-09-01' AND time_end >= '2025-03-01' AND salience >= 0.3")
C.add("scan_find_fibers_tags", lambda t: O.unique(O.find_fibers(t.raw("fibers"), tags=["sync"])).select("id"), "{f} SELECT id FROM f WHERE list_contains(list_concat(coalesce(auto_tags, []), coalesce(agent_tags, [])), 'sync')")
C.add("scan_fibers_of", lambda t: O.fibers_of(t.fibers, [HUB, "neu-f2dac9adc6"]).select("id", "salience"), f"{{f}} SELECT id, salience FROM f WHERE list_has_any(neuron_ids, ['{HUB}', 'neu-f2dac9adc6']) ORDER BY salience DESC NULLS LAST, id LIMIT 20")
C.add("scan_recent_fibers", lambda t: t.fibers.orderBy(F.desc("created_at"), "id").limit(10).select("id", "created_at"), "{f} SELECT id, created_at FROM f ORDER BY created_at DESC NULLS LAST, id LIMIT 10")
_TM = """tm AS (SELECT doc_id, coalesce(memory_type, 'fact') AS memory_type, CASE WHEN memory_type IN ('decision', 'instruction') THEN 8 WHEN memory_type IN ('todo', 'error') THEN 7 ELSE 5 END AS priority,
 brain_id, created_at, created_at + to_days(CASE memory_type WHEN 'todo' THEN 30 WHEN 'context' THEN 7 WHEN 'error' THEN 90 END) AS expires_at FROM documents)"""
C.add("scan_typed_memories", lambda t: O.typed_memories(t.documents).where("priority >= 7").select("doc_id", "memory_type", "priority"), f"WITH {_TM} SELECT doc_id, memory_type, priority FROM tm WHERE priority >= 7")
C.add("scan_expired_memories", lambda t: O.typed_memories(t.documents).where(F.col("expires_at") < now()).select("doc_id", "expires_at"), f"WITH {_TM} SELECT doc_id, expires_at FROM tm WHERE expires_at < '{NOW}'")
C.add("scan_expiring_memories", lambda t: O.typed_memories(t.documents).where("expires_at > TIMESTAMP_NTZ '2025-06-01' AND expires_at <= TIMESTAMP_NTZ '2025-06-08'").select("doc_id"),
      f"WITH {_TM} SELECT doc_id FROM tm WHERE expires_at > '2025-06-01' AND expires_at <= '2025-06-08'")
C.add("scan_project_memories", lambda t: O.typed_memories(t.documents).where("brain_id = 'brain-atlas'").where(F.coalesce(F.col("expires_at") >= now(), F.lit(True))).orderBy(F.desc("priority"), F.desc("created_at"), "doc_id").limit(100).select("doc_id", "priority"),
      f"WITH {_TM} SELECT doc_id, priority FROM tm WHERE brain_id = 'brain-atlas' AND coalesce(expires_at >= '{NOW}', true) ORDER BY priority DESC, created_at DESC NULLS LAST, doc_id LIMIT 100")
C.add("scan_projects", lambda t: t.raw("training_configs").select("config_id", "brain_name", "domain_tag").orderBy("config_id"), "SELECT config_id, brain_name, domain_tag FROM training_configs")
C.add("scan_scope_boost", lambda t: t.documents.where("brain_id = 'brain-atlas'").select("doc_id", F.round(1 + 0.5 * S.clamp(1 - S.days_between(now(), F.col("created_at")) / 365, 0.0, 1.0), 6).alias("boost")),
      f"SELECT doc_id, round(1 + 0.5 * greatest(0.0, least(1.0, 1 - greatest(0.0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400e6 / 365)), 6) AS boost FROM documents WHERE brain_id = 'brain-atlas'")
C.add("scan_fiber_valid_at", lambda t: O.unique(t.raw("fibers").where(O.valid_at("2025-06-01"))).select("id"), "{f} SELECT id FROM f WHERE coalesce(time_start = time_end, false) OR (coalesce(time_start <= '2025-06-01', true) AND coalesce(time_end >= '2025-06-01', true))")
_place = lambda: {"lat": F.pmod(F.col("s_suppkey") * 37, F.lit(170)) - 85.0, "lon": F.pmod(F.col("s_suppkey") * 91, F.lit(360)) - 180.0}
C.add("scan_geo_within", lambda t: O.within(t.raw("supplier").withColumns(_place()), 40.0, 10.0, 3_000_000.0).select("s_suppkey"),
      """WITH p AS (SELECT s_suppkey, (s_suppkey * 37) % 170 - 85.0 AS lat, (s_suppkey * 91) % 360 - 180.0 AS lon FROM supplier)
 SELECT s_suppkey FROM p WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(40.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(10.0) - radians(lon)) / 2), 2)))) <= 3000000.0""")

_Q = [round(((i * 37) % 64 - 31.5) / 32, 6) for i in range(64)]
_GOOD = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
C.add("vector_knn", lambda t: O.knn(t.neurons, _Q), f"{{n}} SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS similarity FROM n WHERE {_GOOD} ORDER BY similarity DESC, id LIMIT 10")
C.add("vector_dedup_ladder", lambda t: O.dedup_ladder(t.neurons, t.neurons.groupBy("brain_id").agg(F.min(F.when(O.usable("embedding", 64), F.struct("id", "embedding"))).alias("m")).where("m IS NOT NULL").select("m.*")),
      f"""{{n}} WITH g AS (SELECT id, brain_id, embedding::DOUBLE[] AS v FROM n WHERE {_GOOD}), q AS (SELECT arg_min(id, id) AS id, arg_min(v, id) AS v FROM g GROUP BY brain_id),
 s AS (SELECT q.id, g.id AS other, round(list_cosine_similarity(g.v, q.v), 6) AS s FROM q JOIN g ON g.id <> q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(g.v, q.v), 6) DESC, g.id) = 1)
 SELECT id, other, s AS similarity, CASE WHEN s >= 0.85 THEN 'duplicate' WHEN s < 0.75 THEN 'distinct' ELSE 'undecided' END AS verdict FROM s WHERE s > 0""")
C.add("vector_fiber_centroids", lambda t: _fiber_centroids(t), f"""{{fm, n}} WITH v AS (SELECT fiber_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM fm JOIN n ON n.id = neuron_id WHERE {_GOOD}),
 c AS (SELECT fiber_id, i, avg(x) AS x FROM v GROUP BY 1, 2), m AS (SELECT fiber_id, list(x ORDER BY i) AS c FROM c GROUP BY 1)
 SELECT fiber_id, round(list_cosine_similarity(c, {_Q}::DOUBLE[]), 6) AS similarity FROM m ORDER BY similarity DESC, fiber_id LIMIT 10""")


def _fiber_centroids(t):
    """Fibers by the cosine of their members' mean vector to a query; means are map-side sums."""
    from engramlake.catalog.base import members

    good = t.neurons.where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    rows = members(t.fibers).join(good.select(F.col("id").alias("neuron_id"), "embedding"), "neuron_id")
    mean = F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(64)])
    return O.knn(rows.groupBy("fiber_id").agg(mean.alias("embedding")), _Q, key="fiber_id")


_AGE = "greatest(0.0, (epoch_us(TIMESTAMP '" + NOW + "') - epoch_us(created_at)) / 86400e6)"
C.add("fn_freshness", lambda t: t.neurons.select("id", S.freshness(age()).alias("freshness"), S.freshness_bucket(age()).alias("bucket")),
      f"{{n}} SELECT id, CASE WHEN a < 7 THEN 1.0 WHEN a < 30 THEN 0.8 WHEN a < 90 THEN 0.5 WHEN a < 365 THEN 0.3 ELSE 0.1 END::DOUBLE AS freshness, CASE WHEN a < 7 THEN 'fresh' WHEN a < 30 THEN 'recent' WHEN a < 90 THEN 'aging' WHEN a < 365 THEN 'stale' ELSE 'ancient' END AS bucket FROM (SELECT id, {_AGE} AS a FROM n)")
C.add("fn_priority_multiplier", lambda t: t.neurons.select("id", F.round(S.priority_multiplier(F.coalesce(F.col("metadata.priority"), F.lit(5))), 6).alias("m")),
      "{n} SELECT id, round(1 + 0.3 * (greatest(0, least(10, coalesce(metadata.priority, 5))) - 5) / 5, 6) AS m FROM n")
C.add("fn_token_estimate", lambda t: t.documents.select("doc_id", S.token_estimate(F.col("text")).alias("tokens")),
      r"SELECT doc_id, floor(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '')) * 1.3)::INT AS tokens FROM documents")
C.add("fn_char_entropy", lambda t: t.neurons.where("content IS NOT NULL").select("id", F.round(S.char_entropy(F.col("content")), 6).alias("bits")),
      """{n} WITH c AS (SELECT id, unnest(list_transform(range(1, length(content) + 1), lambda i: substring(content, i, 1))) AS ch FROM n WHERE content <> ''), k AS (SELECT id, ch, count(*) AS k FROM c GROUP BY 1, 2), z AS (SELECT id, sum(k) AS s FROM k GROUP BY 1)
 SELECT id, round(-sum(k::DOUBLE / s * log2(k::DOUBLE / s)), 6) + 0.0 AS bits FROM k JOIN z USING (id) GROUP BY 1 UNION ALL SELECT id, 0.0 FROM n WHERE content = ''""")
C.add("fn_levenshtein", lambda t: O.unique(t.raw("neurons").where(F.levenshtein(F.lower("content"), F.lit("anchor index"), 5) >= 0)).select("id", F.levenshtein(F.lower("content"), F.lit("anchor index")).alias("distance")),
      "{n} SELECT id, levenshtein(lower(content), 'anchor index')::INT AS distance FROM n WHERE levenshtein(lower(content), 'anchor index') <= 5")
C.add("fn_prefix_variants", lambda t: t.neurons.where("content IS NOT NULL").select("id", F.substring("content", 1, 3).alias("p3"), F.expr("left(content, greatest(0, length(content) - 2))").alias("stem")),
      "{n} SELECT id, substring(content, 1, 3) AS p3, substring(content, 1, greatest(0, length(content) - 2)) AS stem FROM n WHERE content IS NOT NULL")
C.add("fn_idf", lambda t: _idf(t), f"""{{n}} WITH w AS (SELECT DISTINCT id, unnest({_TOK}) AS word FROM n), d AS (SELECT word, count(*) AS df FROM w GROUP BY 1), m AS (SELECT count(*) AS n FROM n)
 SELECT word, df, round(ln((m.n + 1) / (1 + df)) / ln(m.n + 1), 6) AS idf, greatest(1, least(5, ceil(round(ln((m.n + 1) / (1 + df)) / ln(m.n + 1), 6) * 5)))::INT AS anchors FROM d CROSS JOIN m WHERE df >= 3""")


def _idf(t):
    words = t.neurons.select("id", F.explode(F.array_distinct(S.search_tokens(F.col("content")))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df")).where("df >= 3")
    score = F.round(S.idf(F.col("df"), F.col("n")), 6)
    return df.join(F.broadcast(t.neurons.agg(F.count("*").alias("n")))).select("word", "df", score.alias("idf"), S.anchor_limit(score).alias("anchors"))


C.add("fn_decay_rate", lambda t: t.documents.select("doc_id", S.decay_rate(F.col("memory_type")).alias("rate")),
      "SELECT doc_id, coalesce(map {" + ", ".join(f"'{k}': {v}" for k, v in S.DECAY_RATE.items()) + "}[memory_type], 0.02)::DOUBLE AS rate FROM documents")
_SYM = ("related_to", "similar_to", "co_occurs", "contradicts", "alias")
C.add("fn_edge_id", lambda t: t.synapses.select("id", S.deterministic_edge_id(F.col("source_id"), F.col("target_id"), F.col("type"), F.col("type").isin(*_SYM)).alias("edge_id")),
      f"{{e}} SELECT id, sha256(concat_ws('|', CASE WHEN type IN {_SYM} THEN least(source_id, target_id) ELSE source_id END, CASE WHEN type IN {_SYM} THEN greatest(source_id, target_id) ELSE target_id END, type)) AS edge_id FROM e")
C.add("fn_normalise", lambda t: t.neurons.select("id", S.normalise_search(F.col("content")).alias("text")), "{n} SELECT id, lower(trim(content)) AS text FROM n")
_HASHES = """{{n}} WITH h AS (SELECT min(id) AS id, content_hash AS h FROM n WHERE content_hash <> 0 GROUP BY 2)
 SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= {}"""
C.add("fn_hash_pairs", lambda t: O.near_hashes(t.raw("neurons"), limit=7), _HASHES.format(7))
C.add("fn_near_hashes", lambda t: O.near_hashes(t.raw("neurons"), limit=10), _HASHES.format(10))
