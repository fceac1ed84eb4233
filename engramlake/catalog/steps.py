"""Further encoding steps, links by meaning, compressed fibers."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import Catalog, members, sql_words
from engramlake.functions import text as T
from engramlake.operators import encoding as E
from engramlake.operators import linking as L
from engramlake.operators import memory as M

C = Catalog()
_D = "documents WHERE text IS NOT NULL"
_found = lambda p: f"list_distinct(regexp_extract_all(lower(text), '{p}', 1))"
C.add("encode_actions", lambda t: E.actions(t.documents), f"SELECT doc_id, unnest({_found(E.ACTION)}) AS target, 'involves' AS type, 0.6::DOUBLE AS weight FROM {_D}")
C.add("encode_goals", lambda t: E.goals(t.documents), f"SELECT doc_id, unnest({_found(E.GOAL)}) AS target, 'intends' AS type, 0.7::DOUBLE AS weight FROM {_D}")
_in = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
C.add("encode_feelings", lambda t: E.feelings(t.documents.where("text IS NOT NULL"), M.sentiment(F.col("text"))),
      f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM {_D}), c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_in(M.POSITIVE)}, x))) AS p, len(list_filter(w, lambda x: list_contains({_in(M.NEGATIVE)}, x))) AS n FROM w)
 SELECT doc_id, CASE WHEN p > n THEN 'positive' ELSE 'negative' END AS state, round(abs(p - n) / (p + n) * 0.8, 6)::DOUBLE AS weight FROM c WHERE p <> n""")
C.add("encode_copies", lambda t: E.copies(t.documents),
      "WITH d AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lower(trim(text)) ORDER BY created_at NULLS LAST, doc_id) AS original FROM documents WHERE text IS NOT NULL AND trim(text) <> '') SELECT doc_id, original FROM d WHERE doc_id <> original")
_TAGS = "list_filter(coalesce({}, []), lambda x: x IS NOT NULL)"
C.add("encode_confirmed", lambda t: E.confirmed(t.fibers), f"{{f}} SELECT id AS fiber_id, len(list_intersect({_TAGS.format('auto_tags')}, {_TAGS.format('agent_tags')}))::INT AS both, 0.1::DOUBLE AS boost FROM f WHERE len(list_intersect({_TAGS.format('auto_tags')}, {_TAGS.format('agent_tags')})) > 0")
C.add("encode_agent_links", lambda t: E.agent_links(t.fibers, members(t.fibers), t.neurons),
      "{fm, n} WITH t AS (SELECT DISTINCT id AS fiber_id, unnest(agent_tags) AS tag, auto_tags FROM f) SELECT t.fiber_id, neuron_id, tag, 0.3::DOUBLE AS weight FROM t JOIN fm ON fm.fiber_id = t.fiber_id JOIN n ON n.id = neuron_id WHERE tag IS NOT NULL AND NOT list_contains(coalesce(auto_tags, []), tag) AND contains(lower(content), lower(tag))")
C.add("encode_same_content", lambda t: E.same_content_links(t.neurons.where("created_at >= TIMESTAMP_NTZ '2025-09-01'"), t.neurons.where("created_at < TIMESTAMP_NTZ '2025-09-01'")),
      """{n} WITH w AS (SELECT brain_id, id, type, content FROM n WHERE created_at >= '2025-09-01' AND content IS NOT NULL AND trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY brain_id ORDER BY created_at, id) <= 20)
 SELECT w.id AS source_id, o.id AS target_id, 0.4::DOUBLE AS weight FROM w JOIN n o ON o.brain_id = w.brain_id AND o.type = w.type AND o.content = w.content WHERE o.created_at < '2025-09-01' QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY o.id) <= 5""")
_ENT = f"regexp_extract_all(text, '{T.ENTITY}', 1)"
C.add("encode_shared_entities", lambda t: E.shared_entity_links(t.documents.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.transform(T.entities(F.col("text")), lambda e: F.lower(e)))).alias("entity"))),
      f"""WITH m AS (SELECT DISTINCT doc_id, lower(unnest({_ENT})) AS entity FROM {_D}), r AS (SELECT * FROM m WHERE entity IN (SELECT entity FROM m GROUP BY 1 HAVING count(*) <= 50)),
 p AS (SELECT x.doc_id, y.doc_id AS other, x.entity FROM r x JOIN r y ON x.entity = y.entity AND y.doc_id < x.doc_id QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.entity ORDER BY y.doc_id DESC) <= 5),
 s AS (SELECT doc_id, other, count(*) AS shared FROM p GROUP BY 1, 2)
 SELECT doc_id, other, shared, round(least(0.7, 0.3 + 0.1 * (shared - 1)), 6)::DOUBLE AS weight FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, other DESC) <= 15""")
C.add("encode_context", lambda t: E.context(t.documents),
      "SELECT doc_id, sha256(concat_ws('|', coalesce(brain_id, ''), coalesce(source, ''), coalesce(memory_type, ''), lower(coalesce(lang, '')), coalesce(strftime(created_at, '%Y-%m-%d'), ''))) AS fingerprint FROM documents")
C.add("vector_semantic_links", lambda t: L.semantic_links(t.neurons, t.synapses),
      """{n, e} WITH g AS (SELECT id, embedding::DOUBLE[] AS v FROM n WHERE type IN ('concept', 'entity') AND trim(content) <> '' AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 r AS (SELECT x.id, y.id AS other, round(list_cosine_similarity(x.v, y.v), 9) AS c FROM g x JOIN g y ON x.id <> y.id WHERE round(list_cosine_similarity(x.v, y.v), 9) >= 0.7 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.v, y.v), 9) DESC, y.id) <= 5),
 p AS (SELECT least(id, other) AS a, greatest(id, other) AS b, max(c) AS c FROM r GROUP BY 1, 2)
 SELECT a, b, round(c, 6) AS cos, round(c * 0.6, 6) AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(source_id, target_id) = a AND greatest(source_id, target_id) = b)""")
_FC = """fp AS (SELECT f.id AS fiber_id, m, min(pos) AS pos FROM (SELECT id, unnest(neuron_ids) AS m, generate_subscripts(neuron_ids, 1) AS pos FROM f) f WHERE m IS NOT NULL GROUP BY 1, 2),
 fc AS (SELECT fiber_id, list(content ORDER BY pos) AS contents FROM fp JOIN n ON n.id = m WHERE content IS NOT NULL GROUP BY 1),
 sp AS (SELECT f.id AS fiber_id, s, min(pos) AS pos FROM (SELECT id, unnest(synapse_ids) AS s, generate_subscripts(synapse_ids, 1) AS pos FROM f) f WHERE s IS NOT NULL GROUP BY 1, 2),
 fr AS (SELECT fiber_id, list(type ORDER BY pos) AS relations FROM sp JOIN e ON e.id = s WHERE type IS NOT NULL GROUP BY 1),
 fx AS (SELECT f.id AS fiber_id, summary, list_filter(coalesce(contents, []), lambda c: c <> '') AS c, coalesce(relations, []) AS r FROM f LEFT JOIN fc ON fc.fiber_id = f.id LEFT JOIN fr ON fr.fiber_id = f.id)"""
_fc = lambda t: L.fiber_contents(t.fibers, t.neurons, t.synapses)
C.add("compress_template", lambda t: _fc(t).select("fiber_id", L.template(F.col("contents"), F.col("relations")).alias("text")),
      f"""{{n, e, f}} WITH {_FC} SELECT fiber_id, CASE WHEN len(c) = 0 THEN '' WHEN len(c) = 1 THEN c[1] ELSE array_to_string(list_transform(range(1, len(c)), lambda i: concat_ws(' ', c[i], coalesce(r[i], r[1], 'related_to'), c[i + 1])), '; ') END AS text FROM fx""")
_PARTS = r"list_filter(list_transform(regexp_extract_all(summary, '[^.!?。！？]+[.!?。！？]*'), lambda s: trim(s)), lambda s: s <> '')"
_DENS = r"least(1.0, len(list_filter(c, lambda x: contains(lower({0}), lower(x)))) / len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')))"
C.add("compress_entities", lambda t: _fc(t).where("summary IS NOT NULL").select("fiber_id", L.entity_preserving(F.col("summary"), F.col("contents")).alias("text")),
      f"{{n, e, f}} WITH {_FC}, ps AS (SELECT fiber_id, c, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM (SELECT fiber_id, c, {_PARTS} AS ps FROM fx WHERE summary IS NOT NULL)), k AS (SELECT fiber_id, string_agg(s, ' ' ORDER BY i) AS text FROM ps WHERE {_DENS.format('s')} > 0 GROUP BY 1) SELECT fx.fiber_id, coalesce(text, '') AS text FROM fx LEFT JOIN k ON k.fiber_id = fx.fiber_id WHERE summary IS NOT NULL")
C.add("compress_extractive", lambda t: _fc(t).where("summary IS NOT NULL").select("fiber_id", L.extractive(F.col("summary"), F.col("contents"), 1).alias("text")),
      f"{{n, e, f}} WITH {_FC}, ps AS (SELECT fiber_id, c, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM (SELECT fiber_id, c, {_PARTS} AS ps FROM fx WHERE summary IS NOT NULL)), b AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY fiber_id ORDER BY i > 1, -{_DENS.format('s')}, i) <= 1), k AS (SELECT fiber_id, string_agg(s, ' ' ORDER BY i) AS text FROM b GROUP BY 1) SELECT fx.fiber_id, coalesce(text, '') AS text FROM fx LEFT JOIN k ON k.fiber_id = fx.fiber_id WHERE summary IS NOT NULL")
C.add("text_entity_density", lambda t: _fc(t).where("summary IS NOT NULL").select("fiber_id", F.round(L.entity_density(F.col("summary"), F.col("contents")), 6).alias("density")),
      f"{{n, e, f}} WITH {_FC} SELECT fiber_id, CASE WHEN trim(summary) = '' THEN 0.0 ELSE round({_DENS.format('summary')}, 6)::DOUBLE END AS density FROM fx WHERE summary IS NOT NULL")
