"""Text functions, encoding steps, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import Catalog, sql_words
from engramlake.functions import text as T
from engramlake.plans import encode as P

C = Catalog()
X = lambda: F.col("text")
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
_WORDS = sql_words("text")


def _first_distinct(expr: str, k: int) -> str:
    return f"list_filter({expr}, lambda w, i: list_position({expr}, w) = i)[1:{k}]"


_KEYS = _first_distinct(f"list_filter({_WORDS}, lambda w: NOT list_contains({_STOP}, w))", 10)
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in T.TYPES) + " ELSE 'fact' END"
_m = lambda p: f"regexp_matches(lower(text), '{p}')"

_FOUND = f"regexp_extract_all(text, '{T.ENTITY}', 1)"
_ENTS = f"list_filter({_FOUND}, lambda w, i: list_position({_FOUND}, w) = i)"

C.add("text_keywords", lambda t: t.documents.select("doc_id", T.keywords(X()).alias("keywords")), f"SELECT doc_id, {_KEYS} AS keywords FROM documents")
C.add("text_entities", lambda t: t.documents.select("doc_id", T.entities(X()).alias("entities")), f"SELECT doc_id, {_ENTS} AS entities FROM documents")
C.add("text_memory_type", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", T.memory_type(X()).alias("suggested")), f"SELECT doc_id, {_TYPE} AS suggested FROM documents WHERE text IS NOT NULL")
C.add("text_structure", lambda t: t.raw("training_files").dropDuplicates(["file_id"]).select("file_id", T.structure(F.col("body")).alias("structure")))
C.add("text_importance", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", T.importance(X()).alias("importance")),
      f"SELECT doc_id, greatest(1, least(10, 5 + CASE WHEN {_m(T.CAUSAL)} THEN 1 ELSE 0 END + CASE WHEN {_m(chr(92) + 'b(decided|decision|never|must|critical)' + chr(92) + 'b')} THEN 2 ELSE 0 END + CASE WHEN length(text) > 200 THEN 1 ELSE 0 END - CASE WHEN length(text) < 20 THEN 2 ELSE 0 END))::INT AS importance FROM documents WHERE text IS NOT NULL")
C.add("text_quality", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", T.quality(X()).alias("quality")),
      f"SELECT doc_id, ((length(text) >= 20)::INT + (length(text) >= 50)::INT + {_m(T.CAUSAL)}::INT + {_m(T.TEMPORAL)}::INT + {_m(T.COMPARATIVE)}::INT + ({_TYPE} <> 'fact')::INT)::INT AS quality FROM documents WHERE text IS NOT NULL")
C.add("text_write_gate", lambda t: t.documents.where("text IS NOT NULL").where((T.quality(X()) >= 2) & (F.length("text") >= 20)).select("doc_id"),
      f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) >= 20 AND (length(text) >= 20)::INT + (length(text) >= 50)::INT + {_m(T.CAUSAL)}::INT + {_m(T.TEMPORAL)}::INT + {_m(T.COMPARATIVE)}::INT + ({_TYPE} <> 'fact')::INT >= 2")
C.add("text_secrets", lambda t: t.neurons.where("content IS NOT NULL").select("id", T.secrets(F.col("content")).alias("kinds")).where("size(kinds) > 0"),
      "{n} SELECT id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p, _ in T.SECRETS) + "], lambda x: x IS NOT NULL) AS kinds FROM n WHERE content IS NOT NULL AND (" + " OR ".join(f"regexp_matches(content, '{p}')" for _, p, _ in T.SECRETS) + ")")
C.add("text_redact_secrets", lambda t: t.neurons.where("content IS NOT NULL").select("id", F.sha2("content", 256).alias("original"), T.redact_secrets(F.col("content")).alias("content")),
      "{n} SELECT id, sha256(content) AS original, " + __import__("functools").reduce(lambda s, x: f"regexp_replace({s}, '{x[1]}', '[{x[0].upper()}]', 'g')", [x for x in T.SECRETS if x[2] >= 2], "content") + " AS content FROM n WHERE content IS NOT NULL")
C.add("text_arousal", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", F.round(T.arousal(X()), 6).alias("arousal")),
      r"SELECT doc_id, round(least(1.0, 0.3 * len(regexp_extract_all(lower(text), '\b(critical|urgent|never|fails?|failed|broken|stop)\b')) + 0.2 * len(regexp_extract_all(text, '!'))), 6)::DOUBLE AS arousal FROM documents WHERE text IS NOT NULL")
C.add("text_repetitive", lambda t: t.documents.where(T.repetitive(X())).select("doc_id"),
      f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 12 AND len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) * 2 < len(w) - 2")
_SENT = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]*'), lambda s: trim(s)), lambda s: s <> '')"
C.add("text_essence", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", T.essence(X()).alias("essence")),
      f"""WITH s AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, {_SENT} AS p FROM documents WHERE text IS NOT NULL)), k AS (SELECT doc_id, arg_max(text, (len(list_distinct(list_filter({_WORDS}, lambda w: length(w) > 4))), -i)) AS best FROM s GROUP BY 1)
 SELECT doc_id, substring(best, 1, 150) AS essence FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN k USING (doc_id)""")
C.add("text_simhash", lambda t: t.neurons.where("content IS NOT NULL").select("id", T.simhash(F.col("content")).alias("hash")))
C.add("text_sentences", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", F.size(T.sentences(X())).alias("n")), f"SELECT doc_id, len({_SENT})::INT AS n FROM documents WHERE text IS NOT NULL")
_prep = lambda t: P.prepare(t.documents)
_TXT = "d AS (SELECT doc_id, text, created_at FROM documents WHERE text IS NOT NULL AND trim(text) <> '')"
C.add("encode_concepts", lambda t: P.concept_nodes(_prep(t)), f"WITH {_TXT} SELECT sha256('concept:' || content) AS id, content, count(*) AS mentions FROM (SELECT unnest({_KEYS}) AS content FROM d) GROUP BY content")
C.add("encode_entities", lambda t: P.entity_nodes(_prep(t)),
      f"WITH {_TXT}, x AS (SELECT unnest({_ENTS}) AS e FROM d) SELECT regexp_replace(lower(e), '[-_ ]+', ' ', 'g') AS name, count(*) AS mentions, min(e) AS content FROM x GROUP BY 1 HAVING count(*) >= 2")
C.add("encode_anchor_edges", lambda t: P.anchor_edges(_prep(t)).where("type = 'related_to'"), f"WITH {_TXT} SELECT doc_id, k AS target, 'related_to' AS type, round(least(0.8, 0.4 + 0.3 * (1 - 0.05 * (pos - 1))), 6)::DOUBLE AS weight FROM (SELECT doc_id, unnest({_KEYS}) AS k, generate_subscripts({_KEYS}, 1) AS pos FROM d)")
C.add("encode_entity_edges", lambda t: P.anchor_edges(_prep(t)).where("type = 'involves'"),
      f"WITH {_TXT}, x AS (SELECT doc_id, text, unnest({_ENTS}) AS e FROM d) SELECT doc_id, lower(e) AS target, 'involves' AS type, round(least(0.95, 0.7 + 0.05 * ((length(text) - length(replace(text, e, ''))) // length(e))), 6)::DOUBLE AS weight FROM x")
C.add("encode_entity_pairs", lambda t: P.entity_pairs(_prep(t)),
      f"WITH {_TXT}, x AS (SELECT DISTINCT doc_id, lower(unnest({_ENTS})) AS e FROM d) SELECT p.e AS a, q.e AS b, count(*) AS n FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.e < q.e GROUP BY 1, 2")
_REL = " UNION ALL ".join(f"SELECT doc_id, trim(regexp_extract(m, '{p}', 1)) AS source, '{n}' AS relation, trim(regexp_extract(m, '{p}', 2)) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m FROM d)" for p, n in T.RELATIONS)
C.add("encode_relations", lambda t: P.relation_edges(_prep(t)), f"WITH {_TXT} {_REL}")
C.add("encode_times", lambda t: P.time_edges(_prep(t)), f"WITH {_TXT} SELECT doc_id, strftime(created_at, '%Y-%m-%d') AS target, 'happened_at' AS type, 0.9::DOUBLE AS weight FROM d WHERE created_at IS NOT NULL")
C.add("encode_fibers", lambda t: P.fiber_rows(_prep(t)).select("doc_id", "members", "salience"),
      f"WITH {_TXT}, x AS (SELECT doc_id, len({_KEYS}) + len({_ENTS}) AS k FROM d) SELECT doc_id, (k + 1)::INT AS members, round(least(1.0, CASE WHEN k > 0 THEN k / ((k + 1) * k / 2) ELSE 0.0 END + 0.3), 6)::DOUBLE AS salience FROM x")
