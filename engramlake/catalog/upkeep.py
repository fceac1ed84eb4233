"""Merged snapshots, priors, priming rates, narratives, cells, chart kinds, stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, fiber_tags, members, sql_words
from engramlake.functions import text as T
from engramlake.operators import upkeep as U

C = Catalog()
_old = lambda rows: rows.where("created_at < TIMESTAMP_NTZ '2025-09-01'")
_new = lambda rows: rows.where("created_at >= TIMESTAMP_NTZ '2025-02-01'")
_FP = "concat_ws(':', type, lower(content))"
_PICK = "SELECT coalesce(l.{0}, q.{0}) AS {0}, coalesce(l.id, q.id) AS id, CASE WHEN l.id IS NOT NULL THEN 'left' ELSE 'right' END AS \"from\" FROM l FULL JOIN q ON l.{0} = q.{0}"
C.add("merge_edges", lambda t: U.merge_edges(_old(t.synapses), _new(t.synapses), t.neurons),
      f"""{{n, e}} WITH m AS (SELECT id, {_FP} AS k FROM n), x AS (SELECT e.id, e.created_at, sha256(concat_ws('|', a.k, e.type, b.k)) AS triple FROM e JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id),
 l AS (SELECT triple, min(id) AS id FROM x WHERE created_at < '2025-09-01' GROUP BY 1), q AS (SELECT triple, min(id) AS id FROM x WHERE created_at >= '2025-02-01' GROUP BY 1) {_PICK.format('triple')}""")
C.add("merge_fiber_sets", lambda t: U.merge_fiber_sets(_old(t.fibers), _new(t.fibers), members(t.fibers), t.neurons),
      f"""{{fm, n}} WITH x AS (SELECT f.id, f.created_at, sha256(string_agg(DISTINCT k, '|' ORDER BY k)) AS members FROM f JOIN fm ON fm.fiber_id = f.id JOIN (SELECT id AS nid, {_FP} AS k FROM n) ON nid = neuron_id GROUP BY f.id, f.created_at),
 l AS (SELECT members, min(id) AS id FROM x WHERE created_at < '2025-09-01' GROUP BY 1), q AS (SELECT members, min(id) AS id FROM x WHERE created_at >= '2025-02-01' GROUP BY 1) {_PICK.format('members')}""")
C.add("memory_stale_priors", lambda t: U.stale_priors(t.events.groupBy(F.col("user_id").alias("arm")).agg((F.count_if(F.col("value") > 50) / 4 + 1).alias("alpha"), (F.count_if(F.col("value") <= 50) / 4 + 1).alias("beta"), F.count("*").alias("queries"), F.max("ts").alias("updated")), now=NOW),
      f"""WITH p AS (SELECT user_id AS arm, count(*) FILTER (WHERE value > 50) / 4 + 1 AS alpha, count(*) FILTER (WHERE value <= 50) / 4 + 1 AS beta, count(*) AS queries, max(ts) AS updated FROM events GROUP BY 1), d AS (SELECT arm, greatest(1.0, alpha * 0.9) AS alpha, greatest(1.0, beta * 0.9) AS beta, queries FROM p WHERE updated < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)
 SELECT arm, round(alpha, 6) AS alpha, round(beta, 6) AS beta, NOT (alpha < 1.1 AND beta < 1.1 AND queries < 3) AS keep FROM d""")
C.add("memory_aggressiveness", lambda t: t.co_activations.where("source_anchor IS NOT NULL").groupBy("source_anchor").agg(F.round(U.aggressiveness(F.count_if(F.col("binding_strength") >= 0.7), F.count("*")), 6).alias("factor")),
      """{co} SELECT source_anchor, round(CASE WHEN p < 10 THEN 1.0 WHEN h / p > 0.3 THEN least(1.5, 1 + h / p - 0.3) WHEN h / p < 0.1 THEN greatest(0.5, 1 - (0.1 - h / p) * 5) ELSE 1.0 END, 6)::DOUBLE AS factor FROM (SELECT source_anchor, count(*) AS p, count(*) FILTER (WHERE binding_strength >= 0.7) AS h FROM co WHERE source_anchor IS NOT NULL GROUP BY 1)""")
C.add("memory_chart_kind", lambda t: t.documents.groupBy("source").agg(U.chart_kind(F.count("*"), F.count_if(F.col("created_at").isNotNull()), F.count_if(F.col("text").rlike("[0-9]"))).alias("kind")),
      "SELECT source, CASE WHEN n = 0 THEN 'table' WHEN d > 0 AND x > 0 THEN 'line' WHEN x > 0 AND n <= 6 THEN 'pie' WHEN x > 0 THEN 'bar' ELSE 'table' END AS kind FROM (SELECT source, count(*) AS n, count(created_at) AS d, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS x FROM documents GROUP BY 1)")
C.add("memory_granularity", lambda t: t.fibers.where("time_start IS NOT NULL AND time_end IS NOT NULL").select("id", U.granularity(F.col("time_start"), F.col("time_end")).alias("unit")),
      "{f} SELECT id, CASE WHEN s <= 3600 THEN 'minute' WHEN s <= 86400 THEN 'hour' WHEN s <= 604800 THEN 'day' WHEN s <= 2678400 THEN 'week' WHEN s <= 31536000 THEN 'month' ELSE 'year' END AS unit FROM (SELECT id, (epoch_us(time_end) - epoch_us(time_start)) / 1e6 AS s FROM f WHERE time_start IS NOT NULL AND time_end IS NOT NULL)")
_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN substring(w, 1, length(w) - {len(s)})" for s in U.SUFFIXES) + " END"
C.add("memory_expand_stems", lambda t: t.neurons.where("content IS NOT NULL").select("id", F.array_sort(U.expand_stems(T.words(F.col("content")))).alias("words")),
      f"""{{n}} SELECT id, list_sort(list_distinct(list_concat(ws, list_transform(list_filter(ws, lambda w: length(w) BETWEEN 3 AND 6), lambda w: w || '{U.SUFFIXES[0]}'), list_filter(list_transform(ws, lambda w: {_STEM}), lambda x: x IS NOT NULL)))) AS words FROM (SELECT id, {sql_words('content')} AS ws FROM n WHERE content IS NOT NULL)""")
C.add("encode_cells", lambda t: U.cells(t.documents),
      r"""WITH l AS (SELECT doc_id, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, ls, list_filter(ls, lambda x: regexp_matches(x, '^\s*([\w .-]{1,40})[:=]\s*(\S.*?)\s*$')) AS ps FROM l)
 SELECT DISTINCT doc_id, unnest(list_transform(ps[1:50], lambda x: trim(regexp_extract(x, '^\s*([\w .-]{1,40})[:=]\s*(\S.*?)\s*$', 1)) || ' = ' || regexp_extract(x, '^\s*([\w .-]{1,40})[:=]\s*(\S.*?)\s*$', 2))) AS cell, 0.8::DOUBLE AS weight FROM p WHERE len(ls) > 1 AND len(ps) * 2 > len(ls)""")
C.add("narrative_topics", lambda t: U.narratives(t.fibers, fiber_tags(t.fibers)),
      """{ft} WITH b AS (SELECT tag, fiber_id, summary, created_at FROM ft JOIN f ON f.id = fiber_id WHERE summary IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag ORDER BY coalesce(salience, 0) DESC, fiber_id) <= 20)
 SELECT tag, count(*) AS fibers, '# ' || tag || chr(10) || chr(10) || string_agg('- ' || summary, chr(10) ORDER BY created_at NULLS LAST, fiber_id) AS markdown FROM b GROUP BY 1""")
