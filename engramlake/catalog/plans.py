"""Whole plans: bulk recall and its retrievers, maintenance strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import NOW, Catalog, sql_tokens
from engramlake.plans import recall as R
from engramlake.plans.consolidate import strategies

C = Catalog()
QUESTIONS = [(1, "why does the review queue lock stale neurons"), (2, "merge plan and token budget"), (3, "anchor index latency under heavy load"), (4, "who repairs duplicate anchors"), (5, "почему очередь проверки удаляет якоря"), (6, "为什么同步中心检查来源"), (7, "what did the sesion cash drop last week")]
_q = lambda t: t.spark.createDataFrame(QUESTIONS, "query_id int, query string")
C.add("plan_recall", lambda t: R.recall(_q(t), t.neurons, t.synapses, t.fibers, now=NOW))
C.add("plan_recall_valid", lambda t: R.recall(_q(t), t.neurons, t.synapses, t.fibers, now=NOW, valid_at="2025-06-01"))
_Q = "q(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + f"), w AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS word FROM q), h AS (SELECT DISTINCT id, type, unnest({sql_tokens('content')}) AS word FROM n WHERE content IS NOT NULL)"
_TOP = "SELECT query_id, neuron_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, neuron_id) AS rank FROM x) WHERE rank <= {}"
C.add("recall_by_entity", lambda t: R.by_entity(_q(t), t.neurons), f"{{n}} WITH {_Q}, x AS (SELECT query_id, id AS neuron_id, count(*) AS n FROM h JOIN w USING (word) WHERE type = 'entity' GROUP BY 1, 2) {_TOP.format(3)}")
C.add("recall_by_spelling", lambda t: R.by_spelling(_q(t), t.neurons),
      f"{{n}} WITH {_Q}, k AS (SELECT word FROM h GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT * FROM w WHERE length(word) >= 5 AND word NOT IN (FROM k)), v AS (SELECT DISTINCT query_id, o.word FROM r JOIN (SELECT DISTINCT word FROM h WHERE length(word) >= 4) o ON o.word <> r.word AND levenshtein(o.word, r.word) = 1), x AS (SELECT query_id, id AS neuron_id, count(*) AS n FROM h JOIN v USING (word) GROUP BY 1, 2) {_TOP.format(5)}")
_TIMED = [(1, "what changed yesterday", "2025-06-11 08:00:00"), (2, "plans of last week", "2025-03-03 10:30:00"), (3, "what is due today", "2025-10-20 00:00:00"), (4, "nothing about time", "2025-10-20 00:00:00")]
C.add("recall_by_time", lambda t: R.by_time(t.spark.createDataFrame(_TIMED, "query_id int, query string, at string").withColumn("at", F.col("at").cast("timestamp_ntz")), t.neurons, now=NOW),
      """{n} WITH r(query_id, a, b) AS (VALUES (1, TIMESTAMP '2025-06-10', TIMESTAMP '2025-06-11'), (2, TIMESTAMP '2025-02-24', TIMESTAMP '2025-03-03'), (3, TIMESTAMP '2025-10-20', TIMESTAMP '2025-10-21'))
 SELECT query_id, id AS neuron_id, rank::INT AS rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS rank FROM n JOIN r ON created_at >= a AND created_at < b) WHERE rank <= 5""")
C.add("recall_by_graph", lambda t: R.by_graph(R.by_entity(_q(t), t.neurons), t.raw("synapses")),
      f"{{n, e}} WITH {_Q}, y AS (SELECT query_id, id AS neuron_id, count(*) AS n FROM h JOIN w USING (word) WHERE type = 'entity' GROUP BY 1, 2), o AS (SELECT query_id, neuron_id FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, neuron_id) <= 3), b AS (SELECT source_id AS src, target_id AS dst, weight FROM e WHERE weight >= 0.3 UNION ALL SELECT target_id, source_id, weight FROM e WHERE weight >= 0.3), x AS (SELECT query_id, dst AS neuron_id, max(weight) AS n FROM o JOIN b ON src = neuron_id WHERE (query_id, dst) NOT IN (SELECT (query_id, neuron_id) FROM o) GROUP BY 1, 2) {_TOP.format(10)}")


def _passes(t):
    """Every maintenance pass by name with the number of rows it would change."""
    made = strategies(t.neurons, t.synapses, t.fibers, t.co_activations, t.documents, t.events, now=NOW)
    out = None
    for name, rows in made.items():
        part = rows().agg(F.count("*").alias("rows")).select(F.lit(name).alias("strategy"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


C.add("plan_strategies", _passes)
