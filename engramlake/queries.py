"""Queries of the core operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramlake.catalog import encoding, graph, maintenance, memory, mutations, plans, ranking, scans, sources, stats, steps, upkeep
from engramlake.operators.changelog import assemble_transactions, committed_watermark, parse_changes, replay, replay_fields
from engramlake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "change_log")).select("entity_type", "entity_id", "receipt_id")


def p6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_fields(table(spark, sf_dir, "change_log"))


def p6_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a log still arriving may show: what lies before its first missing sequence."""
    return replay(table(spark, sf_dir, "change_log"), gaps="hold").select("entity_type", "entity_id", "receipt_id")


def p6_held_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_fields(table(spark, sf_dir, "change_log"), gaps="hold")


def p6_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed_watermark(assemble_transactions(parse_changes(table(spark, sf_dir, "change_log"))))


CATALOGS = (scans, graph, ranking, stats, maintenance, encoding, steps, memory, upkeep, mutations, sources, plans)
QUERIES: dict[str, Query] = {k: v for c in CATALOGS for k, v in c.C.queries.items()} | {f.__name__: f for f in (p6_found, p6_fields, p6_held, p6_held_fields, p6_watermark)}

_RECEIPTS = """
whole AS (SELECT receipt_id, change::JSON AS c FROM change_log WHERE receipt_id IS NOT NULL AND json_valid(change)),
flat AS (
  SELECT receipt_id, (c->>'sequence')::BIGINT AS seq, c->>'entity_type' AS entity_type, c->>'entity_id' AS entity_id,
         lower(trim(c->>'operation')) AS op, c->'payload' AS payload
  FROM whole WHERE c->>'entity_id' IS NOT NULL AND c->>'sequence' IS NOT NULL
),
tx AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY seq, entity_type, entity_id, op) = 1),
alive AS (
  SELECT entity_type, entity_id, max(seq) FILTER (WHERE op = 'insert') AS ins, arg_max(receipt_id, seq) FILTER (WHERE op IN ('insert', 'update')) AS receipt_id
  FROM tx GROUP BY 1, 2
  HAVING max(seq) FILTER (WHERE op = 'insert') > coalesce(max(seq) FILTER (WHERE op = 'delete'), -1)
)"""

_RUN = "run AS (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS grp FROM (SELECT DISTINCT seq FROM tx)), mark AS (SELECT max(seq) AS watermark FROM run WHERE grp = (SELECT arg_min(grp, seq) FROM run))"
_HELD = _RECEIPTS.replace("alive AS (", f"{_RUN},\nalive AS (").replace("  FROM tx GROUP BY 1, 2", "  FROM tx WHERE seq <= (FROM mark) GROUP BY 1, 2")
_FIELDS = """named AS (SELECT entity_type, entity_id, seq, payload, unnest(json_keys(payload)) AS field FROM tx WHERE op IN ('insert', 'update'){})
SELECT entity_type, entity_id, field, arg_max(coalesce(payload->>field, ''), seq) AS value FROM named JOIN alive USING (entity_type, entity_id)
WHERE seq >= ins GROUP BY 1, 2, 3"""

ORACLE_SQL: dict[str, str] = {k: v for c in CATALOGS for k, v in c.C.sql.items()} | {
    "p6_found": f"WITH {_RECEIPTS} SELECT entity_type, entity_id, receipt_id FROM alive",
    "p6_held": f"WITH {_HELD} SELECT entity_type, entity_id, receipt_id FROM alive",
    "p6_fields": f"WITH {_RECEIPTS}, " + _FIELDS.format(""),
    "p6_held_fields": f"WITH {_HELD}, " + _FIELDS.format(" AND seq <= (FROM mark)"),
    "p6_watermark": f"""WITH {_RECEIPTS}, s AS (SELECT DISTINCT seq FROM tx), r AS (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS grp FROM s)
SELECT min(seq) AS first_sequence, max(seq) FILTER (WHERE grp = (SELECT arg_min(grp, seq) FROM r)) AS watermark, max(seq) AS last_sequence FROM r""",
}
