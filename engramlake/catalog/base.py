"""Registration of queries and the shared tables and SQL parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import scalar as S
from engramlake.operators import scans
from engramlake.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

#: The moment that "now" is in every query, so that results can be compared.
NOW = "2026-03-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def age(column: str = "created_at") -> Column:
    """Days from a column to ``NOW``."""
    return S.days_between(now(), F.col(column))


class Tables:
    """The tables of one directory, copies of rows removed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def neurons(self) -> DataFrame:
        return scans.unique(self.raw("neurons"))

    @property
    def synapses(self) -> DataFrame:
        return scans.unique(self.raw("synapses"))

    @property
    def fibers(self) -> DataFrame:
        return scans.unique(self.raw("fibers"))

    @property
    def co_activations(self) -> DataFrame:
        return scans.unique(self.raw("co_activations"))

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")

    @property
    def events(self) -> DataFrame:
        return self.raw("events")

    @property
    def states(self) -> DataFrame:
        return scans.neuron_states(self.neurons, self.synapses)


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(name)
        self.queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            self.sql[name] = with_tables(sql)


def sql_tokens(column: str) -> str:
    """SQL of ``scalar.search_tokens``."""
    words = rf"regexp_extract_all(regexp_replace(lower({column}), '[{S.UNSPACED}]', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]{{3,}}')"
    runs = f"regexp_extract_all(lower({column}), '[{S.UNSPACED}]+')"
    return f"CASE WHEN {column} IS NOT NULL THEN list_concat({words}, flatten(list_transform({runs}, lambda r: list_transform(range(1, greatest(1, length(r) - 1)::BIGINT + 1), lambda i: substring(r, i, 2))))) END"


def sql_words(column: str) -> str:
    """SQL of ``text.words``."""
    return rf"list_filter({sql_tokens(column)}, lambda w: NOT regexp_matches(w, '^\p{{N}}'))"


CTES = {
    "n": "n AS (SELECT DISTINCT ON (id) * FROM neurons WHERE id IS NOT NULL)",
    "e": "e AS (SELECT DISTINCT ON (id) * FROM synapses WHERE id IS NOT NULL)",
    "f": "f AS (SELECT DISTINCT ON (id) * FROM fibers WHERE id IS NOT NULL)",
    "co": "co AS (SELECT DISTINCT ON (id) * FROM co_activations WHERE id IS NOT NULL)",
    "st": """st AS (SELECT n.id AS neuron_id, coalesce(round(max(x.weight), 6), 0) AS activation_level, coalesce(sum(x.rc), 0)::BIGINT AS access_frequency, max(x.last_activated) AS last_activated
 FROM n LEFT JOIN (SELECT source_id AS nid, weight, coalesce(reinforced_count, 0) AS rc, last_activated FROM e UNION ALL SELECT target_id, weight, coalesce(reinforced_count, 0), last_activated FROM e WHERE target_id <> source_id) x ON x.nid = n.id GROUP BY n.id)""",
    "fm": "fm AS (SELECT DISTINCT f.id AS fiber_id, m AS neuron_id FROM (SELECT id, unnest(neuron_ids) AS m FROM f) f WHERE m IS NOT NULL)",
    "ft": "ft AS (SELECT DISTINCT id AS fiber_id, t AS tag FROM (SELECT id, unnest(list_concat(coalesce(auto_tags, []), coalesce(agent_tags, []))) AS t FROM f) WHERE t IS NOT NULL)",
}
NEEDS = {"st": ("n", "e"), "fm": ("f",), "ft": ("f",)}


def with_tables(sql: str) -> str:
    """``{n, e, st}`` at the start of a text names the shared parts it uses."""
    if not sql.startswith("{"):
        return sql
    names, _, rest = sql[1:].partition("}")
    order: list[str] = []
    for name in (x.strip() for x in names.split(",")):
        for part in (*NEEDS.get(name, ()), name):
            if part not in order:
                order.append(part)
    rest = rest.strip()
    parts = ", ".join(CTES[x] for x in order)
    if rest.upper().startswith("WITH "):
        rest = rest[5:].removeprefix("RECURSIVE ")
        return f"WITH RECURSIVE {parts}, {rest}"
    return f"WITH {parts} {rest}"


def members(fibers: DataFrame) -> DataFrame:
    """``(fiber_id, neuron_id)``, distinct."""
    items = F.array_distinct(F.array_compact(F.coalesce("neuron_ids", F.array().cast("array<string>"))))
    return fibers.select(F.col("id").alias("fiber_id"), F.explode(items).alias("neuron_id"))


def fiber_tags(fibers: DataFrame) -> DataFrame:
    """``(fiber_id, tag)``, distinct."""
    return fibers.select(F.col("id").alias("fiber_id"), F.explode(F.array_compact(scans.tags_of(fibers))).alias("tag")).distinct()
