"""Writes as transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import Catalog
from engramlake.operators import mutations as M

C = Catalog()
HUB = "neu-0000000000"

C.add("write_upsert", lambda t: M.upsert(t.neurons.select("id", "type", "content"), t.neurons.where("type = 'intent'").select("id", F.lit("goal").alias("type"), "content")),
      "{n} SELECT id, CASE WHEN type = 'intent' THEN 'goal' ELSE type END AS type, content FROM n")
C.add("write_update", lambda t: M.update(t.synapses.select("id", "weight", "type"), t.synapses.where("weight < 0.2").select("id", F.lit(0.0).alias("weight"))), "{e} SELECT id, CASE WHEN weight < 0.2 THEN 0.0 ELSE weight END::DOUBLE AS weight, type FROM e")
C.add("write_delete", lambda t: M.delete(t.fibers, t.fibers.where("pinned")).select("id"), "{f} SELECT id FROM f WHERE NOT coalesce(pinned, false)")
C.add("write_delete_neurons", lambda t: M.delete_neurons(t.neurons, t.synapses, t.neurons.where("type = 'intent'"))[1].select("id"),
      "{n, e} WITH g AS (SELECT id FROM n WHERE type = 'intent') SELECT id FROM e WHERE (source_id IS NULL OR source_id NOT IN (FROM g)) AND (target_id IS NULL OR target_id NOT IN (FROM g))")
C.add("write_drop_references", lambda t: M.drop_references(t.fibers, t.synapses.where("weight < 0.5")).select("id", "synapse_ids"),
      "{f, e} WITH g AS (SELECT list(id) AS l FROM e WHERE weight < 0.5) SELECT id, list_filter(synapse_ids, lambda s: s IS NULL OR NOT list_contains(l, s)) AS synapse_ids FROM f CROSS JOIN g")
C.add("write_delete_if_unchanged", lambda t: M.delete_if_unchanged(t.synapses.select("id", "weight", "last_activated"), t.synapses.where("weight < 0.3").select("id", F.when(F.col("type") == "related_to", 9.9).otherwise(F.col("weight")).alias("weight"), "last_activated")).select("id"),
      "{e} SELECT id FROM e WHERE NOT coalesce(weight < 0.3 AND type IS DISTINCT FROM 'related_to', false)")
