"""A versioned store of the graph tables on a shared file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators import mutations

TABLES = ("neurons", "synapses", "fibers")


class GraphStore:
    """Tables under ``root``, one directory a version, partitioned by brain.

    A write makes the next version and then moves the pointer, so readers see whole
    versions; a failed write leaves the pointer where it was.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self, table: str) -> list[int]:
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self, table: str, version: int | None = None, brain: str | None = None) -> DataFrame:
        """The newest or a given version; a brain is one directory."""
        known = self.versions(table)
        if not known:
            raise FileNotFoundError(f"{self.root}/{table} has no version")
        rows = self.spark.read.parquet(f"{self.root}/{table}/v={version or known[-1]:08d}").withColumn("brain_id", F.col("brain_id").cast("string"))
        return rows if brain is None else rows.where(F.col("brain_id") == brain)

    def write(self, table: str, rows: DataFrame) -> int:
        version = (self.versions(table) or [0])[-1] + 1
        rows.write.mode("overwrite").partitionBy("brain_id").parquet(f"{self.root}/{table}/v={version:08d}")
        return version

    def upsert(self, table: str, rows: DataFrame) -> int:
        return self.write(table, mutations.upsert(self.read(table), rows) if self.versions(table) else rows.dropDuplicates(["id"]))

    def update(self, table: str, changes: DataFrame) -> int:
        return self.write(table, mutations.update(self.read(table), changes))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Delete rows; edges of deleted neurons and references to deleted edges go too."""
        if table == "neurons":
            nodes, edges = mutations.delete_neurons(self.read("neurons"), self.read("synapses"), keys)
            before = self.read("synapses")
            self.write("neurons", nodes)
            self.write("synapses", edges)
            self.write("fibers", mutations.drop_references(self.read("fibers"), before.join(edges.select("id"), "id", "left_anti")))
            return
        self.write(table, mutations.delete(self.read(table), keys))
        if table == "synapses":
            self.write("fibers", mutations.drop_references(self.read("fibers"), keys))

    def rollback(self, table: str, version: int) -> int:
        return self.write(table, self.read(table, version))

    def transplant(self, source: str, target: str) -> None:
        """Copy a brain's rows under another brain's name, ids kept apart by a prefix."""
        for table in TABLES:
            rows = self.read(table, brain=source)
            rows = mutations.move_brain(rows.withColumn("id", F.concat(F.lit(f"{target}:"), "id")), target)
            self.upsert(table, rows)
