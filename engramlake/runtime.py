"""Session helpers: table loading, lineage cuts, partition spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, once for each context.

    A worker has its own module path, so a package that only the driver can import would
    fail there.  The driver's file server sends the archive; executors need no shared path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_engramlake", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="engramlake-")) / "engramlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(path.relative_to(package.parent)))
    sc.addPyFile(str(archive))
    sc._engramlake = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session; only where it is unset, and no
    folder was set on the context before, a temporary one is made, and only in local mode:
    a cluster must name a folder that all its executors share.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="engramlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The copy survives lost executors, so a cut is also how one result is used twice
    without computing it twice.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, per_core: int = 3) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` where that is needed to keep all cores busy.

    For work in Python.  A scan with a partition for every core is left alone, so large
    tables are not shuffled for this; a scan of a few large row groups, or a plan whose
    shuffles the engine may merge into few partitions, is spread.  Nothing is run to tell.
    """
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    shuffled = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    if not shuffled and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(max(cores * per_core, int(spark.conf.get("spark.sql.shuffle.partitions"))), *[F.col(k) for k in keys])


def latest_rows(df: DataFrame, *keys: str, order: str = "created_at") -> DataFrame:
    """One row for each key: copies of a row written more than once count once.

    The newest copy by ``order`` is kept, ties by the remaining columns as text, so the
    result does not depend on partitioning.  Map-side combinable: a key that holds a
    third of all rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    tie = F.xxhash64(*[F.col(c) for c in rest])
    pick = F.max_by(F.struct(*rest), F.struct(F.col(order), tie)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)
