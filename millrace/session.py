"""Session settings and the reliable checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings a job needs for its semantics; cluster sizing stays with the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def build_session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with AQE, skew handling, Arrow and a RocksDB state store."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **SEMANTIC_CONF,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints that nothing refers to any more are deleted: a long stream does not fill the disk.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the semantics rely on in a session somebody else built."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, folder: str | None = None) -> None:
    """Send this package (or another package folder) to the Python workers, once per application.

    Not needed where the package is installed on the workers, harmless there.
    """
    source = Path(folder or Path(__file__).parent)
    key = (spark.sparkContext.applicationId, source.name)
    if key in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), source.name)
    archive = shutil.make_archive(target, "zip", source.parent, source.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; fall back only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    context.setCheckpointDir(os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoint"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: survives executor loss, computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
