"""Session helpers: runtime settings the plans rely on, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.vocab import TRACK_KEEP

_SETTINGS = {
    # split hot join keys at run time, also where that costs one more exchange
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # let "newest k per key" drop rows before the shuffle up to the largest k in use
    "spark.sql.optimizer.windowGroupLimitThreshold": str(TRACK_KEEP),
    "spark.sql.session.timeZone": "UTC",
    # rows hold whole texts and pages, so a Python task is given few at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # the vessel registry file is encoded in GBK
    "spark.sql.legacy.javaCharsets": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the plans rely on, leaving alone what the user set at launch."""
    given = spark.sparkContext.getConf()
    for key, value in _SETTINGS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tidewatch", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables one query writes and reads back.

    On a cluster it lies under spark.checkpoint.dir, which every executor must see; only a local
    session falls back to the machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder once and read it back: several outputs share it, and its lineage ends."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
