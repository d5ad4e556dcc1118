"""Track points in buckets of the vessel, cut to length by rewriting only the files that lose points.

A bucket holds a folder for each run that appended to it, so a repeated append replaces itself. `retain` counts the
points of every vessel from the vessel column alone, reads the buckets of vessels that are too long, finds the oldest
point each of them keeps, and rewrites the (bucket, run) folders with points older than that. All others stay as they are.

The new folders are staged as a whole before they replace the old ones; a writer that ends in between is finished by
the next one. Points of no vessel are all kept; equal points of a vessel, the same time and id, stay or go together.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import vocab as V
from tidewatch.operators.skew import top_n_per_key
from tidewatch.operators.tracks import newest_first
from tidewatch.session import stored
from tidewatch.sources import folders, store

PLACE = ["bucket", "run_id"]


def _write(rows: DataFrame, path: str) -> None:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *PLACE, "mmsi", "timestamp", "id").sortWithinPartitions(*PLACE, "mmsi", "timestamp")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(path)


def append(points: DataFrame, path: str, run_id: str, buckets: int | None = None) -> None:
    """Add the points of a run; the same run again replaces what it wrote to the buckets it has points for."""
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"a run is named by letters, digits and _.-, not {run_id!r}")
    n = store.laid_out(points, path, buckets)
    recover(points.sparkSession, path)
    # the prefix keeps a run's name from being read as a number or a date
    _write(points.withColumn("bucket", store.bucket(n, "mmsi")).withColumn("run_id", F.lit(f"r-{run_id}")), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*PLACE)


def retain(spark: SparkSession, path: str, keep: int = V.TRACK_KEEP) -> None:
    """Cut every vessel to its newest ``keep`` points. Run again it changes nothing."""
    if keep < 1:
        raise ValueError("at least one point of a vessel is kept")
    recover(spark, path)
    table = spark.read.parquet(path)
    long = stored(table.where(F.col("mmsi").isNotNull()).groupBy("bucket", "mmsi").agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > keep), "long")
    numbers = [r[0] for r in long.select("bucket").distinct().collect()]  # at most the number of buckets
    if not numbers:
        return
    points = table.where(F.col("bucket").isin(numbers))
    theirs = points.join(long.select("mmsi"), "mmsi", "left_semi").select("mmsi", "timestamp", "id")
    at = F.struct("timestamp", "id")
    oldest = stored(top_n_per_key(theirs, ["mmsi"], newest_first(), keep, ["id"]).groupBy("mmsi").agg(F.min(at).alias("oldest")), "oldest")
    beyond = F.coalesce(at < F.col("oldest"), F.lit(False))
    losing = stored(points.join(oldest, "mmsi").where(beyond).select(*PLACE).distinct(), "losing")
    kept = points.join(losing, PLACE, "left_semi").join(oldest, "mmsi", "left").where(~beyond).drop("oldest")
    stage = f"{path}/_staged_{uuid.uuid4().hex}"
    _write(kept.select(*table.columns), f"{stage}/points")
    losing.write.parquet(f"{stage}/losing")  # the stage counts from here on
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Put staged folders in place of the old ones; a stage that was cut off goes."""
    for name in folders.children(spark, path):
        if name.startswith("_staged_"):
            stage = f"{path}/{name}"
            if folders.complete(spark, f"{stage}/losing"):
                if any(x.startswith("bucket=") for x in folders.children(spark, f"{stage}/points")):
                    _write(spark.read.parquet(f"{stage}/points"), path)
                for b, r in spark.read.parquet(f"{stage}/losing").collect():  # folders, not points
                    if f"run_id={r}" not in folders.children(spark, f"{stage}/points/bucket={b}"):
                        folders.delete(spark, f"{path}/bucket={b}/run_id={r}")
            folders.delete(spark, stage)
