"""Writing tables: partitioned Parquet, whole partitions replaced or rows appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_articles(articles: DataFrame, path: str) -> None:
    """Replace the days present in ``articles``; other days of the table stay.

    Rows are dealt by ranges of time, so that a day with most rows is written by many tasks, each a
    time range of its own, and Parquet statistics help look-ups by time.
    """
    days = articles.withColumn("created_date", F.to_date("created_at"))
    (_ranges(days, "created_date", "created_at", "url").sortWithinPartitions("created_date", "created_at").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(path))


def write_audit(audit: DataFrame, run_id: str | None, path: str) -> None:
    rows = audit if run_id is None else audit.withColumn("run_id", F.lit(run_id))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def append_tracks(points: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append points by day; each file of a day is a range of vessels and times.

    With ``run_id`` the rows lie in a folder of their run, which a repeated write replaces.
    """
    rows = points.withColumn("track_date", F.to_date("timestamp"))
    rows = _ranges(rows, "track_date", "mmsi", "timestamp", "id").sortWithinPartitions("track_date", "mmsi", "timestamp")
    if run_id is None:
        rows.write.mode("append").partitionBy("track_date").parquet(path)
    else:
        (rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "track_date").parquet(path))


def _ranges(rows: DataFrame, *by: str) -> DataFrame:
    """Rows in ranges of the columns, as many as the session has shuffle partitions; a hot day is split like any other."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose files may have gained columns over time."""
    return spark.read.option("mergeSchema", True).parquet(path)
