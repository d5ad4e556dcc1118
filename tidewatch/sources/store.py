"""The article store as a table in buckets of the url, which knows its own layout.

The number of buckets follows the size of the first load and is written beside the data (`_layout`); readers and
writers take it from there, and a caller that expects another number gets an error instead of a store
with the same url in two buckets. An update reads and rewrites the buckets of its urls only.

The new buckets are staged as a whole (`_staged_JOB`) before Spark's dynamic overwrite replaces the old ones, and a
marker (`_jobs/JOB`) tells that this is done. If a writer ends in between, the next one first repeats the
overwrite from the stage, so the store is never left with some of an update; and an update that is run
again under its job id is not applied twice.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.operators.upsert import upsert_articles
from tidewatch.sources import folders

ROWS_PER_BUCKET, MOST_BUCKETS = 100_000, 1 << 16


def buckets_for(rows: int) -> int:
    return min(MOST_BUCKETS, max(1, 1 << max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length()))


def bucket(n: int, url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n)).cast("int")


def layout(spark: SparkSession, path: str, expected: int | None = None) -> int | None:
    """How many buckets the store has, None if there is no store; an error if another number is expected."""
    if not folders.complete(spark, f"{path}/_layout"):
        return None
    n = spark.read.schema("buckets int").parquet(f"{path}/_layout").first()[0]
    if expected not in (None, n):
        raise ValueError(f"the store at {path} has {n} buckets, not {expected}")
    return n


def laid_out(rows: DataFrame, path: str, buckets: int | None = None) -> int:
    """The number of buckets, which a new table takes from its first rows and records."""
    n = layout(rows.sparkSession, path, buckets)
    if n is None:
        n = buckets or buckets_for(rows.count())
        rows.sparkSession.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")
    return n


def write(articles: DataFrame, path: str, buckets: int | None = None, job: str | None = None) -> None:
    """Lay a store out, or replace those buckets of an existing one that ``articles`` has rows of."""
    spark = articles.sparkSession
    n = laid_out(articles, path, buckets)
    recover(spark, path)
    job = job or uuid.uuid4().hex
    if not applied(spark, path, job):
        rows = articles.withColumn("bucket", bucket(n))
        rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "url").sortWithinPartitions("bucket", "url")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_staged_{job}")
        recover(spark, path)


def applied(spark: SparkSession, path: str, job: str) -> bool:
    return folders.complete(spark, f"{path}/_jobs/{job}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish what is staged as a whole; a stage that was cut off goes."""
    for name in folders.children(spark, path):
        if name.startswith("_staged_"):
            job, stage = name.removeprefix("_staged_"), f"{path}/{name}"
            if folders.complete(spark, stage) and not applied(spark, path, job):
                if any(x.startswith("bucket=") for x in folders.children(spark, stage)):
                    rows = spark.read.parquet(stage)
                    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
                spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/_jobs/{job}")
            folders.delete(spark, stage)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def touched(spark: SparkSession, path: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """The stored articles in the buckets of the given urls; the scan reads these buckets only."""
    n = layout(spark, path)
    if n is None:
        raise ValueError(f"there is no store at {path}")
    recover(spark, path)
    numbers = [r[0] for r in urls.where(F.col(url).isNotNull()).select(bucket(n, url)).distinct().collect()]  # at most n
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers)).drop("bucket")


def upsert(spark: SparkSession, path: str, updates: DataFrame, as_of: datetime, buckets: int | None = None, job: str | None = None, **kw) -> None:
    """Apply ordered updates; buckets without updates are neither read nor written. A ``job`` that is run again changes nothing."""
    layout(spark, path, buckets)
    recover(spark, path)
    if job is None or not applied(spark, path, job):
        write(upsert_articles(touched(spark, path, updates), updates, as_of, **kw), path, job=job)
