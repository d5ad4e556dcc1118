"""Streams over collected items and stored articles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import text as T
from tidewatch.operators import reports as R, stats
from tidewatch.operators.filters import visible_valid
from tidewatch.operators.items import normalize_links
from tidewatch.operators.skew import first_per_key
from tidewatch.operators.upsert import upsert_articles
from tidewatch.session import stored
from tidewatch.sources import folders, store
from tidewatch.streaming import seen
from tidewatch.streaming.sinks import FOLD_EVERY, read_batches, run_path, runs, write_batches


def start_article_dedup(items: DataFrame, store: DataFrame, path: str, checkpoint: str, per_bucket: int = seen.PER_BUCKET, **kw) -> StreamingQuery:
    """New links only: the first item (smallest seq) of each link in its batch, if neither stored nor written by an earlier batch.

    What was seen is an index beside the output (`seen.SeenLinks`), of which a batch reads the buckets of its own links
    only; it takes the store's links in once, when the query starts for the first time.
    """
    spark = items.sparkSession
    known = seen.SeenLinks(spark, f"{path}/_links", per_bucket, kw.get("fold_every", FOLD_EVERY))
    known.seed(store)

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = normalize_links(batch).where(~T.is_blank(F.col("link")))
        rows = stored(first_per_key(rows, ["link"], [F.asc("seq")], ["seq"]), "links")
        return rows.join(known.unseen(rows.select("link"), batch_id), "link", "left_semi")

    def note(batch_id: int) -> None:
        known.add(spark.read.parquet(run_path(path, batch_id, batch_id)).select("link"), batch_id)
        if (batch_id + 1) % known.fold_every == 0:
            known.fold(batch_id + 1)

    return write_batches(items, path, checkpoint, each=fresh, with_id=True, after=note, **kw)


def daily_counts(articles: DataFrame) -> DataFrame:
    """Visible, valid articles per day."""
    rows = articles.where(visible_valid()).groupBy(F.to_date("created_at").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("articles"))


def shift_digest(articles: DataFrame) -> DataFrame:
    """Retained articles per half-open shift and digest category."""
    rows = articles.where(visible_valid() & (F.col("is_retained") == 1))
    return rows.groupBy(R.shift_start(F.col("created_at")).alias("shift_start"), stats.digest_bucket(F.col("category")).alias("category")).agg(
        F.count(F.lit(1)).alias("articles"))


def start_counts(articles: DataFrame, count: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Append each batch's partial counts. No state and no watermark, so an article counts however late it arrives.

    Folds add the counts up, so a key is few rows however many batches there were.
    """
    return write_batches(articles, path, checkpoint, each=count, combine=added, **kw)


def added(counts: DataFrame) -> DataFrame:
    """Partial counts of equal keys added up."""
    keys = [c for c in counts.columns if c != "articles"]
    return counts.groupBy(*keys).agg(F.sum("articles").alias("articles"))


def read_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All partial counts so far, added up."""
    return read_batches(spark, path).groupBy(*keys).agg(F.sum("articles").alias("articles"))


def start_updates_log(updates: DataFrame, path: str, checkpoint: str, **kw) -> StreamingQuery:
    """Append arriving updates (url, seq, columns) to a log; the store itself is not rewritten per batch."""
    return write_batches(updates, path, checkpoint, each=lambda rows, i: rows.withColumn("batch_id", F.lit(i).cast("bigint")), with_id=True, **kw)


def current_store(spark: SparkSession, articles: DataFrame, log_path: str, as_of: datetime) -> DataFrame:
    """Store as of all logged updates. Folding ordered updates is the same in one go or batch by batch."""
    return upsert_articles(articles, read_batches(spark, log_path).drop("batch_id"), as_of)


def apply_log(spark: SparkSession, store_path: str, log_path: str, as_of: datetime) -> int:
    """Write updates that were logged since the last call into a stored table, whose buckets with updates alone are rewritten.

    The table notes the last batch it holds, so a call that is repeated, or ended half-way before, applies nothing twice.
    Returns that batch, -1 if there is none.
    """
    logged = runs(spark, log_path)
    if not logged:
        return -1
    store.recover(spark, store_path)
    done = max((int(x[4:]) for x in folders.children(spark, f"{store_path}/_jobs") if x.startswith("log_")), default=-1)
    last = logged[-1][1]
    if last > done:
        new = spark.read.parquet(*[run_path(log_path, *r) for r in logged if r[1] > done]).where(F.col("batch_id") > done).drop("batch_id")
        store.upsert(spark, store_path, new, as_of, job=f"log_{last}")
    return last


def compact(spark: SparkSession, articles: DataFrame, log_path: str, out_path: str, as_of: datetime) -> DataFrame:
    """Write the current store to a new folder; the log can start afresh after it."""
    current_store(spark, articles, log_path, as_of).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)
