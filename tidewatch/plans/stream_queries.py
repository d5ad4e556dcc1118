"""Registered queries that run a stream over the tables to its end and return the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.plans.ingest_queries import STORE_COLUMNS, updates as sample_updates
from tidewatch.plans.article_queries import LATER
from tidewatch.plans.registry import query
from tidewatch.plans.views import DOCUMENTS_DDL, EVENTS_DDL, Views, articles_from_documents, raw_from_documents, tracks_from_events
from tidewatch.session import scratch_dir
from tidewatch.sources import folders
from tidewatch.streaming import articles as SA, tracks as ST
from tidewatch.streaming.sinks import read_batches


BATCHES, FILE_BYTES = 4, 16 << 20


def stream(v: Views, name: str, ddl: str, order: str | None = None) -> DataFrame:
    """One sample table as a stream of files in BATCHES batches, whose rows arrive in no order, or by a column.

    The number of files follows the table's bytes, so no task holds a fixed share of it.
    """
    path, rows = scratch_dir(v.spark, "arriving"), v.table(name)
    n = BATCHES * max(1, -(-folders.size(v.spark, f"{v.sf_dir}/{name}.parquet") // (BATCHES * FILE_BYTES)))
    (rows.repartition(n) if order is None else rows.repartitionByRange(n, order)).write.parquet(path)
    if order is not None:
        folders.date_in_order(v.spark, path)
    files = sum(x.startswith("part-") for x in folders.children(v.spark, path))
    return v.spark.readStream.schema(ddl).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(path)


def events(v: Views) -> DataFrame:
    return tracks_from_events(stream(v, "events", EVENTS_DDL))


def documents(v: Views, order: str | None = None) -> DataFrame:
    return stream(v, "documents", DOCUMENTS_DDL, order)


def places(v: Views, name: str) -> tuple[str, str]:
    base = scratch_dir(v.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@query
def stream_track_ingest(v):
    out, checkpoint = places(v, "positions")
    ST.start_track_ingest(events(v), v.gazetteer, out, checkpoint).awaitTermination()
    return read_batches(v.spark, out).select("id", "mmsi", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
                                             "timestamp", "city", "country")


@query
def stream_vessel_status(v):
    out, checkpoint = places(v, "status")
    ST.start_vessel_status(events(v), out, checkpoint, days=10).awaitTermination()
    rows = ST.current_status(v.spark, out, days=10, offline_hours=24)
    return rows.select("mmsi", "status", F.round("speed_kn", 6).alias("speed_kn"), "heading", "location", "status_date")


@query
def stream_article_dedup(v):
    """Items arrive as they were collected (by seq), so the one that stays is the first of its link in all batches."""
    out, checkpoint = places(v, "items")
    SA.start_article_dedup(raw_from_documents(documents(v, "doc_id")), v.store, out, checkpoint).awaitTermination()
    return read_batches(v.spark, out).groupBy("link").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("times"))


def _counted(v: Views, count, name: str, keys: list[str]) -> DataFrame:
    out, checkpoint = places(v, name)
    SA.start_counts(articles_from_documents(documents(v)), count, out, checkpoint).awaitTermination()
    return SA.read_counts(v.spark, out, keys)


@query
def stream_daily_counts(v):
    rows = _counted(v, SA.daily_counts, "daily", ["day"])
    return rows.select(F.col("day").cast("string").alias("day"), "articles")


@query
def stream_shift_digest(v):
    return _counted(v, SA.shift_digest, "shifts", ["shift_start", "category"])


@query
def stream_upsert(v):
    out, checkpoint = places(v, "updates")
    arriving = Views(v.spark, v.sf_dir)
    arriving.__dict__["raw_items"] = raw_from_documents(documents(v))
    SA.start_updates_log(sample_updates(arriving), out, checkpoint).awaitTermination()
    store = v.store.withColumn("remark", F.lit(None).cast("string"))
    return SA.current_store(v.spark, store, out, LATER).select(*STORE_COLUMNS)
