"""End-to-end batch jobs, each one plan per output table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import vocab as V
from tidewatch.functions import geo, text as T
from tidewatch.operators import analysis as A, dedup as D, filters, fleet, geocode, items as I, tracks, upsert as U
from tidewatch.session import stored
from tidewatch.sources import store as table


def ingest(items: DataFrame, store: DataFrame, as_of: datetime, store_once: bool = True) -> dict[str, DataFrame]:
    """Collected items into the store. Returns decided (every item), audit and the new store.

    Every output comes from the one table of decided items, which is written to the scratch folder
    once (unless told otherwise) instead of being computed for each output.
    """
    rows = I.complete_item_fields(I.normalize_links(items))
    if "remark" not in store.columns:
        store = store.withColumn("remark", F.lit(None).cast("string"))
    decided = D.ingest_disposition(rows, store, as_of)
    if store_once:
        decided = stored(decided, "decided")
    has_link = ~T.is_blank(F.col("link"))
    new = D.as_store_rows(decided.where(has_link & ~F.col("is_known") & F.col("is_first")), as_of)
    grown = store.unionByName(new, allowMissingColumns=True)
    updates = decided.where(F.col("new_valid").isNotNull() & has_link).select(
        F.col("link").alias("url"), "seq", "source_name", "source_type", "pub_date", F.col("new_valid").alias("valid"),
        F.col("new_hidden").alias("is_hidden"),
        F.when(F.col("new_valid") == 0, F.col("remark")).alias("remark"))
    return {"decided": decided, "audit": D.audit_projection(decided),
            "store": U.upsert_articles(grown, updates, as_of)}


def ingest_into(spark: SparkSession, items: DataFrame, path: str, as_of: datetime, job: str | None = None) -> dict[str, DataFrame]:
    """`ingest` on a stored table (`sources.store`): only buckets of the items' links are read and rewritten. Returns decided and audit."""
    links = I.normalize_links(items).select(F.col("link").alias("url"))
    old = table.touched(spark, path, links)
    out = ingest(items, old, as_of)
    table.write(out.pop("store").select(*old.columns), path, job=job)
    return out


def analyse_into(spark: SparkSession, path: str, results: DataFrame, run_items: DataFrame, audit: DataFrame, as_of: datetime,
                 date_source: str = "run", job: str | None = None) -> dict[str, DataFrame]:
    """`analyse` on a stored table: articles with results are looked up by id, their buckets alone are rewritten.

    Returns merged and gated results and the audit.
    """
    articles = table.read(spark, path)
    todo = filters.needs_analysis(articles)
    merged = stored(A.merge_results(todo, results), "merged")
    gated = stored(A.run_date_gate(merged, run_items, as_of, date_source), "gated")
    table.upsert(spark, path, analysis_updates(gated), as_of, job=job)
    return {"merged": merged, "gated": gated, "audit": A.audit_outcome(audit, gated)}


def analysis_updates(gated: DataFrame) -> DataFrame:
    """Gated results as updates of the store."""
    return gated.select("url", F.col("id").alias("seq"), "title", "title_cn", "pub_date", "source_type", "source_name",
                        "summary_cn", "full_text_cn", "content", "screenshot_path", "category", "valid",
                        "is_retained", "remark")


def analyse(store: DataFrame, results: DataFrame, run_items: DataFrame, audit: DataFrame, as_of: datetime,
            date_source: str = "run") -> dict[str, DataFrame]:
    """Model results into the store. Returns merged results, gated results, audit and the new store."""
    todo = filters.needs_analysis(store)
    merged = A.merge_results(todo, results)
    gated = A.run_date_gate(merged, run_items, as_of, date_source)
    updates = analysis_updates(gated)
    return {"merged": merged, "gated": gated, "audit": A.audit_outcome(audit, gated),
            "store": U.upsert_articles(store, updates, as_of)}


def place_positions(payload: DataFrame, ships: DataFrame, gazetteer: DataFrame, as_of: datetime,
                    country_dim: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Reported positions of registered ships, validated and with their nearest place (``index``: a kept ``index_places``)."""
    rows = fleet.fleet_position_join(ships, payload).where(geo.is_nonzero_position(F.col("lat"), F.col("lng")))
    rows = rows.withColumn("vessel_name", fleet.vessel_name_choice(F.col("shipname"), F.col("name"), F.col("registry_name")))
    rows = rows.withColumn("timestamp", F.coalesce("timestamp", filters.ts(as_of)))
    return geocode.reverse_geocode(rows, gazetteer, country_dim, index)


def track_rows(placed: DataFrame, as_of: datetime) -> DataFrame:
    """Placed positions as rows of the track table."""
    return placed.select(F.xxhash64("mmsi", "timestamp").alias("id"), "mmsi", "vessel_name", "lat", "lng", "speed", "heading",
                         "status_raw", "timestamp", filters.ts(as_of).alias("created_at"))


def fleet_job(payload: DataFrame, ships: DataFrame, track_store: DataFrame, gazetteer: DataFrame, as_of: datetime,
              days: int = 3, offline_hours: int = 2, index: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New positions into the registry, status recomputed. Runs on its own output.

    The positions are placed once and written to the scratch folder. ``new_tracks`` is what to append;
    the status reads the look-back of the track table only. ``tracks`` is the whole table cut to its
    length, for a compaction that need not run each time.
    """
    placed = stored(place_positions(payload, ships, gazetteer, as_of, index=index), "placed")
    registry, fresh = fleet.position_update(ships, placed, as_of), track_rows(placed, as_of)
    seen = tracks.recent_tracks(track_store, as_of, days).select(*fresh.columns).unionByName(fresh)
    return {"placed": placed, "new_tracks": fresh, "tracks": tracks.track_retention(track_store.select(*fresh.columns).unionByName(fresh), V.TRACK_KEEP),
            "ships": fleet.fleet_status_update(registry, seen, as_of, days, offline_hours)}
