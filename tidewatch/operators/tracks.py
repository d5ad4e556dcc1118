"""Vessel tracks: retention, segment speeds, stationarity and status.

No step holds a whole vessel in one window: the previous position is found inside time buckets, the
newest speeds by a cut inside these, and all else is an aggregate per vessel. Tables written by
`append_tracks` carry their day (`track_date`); whoever asks for a time range reads these days only.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import vocab as V
from tidewatch.functions import geo
from tidewatch.operators.filters import ts
from tidewatch.operators.skew import ranged_previous, top_n_per_key, with_previous


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def track_retention(tracks: DataFrame, keep: int = V.TRACK_KEEP, salts: int | None = None) -> DataFrame:
    """Newest ``keep`` points of every vessel."""
    return top_n_per_key(tracks, ["mmsi"], newest_first(), keep, ["id"], salts)


def recent_tracks(tracks: DataFrame, as_of: datetime, days: int = 3, limit: int | None = None,
                  salts: int | None = None) -> DataFrame:
    """Points of every vessel within the last days up to ``as_of``, start included; the newest ``limit`` if one is given."""
    since = dated(tracks, as_of - timedelta(days=days), as_of).where(F.col("timestamp").between(ts(as_of - timedelta(days=days)), ts(as_of)))
    return since if limit is None else top_n_per_key(since, ["mmsi"], newest_first(), limit, ["id"], salts)


def dated(tracks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The days from ``start`` to ``end`` of a table that is stored by day; other tables as they are."""
    if "track_date" not in tracks.columns:
        return tracks
    return tracks.where(F.col("track_date").between(F.lit(start.date()), F.lit(end.date()))).drop("track_date")


def _since(as_of: datetime, days: int) -> Column:
    return (F.col("timestamp") > ts(as_of - timedelta(days=days))) & (F.col("timestamp") <= ts(as_of))


def track_history(tracks: DataFrame, mmsi: str, as_of: datetime, days: int = 3) -> DataFrame:
    """Points of one vessel, oldest first; the start itself is left out."""
    return (dated(tracks, as_of - timedelta(days=days), as_of).where((F.col("mmsi") == mmsi) & _since(as_of, days))
            .select("lat", "lng", "speed", "heading", "timestamp", "created_at").orderBy("timestamp"))


def _point() -> Column:
    return F.when(F.col("timestamp").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull(),
                  F.struct("timestamp", "lat", "lng"))


def _segment_speed(prev: str, here: str = "_pt") -> Column:
    dt = geo.seconds_between(F.col(f"{prev}.timestamp"), F.col(f"{here}.timestamp"))
    dist = geo.haversine_m(F.col(f"{prev}.lat"), F.col(f"{prev}.lng"), F.col(f"{here}.lat"), F.col(f"{here}.lng"))
    speed = dist / F.nullif(dt, F.lit(0.0))
    return F.when((dt > 0) & (speed <= V.MAX_SEGMENT_MS), speed)


def segment_speeds(recent: DataFrame, by_range: bool = False) -> DataFrame:
    """Valid speeds between consecutive positions. The previous position counts even if its own segment was refused."""
    rows = long_track_segments(recent, by_range=by_range).where(F.col("speed_ms").isNotNull())
    return rows.select("mmsi", "id", "timestamp", "speed_ms")


def last_speeds(recent: DataFrame, n: int = V.SPEED_TAIL) -> DataFrame:
    """The newest ``n`` valid speeds of every vessel, ``age`` 1 for the newest."""
    few = top_n_per_key(segment_speeds(recent), ["mmsi"], newest_first(), n, ["id"])
    return few.withColumn("age", F.row_number().over(Window.partitionBy("mmsi").orderBy(*newest_first())).cast("bigint"))


def median_speed(recent: DataFrame) -> DataFrame:
    """Median of the newest valid segment speeds, metres per second."""
    return last_speeds(recent).groupBy("mmsi").agg(F.median("speed_ms").alias("speed_ms"))


def _median_knots(recent: DataFrame) -> DataFrame:
    """Exact median of the recorded knots, from counts per value."""
    counts = recent.where(F.col("speed") >= 0).groupBy("mmsi", "speed").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("mmsi").agg(F.percentile("speed", 0.5, F.col("_n")).alias("knots"))


def fallback_speed(recent: DataFrame) -> DataFrame:
    """Median of the recorded knots, as metres per second."""
    return _median_knots(recent).select("mmsi", geo.knots_to_ms(F.col("knots")).alias("speed_ms"))


def latest_point(tracks: DataFrame) -> DataFrame:
    """Newest point of every vessel."""
    row = F.struct("id", "timestamp", "lat", "lng", "speed", "heading", "status_raw")
    return (tracks.where(F.col("timestamp").isNotNull()).groupBy("mmsi")
            .agg(F.max_by(row, F.struct("timestamp", "id")).alias("p")).select("mmsi", "p.*"))


def latest_position(tracks: DataFrame) -> DataFrame:
    return latest_point(tracks).select("mmsi", "lat", "lng")


def recent_window(tracks: DataFrame, hours: int) -> DataFrame:
    """Points within ``hours`` of the vessel's own newest point."""
    if hours <= 0:
        return tracks.limit(0)
    newest = tracks.groupBy("mmsi").agg(F.max("timestamp").alias("_newest"))
    return (tracks.join(newest, "mmsi")
            .where(F.col("timestamp") >= F.col("_newest") - F.make_dt_interval(hours=F.lit(hours)))
            .drop("_newest"))


def _when() -> Column:
    return F.struct("timestamp", "id")


def _placed() -> Column:
    return F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("timestamp").isNotNull()


def _newest_time() -> Column:
    return F.max("timestamp").alias("latest_ts")


def _newest_spot() -> Column:
    return F.max_by(F.struct("lat", "lng"), F.when(_placed(), _when())).alias("_spot")


def _last_step() -> Column:
    return F.max_by(F.struct("step_m", "gap_s"), F.when(_placed(), _when())).alias("_last")


def _with_drift(facts: DataFrame, recent: DataFrame, window_hours: int) -> DataFrame:
    """Adds how many positions lie near the newest time of a vessel, and how far they are from its newest spot."""
    near = recent.where(_placed()).select("mmsi", F.col("timestamp").alias("_ts"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    soon = F.col("_ts") >= F.col("latest_ts") - F.make_dt_interval(hours=F.lit(window_hours))
    drift = F.when(soon, geo.haversine_m(F.col("_spot.lat"), F.col("_spot.lng"), F.col("_lat"), F.col("_lng")))
    same = [c for c in facts.columns if c not in ("mmsi", "_spot")]
    return facts.join(near, "mmsi", "left").groupBy("mmsi").agg(
        *(F.any_value(c).alias(c) for c in same), F.count_if(soon).alias("_in_window"), F.max(drift).alias("_drift"))


def _facts(recent: DataFrame, window_hours: int, drift_m: float, gap_hours: float) -> DataFrame:
    """Everything the rules need to know about a vessel, one row per vessel.

    One pass finds the steps, one aggregate takes all that needs no other row, one join the drift around
    the newest point. Of each hour at most as many speeds as count in the end are gathered.
    """
    when = _when()
    steps = long_track_segments(recent, keep=["speed", "heading"], all_points=True)
    valid = F.col("speed_ms").isNotNull()
    rank = F.row_number().over(Window.partitionBy("mmsi", "_bucket", valid).orderBy(*newest_first()))
    steps = steps.withColumn("_age", F.when(valid, rank))
    tail = F.slice(F.sort_array(F.collect_list(F.when(F.col("_age") <= V.SPEED_TAIL, F.struct("timestamp", "id", "speed_ms"))), False), 1, V.SPEED_TAIL)
    facts = steps.groupBy("mmsi").agg(
        _newest_time(), F.max_by(F.struct("lat", "lng", "heading"), when).alias("_row"), _newest_spot(), _last_step(), tail.alias("_tail"),
        F.percentile(F.when(F.col("speed") >= 0, F.col("speed")), 0.5).alias("_median_kn"))
    facts = _with_drift(facts, recent, window_hours)
    speeds = F.array_sort(F.transform("_tail", lambda x: x.speed_ms))
    n = F.size(speeds)
    middle = (F.get(speeds, F.floor((n - 1) / 2).cast("int")) + F.get(speeds, F.floor(n / 2).cast("int"))) / 2
    facts = facts.withColumns({"lat": F.col("_row.lat"), "lng": F.col("_row.lng"), "heading": F.col("_row.heading"), "_step_m": F.col("_last.step_m"),
                               "_gap_s": F.col("_last.gap_s"), "_median_ms": F.when(n > 0, middle)})
    return at_rest(facts, drift_m, gap_hours)


def at_rest(facts: DataFrame, drift_m: float = V.DRIFT_M, gap_hours: float = 2) -> DataFrame:
    """Whether the points around the newest one, or else the last step, show a vessel that stays where it is."""
    still = (F.col("_gap_s") / 3600 >= gap_hours) & (F.col("_step_m") <= drift_m)
    return (facts.withColumn("by_window", (F.col("_in_window") >= 2) & (F.col("_drift") <= drift_m))
            .withColumn("by_fallback", (F.col("_in_window") < 2) & F.coalesce(still, F.lit(False))))


def stationary_window(recent: DataFrame, window_hours: int = 2, drift_m: float = V.DRIFT_M) -> DataFrame:
    """Vessels with at least two positions near their newest point in time, and how far they drifted."""
    facts = _with_drift(recent.groupBy("mmsi").agg(_newest_time(), _newest_spot()), recent, window_hours)
    return facts.where(F.col("_in_window") >= 2).select(
        "mmsi", F.col("_in_window").alias("points"), F.col("_drift").alias("max_drift_m"),
        (F.col("_drift") <= drift_m).alias("is_stationary"))


def stationary_fallback(recent: DataFrame, gap_hours: float = 2, drift_m: float = V.DRIFT_M) -> DataFrame:
    """Other vessels: newest two positions far apart in time and close in space."""
    steps = long_track_segments(recent, all_points=True)
    facts = _with_drift(steps.groupBy("mmsi").agg(_newest_time(), _newest_spot(), _last_step()), recent, 2)
    facts = at_rest(facts.withColumns({"_step_m": F.col("_last.step_m"), "_gap_s": F.col("_last.gap_s")}), drift_m, gap_hours)
    return facts.where(F.col("_in_window") < 2).select("mmsi", F.col("by_fallback").alias("is_stationary"))


def offline_rule(ships: DataFrame, recent: DataFrame, as_of: datetime, offline_hours: int = 2) -> DataFrame:
    """Per ship with a mmsi: is there no point, or only old ones?"""
    newest = recent.groupBy("mmsi").agg(F.max("timestamp").alias("latest_ts"))
    rows = ships.where(geo.has_mmsi(F.col("mmsi"))).select("id", F.trim("mmsi").alias("mmsi")).join(newest, "mmsi", "left")
    return rows.withColumn("is_offline", _offline(as_of, offline_hours))


def _offline(as_of: datetime, hours: int) -> Column:
    return F.col("latest_ts").isNull() | (F.col("latest_ts") < ts(as_of - timedelta(hours=hours)))


def vessel_status(tracks: DataFrame, as_of: datetime, days: int = 3, offline_hours: int = 2,
                  limit: int | None = None, salts: int | None = None) -> DataFrame:
    """Status, speed in knots, heading and position of every vessel with points in the last days.

    Offline, else stationary, else by the median segment speed, else by the recorded speeds.
    """
    facts = _facts(recent_tracks(tracks, as_of, days, limit, salts), 2, V.DRIFT_M, 2)
    return status_rows(facts, as_of, offline_hours)


def status_rows(facts: DataFrame, as_of: datetime, offline_hours: int) -> DataFrame:
    """The rules: status, speed in knots, heading and position from a vessel's facts."""
    facts = facts.withColumn("_offline", _offline(as_of, offline_hours))
    facts = facts.withColumn("_still", ~F.col("_offline") & (F.col("by_window") | F.col("by_fallback")))
    speed = F.coalesce("_median_ms", geo.knots_to_ms(F.col("_median_kn")))
    return facts.select(
        "mmsi",
        F.when(F.col("_offline"), F.lit("offline")).when(F.col("_still"), F.lit("moored"))
        .otherwise(geo.speed_status(speed)).alias("status"),
        F.when(F.col("_offline"), F.lit(None)).when(F.col("_still"), F.lit(0.0))
        .otherwise(geo.ms_to_knots(speed)).alias("speed_kn"),
        "heading",
        F.when(~F.col("_offline"), geo.location_text(F.col("lat"), F.col("lng"))).alias("location"),
        F.col("latest_ts").alias("status_date"))


def long_track_segments(tracks: DataFrame, bucket_seconds: int = 3600, keep: list[str] | None = None, all_points: bool = False,
                        by_range: bool = False) -> DataFrame:
    """Distance and speed of every step of whole tracks, however long one track is.

    ``keep`` names more columns to carry along. With ``all_points`` rows without a position stay, as rows without a
    step, and `_bucket` tells the time bucket. ``by_range`` is for tracks with millions of points in one hour: it
    deals points by range instead of by hour, for the price of one written table.
    """
    if by_range and all_points:
        raise ValueError("by_range takes points with a position only")
    placed = F.col("timestamp").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    points = tracks.select("mmsi", "id", "timestamp", "lat", "lng", *(keep or []))
    if not all_points:
        points = points.where(placed)
    if by_range:
        steps = ranged_previous(points, "mmsi", "timestamp", "id", ["lat", "lng"])
    else:
        steps = with_previous(points, "mmsi", "timestamp", "id", ["lat", "lng"], bucket_seconds, placed if all_points else None)
    steps = (steps.withColumn("_pt", _point())
             .withColumn("step_m", geo.haversine_m(F.col("prev.lat"), F.col("prev.lng"), F.col("lat"), F.col("lng")))
             .withColumn("gap_s", F.when(F.col("_pt").isNotNull(), geo.seconds_between(F.col("prev.timestamp"), F.col("timestamp"))))
             .withColumn("speed_ms", _segment_speed("prev")).drop("prev", "_pt"))
    return steps if all_points else steps.drop("_bucket")


def path_length(tracks: DataFrame, bucket_seconds: int = 3600, by_range: bool = False) -> DataFrame:
    """Length of every track and of its last step."""
    return long_track_segments(tracks, bucket_seconds, by_range=by_range).groupBy("mmsi").agg(
        F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("total_m"),
        F.coalesce(F.max_by("step_m", F.struct("timestamp", "id")), F.lit(0.0)).alias("last_step_m"))


def track_extent(tracks: DataFrame) -> DataFrame:
    """Bounding box of every track; a single position is flagged."""
    return tracks.groupBy("mmsi").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"),
        F.max("lng").alias("max_lng")).withColumn(
        "is_single_spot", (F.col("min_lat") == F.col("max_lat")) & (F.col("min_lng") == F.col("max_lng")))


def has_track(tracks: DataFrame, as_of: datetime, days: int = 3) -> DataFrame:
    """Vessels with at least two points in the last days."""
    return (dated(tracks, as_of - timedelta(days=days), as_of).where(_since(as_of, days)).groupBy("mmsi")
            .agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= 2))
