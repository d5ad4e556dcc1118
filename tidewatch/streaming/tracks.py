"""Streams over vessel positions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidewatch import vocab as V
from tidewatch.functions import geo
from tidewatch.operators.filters import ts
from tidewatch.operators.geocode import index_places, reverse_geocode
from tidewatch.operators.tracks import at_rest, status_rows
from tidewatch.session import stored
from tidewatch.streaming.sinks import latest_per_key, read_batches, write_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_track_ingest(reports: DataFrame, gazetteer: DataFrame, path: str, checkpoint: str,
                       as_of: datetime | None = None, **kw) -> StreamingQuery:
    """Position reports: validated, placed and appended. The places are indexed once, not in every batch."""
    index = tuple(stored(t, "places") for t in index_places(gazetteer))

    def place(batch: DataFrame) -> DataFrame:
        good = batch.where(geo.is_nonzero_position(F.col("lat"), F.col("lng")))
        if as_of is not None:
            good = good.withColumn("timestamp", F.coalesce("timestamp", ts(as_of)))
        return reverse_geocode(good, gazetteer, index=index)

    return write_batches(reports, path, checkpoint, each=place, **kw)


CHUNK_KEY, CHUNK = "chunk BIGINT", "points BINARY"
POINT = np.dtype([("ts_us", "<i8"), ("id", "<i8"), ("lat", "<f8"), ("lng", "<f8"), ("speed", "<f8"), ("heading", "<f8")])
CHUNKS = 4  # of a look-back
FACTS = ("mmsi STRING, latest_us BIGINT, lat DOUBLE, lng DOUBLE, heading DOUBLE, _in_window BIGINT, _drift DOUBLE, _step_m DOUBLE, _gap_s DOUBLE, "
         "_median_ms DOUBLE, _median_kn DOUBLE")
HOUR_US = 3_600_000_000


def _metres(lat1, lng1, lat2, lng2):
    a = (np.sin(np.radians(lat2 - lat1) / 2) ** 2
         + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2)
    return 2 * V.EARTH_RADIUS_M * np.arcsin(np.minimum(np.sqrt(a), 1.0))


def _measured(when: np.ndarray, rows: np.ndarray, window_hours: float) -> dict:
    """What `tracks._facts` measures, of one vessel's points in time order; the rules are not repeated here."""
    lat, lng, speed, heading = rows.T
    placed = ~np.isnan(lat) & ~np.isnan(lng)
    t, y, x = when[placed], lat[placed], lng[placed]
    near = t >= when[-1] - window_hours * HOUR_US
    step, gap = _metres(y[:-1], x[:-1], y[1:], x[1:]), np.diff(t) / 1e6
    ok = gap > 0
    speeds = step[ok] / gap[ok]
    speeds, knots = speeds[speeds <= V.MAX_SEGMENT_MS][-V.SPEED_TAIL:], speed[speed >= 0]
    number = lambda v: None if np.isnan(v) else float(v)
    return {"latest_us": int(when[-1]), "lat": number(lat[-1]), "lng": number(lng[-1]), "heading": number(heading[-1]), "_in_window": int(near.sum()),
            "_drift": float(_metres(y[-1], x[-1], y[near], x[near]).max()) if near.any() else None,
            "_step_m": float(step[-1]) if len(step) else None, "_gap_s": float(gap[-1]) if len(gap) else None,
            "_median_ms": float(np.median(speeds)) if len(speeds) else None, "_median_kn": float(np.median(knots)) if len(knots) else None}


def _points(rows: Iterator[Row]) -> np.ndarray:
    """Reports as they are kept in the state; missing measures are NaN."""
    return np.array([tuple(np.nan if r[c] is None else r[c] for c in POINT.names) for r in rows], POINT)


class VesselPoints(StatefulProcessor):
    """The points of a vessel's look-back, in chunks of a quarter of it by time.

    An entry of the state is the points of one chunk, packed; a report rewrites its own chunk, wherever in time it falls,
    and chunks older than the look-back of the newest point go. A repeated report replaces itself. A timer
    clears what a silent vessel leaves behind.
    """

    def __init__(self, days: int = 3, window_hours: float = 2):
        self.look_back, self.window_hours = days * 24 * HOUR_US, window_hours
        self.width = max(1, self.look_back // CHUNKS)

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", CHUNK_KEY, CHUNK)

    def handleInputRows(self, key, rows, timerValues):
        new = _points(rows)
        held = {k[0]: np.frombuffer(bytes(v[0]), POINT) for k, v in self.chunks.iterator()}
        before = max((int(x["ts_us"].max()) for x in held.values()), default=None)
        newest = int(new["ts_us"].max()) if before is None else max(before, int(new["ts_us"].max()))
        oldest = newest - self.look_back
        new = new[new["ts_us"] >= oldest]
        found = np.concatenate([*held.values(), new])
        found = found[np.lexsort((np.arange(len(found)), found["id"], found["ts_us"]))]
        last = np.append((found["ts_us"][1:] != found["ts_us"][:-1]) | (found["id"][1:] != found["id"][:-1]), True)
        found = found[last & (found["ts_us"] >= oldest)]  # of a repeated report, the one that came last
        for chunk in held:
            if chunk < oldest // self.width:
                self.chunks.removeKey((chunk,))
        of = found["ts_us"] // self.width
        for chunk in np.unique(new["ts_us"] // self.width).tolist():
            self.chunks.updateValue((chunk,), (found[of == chunk].tobytes(),))
        if before is None or before // 1000 != newest // 1000:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            self.handle.registerTimer(newest // 1000)
        values = np.stack([found[c] for c in POINT.names[2:]], axis=1)
        facts = _measured(found["ts_us"], values, self.window_hours)
        yield Row(mmsi=key[0], **facts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.chunks.clear()
        return iter([])


def vessel_facts_stream(points: DataFrame, days: int = 3, window_hours: float = 2) -> DataFrame:
    """The facts of a vessel, anew whenever it reports, in time or late.

    The look-back of a vessel ends at its newest report. The watermark is two look-backs behind the newest report of
    all, so every report counts that can lie in the look-back of a vessel that is still listed (`current_status`).

    ``points``: id, mmsi, lat, lng, speed, heading, timestamp.
    """
    rows = points.select("mmsi", "id", "lat", "lng", "speed", "heading", F.col("timestamp").cast("timestamp").alias("timestamp"))
    rows = rows.where(F.col("timestamp").isNotNull() & F.col("mmsi").isNotNull() & F.col("id").isNotNull())
    rows = rows.withColumn("ts_us", F.unix_micros("timestamp")).withWatermark("timestamp", f"{2 * days} days")
    facts = rows.groupBy("mmsi").transformWithState(
        statefulProcessor=VesselPoints(days, window_hours), outputStructType=FACTS, outputMode="Update", timeMode="EventTime")
    return facts.select("mmsi", F.timestamp_micros("latest_us").alias("latest_ts"), *facts.columns[2:])


def start_vessel_status(points: DataFrame, path: str, checkpoint: str, days: int = 3, **kw) -> StreamingQuery:
    """Keep the newest facts of every vessel; folds keep one row of each."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def numbered(rows: DataFrame, batch_id: int) -> DataFrame:
        return rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("mmsi").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "mmsi"]), "batch_id").alias("s")).select("mmsi", "s.*")

    return write_batches(vessel_facts_stream(points, days), path, checkpoint, mode="update", each=numbered, with_id=True, combine=newest, **kw)


def current_status(spark: SparkSession, path: str, as_of: datetime | None = None, days: int = 3, offline_hours: int = 2) -> DataFrame:
    """Status of every vessel with reports in the last days up to ``as_of`` (default: the newest report), by the rules of the batch job."""
    facts = latest_per_key(read_batches(spark, path), ["mmsi"]).withColumn("latest_ts", F.col("latest_ts").cast("timestamp_ntz"))
    as_of = as_of or facts.agg(F.max("latest_ts")).first()[0]
    if as_of is None:
        return status_rows(at_rest(facts), datetime(1970, 1, 1), offline_hours)
    return status_rows(at_rest(facts.where(F.col("latest_ts") >= ts(as_of - timedelta(days=days)))), as_of, offline_hours)
