"""Registered queries over vessel tracks and the vessel registry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import dates, geo, labels
from tidewatch.operators import fleet, geocode, tracks as T, upsert as U
from tidewatch.operators.filters import ts
from tidewatch.plans import jobs
from tidewatch.plans.registry import query
from tidewatch.plans.views import AS_OF, Views, as_of
from tidewatch.session import scratch_dir
from tidewatch.sources import files, sinks, track_store

DAYS, OFFLINE_HOURS = 10, 24


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def recent(v: Views) -> DataFrame:
    return T.recent_tracks(v.tracks, AS_OF, DAYS)


@query
def scan_tracks(v):
    since = AS_OF - timedelta(days=DAYS)
    return v.tracks.where(F.col("timestamp") >= ts(since)).select("mmsi", "timestamp", r6("lat"), r6("lng"), r6("speed"))


@query
def scan_ships(v):
    return v.ships


@query
def track_retention(v):
    return T.track_retention(v.tracks).select("id", "mmsi", "timestamp")


@query
def track_retention_short(v):
    return T.track_retention(v.tracks, keep=40, salts=4).select("id", "mmsi", "timestamp")


@query
def recent_tracks(v):
    return recent(v).select("id", "mmsi", "timestamp")


@query
def recent_tracks_short(v):
    return T.recent_tracks(v.tracks, AS_OF, DAYS, limit=5, salts=4).select("id", "mmsi", "timestamp")


@query
def track_history(v):
    return T.track_history(v.tracks, "7", AS_OF, 30).select(r6("lat"), r6("lng"), r6("speed"), "heading", "timestamp")


@query
def segment_speed(v):
    return T.segment_speeds(recent(v)).select("mmsi", "id", r6("speed_ms"))


@query
def last_24_speeds(v):
    return T.last_speeds(recent(v)).select("mmsi", "id", "age", r6("speed_ms"))


@query
def median_speed(v):
    return T.median_speed(recent(v)).select("mmsi", r6("speed_ms"))


@query
def fallback_speed(v):
    return T.fallback_speed(recent(v)).select("mmsi", r6("speed_ms"))


@query
def latest_point(v):
    return T.latest_point(v.tracks).select("mmsi", "id", "timestamp", r6("lat"), r6("lng"), "heading", "status_raw")


@query
def latest_position(v):
    return T.latest_position(v.tracks).select("mmsi", r6("lat"), r6("lng"))


@query
def recent_window(v):
    return T.recent_window(v.tracks, 12).select("id", "mmsi", "timestamp")


@query
def stationary_window(v):
    return T.stationary_window(recent(v)).select("mmsi", "points", F.round("max_drift_m", 3).alias("max_drift_m"),
                                                 "is_stationary")


@query
def stationary_fallback(v):
    return T.stationary_fallback(recent(v))


@query
def offline_rule(v):
    return T.offline_rule(v.ships, recent(v), AS_OF, OFFLINE_HOURS)


def _status(v: Views, hours: int) -> DataFrame:
    return T.vessel_status(v.tracks, AS_OF, DAYS, hours).select(
        "mmsi", "status", r6("speed_kn"), "heading", "location", "status_date")


@query
def vessel_status(v):
    return _status(v, OFFLINE_HOURS)


@query
def vessel_status_2h(v):
    return _status(v, 2)


@query
def fleet_status_update(v):
    return fleet.fleet_status_update(v.ships, v.tracks, AS_OF, DAYS, OFFLINE_HOURS).select(
        "id", "mmsi", "status", "status_date", "location", "region", "updated_at", r6("speed"), "heading")


@query
def path_length(v):
    return T.path_length(v.tracks).select("mmsi", F.round("total_m", 2).alias("total_m"),
                                          F.round("last_step_m", 2).alias("last_step_m"))


@query
def path_length_by_range(v):
    return T.path_length(v.tracks, by_range=True).select("mmsi", F.round("total_m", 2).alias("total_m"),
                                                         F.round("last_step_m", 2).alias("last_step_m"))


@query
def segment_speed_by_range(v):
    return T.segment_speeds(recent(v), by_range=True).select("mmsi", "id", r6("speed_ms"))


@query
def track_extent(v):
    return T.track_extent(v.tracks).select("mmsi", r6("min_lat"), r6("max_lat"), r6("min_lng"), r6("max_lng"),
                                           "is_single_spot")


@query
def has_track(v):
    return T.has_track(v.tracks, AS_OF, 3)


@query
def haversine_m(v):
    dist = geo.haversine_m(F.lit(31.23), F.lit(121.47), F.col("lat"), F.col("lng"))
    return v.tracks.select("id", F.round(dist, 3).alias("metres"))


@query
def speed_status(v):
    return v.tracks.select("id", geo.speed_status(geo.knots_to_ms(F.col("speed"))).alias("status"))


@query
def knots_ms(v):
    ms = geo.knots_to_ms(F.col("speed"))
    return v.tracks.select("id", F.round(ms, 6).alias("ms"), F.round(geo.ms_to_knots(ms), 6).alias("knots"))


@query
def parse_track_ts(v):
    iso = F.replace(F.col("timestamp").cast("string"), F.lit(" "), F.lit("T"))
    text = F.when(F.col("id") % 4 == 0, F.concat(iso, F.lit("Z"))).when(F.col("id") % 4 == 1, iso).when(
        F.col("id") % 4 == 2, F.concat(F.lit("at "), iso)).otherwise(F.lit(""))
    return v.tracks.select("id", dates.parse_track_ts(text).alias("parsed"))


@query
def location_text(v):
    return v.tracks.select("id", geo.location_text(F.col("lat"), F.col("lng")).alias("location"))


@query
def nonzero_position(v):
    centred = v.tracks.select("id", (F.col("lat") - 30).alias("lat"), (F.col("lng") - 120).alias("lng"))
    return centred.where(geo.is_nonzero_position(F.col("lat"), F.col("lng"))).select("id", r6("lat"), r6("lng"))


@query
def map_status_text(v):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", " ", "离线", "（锚泊中）", "机动船在航")]),
                        (F.col("id") % 5 + 1).cast("int"))
    text = F.concat(F.col("status_raw"), tail)
    return v.tracks.select("id", text.alias("text"), geo.map_status_text(text).alias("status_key"))


@query
def effective_status(v):
    return fleet.with_status_key(v.ships).select("id", "status_key")


@query
def status_label(v):
    return fleet.with_status_key(v.ships).select("id", labels.status_label(F.col("status_key")).alias("label"))


@query
def tracked_vessel(v):
    return v.ships.select("id", geo.is_tracked(F.col("mmsi")).alias("server"), geo.has_mmsi(F.col("mmsi")).alias("client"))


@query
def active_vessel(v):
    return v.ships.select("id", fleet.is_active(AS_OF).alias("is_active"))


@query
def vessel_search(v):
    return fleet.vessel_search(v.ships, " NATION_1").select("id", "name", "mmsi", "company")


@query
def fleet_key(v):
    return v.ships.select("id", labels.fleet_key(F.col("company")).alias("fleet"))


@query
def translate_place(v):
    names = list(V.COUNTRY_LABELS) + ["Atlantis"]
    country = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int"))
    places = list(V.CONTINENT_LABELS) + ["Moon"]
    continent = F.element_at(F.array(*[F.lit(n) for n in places]), (F.col("id") % len(places) + 1).cast("int"))
    return v.ships.select("id", labels.translate_place(country, V.COUNTRY_LABELS).alias("country"),
                          labels.translate_place(continent, V.CONTINENT_LABELS).alias("continent"))


@query
def parse_location(v):
    p = geo.parse_location(F.col("location"))
    return v.ships.select("id", p["lat"].alias("lat"), p["lng"].alias("lng"))


def overview(v: Views) -> DataFrame:
    return fleet.fleet_overview(v.ships, v.tracks, AS_OF)


@query
def vessel_position_resolve(v):
    return fleet.position_resolve(v.ships, v.tracks).select("id", r6("lat"), r6("lng"))


@query
def fleet_overview(v):
    return overview(v).select("id", "mmsi", "name", "status", "updated_at", r6("lat"), r6("lng"), "is_active", "is_tracked")


@query
def fleet_counts(v):
    return fleet.fleet_counts(overview(v))


@query
def status_counts(v):
    return fleet.status_counts(v.ships)


@query
def plottable(v):
    return fleet.plottable(overview(v)).select("id", r6("lat"), r6("lng"))


@query
def vessel_bbox(v):
    return fleet.vessel_bbox(overview(v)).select(r6("south"), r6("west"), r6("north"), r6("east"))


@query
def fleet_group_sort(v):
    return fleet.fleet_group_sort(v.ships).select("id", "company_group", "group_rank", "vessel_rank", "name")


def payloads(v: Views, batch: int = 500) -> DataFrame:
    """Position replies built from the tracks, ``batch`` reports each; every fifth reply failed."""
    i = F.col("id")
    at = as_of() - F.make_dt_interval(mins=(F.col("mmsi").cast("int") % 120))
    report = F.struct(
        i, F.struct(F.when(i % 50 == 7, "").otherwise(F.col("mmsi")).alias("mmsi"), "lat", F.col("lng").alias("lon"),
                    "speed", "heading", F.col("status_raw").alias("status"),
                    F.replace(at.cast("string"), F.lit(" "), F.lit("T")).alias("updatetime"),
                    F.when(i % 3 == 0, "").otherwise(F.col("vessel_name")).alias("shipname"),
                    F.when(i % 2 == 0, F.concat(F.lit("N"), F.col("mmsi"))).alias("name")).alias("v"))
    rows = v.tracks.select(F.floor(i / batch).alias("batch"), report.alias("r")).groupBy("batch").agg(
        F.array_sort(F.collect_list("r")).alias("rs"))
    state = F.when(F.col("batch") % 5 == 4, "error").otherwise("ok")
    return rows.select("batch", F.to_json(F.struct(state.alias("result"), F.transform("rs", lambda r: r["v"]).alias("list"))
                                          ).alias("payload"))


@query
def fleet_payload(v):
    return files.fleet_positions(payloads(v)).select("mmsi", r6("lat"), r6("lng"), r6("speed"), "heading", "status_raw",
                                                     "timestamp", "shipname", "name")


@query
def fleet_position_join(v):
    return fleet.fleet_position_join(v.ships, files.fleet_positions(payloads(v))).select(
        "mmsi", "registry_name", r6("lat"), r6("lng"))


@query
def vessel_name_choice(v):
    rows = fleet.fleet_position_join(v.ships, files.fleet_positions(payloads(v)))
    return rows.select("mmsi", fleet.vessel_name_choice(F.col("shipname"), F.col("name"), F.col("registry_name")).alias("vessel_name"))


@query
def reverse_geocode(v):
    return geocode.reverse_geocode(v.tracks.select("id", "lat", "lng"), v.gazetteer).select(
        "id", "city", "province", "country", "continent", F.round("place_distance_m", 1).alias("metres"))


@query
def position_update(v):
    placed = jobs.place_positions(files.fleet_positions(payloads(v)), v.ships, v.gazetteer, AS_OF)
    return fleet.position_update(v.ships, placed, AS_OF).select(
        "id", "mmsi", "location", "updated_at", "country", "continent", "province", "city", r6("speed"), "heading", "status")


@query
def update_status_by_mmsi(v):
    seen = T.vessel_status(v.tracks, AS_OF, DAYS, OFFLINE_HOURS)
    status = seen.select("mmsi", "status", "status_date", "location", F.lit("sea").alias("region"),
                         F.col("speed_kn").alias("speed"), "heading")
    return U.update_status_by_mmsi(v.ships, status, AS_OF).select(
        "id", "mmsi", "status", "status_date", "location", "region", r6("speed"), "heading", "updated_at")


@query
def upsert_ships(v):
    ships = v.ships
    known = ships.where(F.col("id") % 3 != 0)
    first = ships.withColumn("seq", F.col("id") * 2)
    second = ships.where(F.col("id") % 4 != 1).select(
        *[c for c in ships.columns if c not in ("name", "speed", "country")],
        F.concat("name", F.lit(" II")).alias("name"), (F.coalesce("speed", F.lit(0.0)) + 1).alias("speed"),
        F.lit(None).cast("string").alias("country"), (F.col("id") * 2 + 1).alias("seq"))
    return U.upsert_ships(known, first.unionByName(second), AS_OF).select(
        "id", "imo", "mmsi", "name", "company", "country", "location", r6("speed"), "heading", "updated_at")


@query
def fleet_job(v):
    out = jobs.fleet_job(files.fleet_positions(payloads(v)), v.ships, v.tracks, v.gazetteer, AS_OF, DAYS, OFFLINE_HOURS)
    return out["ships"].select("id", "mmsi", "status", "status_date", "location", "country", "continent", "province",
                               "city", r6("speed"), "heading", "updated_at")


@query
def append_tracks(v):
    """Two appends, read back as one table."""
    path = scratch_dir(v.spark, "tracks")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        sinks.append_tracks(v.tracks.where(part), path)
    return sinks.read_table(v.spark, path).select("id", "mmsi", r6("lat"), r6("lng"), "timestamp",
                                                  F.col("track_date").cast("string").alias("track_date"))


@query
def track_store_retention(v):
    """Two runs appended to the bucketed track store, then every vessel cut to its newest 40 points."""
    path = scratch_dir(v.spark, "track_store")
    for run, part in (("even", F.col("id") % 2 == 0), ("odd", F.col("id") % 2 == 1)):
        track_store.append(v.tracks.where(part), path, run, 16)
    track_store.retain(v.spark, path, keep=40)
    return track_store.read(v.spark, path).select("id", "mmsi", "timestamp")


@query
def read_vessel_csv(v):
    """Registry written as a GBK file and imported again."""
    path = scratch_dir(v.spark, "vessels")
    s = v.ships
    out = s.select(F.col("id").cast("string").alias("序号"),
                   F.when(F.col("id") % 2 == 0, F.concat("mmsi", F.lit(".0"))).otherwise(F.col("mmsi")).alias("MMSI"),
                   F.col("imo").alias("IMO"),
                   F.when(F.col("id") % 13 == 0, "nan").otherwise(F.concat(F.lit(" "), "name", F.lit(" "))).alias("船名"),
                   F.col("company").alias("公司"), F.lit("耙吸").alias("船舶类型"), F.col("region").alias("区域"),
                   F.col("country").alias("位置"), F.col("status").alias("目前状态"),
                   F.col("updated_at").cast("string").alias("日期"), F.lit("nan").alias("备注"))
    out.write.option("encoding", "GBK").option("header", True).csv(path)
    return files.read_vessel_csv(v.spark, path)
