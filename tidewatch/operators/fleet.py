"""The vessel registry: positions, counts, ordering and search."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import vocab as V
from tidewatch.functions import geo, text as T
from tidewatch.operators.filters import ts
from tidewatch.operators.tracks import latest_position, vessel_status


def is_active(as_of: datetime, hours: int = 24) -> Column:
    return F.coalesce(F.col("updated_at") >= ts(as_of - timedelta(hours=hours)), F.lit(False))


def vessel_search(ships: DataFrame, query: str) -> DataFrame:
    q = query.lower().strip()
    if not q:
        return ships

    def has(name: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(q))

    return ships.where(has("name") | has("mmsi") | has("company"))


def position_resolve(ships: DataFrame, tracks: DataFrame) -> DataFrame:
    """Add lat, lng: the registry's own location text, else the newest track point."""
    own = geo.parse_location(F.col("location"))
    rows = ships.withColumn("_own", own).withColumn("_mmsi", F.trim("mmsi"))
    last = latest_position(tracks).select(F.col("mmsi").alias("_mmsi"), F.col("lat").alias("_t_lat"),
                                          F.col("lng").alias("_t_lng"))
    rows = rows.join(last, "_mmsi", "left")
    use_own = F.coalesce(geo.is_shown_position(F.col("_own.lat"), F.col("_own.lng")), F.lit(False))
    use_track = F.coalesce(geo.is_shown_position(F.col("_t_lat"), F.col("_t_lng")), F.lit(False))
    return (rows.withColumn("lat", F.when(use_own, F.col("_own.lat")).when(use_track, F.col("_t_lat")))
            .withColumn("lng", F.when(use_own, F.col("_own.lng")).when(use_track, F.col("_t_lng")))
            .drop("_own", "_mmsi", "_t_lat", "_t_lng"))


def fleet_overview(ships: DataFrame, tracks: DataFrame, as_of: datetime) -> DataFrame:
    """Registry with positions and activity."""
    return (position_resolve(ships, tracks).withColumn("is_active", is_active(as_of))
            .withColumn("is_tracked", geo.is_tracked(F.col("mmsi"))))


def fleet_counts(overview: DataFrame) -> DataFrame:
    return overview.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_tracked").alias("tracked"),
                        F.count_if("is_active").alias("active"), F.count("lat").alias("visible"))


def with_status_key(ships: DataFrame) -> DataFrame:
    return ships.withColumn("status_key", geo.effective_status(F.col("mmsi"), F.col("status"), F.col("speed")))


def status_counts(ships: DataFrame) -> DataFrame:
    """Vessels with a mmsi per status key."""
    return (with_status_key(ships.where(geo.has_mmsi(F.col("mmsi")))).groupBy("status_key")
            .agg(F.count(F.lit(1)).alias("vessels")))


def plottable(overview: DataFrame) -> DataFrame:
    return overview.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & geo.has_mmsi(F.col("mmsi")))


def vessel_bbox(overview: DataFrame, pad: float = 0.2) -> DataFrame:
    """Box around all plottable vessels, widened on every side by a share of its size."""
    box = plottable(overview).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"),
                                  F.max("lng").alias("e"))
    high, wide = F.abs(F.col("s") - F.col("n")) * pad, F.abs(F.col("w") - F.col("e")) * pad
    return box.select((F.col("s") - high).alias("south"), (F.col("w") - wide).alias("west"),
                      (F.col("n") + high).alias("north"), (F.col("e") + wide).alias("east"))


def fleet_group_sort(ships: DataFrame) -> DataFrame:
    """Known companies in fixed order, then by name, the rest last; inside by status, then name."""
    company = T.first_filled(F.col("company"), F.lit(V.FLEET_OTHER))
    rows = with_status_key(ships.withColumn("company_group", company))
    place = F.array_position(F.array(*[F.lit(c) for c in V.FLEET_ORDER]), F.col("company_group"))
    group_rank = (F.when(place > 0, place - 1).when(F.col("company_group") == V.FLEET_OTHER, len(V.FLEET_ORDER) + 1)
                  .otherwise(len(V.FLEET_ORDER))).cast("int")
    return (rows.withColumn("group_rank", group_rank)
            .withColumn("vessel_rank", geo.status_rank(F.col("mmsi"), F.col("status_key")))
            .orderBy("group_rank", "company_group", "vessel_rank", "name", "id"))


def vessel_name_choice(shipname: Column, name: Column, registry_name: Column) -> Column:
    return T.first_filled(shipname, name, registry_name)


def fleet_position_join(ships: DataFrame, payload: DataFrame) -> DataFrame:
    """Registry ships with a mmsi and their newest reported position."""
    return ships.where(F.col("mmsi") != "").select("mmsi", F.col("name").alias("registry_name")).join(payload, "mmsi")


def position_update(ships: DataFrame, placed: DataFrame, as_of: datetime) -> DataFrame:
    """Write reported positions (mmsi, lat, lng, speed, heading, status_raw, place columns) to the registry."""
    new = placed.select("mmsi", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("speed").alias("_speed"),
                        F.col("heading").alias("_heading"), F.col("status_raw").alias("_status"),
                        F.col("country").alias("_country"), F.col("continent").alias("_continent"),
                        F.col("province").alias("_province"), F.col("city").alias("_city"), F.lit(True).alias("_hit"))
    for name in ("province", "city"):
        if name not in ships.columns:
            ships = ships.withColumn(name, F.lit(None).cast("string"))
    rows = ships.join(new, "mmsi", "left")
    change = {"location": F.concat_ws(", ", F.col("_lat").cast("string"), F.col("_lng").cast("string")),
              "updated_at": ts(as_of), "country": F.col("_country"), "continent": F.col("_continent"),
              "province": F.col("_province"), "city": F.col("_city"), "speed": F.col("_speed"),
              "heading": F.col("_heading"), "status": F.col("_status")}
    return rows.select(*[F.when(F.col("_hit"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c)
                         for c in ships.columns])


def fleet_status_update(ships: DataFrame, tracks: DataFrame, as_of: datetime, days: int = 3,
                        offline_hours: int = 2, limit: int | None = None) -> DataFrame:
    """Recompute the status of every ship with a mmsi and write it back; ``status_date`` is added or kept up."""
    seen = vessel_status(tracks, as_of, days, offline_hours, limit)
    wanted = ships.where(geo.has_mmsi(F.col("mmsi"))).select("id", "mmsi", F.col("location").alias("_loc"), "region")
    status = wanted.join(seen.withColumnRenamed("mmsi", "_m"), F.trim("mmsi") == F.col("_m"), "left").select(
        "id", F.coalesce("status", F.lit("offline")).alias("_s"), F.coalesce("status_date", ts(as_of)).alias("_d"),
        T.first_filled(F.col("location"), F.col("_loc")).alias("_l"), F.col("speed_kn").alias("_kn"),
        F.col("heading").alias("_h"), F.lit(True).alias("_hit"))
    rows = ships.join(status, "id", "left")
    hit = F.col("_hit")
    change = {"status": F.when(hit, F.col("_s")).otherwise(F.col("status")),
              "location": F.when(hit, F.col("_l")).otherwise(F.col("location")),
              "updated_at": F.when(hit, ts(as_of)).otherwise(F.col("updated_at")),
              "speed": F.coalesce("_kn", "speed"), "heading": F.coalesce("_h", "heading")}
    if "status_date" in ships.columns:
        kind = ships.schema["status_date"].dataType
        change["status_date"] = F.when(hit, F.col("_d").cast(kind)).otherwise(F.col("status_date"))
        return rows.select(*[change.get(c, F.col(c)).alias(c) for c in ships.columns])
    return rows.select(*[change.get(c, F.col(c)).alias(c) for c in ships.columns], F.col("_d").alias("status_date"))


