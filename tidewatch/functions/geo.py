"""Positions, distances, speeds and vessel status keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch import vocab as V
from tidewatch.functions.labels import lookup
from tidewatch.functions.text import contains_any, is_blank


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = (F.sin(half_lat) * F.sin(half_lat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng))
    # rounding may lift antipodes above 1; NULL stays NULL
    return 2 * V.EARTH_RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def ms_to_knots(c: Column) -> Column:
    return c / V.KNOT_MS


def knots_to_ms(c: Column) -> Column:
    return c * V.KNOT_MS


def is_nonzero_position(lat: Column, lng: Column) -> Column:
    """Write side: refuse points next to 0,0."""
    return ~((F.abs(lat) < 0.01) & (F.abs(lng) < 0.01))


def is_shown_position(lat: Column, lng: Column) -> Column:
    """Read side: the bound itself does not count as a position."""
    return (F.abs(lat) > 0.01) | (F.abs(lng) > 0.01)


def location_text(lat: Column, lng: Column) -> Column:
    return F.when(lat.isNotNull() & lng.isNotNull(), F.format_string("%.6f, %.6f", lat, lng))


def parse_location(text: Column) -> Column:
    """STRUCT<lat, lng> from "lat, lng"; NULL unless there are exactly two numbers."""
    parts = F.split(text, ",", -1)
    lat = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double")
    lng = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def speed_status(speed_ms: Column) -> Column:
    return (F.when(speed_ms.isNull(), F.lit("offline")).when(speed_ms < 0.3, F.lit("moored"))
            .when(speed_ms <= 3.0, F.lit("dredging")).otherwise(F.lit("underway")))


def map_status_text(status: Column) -> Column:
    low = F.trim(F.lower(status))
    exact = lookup(low, V.STATUS_EXACT)
    chain = F.when(is_blank(low), F.lit("offline")).when(exact.isNotNull(), exact)
    for parts, key in V.STATUS_PARTS:
        chain = chain.when(contains_any(low, parts), F.lit(key))
    return chain.otherwise(F.lit("offline"))


def effective_status(mmsi: Column, status: Column, speed: Column) -> Column:
    key = map_status_text(status)
    return (F.when(is_blank(mmsi), F.lit("untracked"))
            .when((key == "offline") & (speed > 0.2), F.lit("underway")).otherwise(key))


def status_rank(mmsi: Column, key: Column) -> Column:
    return (F.when(is_blank(mmsi), 4).when(key == "dredging", 0).when(key == "underway", 1)
            .when(key == "moored", 2).when(key == "offline", 3).otherwise(2))


def has_mmsi(mmsi: Column) -> Column:
    return F.coalesce(F.trim(mmsi) != "", F.lit(False))


def is_tracked(mmsi: Column) -> Column:
    return F.coalesce(mmsi.rlike(r"\d"), F.lit(False))


def unit_vector(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    return (F.cos(F.radians(lat)) * F.cos(F.radians(lng)), F.cos(F.radians(lat)) * F.sin(F.radians(lng)),
            F.sin(F.radians(lat)))
