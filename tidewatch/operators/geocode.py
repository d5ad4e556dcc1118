"""Nearest known place of a position, without comparing every position with every place.

Positions are collapsed to small cells, of which a sphere has a bounded number, and the places that
can be nearest to any point of a cell are found once per cell. Places lie in cubes of several sizes
in three dimensions, where neither poles nor the date line are special: whatever is within one cube
length of a cell lies in one of the 27 cubes around it. One representative per cube bounds the
distance to the nearest place; that bound picks the cube size in which all candidates must lie.
Both steps are equi-joins. Only the coarsest cells go through the cubes, some thousands at most; finer
cells look among the candidates of the cell they lie in, so that a cell far from any place meets the
few places its surroundings can be nearest to, not all of a continent. Positions then meet only the
few candidates of their own cell, inside the row, with no further shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import vocab as V
from tidewatch.functions import geo, text as T
from tidewatch.functions.labels import lookup

CELL_DEGREES = 0.1
# cells of each level, coarsest first, in cells of the finest
LEVELS = [32, 1]
# chord lengths on the unit sphere; cubes of the last size reach every place
CUBE_SIZES = [1 / 256, 1 / 64, 1 / 16, 1 / 4, 1.0, 2.0]


def cell_radius(width: int = 1) -> float:
    """Chord from the middle of a cell to its corner, with a margin for rounding."""
    return math.radians(CELL_DEGREES * width) / math.sqrt(2) * 1.01


def _cell(name: str) -> Column:
    return F.floor(F.col(name) / CELL_DEGREES)


def _with_xyz(df: DataFrame, lat: Column, lng: Column) -> DataFrame:
    x, y, z = geo.unit_vector(lat, lng)
    return df.withColumns({"x": x, "y": y, "z": z})


KEYS = ["size_no", "kx", "ky", "kz"]


def _sizes() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("size_no"), F.lit(float(s)).alias("size")) for i, s in enumerate(CUBE_SIZES)])


def _cubes(df: DataFrame, sizes: Column) -> DataFrame:
    """One row per cube size with the cube the point lies in."""
    rows = df.withColumn("_s", F.explode(sizes))
    cube = {f"k{a}": F.floor(F.col(a) / F.col("_s.size")).cast("int") for a in ("x", "y", "z")}
    return rows.withColumn("size_no", F.col("_s.size_no")).withColumns(cube).drop("_s")


def _spread(df: DataFrame) -> DataFrame:
    """Announce every row to the 27 cubes around its own."""
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for k in ("kx", "ky", "kz"):
        df = df.withColumn("_d", F.explode(step)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
    return df


def index_places(gazetteer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cube representatives, places by cube), both announced to the neighbouring cubes.

    Depends on the gazetteer alone, so a job that runs often can store the two tables and pass them
    to ``cell_candidates``.
    """
    places = _cubes(_with_xyz(gazetteer, F.col("lat"), F.col("lng")), _sizes())
    one = places.groupBy(*KEYS).agg(F.min(F.struct("x", "y", "z")).alias("q"))
    place = F.struct("place", "admin1", "cc", "continent", "lat", "lng")
    return _spread(one), _spread(places.select(*KEYS, F.struct("x", "y", "z").alias("q"), place.alias("p")))


def _chord() -> Column:
    return F.sqrt(sum((F.col(a) - F.col(f"q.{a}")) * (F.col(a) - F.col(f"q.{a}")) for a in ("x", "y", "z")))


def _level(cells: DataFrame, width: int) -> DataFrame:
    """The cells of a level that hold the given finest cells, with their middles."""
    up = [F.floor(F.col(c) / width).alias(c) for c in ("cell_lat", "cell_lng")]
    middle = [(F.col(c) + 0.5) * (CELL_DEGREES * width) for c in ("cell_lat", "cell_lng")]
    return _with_xyz(cells.select(*up).distinct() if width > 1 else cells, *middle)


def _nearest_of(met: DataFrame, width: int) -> DataFrame:
    """Of the places a cell has met those that can be nearest to one of its points."""
    nearest = F.min("d").over(Window.partitionBy("cell_lat", "cell_lng"))
    near = met.withColumn("d", _chord()).withColumn("reach", nearest + 2 * cell_radius(width))
    return near.where(F.col("d") <= F.col("reach")).select("cell_lat", "cell_lng", "q", "p")


def _coarse_candidates(cells: DataFrame, index: tuple[DataFrame, DataFrame], width: int) -> DataFrame:
    """Candidates through the cubes; for cells of which there are few."""
    representatives, places = index
    bound = (_cubes(_level(cells, width), _sizes()).join(representatives, KEYS).groupBy("cell_lat", "cell_lng", "x", "y", "z")
             .agg((F.min(_chord()) + 2 * cell_radius(width)).alias("within")))
    pick = F.lit(len(CUBE_SIZES) - 1)
    for i in reversed(range(len(CUBE_SIZES) - 1)):
        pick = F.when(F.col("within") <= CUBE_SIZES[i], i).otherwise(pick)
    return _nearest_of(_cubes(bound, F.array(F.element_at(_sizes(), pick + 1))).join(places, KEYS), width)


def met_in_parents(cells: DataFrame, parents: DataFrame, width: int, parent_width: int) -> DataFrame:
    """Every cell of a level with the candidates of the coarser cell it lies in."""
    ratio = parent_width // width
    own = (_level(cells, width).withColumn("_lat", F.floor(F.col("cell_lat") / ratio))
           .withColumn("_lng", F.floor(F.col("cell_lng") / ratio)))
    above = parents.select(F.col("cell_lat").alias("_lat"), F.col("cell_lng").alias("_lng"), "q", "p")
    return own.join(above, ["_lat", "_lng"]).drop("_lat", "_lng")


def cell_candidates(cells: DataFrame, gazetteer: DataFrame,
                    index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(cell_lat, cell_lng, places): every place that can be nearest to a point of the cell."""
    found = _coarse_candidates(cells, index or index_places(gazetteer), LEVELS[0])
    for above, width in zip(LEVELS, LEVELS[1:]):
        found = _nearest_of(met_in_parents(cells, found, width, above), width)
    return found.groupBy("cell_lat", "cell_lng").agg(F.collect_list("p").alias("places"))


def continent_name(code: Column) -> Column:
    """Name of a continent code, for building ``country_dim``."""
    return F.coalesce(lookup(code, V.CONTINENT_CODES), F.lit("Unknown"))


def reverse_geocode(points: DataFrame, gazetteer: DataFrame, country_dim: DataFrame | None = None,
                    index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Add city, province, country and continent of the nearest place; empty where lat or lng is 0.

    ``gazetteer`` has place, admin1, cc, continent, lat and lng. ``country_dim`` (cc, country,
    continent), if given, supplies names; unknown codes stay codes, with continent Unknown.
    """
    real = (F.col("lat") != 0) & (F.col("lng") != 0)
    rows = points.withColumn("cell_lat", F.when(real, _cell("lat"))).withColumn("cell_lng", F.when(real, _cell("lng")))
    cells = rows.select("cell_lat", "cell_lng").where(F.col("cell_lat").isNotNull()).distinct()
    rows = rows.join(cell_candidates(cells, gazetteer, index), ["cell_lat", "cell_lng"], "left")
    measured = F.transform("places", lambda p: F.struct(
        F.round(geo.haversine_m(F.col("lat"), F.col("lng"), p["lat"], p["lng"]), 3).alias("dist"),
        p["place"].alias("place"), p["admin1"].alias("admin1"), p["cc"].alias("cc"),
        p["continent"].alias("continent")))
    rows = rows.withColumn("_near", F.array_min(measured))
    if country_dim is not None:
        names = country_dim.select(F.col("cc").alias("_cc"), F.col("country").alias("_country"),
                                   F.col("continent").alias("_continent"))
        rows = rows.withColumn("_cc", F.col("_near.cc")).join(names, "_cc", "left").drop("_cc")
    else:
        rows = rows.withColumn("_country", F.lit(None).cast("string")).withColumn("_continent", F.col("_near.continent"))
    blank = F.lit("")
    has_cc = ~T.is_blank(F.col("_near.cc"))
    return (rows.withColumn("city", F.coalesce("_near.place", blank))
            .withColumn("province", F.coalesce("_near.admin1", blank))
            .withColumn("country", F.when(has_cc, F.coalesce("_country", "_near.cc")).otherwise(blank))
            .withColumn("continent", F.when(has_cc, F.coalesce("_continent", F.lit("Unknown"))).otherwise(blank))
            .withColumn("place_distance_m", F.col("_near.dist"))
            .drop("cell_lat", "cell_lng", "places", "_near", "_country", "_continent"))
