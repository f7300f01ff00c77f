"""Map layers as tidy tables and GeoJSON features; drawing is left to map tools."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import clip
from .kinematics import trip


def lines(df: DataFrame, state: str = "is_fishing") -> DataFrame:
    """trip_id, run, state and the run's points in time order (array<struct<lon, lat>>): polylines of more than one point."""
    w = trip()
    change = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    runs = df.withColumn("run", F.sum(change).over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = F.array_sort(F.collect_list(F.struct("t_us", "event_id", "longitude", "latitude")))
    out = runs.groupBy("trip_id", "run").agg(F.min(state).alias("state"), at.alias("p")).where(F.size("p") > 1)
    return out.select("trip_id", "run", "state", F.transform("p", lambda x: F.struct(x["longitude"].alias("lon"), x["latitude"].alias("lat"))).alias("points"))


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def point_features(df: DataFrame, *properties: str) -> DataFrame:
    return df.select(_feature("Point", F.array("longitude", "latitude"), F.struct(*properties)).alias("feature"))


def line_features(df: DataFrame) -> DataFrame:
    return df.select(_feature("LineString", F.transform("points", lambda p: F.array(p["lon"], p["lat"])), F.struct("trip_id", "run", "state")).alias("feature"))


def hex_features(df: DataFrame, resolution: int, *properties: str) -> DataFrame:
    """Polygons from the hexagons' centres (columns lat and lon)."""
    from .hexgrid import boundary

    ring = boundary(F.col("lat"), F.col("lon"), resolution)
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return df.select(_feature("Polygon", F.array(F.transform(closed, lambda p: F.array(p["lon"], p["lat"]))), F.struct(*properties)).alias("feature"))


def clusters(df: DataFrame, zooms: tuple[int, ...] = tuple(range(4, 13)), per_tile: int = 4, state: str = "is_fishing") -> DataFrame:
    """zoom, n_points, lat, lon, share: points clustered for each zoom level of a web map, with their mean place and the part whose state is 1.

    Cells are per_tile (a power of 2) to a side of a map tile, so that four cells of a level make one of the level above: points
    are summed up by the finest cells once, and all levels are made of those sums.  Points without a place are left out."""
    from ..sources.staging import staged

    finest = max(zooms)
    lat = F.radians(clip(F.col("latitude"), -85.05112878, 85.05112878))
    x, y = (F.col("longitude") + 180) / 360, F.lit(0.5) - F.log(F.tan(F.lit(math.pi / 4) + lat / 2)) / (2 * math.pi)
    side = 2**finest * per_tile  # the map's own edge belongs to the last cell
    cell = lambda v: F.greatest(F.least(F.floor(v * float(side)).cast("long"), F.lit(side - 1)), F.lit(0))
    at = df.where("latitude is not null and longitude is not null").groupBy(cell(x).alias("cx"), cell(y).alias("cy"))
    sums = [F.count("*").alias("n"), F.sum("latitude").alias("slat"), F.sum("longitude").alias("slon"), F.count_if(F.col(state) == 1).alias("ones")]
    at = staged(at.agg(*sums), "clusters").withColumn("zoom", F.explode(F.array(*map(F.lit, sorted(zooms)))))
    up = lambda c: F.expr(f"shiftright({c}, {finest} - zoom)").alias(c)
    out = at.groupBy("zoom", up("cx"), up("cy")).agg(*[F.sum(c).alias(c) for c in ("n", "slat", "slon", "ones")])
    return out.select("zoom", F.col("n").alias("n_points"), (F.col("slat") / F.col("n")).alias("lat"), (F.col("slon") / F.col("n")).alias("lon"), (F.col("ones") / F.col("n")).alias("share"))


def zoom(df: DataFrame) -> DataFrame:
    """center_lat, center_lon and a zoom level from the larger side of the box, in degrees."""
    out = df.agg(F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"), F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude")).alias("_d"))
    d = F.col("_d")
    return out.withColumn("zoom", F.when(d > 10, 5).when(d > 5, 6).when(d > 2, 7).when(d > 1, 8).when(d > 0.5, 9).when(d > 0.2, 10).otherwise(11)).drop("_d")
