"""Harbour, coastline and land filters.

Reference points and coastline segments come to the points in two ways: few of them (counted, at most SMALL) as literals
of one expression; more through joins of grids, from min_km wide to the whole earth, with the same distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_KM, haversine_km, segment_distance
from ..sources.shapefile import read_shapefile
from .rules import flag

#: (min_lat, max_lat, min_lon, max_lon).  Fixed values.
REGIONS = {
    "zanzibar": (-7.0, -4.5, 38.5, 40.5),
    "kenya": (-5.0, -1.5, 39.0, 42.0),
    "tanzania": (-11.5, -0.5, 38.5, 41.0),
    "mozambique": (-27.0, -10.0, 32.0, 41.0),
    "timor_leste": (-9.5, -8.0, 124.0, 127.5),
    "wio": (-27.0, -0.5, 32.0, 42.0),
}
DEFAULT_REGION = "wio"
#: (latitude, longitude) of landing sites.  Fixed values.
HARBORS = {
    "zanzibar": [(-6.1659, 39.1959), (-6.1435, 39.1937), (-6.2285, 39.1835), (-6.0755, 39.2992), (-6.4760, 39.5068)],
    "kenya": [(-4.0435, 39.6682), (-3.3693, 39.9618), (-4.6633, 39.6656), (-2.2827, 40.1167)],
    "timor_leste": [(-8.5569, 125.5603), (-8.4754, 125.6432), (-8.8390, 125.9558)],
    "tanzania_mainland": [(-6.7924, 39.2083), (-6.8160, 39.2803), (-10.2796, 40.1963)],
}
#: Region -> the name that its harbours have.
MAINLAND = {"tanzania": "tanzania_mainland"}
FAR_KM, SMALL = 999.0, 2000


class Regions:
    """Known regions; custom ones belong to this object."""

    def __init__(self):
        self.boxes, self.harbors = dict(REGIONS), {k: list(v) for k, v in HARBORS.items()}

    def add(self, name: str, box: tuple[float, float, float, float], harbors: list | None = None) -> None:
        self.boxes[name] = box
        if harbors:
            self.harbors[name] = list(harbors)

    def names(self) -> list[str]:
        return sorted(self.boxes)


def nearest_km(lat: Column, lon: Column, places: list[tuple[float, float]]) -> Column:
    """Great-circle km to the nearest of a few places; infinite if there are none."""
    if not places:
        return F.lit(float("inf"))
    far = [haversine_km(lat, lon, F.lit(float(a)), F.lit(float(b))) for a, b in places]
    return F.least(*far) if len(far) > 1 else far[0]


def harbor_filter(df: DataFrame, harbors: list[tuple[float, float]], min_km: float = 1.0, buffer_km: float = 0.0, effort: str = "is_fishing", score: str | None = None) -> DataFrame:
    """dist_to_shore_km, is_near_shore and <effort>_filtered (0 near a harbour).  With a buffer also shore_score: the score, rising from 0 at min_km to whole at min_km + buffer_km, NULL elsewhere."""
    if not harbors:
        raise ValueError("no harbours are known for the region; give some")
    df = df.withColumn("dist_to_shore_km", nearest_km(F.col("latitude"), F.col("longitude"), harbors))
    df = df.withColumn("is_near_shore", flag(F.col("dist_to_shore_km") < min_km)).withColumn(f"{effort}_filtered", F.when(F.col("is_near_shore") == 1, 0).otherwise(F.col(effort)))
    if buffer_km and score:
        d = F.col("dist_to_shore_km")
        df = df.withColumn("shore_score", F.when((d >= min_km) & (d < min_km + buffer_km), F.col(score) * (d - min_km) / buffer_km))
    return df


def read_segments(spark, path: str, land_only: bool = False) -> DataFrame:
    """ring_id, seq, x1, y1, x2, y2 of a GeoJSON file's (multi)lines and outer and inner polygon rings; land_only takes polygons only."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>>>"  # coordinates as text: their depth depends on the type
    feature = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    line, poly = "array<array<double>>", "array<array<array<double>>>"
    rings = F.when(F.col("kind") == "LineString", F.array(F.from_json("c", line))).when(F.col("kind").isin("MultiLineString", "Polygon"), F.from_json("c", poly)).when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("c", f"array<{poly}>")))
    if land_only:
        feature = feature.where(F.col("kind").isin("Polygon", "MultiPolygon"))
    ring = feature.select(F.xxhash64("c").alias("shape"), F.posexplode(rings).alias("nth", "ring"))
    step = ring.select(F.xxhash64("shape", "nth").alias("ring_id"), F.posexplode(F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2")))).alias("seq", "s"))
    return step.select("ring_id", "seq", "s.*")


def load_segments(spark, path: str, land_only: bool = False, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Segments of a shapefile (.shp), of a GeoJSON file, or of a Parquet table that install_coast() wrote; box crops them."""
    if path.endswith(".shp"):
        found = read_shapefile(spark, path, land_only, box)
    else:
        found = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_segments(spark, path, land_only)
    return crop(found, box) if box else found


def install_coast(spark, path: str, output: str, box: tuple[float, float, float, float] | None = None, land_only: bool = False) -> dict:
    """A coastline's shapefile or GeoJSON file as a Parquet table of segments, cropped to a box if given; returns how many there are and their bounds.  None at all is an error."""
    load_segments(spark, path, land_only, box).write.mode("overwrite").parquet(output)
    return check_coast(load_segments(spark, output))


def check_coast(segments: DataFrame) -> dict:
    """segments, rings and the bounds of a table of segments."""
    r = segments.agg(F.count("*").alias("segments"), F.count_distinct("ring_id").alias("rings"), F.min(F.least("y1", "y2")).alias("min_lat"), F.max(F.greatest("y1", "y2")).alias("max_lat"), F.min(F.least("x1", "x2")).alias("min_lon"), F.max(F.greatest("x1", "x2")).alias("max_lon")).first()
    if not r.segments:
        raise ValueError("the coastline has no segments")
    return r.asDict()


def clean_points(df: DataFrame) -> DataFrame:
    """Points that are neither near the shore nor on land; unmeasured ones stay."""
    land = F.coalesce(F.col("is_on_land"), F.lit(False)) if "is_on_land" in df.columns else F.lit(False)
    return df.where((F.coalesce(F.col("is_near_shore"), F.lit(0)) != 1) & ~land)


def crop(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Segments whose own box meets (min_lat, max_lat, min_lon, max_lon)."""
    a, b, c, d = box
    return segments.where((F.greatest("y1", "y2") >= a) & (F.least("y1", "y2") <= b) & (F.greatest("x1", "x2") >= c) & (F.least("x1", "x2") <= d))


def _literals(segments: list) -> Column:
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), s, strict=True)]) for s in segments])


def coast_km(lat: Column, lon: Column, segments: list[tuple[float, float, float, float]]) -> Column:
    """Planar degrees times 111 to the nearest of a few segments (x1, y1, x2, y2)."""
    return F.array_min(F.transform(_literals(segments), lambda s: segment_distance(lon, lat, s["x1"], s["y1"], s["x2"], s["y2"]))) * DEGREE_KM


def on_land(lat: Column, lon: Column, rings: list[tuple[float, float, float, float]]) -> Column:
    """Even-odd rule over a few rings' segments."""
    def crosses(s):
        up = (s["y1"] > lat) != (s["y2"] > lat)
        return F.when(up, lon < (s["x2"] - s["x1"]) * (lat - s["y1"]) / F.when(s["y2"] != s["y1"], s["y2"] - s["y1"]) + s["x1"]).otherwise(F.lit(False))

    return F.size(F.filter(_literals(rings), crosses)) % 2 == 1


def coast_filter(df: DataFrame, coast: DataFrame, land: DataFrame | None = None, min_km: float = 1.0, effort: str = "is_fishing", only_fishing: bool = True, box: tuple | None = None, few: int | None = None) -> DataFrame:
    """dist_to_shore_km, is_on_land, is_near_shore and <effort>_filtered.

    only_fishing: other points aren't measured and read FAR_KM and false.  coast and land: segment tables; with more than
    `few` (SMALL) segments (after cropping to the box) they are joined by grid cell instead of being literals, with equal results.
    Points are told apart by their place: a measured point without a coordinate has no distance and isn't on land."""
    few = SMALL if few is None else few
    coast = crop(coast, box) if box else coast
    land = crop(land, box) if box and land is not None else land
    take = lambda t: [tuple(r) for r in t.select("x1", "y1", "x2", "y2").limit(few + 1).collect()]
    edges, rings = take(coast), take(land) if land is not None else []
    measured = (F.col(effort) == 1) if only_fishing else F.lit(True)
    lat, lon = F.col("latitude"), F.col("longitude")
    if len(edges) <= few and len(rings) <= few:
        far = coast_km(lat, lon, edges) if edges else F.lit(FAR_KM)
        inside = on_land(lat, lon, rings) if rings else F.lit(False)
        df = df.withColumn("dist_to_shore_km", F.when(measured, far).otherwise(FAR_KM)).withColumn("is_on_land", F.when(measured, F.coalesce(inside, F.lit(False))).otherwise(F.lit(False)))
    else:
        df = _joined(df, coast, land, measured, min_km)
    df = df.withColumn("is_near_shore", flag(F.col("dist_to_shore_km") < min_km))
    return df.withColumn(f"{effort}_filtered", F.when((F.col("is_near_shore") == 1) | F.col("is_on_land"), 0).otherwise(F.col(effort)))


def _joined(df: DataFrame, coast: DataFrame, land: DataFrame | None, measured: Column, min_km: float) -> DataFrame:
    """The same distances as coast_km() through nested grids; land by latitude bands and longitude strips.

    Distances are worked out for different places only and come back by place, so that neither null nor repeated ids
    matter."""
    size = min_km / DEGREE_KM
    lat, lon = F.col("latitude"), F.col("longitude")
    places = df.where(measured & lat.isNotNull() & lon.isNotNull()).select("latitude", "longitude").distinct()
    near = _nearest(places, coast, size)
    found = near if land is None else near.join(_inside(places, land, size), ["latitude", "longitude"], "full")
    found = found if land is not None else found.withColumn("is_on_land", F.lit(False))
    found = found.withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    blank = F.when(measured & (lat.isNull() | lon.isNull()), F.lit(None)).otherwise(FAR_KM)
    out = df.join(found, measured & (lat == F.col("_lat")) & (lon == F.col("_lon")), "left")
    return out.withColumn("dist_to_shore_km", F.coalesce("_far", blank)).withColumn("is_on_land", F.coalesce("is_on_land", F.lit(False))).drop("_far", "_lat", "_lon")


def _inside(places: DataFrame, land: DataFrame, size: float) -> DataFrame:
    """Places with is_on_land: whether edges cross their latitude an odd number of times further east.

    Edges are cut at bands of latitude.  A band's pieces in a place's own strip of longitude are compared with it.  Of those
    in strips further east only the number that spans the place's latitude matters: strips east of one are a few dyadic
    ranges, and in each the count at a latitude is a running sum over the pieces' lower (+1) and upper ends (-1)."""
    cell = lambda c: F.floor(c / size).cast("long")
    lat, lon = F.col("latitude"), F.col("longitude")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    across = lambda y: x1 + (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1)
    edges = land.where("y1 <> y2").select("x1", "y1", "x2", "y2", F.explode(F.sequence(cell(F.least(y1, y2)), cell(F.greatest(y1, y2)))).alias("_band"))
    ends = [across(F.greatest(F.least(y1, y2), F.col("_band") * size)), across(F.least(F.greatest(y1, y2), (F.col("_band") + 1) * size))]
    pieces = edges.withColumn("_west", cell(F.least(*ends) - size / 1e3)).withColumn("_east", cell(F.greatest(*ends) + size / 1e3))  # a little wider: rounding
    at = places.withColumn("_band", cell(lat)).withColumn("_strip", cell(lon))
    hit = ((y1 > lat) != (y2 > lat)) & (lon < across(lat))
    own = at.join(pieces.withColumn("_strip", F.explode(F.sequence("_west", "_east"))), ["_band", "_strip"]).where(hit).select("latitude", "longitude", F.lit(1).cast("long").alias("n"))

    bits = math.ceil(math.log2(1080 / size))
    low = math.ceil(540 / size)  # strips from 0 on
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_l")
    up = lambda c: F.expr(f"shiftright({c} + {low}, _l)")
    east = pieces.select("_band", "_west", "y1", "y2", levels).withColumn("_node", up("_west")).where("_node % 2 = 1")
    steps = F.array(F.struct(F.least(y1, y2).alias("y"), F.lit(1).cast("long").alias("n")), F.struct(F.greatest(y1, y2).alias("y"), F.lit(-1).cast("long").alias("n")))
    steps = east.select("_band", "_l", "_node", F.inline(steps)).groupBy("_band", "_l", "_node", "y").agg(F.sum("n").alias("n"))
    asked = at.select("_band", "_strip", "latitude", "longitude", levels).withColumn("_node", up("_strip") + 1).where("_node % 2 = 1")
    asked = asked.join(steps.select("_band", "_l", "_node").distinct(), ["_band", "_l", "_node"], "left_semi").select("_band", "_l", "_node", lat.alias("y"), F.lit(0).cast("long").alias("n"), "latitude", "longitude")
    both = asked.unionByName(steps, allowMissingColumns=True)
    upto = F.sum("n").over(W.partitionBy("_band", "_l", "_node").orderBy("y").rangeBetween(W.unboundedPreceding, 0))
    beyond = both.withColumn("n", upto).where("latitude is not null").select("latitude", "longitude", "n")
    return own.unionByName(beyond).groupBy("latitude", "longitude").agg((F.sum("n") % 2 == 1).alias("is_on_land"))


def _nearest(places: DataFrame, coast: DataFrame, size: float) -> DataFrame:
    """latitude, longitude, _far: the distance to the nearest segment, however far.

    Level k has cells of size * 2**k; at the last one all is within a cell of all else.  A segment's end in a cell next to
    the point's bounds the distance; the segments near the point at the first level as wide as that bound hold the nearest.
    A segment is kept in the cells along it and next to those."""
    top = math.ceil(math.log2(540 / size))
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_k")
    width = size * F.pow(F.lit(2.0), F.col("_k"))
    cell = lambda c: F.floor(c / width).cast("long")
    x, y = F.col("longitude"), F.col("latitude")
    ends = coast.select("x1", "y1").union(coast.select("x2", "y2")).toDF("ex", "ey").select("ex", "ey", level)
    ends = ends.groupBy(cell(F.col("ex")).alias("cx"), cell(F.col("ey")).alias("cy"), "_k").agg(F.min(F.struct("ex", "ey")).alias("e"))
    ends = ends.select("_k", "e.*", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("_cx"), "cy").withColumn("_cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).drop("cy")
    place = {"_cx": cell(x), "_cy": cell(y)}
    seen = places.select("*", level).withColumns(place).join(ends, ["_k", "_cx", "_cy"])
    bound = seen.groupBy("latitude", "longitude").agg((F.min(F.sqrt(F.pow(x - F.col("ex"), 2) + F.pow(y - F.col("ey"), 2))) * (1 + 1e-9)).alias("_most"))
    wide = F.ceil(F.log2(F.greatest(F.col("_most") / size, F.lit(1.0))) + 1e-9)
    points = bound.withColumn("_k", F.least(wide, F.lit(top)).cast("int")).withColumns(place)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = coast.select("x1", "y1", "x2", "y2", level).withColumn("_cy", F.explode(F.sequence(cell(F.least(y1, y2)) - 1, cell(F.greatest(y1, y2)) + 1)))
    # of the segment the part in the row and the two next to it
    low, high = F.greatest(F.least(y1, y2), (F.col("_cy") - 1) * width), F.least(F.greatest(y1, y2), (F.col("_cy") + 2) * width)
    part = [F.when(y1 == y2, e).otherwise(x1 + (x2 - x1) * (h - y1) / F.when(y2 != y1, y2 - y1)) for e, h in ((x1, low), (x2, high))]
    cells = rows.withColumn("_cx", F.explode(F.sequence(cell(F.least(*part) - width / 1e3) - 1, cell(F.greatest(*part) + width / 1e3) + 1)))
    return points.join(cells, ["_k", "_cx", "_cy"]).groupBy("latitude", "longitude").agg((F.min(segment_distance(x, y, x1, y1, x2, y2)) * DEGREE_KM).alias("_far"))


def raster(spark, box: tuple[float, float, float, float], places: list[tuple[float, float]], step: float = 0.01) -> DataFrame:
    """i, j, km: the distance of each grid node of the box to the nearest place."""
    a, b, c, d = box
    rows, cols = int((b - a) / step) + 1, int((d - c) / step) + 1
    nodes = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    return nodes.withColumn("km", nearest_km(a + F.col("i") * step, c + F.col("j") * step, places))


def raster_filter(df: DataFrame, grid: DataFrame, box: tuple[float, float, float, float], step: float = 0.01, min_km: float = 1.0, effort: str = "is_fishing") -> DataFrame:
    """The same columns as harbor_filter() by looking points up in a raster; outside of it the distance is infinite."""
    index = lambda x, low: F.expr(f"cast(({x} - ({low!r})) / {step!r} as int)")
    out = df.withColumn("i", index("latitude", box[0])).withColumn("j", index("longitude", box[2])).join(grid, ["i", "j"], "left")
    out = out.withColumn("dist_to_shore_km", F.coalesce("km", F.lit(float("inf")))).drop("i", "j", "km")
    out = out.withColumn("is_near_shore", flag(F.col("dist_to_shore_km") < min_km))
    return out.withColumn(f"{effort}_filtered", F.when(F.col("is_near_shore") == 1, 0).otherwise(F.col(effort)))


def add_shore_filtering(df: DataFrame, region: str, min_km: float = 1.0, method: str = "coastline", coast: DataFrame | None = None, land: DataFrame | None = None, regions: Regions | None = None, **options) -> DataFrame:
    """The filter by name; an unknown method or region is an error, and so is a coastline filter without segments."""
    regions = regions or Regions()
    if method not in ("harbor", "coastline"):
        raise ValueError(f"method {method!r} is neither 'harbor' nor 'coastline'")
    if region not in regions.boxes and region not in regions.harbors:
        raise ValueError(f"region {region!r} is none of {', '.join(sorted({*regions.boxes, *regions.harbors}))}")
    if method == "harbor":
        return harbor_filter(df, regions.harbors.get(region) or regions.harbors.get(MAINLAND.get(region), []), min_km, **options)
    if coast is None:
        raise ValueError("a coastline filter needs the coastline's segments")
    return coast_filter(df, coast, land, min_km, box=regions.boxes.get(region) or regions.boxes.get({v: k for k, v in MAINLAND.items()}.get(region)), **options)
