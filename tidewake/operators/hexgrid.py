"""Hexagonal effort grids: cell index, one pass over eight groupings, quality, dashboard cube and roll-up.

The default index is a planar axial hexagon grid in Column expressions (x is scaled at a reference latitude); any other
index can be given as a function of latitude, longitude and resolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_KM, clip
from ..functions.temporal import day_night, monsoon
from ..sources.staging import staged
from .kinematics import time_weights
from .quantiles import first_of, many_quantiles, quantiles

#: Cell areas in km² by resolution, fixed values; others by the ratio 7.
AREAS = {7: 5.16, 8: 0.74, 9: 0.10}
#: Slices: each is aggregated by hexagon and these columns.
SLICES = {"overall": [], "by_year": ["year"], "by_month": ["month"], "by_season": ["season"], "by_day_night": ["day_night"], "by_year_month": ["year", "month"], "by_year_season": ["year", "season"], "by_season_day_night": ["season", "day_night"]}
_KEYS, _TYPES = ["year", "month", "season", "day_night"], ["int", "int", "string", "string"]


def edge_km(resolution: int) -> float:
    area = AREAS.get(resolution, AREAS[7] * 7.0 ** (7 - resolution))
    return math.sqrt(area * 2 / (3 * math.sqrt(3)))


def axial(lat: Column, lon: Column, resolution: int, lat0: float = 0.0) -> tuple[Column, Column]:
    """Axial coordinates of the cell around a point: the three cube coordinates rounded, the one that moved most made up."""
    s = edge_km(resolution)
    x, y = lon * (DEGREE_KM * math.cos(math.radians(lat0))), lat * DEGREE_KM
    q, r = (x * math.sqrt(3) / 3 - y / 3) / s, (y * 2 / 3) / s
    near = lambda v: F.floor(v + 0.5)
    t = -q - r
    dq, dr, dt = F.abs(near(q) - q), F.abs(near(r) - r), F.abs(near(t) - t)
    return F.when((dq > dr) & (dq > dt), -near(r) - near(t)).otherwise(near(q)).cast("long"), F.when((dr > dt) & ~((dq > dr) & (dq > dt)), -near(q) - near(t)).otherwise(near(r)).cast("long")


def center(q: Column, r: Column, resolution: int, lat0: float = 0.0) -> tuple[Column, Column]:
    s = edge_km(resolution)
    return r * (1.5 * s / DEGREE_KM), (q + r / 2) * (math.sqrt(3) * s / (DEGREE_KM * math.cos(math.radians(lat0))))


def boundary(lat: Column, lon: Column, resolution: int, lat0: float = 0.0) -> Column:
    """Six corners around a centre: array<struct<lat, lon>>."""
    s = edge_km(resolution) / DEGREE_KM
    turn = [math.radians(60 * k + 30) for k in range(6)]
    return F.array(*[F.struct((lat + s * math.sin(a)).alias("lat"), (lon + s * math.cos(a) / math.cos(math.radians(lat0))).alias("lon")) for a in turn])


def with_cell(df: DataFrame, resolution: int) -> DataFrame:
    """cell (h<resolution>_<q>_<r>), q and r."""
    q, r = axial(F.col("latitude"), F.col("longitude"), resolution)
    return df.withColumn("q", q).withColumn("r", r).withColumn("cell", F.concat(F.lit(f"h{resolution}_"), F.col("q"), F.lit("_"), F.col("r")))


def calendar(df: DataFrame, time: Column) -> DataFrame:
    """year, month, month_name, season, hour, day_night, date."""
    return df.withColumn("_t", time).withColumns({"year": F.year("_t"), "month": F.month("_t"), "month_name": F.date_format("_t", "MMM"), "season": monsoon(F.month("_t")), "hour": F.hour("_t"), "day_night": day_night(F.hour("_t")), "date": F.to_date("_t")}).withColumnRenamed("_t", "time")


def trip_cube(df: DataFrame, resolution: int, speed: str | None = "speed") -> DataFrame:
    """The finest sums: one row by hexagon, year, month, day or night and trip, with a bit for each day of the month.

    Whatever else is counted distinctly follows from it exactly: trips are rows' trips, days the bits.  No exchange is
    needed where points lie by trip."""
    each = ["cell", "q", "r", *_KEYS, "trip_id"]
    day = F.expr("bit_or(shiftleft(1, dayofmonth(date) - 1))")
    sums = [F.sum("time_hours").alias("time_hours"), F.count("time").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")]
    v = F.col(speed) if speed else F.lit(None).cast("double")
    sums += [F.count(v).alias("v0"), F.sum(v).alias("v1"), F.sum(v * v).alias("v2"), F.coalesce(day, F.lit(0)).alias("days"), F.max(F.col("date").isNull()).alias("undated")]
    return with_cell(df, resolution).groupBy(*each).agg(*sums)


def _entries(slices: dict[str, list[str]]) -> Column:
    """The entries of a trip in a hexagon (array `e`) for each slice: its keys, sums, days, and what of trips and vessel-days it adds to those before it."""

    def of(name: str, keys: list[str]):
        def entry(x, i):
            before = F.slice("e", 1, i)
            met = F.exists(before, lambda o: _same(o, x, keys))
            month = ["year", "month", *(["day_night"] if "day_night" in keys else [])]
            again = F.filter(before, lambda o: _same(o, x, month))
            fresh = x["days"].bitwiseAND(F.bitwise_not(F.aggregate(again, F.lit(0), lambda a, o: a.bitwiseOR(o["days"]))))
            undated = x["undated"] & ~F.exists(again, lambda o: o["undated"])
            return F.struct(
                F.lit(name).alias("slice"), *[(x[k] if k in keys else F.lit(None).cast(t)).alias(k) for k, t in zip(_KEYS, _TYPES, strict=True)], x["year"].alias("y"), x["month"].alias("m"),
                (~met).cast("int").alias("trips"), (F.bit_count(fresh) + undated.cast("int")).alias("vessel_days"), *[x[c].alias(c) for c in ("days", "time_hours", "n", "first", "last", "v0", "v1", "v2")],
            )

        return F.transform("e", entry)

    return F.flatten(F.array(*[of(name, keys) for name, keys in slices.items()]))


def _same(a, b, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def metrics(df: DataFrame, resolution: int, slices: dict[str, list[str]] = SLICES, speed: str | None = "speed") -> DataFrame:
    """One row for each hexagon of each slice: hours, points, trips, days, vessel-days, speeds, first and last time, coverage, centre, hours per trip and day.

    coverage: days with points over the days from the slice's first to its last point.  Each trip's few rows of a hexagon in
    trip_cube() are looked at once for all slices, so that nothing is counted distinctly any more: trips and vessel-days
    are summed, days are bits.  The result is staged, as the slices' bounds are worked out from it."""
    fine = trip_cube(df, resolution, speed)
    fields = [*_KEYS, "days", "undated", "time_hours", "n", "first", "last", "v0", "v1", "v2"]
    by_trip = fine.groupBy("cell", "q", "r", "trip_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))  # a trip's months
    rows = by_trip.select("cell", "q", "r", F.col("trip_id").isNotNull().alias("_known"), F.explode(_entries(slices)).alias("x")).select("cell", "q", "r", "_known", "x.*")
    s = lambda c: F.sum(c).alias(c)
    keys = ["slice", "cell", "q", "r", *_KEYS]
    ends = [F.min("first").alias("first"), F.max("last").alias("last")]
    sums = [s(c) for c in ("vessel_days", "time_hours", "n", "v0", "v1", "v2")]
    months = rows.groupBy(*keys, "y", "m").agg(F.sum(F.col("trips") * F.col("_known").cast("int")).alias("trips"), F.bit_or("days").alias("days"), *sums, *ends)
    at = months.groupBy(*keys).agg(s("trips"), F.sum(F.bit_count("days")).alias("n_days"), *sums, *ends)
    speeds = []
    if speed:
        n, v1, v2 = F.col("v0"), F.col("v1"), F.col("v2")
        some, more = F.when(n > 0, n), F.when(n > 1, n - 1)
        speeds = [(v1 / some).alias("mean_speed_kmh"), F.sqrt(F.greatest((v2 - v1 * v1 / some) / more, F.lit(0.0) * more)).alias("std_speed_kmh")]
    names = {"fishing_hours": "time_hours", "n_points": "n", "n_trips": "trips", "n_days": "n_days", "vessel_days": "vessel_days"}
    out = staged(at.select(*keys, *[F.col(c).alias(n) for n, c in names.items()], *speeds, F.col("first").alias("first_seen"), F.col("last").alias("last_seen")), "hexagons")
    bounds = out.groupBy("slice", *_KEYS).agg(F.min("first_seen").alias("a"), F.max("last_seen").alias("b")).withColumnsRenamed({k: f"_{k}" for k in ("slice", *_KEYS)})
    same = F.lit(True)
    for k in ("slice", *_KEYS):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = out.join(F.broadcast(bounds), same).drop(*bounds.columns[:-2])  # a row for each slice's part of the calendar
    us = F.expr("timestampdiff(MICROSECOND, a, b)")
    out = out.withColumn("temporal_coverage", F.col("n_days") / (F.floor(us / 86400e6) + 1)).drop("a", "b")
    lat, lon = center(F.col("q"), F.col("r"), resolution)
    return out.withColumns({"lat": lat, "lon": lon, "hours_per_trip": F.col("fishing_hours") / F.when(F.col("n_trips") > 0, F.col("n_trips")), "hours_per_day": F.col("fishing_hours") / F.when(F.col("n_days") > 0, F.col("n_days"))}).drop("q", "r")


def density(df: DataFrame, resolution: int) -> DataFrame:
    """cell, n_points: points by hexagon, not weighted by time."""
    return with_cell(df, resolution).groupBy("cell").agg(F.count("*").alias("n_points"))


def quality(df: DataFrame, min_hours: float = 0.1, min_trips: int = 1, min_days: int = 1) -> DataFrame:
    """Hexagons with enough data, and their confidence: the mean of trips, days and hours over each slice's 75th percentiles (after filtering), each at most 1."""
    kept = df.where((F.col("fishing_hours") >= min_hours) & (F.col("n_trips") >= min_trips) & (F.col("n_days") >= min_days))
    q = many_quantiles(kept, {"n_trips": [0.75], "n_days": [0.75], "fishing_hours": [0.75]}, ["slice"])
    q = q.select("slice", first_of("n_trips").alias("_t"), F.greatest(first_of("n_days"), F.lit(1.0)).alias("_d"), first_of("fishing_hours").alias("_h"))
    ratio = lambda a, b: clip(F.col(a) / F.when(F.col(b) > 0, F.col(b)), 0, 1)
    out = kept.join(F.broadcast(q), "slice")  # a row for each slice
    return out.withColumn("confidence", (ratio("n_trips", "_t") + ratio("n_days", "_d") + ratio("fishing_hours", "_h")) / 3).drop("_t", "_d", "_h")


def fishing_points(df: DataFrame, time: Column, fishing: str | None = "is_fishing", cap_seconds: float = 600.0) -> DataFrame:
    """Fishing points with calendar columns and time_hours; the gaps are those between fishing points."""
    df = df.where(F.col(fishing) == 1) if fishing else df
    return time_weights(calendar(df, time), cap_seconds)


def run_hex(df: DataFrame, time: Column, resolutions=(7, 8), fishing: str | None = "is_fishing", speed: str | None = "speed", min_hours=0.1, min_trips=1, min_days=1, output: str | None = None) -> dict[int, DataFrame]:
    """Resolution -> filtered metrics of all slices, optionally written as Parquet partitioned by slice."""
    points = fishing_points(df, time, fishing)
    if points.isEmpty():
        raise ValueError("there are no fishing points")
    out = {r: quality(metrics(points, r, speed=speed), min_hours, min_trips, min_days) for r in resolutions}
    if output:
        for r, one in out.items():
            one.write.mode("overwrite").partitionBy("slice").parquet(f"{output}/hex_res{r}")
    return out


def cube(points: DataFrame, resolution: int, speed: str | None = "speed") -> DataFrame:
    """The dashboard's finest grain: h, y, m, dn, s, fh, nt, nd, vd, sp."""
    speeds = [F.round(F.avg(speed), 2).alias("sp")] if speed else []
    out = with_cell(points, resolution).groupBy(F.col("cell").alias("h"), F.col("year").alias("y"), F.col("month").alias("m"), F.col("day_night").alias("dn")).agg(F.round(F.sum("time_hours"), 4).alias("fh"), F.count_distinct("trip_id").alias("nt"), F.count_distinct("date").alias("nd"), F.count_distinct(F.struct("trip_id", "date")).alias("vd"), *speeds)
    return out.withColumn("s", monsoon(F.col("m")))


def roll_up(cube_: DataFrame, **only) -> DataFrame:
    """Cube rows of the given dimension values by hexagon: hours, trips, days and vessel-days summed over grains (so distinct ones count once for each grain, as the dashboard shows them), and mean speed weighted by hours (weight 1 without hours)."""
    for name, value in only.items():
        cube_ = cube_.where(F.col(name) == value)
    weight = F.when(F.col("fh") > 0, F.col("fh")).otherwise(1.0)
    return cube_.groupBy("h").agg(F.sum("fh").alias("fh"), F.sum("nt").alias("nt"), F.sum("nd").alias("nd"), F.sum("vd").alias("vd"), (F.sum(F.col("sp") * weight) / F.sum(F.when(F.col("sp").isNotNull(), weight))).alias("sp"))


def roll_up_exact(fine: DataFrame, **only) -> DataFrame:
    """Rows of trip_cube() of the given dimension values by hexagon: hours, and trips, days and vessel-days each counted once however many grains they touch."""
    for name, value in only.items():
        fine = fine.where(F.col(name) == value)
    # a trip's day is one whether by day or night; then a month's days are one whichever trip saw them
    trips = fine.groupBy("cell", "trip_id", "year", "month").agg(F.sum("time_hours").alias("h"), F.bit_or("days").alias("days"))
    months = trips.groupBy("cell", "year", "month").agg(F.sum("h").alias("h"), F.bit_or("days").alias("days"), F.sum(F.bit_count("days")).alias("vd"))
    days = months.groupBy("cell").agg(F.sum("h").alias("fh"), F.sum(F.bit_count("days")).alias("nd"), F.sum("vd").alias("vd"))
    count = fine.where("trip_id is not null").groupBy("cell", "trip_id").agg(F.lit(1).alias("one")).groupBy("cell").agg(F.count("*").alias("nt"))
    return days.join(count, "cell", "left").select(F.col("cell").alias("h"), "fh", F.coalesce("nt", F.lit(0)).alias("nt"), "nd", "vd")


def color_max(df: DataFrame, metric: str, part: float = 0.95) -> DataFrame:
    """The value at rank floor(part * n) (from 0) of the positive values: a robust end of a colour scale."""
    full = df.where(F.col(metric) > 0)
    n = full.count()
    if not n:
        return full.select(F.col(metric).alias("color_max"))
    rank = min(math.floor(n * part), n - 1)
    return quantiles(full, metric, [rank / max(1, n - 1)]).select(first_of("q").alias("color_max"))


def hex_summary(df: DataFrame) -> DataFrame:
    middle = quantiles(df, "fishing_hours", [0.5], ["slice"]).select("slice", first_of("q").alias("median_hours"))
    hours = F.col("fishing_hours")
    out = df.groupBy("slice").agg(F.count("*").alias("n_hexagons"), F.avg(hours).alias("mean_hours"), F.max(hours).alias("max_hours"), F.sum(hours).alias("total_hours"))
    return out.join(F.broadcast(middle), "slice").select("slice", "n_hexagons", "mean_hours", "median_hours", "max_hours", "total_hours")  # a row for each slice


def top_hexagons(df: DataFrame, k: int = 10) -> DataFrame:
    return df.where("slice = 'overall'").orderBy(F.desc("fishing_hours"), "cell").select("cell", "fishing_hours", "n_trips").limit(k)


def dashboard(points: DataFrame, country: str, resolutions=(7, 8), speed: str | None = "speed") -> DataFrame:
    """One row: the dashboard's JSON document {meta, boundaries, centers, data}; the cubes are small aggregates."""
    meta = points.agg(F.struct(
        F.lit(country).alias("country"), F.array(*map(F.lit, resolutions)).alias("resolutions"), F.count("*").alias("total_points"), F.round(F.sum("time_hours"), 2).alias("total_fishing_hours"), F.array(F.min("year"), F.max("year")).alias("year_range"),
        F.array_sort(F.collect_set("year")).alias("years"), F.array_sort(F.collect_set("month")).alias("months"), F.array_sort(F.collect_set("season")).alias("seasons"), F.array_sort(F.collect_set("day_night")).alias("day_night"),
    ).alias("meta"))
    r6 = lambda c: F.round(c, 6)
    parts = []
    for res in resolutions:
        rows = cube(points, res, speed)
        q, r = F.split_part("h", F.lit("_"), F.lit(2)).cast("long"), F.split_part("h", F.lit("_"), F.lit(3)).cast("long")
        lat, lon = center(q, r, res)
        rows = rows.withColumn("center", F.array(r6(lat), r6(lon))).withColumn("ring", F.transform(boundary(lat, lon, res), lambda p: F.array(r6(p["lat"]), r6(p["lon"]))))
        each = [c for c in rows.columns if c not in ("center", "ring")]
        sets = lambda c: F.map_from_entries(F.array_sort(F.collect_set(F.struct("h", c))))
        parts.append(rows.agg(F.array_sort(F.collect_list(F.struct(*each))).alias("data"), sets("center").alias("centers"), sets("ring").alias("boundaries")).select(F.lit(str(res)).alias("res"), "*"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("res", c)), lambda a, b: F.when(a["res"] < b["res"], -1).otherwise(1))).alias(c)
    body = every.agg(by("data"), by("centers"), by("boundaries"))
    return meta.crossJoin(body).select(F.to_json(F.struct("meta", "boundaries", "centers", "data")).alias("document"))  # one row each


def write_dashboard(points: DataFrame, country: str, output: str, **options) -> None:
    dashboard(points, country, **options).coalesce(1).write.mode("overwrite").text(f"{output}/dashboard_{country}")


_META = "struct<country:string,total_points:bigint,total_fishing_hours:double>"
_ROWS = "map<string,array<struct<h:string,y:int,m:int,dn:string,s:string,fh:double,nt:bigint,nd:bigint,vd:bigint,sp:double>>>"


def load_dashboards(documents: DataFrame, column: str = "document") -> DataFrame:
    """Dashboard documents (JSON text) as rows: country, total_points, total_fishing_hours, document.  Of several of a country the greatest text counts."""
    at = documents.select(F.col(column).alias("document"), F.from_json(F.get_json_object(column, "$.meta"), _META).alias("m"))
    rows = at.select("m.country", "m.total_points", "m.total_fishing_hours", "document").where("country is not null")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("country").orderBy(F.desc("document")))).where("_n = 1").drop("_n")


def replace_dashboards(held: DataFrame, loaded: DataFrame) -> DataFrame:
    """The held dashboards, each replaced by the loaded one of its country, and the loaded ones of further countries."""
    return held.join(loaded.select("country"), "country", "left_anti").unionByName(loaded)


def remove_dashboard(held: DataFrame, country: str) -> DataFrame:
    return held.where(F.col("country") != country)


def dashboard_rows(held: DataFrame) -> DataFrame:
    """country, res and the cube's rows of the dashboards."""
    at = held.select("country", F.explode(F.from_json(F.get_json_object("document", "$.data"), _ROWS)).alias("res", "rows"))
    return at.select("country", "res", F.inline("rows"))
