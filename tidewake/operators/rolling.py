"""Rolling statistics: time frames, row frames, and frames of nearby points."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import DEGREE_KM, EARTH_KM, clip, haversine_km
from ..sources.staging import beside, staged
from .kinematics import trip
from .nearby import Track

SERIES = ("speed_kmh", "acceleration", "turn_angle")
#: Rows of a trip that one task takes whole, and pairs of points in one part of a tile (few of which are looked at).
WHOLE, PAIRS = 20_000, 10_000_000_000


def _stats(df: DataFrame, frame: W, suffix: str) -> DataFrame:
    for c in SERIES:
        df = df.withColumns({f"{c}_mean{suffix}": F.avg(c).over(frame), f"{c}_std{suffix}": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)), f"{c}_max{suffix}": F.max(c).over(frame), f"{c}_min{suffix}": F.min(c).over(frame)})
    return _variation(df, suffix)


def _variation(df: DataFrame, suffix: str) -> DataFrame:
    cv = lambda name, mean: F.col(f"{name}_std{suffix}") / (mean + 0.1)
    return df.withColumns({f"speed_cv{suffix}": cv("speed_kmh", F.col(f"speed_kmh_mean{suffix}")), f"accel_cv{suffix}": cv("acceleration", F.abs(f"acceleration_mean{suffix}"))})


def large_trips(df: DataFrame, whole: int = WHOLE) -> DataFrame | None:
    """_trip: the trips of more than `whole` rows, counted now; None if there are none."""
    sizes = df.groupBy(F.col("trip_id").alias("_trip")).agg(F.count("*").alias("_rows"))
    large = beside(sizes.where(F.col("_rows") > whole).select("_trip"), "large-trips")
    return None if large.isEmpty() else large


def split(df: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the other trips, and those of the large ones."""
    same = F.col("trip_id").eqNullSafe(F.col("_trip"))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def time_stats(df: DataFrame, minutes: tuple[float, ...] = (10.0,), whole: int | None = WHOLE) -> DataFrame:
    """Mean, standard deviation (0 on one point), extremes and variation within a centred, half-open time window: the points after t - N/2 up to t + N/2.  Columns have the suffix _Nmin if there are several windows.

    Spark's moving frames read a whole window again for each row, so trips of more than `whole` rows are counted first and dealt
    out by time (None: no trip, 0: all)."""
    if whole:
        large = large_trips(df, whole)
        if large is None:
            return time_stats(df, minutes, None)
        small, rest = split(df, large)
        return time_stats(small, minutes, None).unionByName(time_stats(rest, minutes, 0))
    for m in minutes:
        half, suffix = int(m * 30e6), f"_{m:g}min" if len(minutes) > 1 else ""
        if whole is None:
            df = _stats(df, W.partitionBy("trip_id").orderBy("t_us").rangeBetween(-half + 1, half), suffix)
            continue
        told = _by_times(df, half, suffix).withColumnsRenamed({"trip_id": "_of_trip", "t_us": "_of_time"})
        same = F.col("trip_id").eqNullSafe(F.col("_of_trip")) & F.col("t_us").eqNullSafe(F.col("_of_time"))
        df = _variation(df.drop(*told.columns).join(told, same).drop("_of_trip", "_of_time"), suffix)
    return df


def frames(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean, standard deviation (0 on one value), largest and smallest of each x[low:high]; NaN on none.

    A frame is put together of stretches of 1, 2, 4 ... values, whose means and squares are merged: nothing is subtracted, so that
    no digits are lost."""
    at, n = low.copy(), np.zeros(len(low))
    mean, square, top, least = np.zeros(len(low)), np.zeros(len(low)), np.full(len(low), -np.inf), np.full(len(low), np.nan)
    m, s, t, b, size = x, np.zeros(len(x)), x, x, 1
    with np.errstate(invalid="ignore"):
        while len(m) and size <= (high - low).max(initial=0):
            k = np.flatnonzero((high - low) & size)
            i, before, d = at[k], n[k], m[at[k]] - mean[k]
            n[k] += size
            mean[k] += d * (size / n[k])
            square[k] += s[i] + d * d * (before * size / n[k])
            top[k], least[k] = np.maximum(top[k], t[i]), np.fmin(least[k], b[i])
            at[k] += size
            d = m[size:] - m[:-size]
            m, s = m[:-size] + d / 2, s[:-size] + s[size:] + d * d * (size / 2)
            t, b, size = np.maximum(t[:-size], t[size:]), np.fmin(b[:-size], b[size:]), 2 * size
    none = n == 0
    return np.where(none, np.nan, mean), np.sqrt(square / np.maximum(n - 1, 1)), np.where(none, np.nan, top), least


def _by_times(df: DataFrame, half: int, suffix: str) -> DataFrame:
    """trip_id, t_us and the statistics of each different time of a trip: stretches of half a window meet those before and after."""
    rows = df.select("trip_id", "t_us", *[F.col(c).cast("double").alias(c) for c in SERIES])
    stretch = F.coalesce(F.floor(F.col("t_us") / half), F.lit(-(1 << 62)))  # rows without a time see one another
    rows = rows.withColumn("_d", F.explode(F.when(F.col("t_us").isNull(), F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))))
    rows = rows.withColumn("_stretch", stretch + F.col("_d")).withColumn("_own", F.col("_d") == 0).drop("_d")
    group = ["trip_id", "_stretch"]
    rows = rows.withColumn("_g", F.xxhash64(*group))
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(64, shuffles), *group).sortWithinPartitions(*group, "t_us")

    def told(held: pa.Table) -> list[pa.RecordBatch]:
        t, own = held.column("t_us").fill_null(0).to_numpy(), held.column("_own").to_numpy(zero_copy_only=False)
        own = np.flatnonzero(own)
        at, first = np.unique(t[own], return_index=True)
        if not len(at):
            return []
        out = held.select(["trip_id", "t_us"]).take(pa.array(own[first]))
        for c in SERIES:
            there = held.column(c).is_valid().to_numpy(zero_copy_only=False)
            x, times = held.column(c).to_numpy()[there], t[there]
            low, high = np.searchsorted(times, at - half + 1), np.searchsorted(times, at + half, "right")
            for name, v in zip(("mean", "std", "max", "min"), frames(x, low, high), strict=True):
                out = out.append_column(f"{c}_{name}{suffix}", pa.array(v, mask=(high == low) & (name != "std")))
        return out.to_batches()

    made = [T.StructField(f"{c}_{name}{suffix}", T.DoubleType()) for c in SERIES for name in ("mean", "std", "max", "min")]
    return rows.mapInArrow(_in_groups(told, ["_stretch"]), T.StructType([df.schema["trip_id"], df.schema["t_us"], *made]))


def _in_groups(told, cut: list[str]):
    """A function of batches that gives told() a table for each group of rows, which differ in _g or `cut`."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column("_g").to_numpy(), *(batch.column(c).to_numpy() for c in cut)])
            begins = np.append(0, 1 + np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            for a, b in zip(begins, np.append(begins[1:], batch.num_rows), strict=True):
                if last is not None and (marks[:, a] != last).any():
                    yield from told(pa.Table.from_batches(held))
                    held = []
                last = marks[:, a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def trailing_stats(df: DataFrame, rows: int = 10) -> DataFrame:
    """Mean and standard deviation (NULL on one point) of the last rows, and speed_cv."""
    frame = trip().rowsBetween(1 - rows, 0)
    for c in SERIES:
        df = df.withColumns({f"{c}_mean": F.avg(c).over(frame), f"{c}_std": F.stddev_samp(c).over(frame)})
    return df.withColumn("speed_cv", F.col("speed_kmh_std") / (F.col("speed_kmh_mean") + 1e-6))


def window_stats(df: DataFrame, columns: list[str], rows: int = 5) -> DataFrame:
    """Mean, standard deviation and quartiles (interpolated) in a centred frame of rows, NULLs left out; suffix _w."""
    frame = trip().rowsBetween(-(rows // 2), (rows - 1) // 2)
    for c in columns:
        df = df.withColumn("_q", F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(frame))  # both from one look at the frame
        df = df.withColumns({f"{c}_mean_w": F.avg(c).over(frame), f"{c}_std_w": F.stddev_samp(c).over(frame), f"{c}_q25_w": F.get("_q", F.lit(0)), f"{c}_q75_w": F.get("_q", F.lit(1))}).drop("_q")
    return df


def _squared(center: Column):
    return lambda v: (v - center) * (v - center)


def adaptive_stats(df: DataFrame, window_minutes: float = 10.0, most: int = 25) -> DataFrame:
    """_stats() in centred row frames whose size follows each trip's median gap: 3 to `most` rows that span the minutes; 5 rows for trips of one point.  Gaps count in whole seconds."""
    t_s = F.floor(F.col("t_us") / 1e6)
    gaps = df.withColumn("gap", t_s - F.lag(t_s).over(trip()))
    every = W.partitionBy("trip_id")
    median = F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(every)
    df = gaps.withColumn("rows", F.when(F.count("*").over(every) < 2, 5).otherwise(F.greatest(F.lit(3), F.least(F.lit(most), F.coalesce(F.floor(window_minutes * 60 / median).cast("int"), F.lit(most)))))).drop("gap")
    df = df.withColumn("nth", F.row_number().over(trip()))
    around = F.collect_list(F.struct("nth", *SERIES)).over(trip().rowsBetween(-(most // 2), most // 2))
    mine = F.filter(F.col("around"), lambda s: (s["nth"] >= F.col("nth") - F.floor(F.col("rows") / 2)) & (s["nth"] <= F.col("nth") + F.floor((F.col("rows") - 1) / 2)))
    df = df.withColumn("around", around).withColumn("around", mine)
    for c in SERIES:
        x = F.col("around")[c]
        n = F.size("around")
        mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        df = df.withColumn(f"{c}_mean", mean)
        center = F.col(f"{c}_mean")
        spread = F.aggregate(F.transform(x, _squared(center)), F.lit(0.0), lambda a, v: a + v)
        df = df.withColumns({f"{c}_std": F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0), f"{c}_max": F.array_max(x), f"{c}_min": F.array_min(x)})
    df = df.withColumns({"speed_cv": F.col("speed_kmh_std") / (F.col("speed_kmh_mean") + 0.1), "accel_cv": F.col("acceleration_std") / (F.abs("acceleration_mean") + 0.1)})
    return df.drop("around", "nth", "rows")


def _shaped(df: DataFrame, points: str, names) -> DataFrame:
    """Straightness, radius of gyration and sinuosity of the array<struct<lat, lon>> in `points`, in time order; a name of None is left out.

    Path, chord and spread are columns first, so that none is worked out twice."""
    at = F.col(points)
    n = F.size(at)
    far = lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
    rest = F.greatest(n - 1, F.lit(0))
    mean = lambda c: F.aggregate(at[c], F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumns({"_path": F.aggregate(F.zip_with(F.slice(at, 1, rest), F.slice(at, 2, rest), far), F.lit(0.0), lambda a, x: a + x), "_chord": far(F.get(at, F.lit(0)), F.get(at, n - 1)), "_center": F.struct(mean("lat").alias("lat"), mean("lon").alias("lon")), "_points": n})
    spread = F.aggregate(at, F.lit(0.0), lambda a, p: a + F.pow(far(p, F.col("_center")), 2)) / n
    path, chord, one = F.col("_path"), F.col("_chord"), F.col("_points") < 2
    values = (F.when(one | (path == 0), 1.0).otherwise(chord / F.when(path > 0, path)), F.when(one, 0.0).otherwise(F.sqrt(spread)), F.when(one | (chord <= 0.001), 1.0).otherwise(path / F.when(chord > 0.001, chord)))
    out = {name: clip(v, 1, 10) if i == 2 else v for i, (name, v) in enumerate(zip(names, values, strict=True)) if name}
    return df.withColumns(out).drop("_path", "_chord", "_center", "_points")


def shape(df: DataFrame, before: int = 7, after: int = 7, names=("straightness", "radius_gyration_km", "sinuosity")) -> DataFrame:
    """Trajectory shape in a frame of rows: chord over path, root mean square distance to the centroid, path over chord (1 to 10)."""
    at = F.collect_list(F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).over(trip().rowsBetween(-before, after))
    return _shaped(df.withColumn("_frame", at), "_frame", names).drop("_frame")


def start_distance(df: DataFrame) -> DataFrame:
    whole = trip().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c).over(whole)
    return df.withColumn("dist_to_start_km", haversine_km(F.col("latitude"), F.col("longitude"), first("latitude"), first("longitude")))


def near_shape(df: DataFrame, radius_km: float = 1.0, planar: bool = True, whole: int | None = WHOLE, pairs: int = PAIRS) -> DataFrame:
    """Trajectory shape over all points of the trip within a radius, in time order: planar distance (degrees scaled at the trip's mean latitude) or great-circle distance.

    No row is lost: equal rows each count among the neighbours and get equal results, rows without a trip are one trip, and
    a point without a coordinate has no neighbours (n_near 0, straightness 1, radius 0, sinuosity 1).  No pairs are made: a
    task holds one trip at a time in Arrow columns and sums it up as nearby.Track does.  Trips of more than `whole` rows are
    counted first and dealt out by tiles of the radius's size (None: no trip, 0: all)."""
    known = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    at = df.withColumn("_lat", known("latitude")).withColumn("_lon", known("longitude"))
    if whole is None:
        return _by_trips(at, df, radius_km, planar)
    large = large_trips(df, whole)
    if large is None:
        return _by_trips(at, df, radius_km, planar)
    if whole:  # the tiles, their trips and the other trips read the points
        at = staged(at, "points")
    same = F.col("trip_id").eqNullSafe(F.col("_trip"))
    mean = at.groupBy(F.col("trip_id").alias("_trip")).agg(F.avg("_lat").alias("_mean"))
    mean = beside(mean.join(large.withColumnRenamed("_trip", "trip_id"), same, "left_semi"), "large-trips-means")
    shaped = _by_tiles(at.join(mean, same).select("trip_id", "t_us", "event_id", "_lat", "_lon", "_mean"), radius_km, planar, pairs)
    keys = ["trip_id", "t_us", "event_id", "_lat", "_lon"]
    named = shaped.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    rest = at.drop(*[c for c, _, _ in SHAPE]).join(large, same, "left_semi")
    told = rest.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]), "left")
    kept = [c for c in df.columns if c not in {c for c, _, _ in SHAPE}]
    told = told.select(*kept, *[F.coalesce(c, F.lit(v).cast(t)).alias(c) for c, t, v in SHAPE])
    return told if not whole else _by_trips(at.join(large, same, "left_anti"), df, radius_km, planar).unionByName(told)


#: Columns of a shape, and what they read without neighbours.
SHAPE = (("n_near", T.LongType(), 0), ("straightness", T.DoubleType(), 1.0), ("radius_gyration_km", T.DoubleType(), 0.0), ("sinuosity", T.DoubleType(), 1.0))


def _by_tiles(points: DataFrame, radius_km: float, planar: bool, pairs: int) -> DataFrame:
    """trip_id, t_us, event_id, _lat, _lon and the shape of each different point: a tile's points meet those within the radius of
    it.  Tiles of more than `pairs` pairs are cut along each axis into parts that are dealt out by themselves."""
    keys = ["trip_id", "t_us", "event_id", "_lat", "_lon"]
    points = points.where("_lat is not null and _lon is not null").groupBy(*keys, "_mean").agg(F.count("*").alias("_w"))
    side = radius_km * (1 + 1e-6)
    lat, lon = F.radians("_lat"), F.radians("_lon")
    if planar:
        axes = [F.col("_lon") * DEGREE_KM * F.cos(F.radians("_mean")), F.col("_lat") * DEGREE_KM]
    else:  # in space: a chord is shorter than its arc, and neither poles nor the date line are borders
        axes = [F.cos(lat) * F.cos(lon) * EARTH_KM, F.cos(lat) * F.sin(lon) * EARTH_KM, F.sin(lat) * EARTH_KM]
    dims = range(len(axes))
    tile = [f"_t{k}" for k in dims]
    points = points.withColumns({f"_a{k}": a / side for k, a in zip(dims, axes, strict=True)})
    points = staged(points.withColumns({f"_t{k}": F.floor(f"_a{k}") for k in dims}), "tile-points")

    def around(df: DataFrame) -> DataFrame:
        for t in tile:
            df = df.withColumn(f"_d{t}", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(t, F.col(t) + F.col(f"_d{t}"))
        own = reduce(and_, [F.col(f"_d{t}") == 0 for t in tile])
        return df.withColumn("_own", own).drop(*[f"_d{t}" for t in tile])

    of = {c: f"_of{c}" for c in ("trip_id", *tile)}
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(o)) for c, o in of.items()])
    sizes = staged(points.groupBy("trip_id", *tile).agg(F.count("*").alias("_c")), "tiles")
    # a tile's own points times all of the tiles around it
    met = around(sizes).groupBy("trip_id", *tile).agg(F.max(F.when(F.col("_own"), F.col("_c"))).alias("_mine"), F.sum("_c").alias("_k")).where("_mine is not null")
    cuts = beside(met.select(*[F.col(c).alias(o) for c, o in of.items()], F.ceil(F.sqrt(F.col("_mine") * F.col("_k") / pairs)).alias("_cut")), "tile-cuts")
    part = [F.least(F.floor((F.col(f"_a{k}") - F.col(f"_t{k}")) * F.col("_cut")), F.col("_cut") - 1) for k in dims]
    # the parts that hold points, numbered
    parts = points.join(cuts, same).select(*of.values(), "_cut", *[p.alias(f"_s{k}") for k, p in zip(dims, part, strict=True)]).distinct()
    parts = beside(parts.withColumn("_part", F.monotonically_increasing_id()), "tile-parts")
    at = around(points).join(parts, same)
    begins = [F.col(f"_t{k}") + F.col(f"_s{k}") / F.col("_cut") for k in dims]
    off = [F.greatest(b - F.col(f"_a{k}"), F.col(f"_a{k}") - b - 1 / F.col("_cut"), F.lit(0.0)) for k, b in zip(dims, begins, strict=True)]
    at = at.where(sum((x * x for x in off), F.lit(0.0)) <= 1)  # in sides, which are a little longer than the radius
    at = at.withColumn("_own", F.col("_own") & reduce(and_, [p == F.col(f"_s{k}") for k, p in zip(dims, part, strict=True)]))
    at = at.select(*keys, "_mean", "_w", "_own", "_part", F.col("_part").alias("_g"))
    shuffles = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = at.repartition(max(min(128, parts.count()), shuffles), "_part").sortWithinPartitions("_part", "t_us", "event_id", "_lat", "_lon")

    def told(rows: pa.Table) -> list[pa.RecordBatch]:
        own = np.flatnonzero(rows.column("_own").to_numpy(zero_copy_only=False))
        lat, lon, w = (rows.column(c).to_numpy() for c in ("_lat", "_lon", "_w"))
        shapes = Track(lat, lon, w, radius_km, planar, rows.column("_mean")[0].as_py()).shapes(own)
        out = rows.select(keys).take(pa.array(own))
        for (c, _, _), v in zip(SHAPE, shapes, strict=True):
            out = out.append_column(c, pa.array(v))
        return out.to_batches()

    fields = [points.schema[c] for c in keys] + [T.StructField(c, t) for c, t, _ in SHAPE]
    return at.mapInArrow(_in_groups(told, []), T.StructType(fields))


def _by_trips(at: DataFrame, df: DataFrame, radius_km: float, planar: bool) -> DataFrame:
    """near_shape() of df, which `at` is with _lat and _lon, a trip at a time."""
    # a number for each different point of a trip, in time order; the windows leave each trip whole and its rows together
    order = W.partitionBy("trip_id").orderBy("t_us", "event_id", "_lat", "_lon")
    at = at.withColumn("_p", F.dense_rank().over(order)).withColumn("_i", F.row_number().over(order))
    new = {c: t for c, t, _ in SHAPE}
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]

    def told(rows: pa.Table) -> list[pa.RecordBatch]:
        """Whole trips, each with its shapes."""
        lat, lon, point = (rows.column(c).to_numpy() for c in ("_lat", "_lon", "_p"))
        out = {c: np.full(len(lat), v) for c, v in zip(new, (0, 1.0, 0.0, 1.0), strict=True)}
        cut = np.append(np.flatnonzero(rows.column("_i").to_numpy() == 1), len(lat))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            there = a + np.flatnonzero(~(np.isnan(lat[a:b]) | np.isnan(lon[a:b])))
            if len(there):
                _, first, place, weight = np.unique(point[there], return_index=True, return_inverse=True, return_counts=True)
                track = Track(lat[there][first], lon[there][first], weight, radius_km, planar, np.nanmean(lat[a:b]))
                for c, v in zip(new, track.shapes(), strict=True):
                    out[c][there] = v[place]
        rows = rows.select(names)
        for c, v in out.items():
            rows = rows.append_column(c, pa.array(v))
        return rows.to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_i").to_numpy() == 1)
            if len(begins) and (held or begins[-1]):
                yield from told(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]))
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield from told(pa.Table.from_batches(held))

    return at.mapInArrow(run, T.StructType(kept + [T.StructField(c, t) for c, t in new.items()]))


def whole_trip_shape(df: DataFrame) -> DataFrame:
    """The phase-aware variant's shape: distance to the start over the path so far, mean distance to the trip's centroid, and one sinuosity for each trip.  Needs leg_km."""
    whole = trip().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = start_distance(df)
    lat, lon = F.col("latitude"), F.col("longitude")
    df = df.withColumn("straightness", F.when(F.col("leg_km").isNotNull(), F.col("dist_to_start_km") / (F.sum("leg_km").over(trip().rowsBetween(W.unboundedPreceding, 0)) + 1e-6)))
    every = W.partitionBy("trip_id")
    df = df.withColumn("_d", haversine_km(lat, lon, F.avg(lat).over(every), F.avg(lon).over(every))).withColumn("radius_gyration_km", F.avg("_d").over(every)).drop("_d")
    ends = haversine_km(F.first(lat).over(whole), F.first(lon).over(whole), F.last(lat).over(whole), F.last(lon).over(whole))
    return df.withColumn("sinuosity", F.coalesce(F.sum("leg_km").over(every), F.lit(0.0)) / (ends + 1e-6))
