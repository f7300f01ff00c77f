"""Column resolution: standard names from the many names that files use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ORIGIN

#: Standard name -> names that files use, in order of preference.  Fixed values.
ALIASES = {
    "latitude": ["latitude", "Latitude", "lat", "Lat", "LAT", "LATITUDE", "y", "Y"],
    "longitude": ["longitude", "Longitude", "lon", "Lon", "Lng", "LON", "LONGITUDE", "lng", "x", "X"],
    "trip_id": ["trip_id", "Trip_ID", "TRIP_ID", "tripid", "TripID", "Trip"],
    "timestamp": ["timestamp", "Timestamp", "time", "Time", "TIME", "datetime", "ltime", "date_time", "DateTime", "date"],
    "speed": ["speed", "Speed", "SPEED", "sog", "SOG", "speed_kmh", "speed_kn", "velocity", "Velocity", "Speed (M/S)"],
    "heading": ["heading", "Heading", "HEADING", "cog", "COG", "course", "Course", "bearing", "Bearing"],
    "altitude": ["altitude", "Altitude", "ALT", "elevation", "Elevation", "height"],
    "effort": ["effort_pred", "effort", "is_fishing", "is_Fishing", "IsFishing", "fishing", "Fishing", "Activity", "activity", "effort_class"],
    "vessel_id": ["vessel_id", "Vessel_ID", "VesselID", "boat_id", "BoatID", "fisher_id", "FisherID"],
    "vessel_type": ["vessel_type", "VesselType", "boat_type", "BoatType"],
    "gear_type": ["gear_type", "GearType", "gear", "Gear", "GEAR"],
    "device_model": ["model", "Model", "device_model", "DeviceModel", "device"],
    "catch_weight": ["catch_weight", "CatchWeight", "weight", "Weight", "catch_kg"],
    "species": ["species", "Species", "SPECIES", "fish_species", "FishSpecies"],
}


class ColumnResolver:
    """Finds columns by standard name.  Own aliases come after the standard ones and belong to this resolver only."""

    def __init__(self, aliases: dict[str, list[str]] | None = None):
        self.aliases = {k: list(v) for k, v in ALIASES.items()}
        self.register(aliases or {})

    def add(self, name: str, alias: str) -> None:
        known = self.aliases.setdefault(name, [])
        if alias not in known:
            known.append(alias)

    def register(self, aliases: dict[str, list[str]]) -> None:
        for name, others in aliases.items():
            for alias in others:
                self.add(name, alias)

    def find(self, df: DataFrame, name: str, required: bool = False) -> str | None:
        """The first alias, in the list's order, that is a column of df (names match exactly)."""
        have = set(df.columns)
        found = next((a for a in self.aliases.get(name, [name]) if a in have), None)
        if found is None and required:
            raise ValueError(f"no column for {name!r}: tried {self.aliases.get(name, [name])}, there are {df.columns}")
        return found

    def resolve(self, df: DataFrame, name: str, own: str | None = None, required: bool = True) -> str | None:
        """The caller's own column if given (it must exist), else find()."""
        if own is not None:
            if own not in df.columns:
                raise ValueError(f"column {own!r} for {name!r} isn't among {df.columns}")
            return own
        return self.find(df, name, required)

    def mapping(self, df: DataFrame, required: list[str] = (), optional: list[str] = ()) -> dict[str, str]:
        """Standard name -> column; all missing required names are reported together."""
        found = {n: c for n in [*required, *optional] if (c := self.find(df, n)) is not None}
        missing = [n for n in required if n not in found]
        if missing:
            raise ValueError(f"no columns for {missing}; there are {df.columns}")
        return found

    def rename(self, df: DataFrame, mapping: dict[str, str], drop_others: bool = False) -> DataFrame:
        """Columns renamed to their standard names; drop_others keeps only those."""
        if drop_others:
            return df.select(*[df[c].alias(n) for n, c in mapping.items()])
        taken = [n for n, c in mapping.items() if n != c and n in df.columns]
        return df.drop(*taken).withColumnsRenamed({c: n for n, c in mapping.items() if c != n})

    def standardize(self, df: DataFrame, required: list[str] = (), optional: list[str] = ()) -> DataFrame:
        return self.rename(df, self.mapping(df, required, optional))

    def validate(self, df: DataFrame, required: list[str], optional: list[str] = ()) -> dict[str, bool]:
        found = self.mapping(df, (), [*required, *optional])
        return {n: n in found for n in [*required, *optional]}

    def spatial(self, df: DataFrame) -> tuple[str, str]:
        return self.find(df, "latitude", True), self.find(df, "longitude", True)

    def temporal(self, df: DataFrame) -> str:
        return self.find(df, "timestamp", True)

    def trip(self, df: DataFrame) -> str:
        return self.find(df, "trip_id", True)

    def effort(self, df: DataFrame) -> str:
        return self.find(df, "effort", True)


def as_points(df: DataFrame, trip_col: str | None = None, lat_col: str | None = None, lon_col: str | None = None, time_col: str | None = None, resolver: ColumnResolver | None = None) -> DataFrame:
    """df with trip_id (1 where there is none), event_id, t_us, latitude and longitude first; other columns follow.

    Times may be timestamps or strings; strings that are no times become NULL.  event_id only breaks ties in time: made from
    the values where there is none, so that equal rows share it."""
    r = resolver or ColumnResolver()
    lat, lon, at = (r.resolve(df, n, c) for n, c in (("latitude", lat_col), ("longitude", lon_col), ("timestamp", time_col)))
    trip = r.resolve(df, "trip_id", trip_col, required=False)
    time = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', try_to_timestamp(cast(`{at}` as string)))") if dict(df.dtypes)[at] == "string" else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', cast(`{at}` as timestamp_ntz))")
    first = {"trip_id": df[trip] if trip else F.lit(1), "t_us": df["t_us"] if "t_us" in df.columns else time, "latitude": df[lat].cast("double"), "longitude": df[lon].cast("double")}
    first["event_id"] = df["event_id"] if "event_id" in df.columns else F.xxhash64(*first.values())
    return df.select(*[c.alias(n) for n, c in first.items()], *[df[c] for c in df.columns if c not in first and c not in (lat, lon, trip)])


def export_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def label_codes(df: DataFrame, column: str, code: str, missing: str = "Unknown") -> DataFrame:
    """code: the place (from 0) of each label among the sorted distinct labels; NULL reads `missing`."""
    from pyspark.sql import Window as W

    label = F.coalesce(F.col(column), F.lit(missing))
    codes = df.select(label.alias("_label")).distinct().withColumn(code, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_label")) - 1).cast("long"))  # distinct labels only
    return df.withColumn("_label", label).join(codes, "_label").drop("_label")
