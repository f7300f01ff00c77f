"""The rule-based effort classifiers as lazy plans, and a class with the usual calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kinematics as K
from ..operators import rolling as R
from ..operators import shore as S
from ..operators.phases import Phases, activity_types, phases
from ..operators.rules import CONFIGS, Rules, flag, indicators, phase_aware_rules, score, slow_and_turning
from ..operators.smoothing import smooth
from ..operators.summary import trip_summary
from ..sources.staging import staged

VARIANTS = ("row_frames", "instantaneous", "great_circle", "planar", "phase_aware")
_BY_ROWS = ("row_frames", "instantaneous")


def _in_windows(points: DataFrame, variant: str, rules: Rules, how: K.Kinematics) -> DataFrame:
    """Features of trips that a task takes whole: the shape first, while points have few columns to hand over."""
    df = R.near_shape(points, rules.spatial_window_km, variant == "planar", None)
    return R.start_distance(R.time_stats(K.kinematics(df, how), rules.time_windows, None))


def features(points: DataFrame, variant: str, rules: Rules) -> DataFrame:
    """The features that a variant's rules look at."""
    if variant == "phase_aware":
        df = R.whole_trip_shape(R.trailing_stats(K.kinematics(points, K.UNLIMITED)))
        return K.positions(df, from_one=True)
    how = K.Kinematics(min_leg_km=0.0 if variant in _BY_ROWS else rules.min_distance_for_turn)
    if variant in _BY_ROWS:
        df = R.shape(R.start_distance(R.adaptive_stats(K.kinematics(points, how))))
    else:
        large = R.large_trips(points)
        if large is None:
            df = _in_windows(points, variant, rules, how)
        else:
            small, rest = R.split(staged(points, "points"), large)
            rest = staged(K.kinematics(rest, how), "large-trips-kinematics")
            rest = staged(R.near_shape(rest, rules.spatial_window_km, variant == "planar", 0), "large-trips-shapes")  # read twice
            rest = R.time_stats(rest, rules.time_windows, 0)
            df = _in_windows(small, variant, rules, how).unionByName(R.start_distance(rest))
    return K.positions(df)


def shore_step(df: DataFrame, rules: Rules) -> DataFrame:
    """The rules' shore filter over classified points: dist_to_shore_km, is_near_shore and is_fishing_filtered, with a coastline also is_on_land.

    Coast and land come from the GeoJSON files (or segments in Parquet) that the rules name.  Whatever can't take effect
    (an unknown region, a coastline filter without files) is an error."""
    if rules.shore_filter_method == "harbor":
        return S.add_shore_filtering(df, rules.shore_filter_region, rules.shore_min_distance_km, "harbor")
    if not rules.shore_coastline_shapefile or (rules.shore_filter_land_points and not rules.shore_land_shapefile):
        raise ValueError("a coastline filter needs shore_coastline_shapefile, and shore_land_shapefile unless shore_filter_land_points is off")
    coast = S.load_segments(df.sparkSession, rules.shore_coastline_shapefile)
    land = S.load_segments(df.sparkSession, rules.shore_land_shapefile, land_only=True) if rules.shore_filter_land_points else None
    return S.add_shore_filtering(df, rules.shore_filter_region or S.DEFAULT_REGION, rules.shore_min_distance_km, "coastline", coast, land, only_fishing=rules.shore_filter_only_fishing)


def classify(points: DataFrame, variant: str = "planar", rules: Rules | None = None, ends: Phases | None = Phases()) -> DataFrame:
    """points -> features, flags, fishing_score and is_fishing (smoothed, but for row_frames, instantaneous and phase_aware); phase_aware also has phases and activity types unless ends is None.  Rules that enable the shore filter add its columns."""
    out = _classified(points, variant, rules, ends)
    return shore_step(out, rules) if rules and rules.enable_shore_filtering else out


def _classified(points: DataFrame, variant: str, rules: Rules | None, ends: Phases | None) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"variant {variant!r} is none of {', '.join(VARIANTS)}")
    rules = rules or Rules.of(CONFIGS[variant] if variant in _BY_ROWS else {})
    df = features(points, variant, rules)
    if variant == "phase_aware":
        df = phase_aware_rules(df)
        return activity_types(phases(df, ends)) if ends else df
    suffix = f"_{rules.time_windows[0]:g}min" if variant not in _BY_ROWS and len(rules.time_windows) > 1 else ""
    df = score(indicators(df, rules, suffix, "speed_kmh" if variant == "instantaneous" else None), rules)
    df = slow_and_turning(df, rules.stationary_speed, rules.moderate_turn_threshold) if variant == "instantaneous" else df
    df = df.withColumn("is_fishing", flag(F.col("fishing_score") >= rules.fishing_score_threshold))
    return df if variant in _BY_ROWS else smooth(df, least=rules.min_state_duration)


class EffortClassifier:
    """predict(), trip_summary() and configuration files over classify(); columns are found by their usual names."""

    def __init__(self, config: dict | Rules | None = None, variant: str = "planar"):
        self.variant = variant
        base = CONFIGS[variant] if variant in _BY_ROWS else {}
        self.rules = config if isinstance(config, Rules) else Rules.of({**base, **(config or {})})

    def predict(self, df: DataFrame, shore=None, **columns: str | None) -> DataFrame:
        """df with any of the known column names -> classified points.  shore: a function of a DataFrame that filters near the shore afterwards."""
        from ..operators.columns import as_points

        out = classify(as_points(df, **columns), self.variant, self.rules)
        return shore(out) if shore else out

    predict_trips = predict

    def summary(self, predicted: DataFrame) -> DataFrame:
        return trip_summary(predicted)

    def save_config(self, path: str) -> None:
        self.rules.save(path)

    @classmethod
    def load_config(cls, path: str, variant: str = "planar") -> EffortClassifier:
        return cls(Rules.load(path), variant)


def predict_fishing_effort(df: DataFrame, config: dict | None = None, variant: str = "planar", **columns: str | None) -> DataFrame:
    return EffortClassifier(config, variant).predict(df, **columns)
