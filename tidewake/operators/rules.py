"""Rule-based effort classification: indicator flags, a weighted score, a threshold."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clip


@dataclass(frozen=True)
class Rules:
    """Thresholds (km/h, degrees, km) and weights; the fixed values of the current variants."""

    min_fishing_speed: float = 0.5
    max_fishing_speed: float = 8.0
    min_transit_speed: float = 12.0
    high_turn_threshold: float = 45.0
    low_straightness_threshold: float = 0.4
    high_sinuosity_threshold: float = 1.5
    clustering_radius_km: float = 0.5
    high_speed_cv_threshold: float = 0.6
    search_speed_min: float = 2.0
    search_speed_max: float = 10.0
    weight_speed: float = 3.0
    weight_turning: float = 2.0
    weight_straightness: float = 2.0
    weight_sinuosity: float = 1.5
    weight_clustering: float = 2.0
    weight_speed_variability: float = 1.5
    weight_interaction_fishing_pattern: float = 3.0
    weight_interaction_search_pattern: float = 2.0
    transit_penalty: float = 5.0
    fishing_score_threshold: float = 0.5
    min_state_duration: int = 3
    min_distance_for_turn: float = 0.1
    spatial_window_km: float = 1.0
    stationary_speed: float = 2.0
    moderate_turn_threshold: float = 20.0
    time_windows: tuple[float, ...] = (10.0,)
    patterns: bool = True
    enable_shore_filtering: bool = False
    shore_filter_region: str | None = None
    shore_filter_method: str = "coastline"
    shore_coastline_shapefile: str | None = None
    shore_land_shapefile: str | None = None
    shore_min_distance_km: float = 0.5
    shore_filter_land_points: bool = True
    shore_filter_only_fishing: bool = True

    def __post_init__(self):
        if self.enable_shore_filtering and self.shore_filter_method not in ("coastline", "harbor"):
            raise ValueError(f"shore_filter_method {self.shore_filter_method!r} is neither 'harbor' nor 'coastline'")
        if self.enable_shore_filtering and self.shore_filter_method == "harbor" and not self.shore_filter_region:
            raise ValueError("a harbour filter needs shore_filter_region")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Rules:
        return cls.of(json.loads(Path(path).read_text()))

    @classmethod
    def of(cls, values: dict) -> Rules:
        """The defaults with some values replaced; unknown names are an error."""
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


#: Named configurations, fixed values: sensitivity and gear.
CONFIGS = {
    "default": {},
    "row_frames": {"patterns": False, "min_distance_for_turn": 0.0},
    "instantaneous": {"patterns": False, "min_distance_for_turn": 0.0, "min_fishing_speed": 0.5, "max_fishing_speed": 8.0, "min_transit_speed": 10.0, "high_turn_threshold": 45.0, "low_straightness_threshold": 0.7, "high_sinuosity_threshold": 1.5, "clustering_radius_km": 2.0, "high_speed_cv_threshold": 0.8, "weight_speed": 2.5, "weight_turning": 2.0, "weight_straightness": 1.5, "weight_sinuosity": 1.0, "weight_clustering": 1.5, "weight_speed_variability": 1.0},
    "alternative": {"min_fishing_speed": 0.8, "max_fishing_speed": 7.5, "stationary_speed": 1.5, "min_transit_speed": 10.0, "high_turn_threshold": 40.0, "moderate_turn_threshold": 15.0, "low_straightness_threshold": 0.75, "high_sinuosity_threshold": 1.4, "clustering_radius_km": 1.5, "high_speed_cv_threshold": 0.7, "weight_speed": 3.0, "weight_turning": 2.0, "weight_straightness": 1.5, "weight_sinuosity": 1.0, "weight_clustering": 2.0, "weight_speed_variability": 1.0, "fishing_score_threshold": 0.55},
    "conservative": {"fishing_score_threshold": 0.55, "min_fishing_speed": 0.8, "max_fishing_speed": 7.5, "min_transit_speed": 10.0, "high_turn_threshold": 40.0, "low_straightness_threshold": 0.75, "high_sinuosity_threshold": 1.4, "clustering_radius_km": 1.5, "high_speed_cv_threshold": 0.7, "weight_speed": 3.0, "weight_turning": 2.0, "weight_straightness": 1.5, "weight_sinuosity": 1.0, "weight_clustering": 2.0, "weight_speed_variability": 1.0},
    "high_sensitivity": {"fishing_score_threshold": 0.35, "min_fishing_speed": 0.2, "max_fishing_speed": 10.0, "min_transit_speed": 12.0, "high_turn_threshold": 35.0, "low_straightness_threshold": 0.50, "high_sinuosity_threshold": 1.4, "clustering_radius_km": 1.2, "high_speed_cv_threshold": 0.5, "min_state_duration": 1, "min_distance_for_turn": 0.05},
    "low_sensitivity": {"fishing_score_threshold": 0.55, "min_fishing_speed": 0.5, "max_fishing_speed": 7.0, "min_transit_speed": 8.0, "high_turn_threshold": 45.0, "low_straightness_threshold": 0.40, "high_sinuosity_threshold": 1.6, "clustering_radius_km": 0.8, "high_speed_cv_threshold": 0.7, "min_state_duration": 3, "min_distance_for_turn": 0.1},
    "gillnet": {"fishing_score_threshold": 0.38, "min_fishing_speed": 0.3, "max_fishing_speed": 4.0, "min_transit_speed": 5.0, "high_turn_threshold": 35.0, "low_straightness_threshold": 0.50, "high_sinuosity_threshold": 1.5, "clustering_radius_km": 0.6, "high_speed_cv_threshold": 0.6, "min_state_duration": 2, "min_distance_for_turn": 0.05},
    "trawl": {"fishing_score_threshold": 0.40, "min_fishing_speed": 2.0, "max_fishing_speed": 7.0, "min_transit_speed": 8.0, "high_turn_threshold": 25.0, "low_straightness_threshold": 0.35, "high_sinuosity_threshold": 1.3, "clustering_radius_km": 2.0, "high_speed_cv_threshold": 0.5, "min_state_duration": 2, "min_distance_for_turn": 0.1},
    "longline": {"fishing_score_threshold": 0.40, "min_fishing_speed": 1.0, "max_fishing_speed": 6.0, "min_transit_speed": 8.0, "high_turn_threshold": 30.0, "low_straightness_threshold": 0.45, "high_sinuosity_threshold": 1.4, "clustering_radius_km": 1.0, "high_speed_cv_threshold": 0.6, "min_state_duration": 2, "min_distance_for_turn": 0.08},
}


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def indicators(df: DataFrame, rules: Rules, suffix: str = "", speed_column: str | None = None) -> DataFrame:
    """Flags from the first time window's statistics and the shape columns; speed_column replaces the window's mean speed."""
    speed, turn = F.col(speed_column or f"speed_kmh_mean{suffix}"), F.col(f"turn_angle_mean{suffix}")
    df = df.withColumns({
        "is_fishing_speed": flag(speed.between(rules.min_fishing_speed, rules.max_fishing_speed)),
        "is_transit_speed": flag(speed >= rules.min_transit_speed),
        "is_high_turning": flag(turn >= rules.high_turn_threshold),
        "is_low_straightness": flag(F.col("straightness") <= rules.low_straightness_threshold),
        "is_high_sinuosity": flag(F.col("sinuosity") >= rules.high_sinuosity_threshold),
        "is_clustered": flag(F.col("radius_gyration_km") <= rules.clustering_radius_km),
        "is_variable_speed": flag(F.col(f"speed_cv{suffix}") >= rules.high_speed_cv_threshold),
    })
    if rules.patterns:
        df = df.withColumns({
            "is_fishing_pattern": F.col("is_fishing_speed") * F.col("is_high_turning") * F.col("is_clustered"),
            "is_search_pattern": flag(speed.between(rules.search_speed_min, rules.search_speed_max)) * F.col("is_high_turning"),
        })
    return df


def score(df: DataFrame, rules: Rules) -> DataFrame:
    """fishing_score: the weighted flags less the transit penalty, as a part of all weights, within 0 to 1."""
    weights = {"is_fishing_speed": rules.weight_speed, "is_high_turning": rules.weight_turning, "is_low_straightness": rules.weight_straightness, "is_high_sinuosity": rules.weight_sinuosity, "is_clustered": rules.weight_clustering, "is_variable_speed": rules.weight_speed_variability}
    if rules.patterns:
        weights |= {"is_fishing_pattern": rules.weight_interaction_fishing_pattern, "is_search_pattern": rules.weight_interaction_search_pattern}
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) - F.col("is_transit_speed") * rules.transit_penalty
    return df.withColumn("fishing_score", clip(total / sum(weights.values()), 0, 1))


def slow_and_turning(df: DataFrame, stationary: float = 2.0, turning: float = 20.0) -> DataFrame:
    """is_stationary and is_moderate_turning, two flags that don't count for the score."""
    return df.withColumns({"is_stationary": flag(F.col("speed_kmh") < stationary), "is_moderate_turning": flag(F.col("turn_angle_mean") >= turning)})


def phase_aware_rules(df: DataFrame) -> DataFrame:
    """The phase-aware variant: strict comparisons, the turn at the point itself, and transit always overrides."""
    df = df.withColumns({
        "is_fishing_speed": flag(F.col("speed_kmh_mean").between(0.5, 5.0)),
        "is_transit_speed": flag(F.col("speed_kmh_mean") > 8.0),
        "is_high_turning": flag(F.col("turn_angle") > 45.0),
        "is_low_straightness": flag(F.col("straightness") < 0.3),
        "is_high_sinuosity": flag(F.col("sinuosity") > 1.5),
        "is_clustered": flag(F.col("radius_gyration_km") < 0.5),
        "is_variable_speed": flag(F.col("speed_cv") > 0.5),
    })
    hundredths = sum((F.col(c) * w for c, w in {"is_fishing_speed": 25, "is_high_turning": 20, "is_low_straightness": 15, "is_high_sinuosity": 15, "is_clustered": 10, "is_variable_speed": 15}.items()), F.lit(0))
    return df.withColumn("fishing_score", hundredths / 100).withColumn("is_fishing", F.when(F.col("is_transit_speed") == 1, 0).otherwise(flag(hundredths >= 50)))


def indicator_rates(df: DataFrame) -> DataFrame:
    """Each flag's rate in percent, one row each."""
    names = [c for c in df.columns if c.startswith("is_") and c not in ("is_daytime", "is_fishing")]
    return df.agg(*[(F.avg(c) * 100).alias(c) for c in names]).unpivot([], names, "indicator", "rate")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of points by two configurations' verdicts.  Points are told apart by trip (none is a trip too) and id: repeated rows count once."""
    one = a.select("trip_id", "event_id", F.col("is_fishing").alias("left_verdict")).dropDuplicates(["trip_id", "event_id"])
    two = b.select(F.col("trip_id").alias("_trip"), F.col("event_id").alias("_id"), F.col("is_fishing").alias("right_verdict")).dropDuplicates(["_trip", "_id"])
    both = one.join(two, F.col("trip_id").eqNullSafe(F.col("_trip")) & F.col("event_id").eqNullSafe(F.col("_id")))
    return both.groupBy("left_verdict", "right_verdict").agg(F.count("*").alias("n"))
