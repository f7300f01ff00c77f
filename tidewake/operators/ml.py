"""Supervised models over point and trip features, and their evaluation by grouped counts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import KernelMachine, literal

#: Feature order of the point model, fixed.
POINT_FEATURES = [
    "latitude", "longitude", "hour", "dayofweek", "trip_pos_norm", "time_since_start_min", "speed_kmh", "acceleration", "jerk",
    "speed_kmh_mean_w", "speed_kmh_std_w", "speed_kmh_q25_w", "speed_kmh_q75_w", "acceleration_mean_w", "acceleration_std_w", "acceleration_q25_w", "acceleration_q75_w",
    "turn_angle", "turn_angle_mean_w", "turn_angle_std_w", "turn_angle_q25_w", "turn_angle_q75_w", "lat_std_w", "lon_std_w", "straightness_w", "rog_w", "is_stationary", "dist_to_start_km",
]
TRIP_FEATURES = ["duration_hours", "distance_nm", "mean_sog"]


@dataclass
class ModelCard:
    """What a trained model is; to_row() gives a JSON line."""

    name: str
    task: str
    version: str = "1"
    features: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    notes: str = ""

    def to_row(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def effort_label(activity: str = "Activity"):
    """Fishing and Searching read 1; Sailing, Traveling, NULL and unknown labels read 0."""
    return F.coalesce(F.col(activity).isin("Fishing", "Searching"), F.lit(False)).cast("double")


def readable(column: str = "effort_pred"):
    return F.when(F.col(column) == 1, "Fishing").otherwise("Not Fishing")


class EffortForest:
    """Random forest over points: effort_pred and effort_prob.  Features are made unless they are there."""

    def __init__(self, trees: int = 400, depth: int = 30, seed: int = 42, model: PipelineModel | None = None):
        self.trees, self.depth, self.seed, self.model = trees, depth, seed, model

    @staticmethod
    def features(points: DataFrame) -> DataFrame:
        """points with their features, written once: a fit reads its rows four times, and those who also predict the same points read them again."""
        from ..sources.staging import staged
        from .kinematics import learned_features

        return staged(learned_features(points), "point-features")

    def _features(self, points: DataFrame, again: bool = False) -> DataFrame:
        from .kinematics import learned_features

        known = set(POINT_FEATURES) <= set(points.columns)
        df = points if known else self.features(points) if again else learned_features(points)
        return df.withColumns({f"_{c}": F.col(c).cast("float").cast("double") for c in POINT_FEATURES})

    def fit(self, points: DataFrame, label: str = "Activity") -> EffortForest:
        df = self._features(points, again=True).withColumn("label", effort_label(label))
        forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess", numTrees=self.trees, maxDepth=self.depth, seed=self.seed, maxMemoryInMB=512)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=[f"_{c}" for c in POINT_FEATURES], outputCol="_vector"), forest]).fit(df)
        return self

    def predict(self, points: DataFrame, probability: bool = True) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit or load a model first")
        out = self.model.transform(self._features(points)).withColumn("effort_pred", F.col("_guess").cast("int"))
        if probability:
            out = out.withColumn("effort_prob", F.get(vector_to_array("_p"), F.lit(1)))
        return out.drop("_vector", "_p", "_raw", "_guess", *[f"_{c}" for c in POINT_FEATURES])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> EffortForest:
        return cls(model=PipelineModel.load(path))


def trip_features(points: DataFrame) -> DataFrame:
    """duration_hours, distance_nm and mean_sog (knots) of each trip."""
    from .kinematics import legs

    out = legs(points).groupBy("trip_id").agg(((F.max("t_us") - F.min("t_us")) / 3.6e9).alias("duration_hours"), (F.coalesce(F.sum("leg_km"), F.lit(0.0)) / 1.852).alias("distance_nm"))
    return out.withColumn("mean_sog", F.coalesce(F.col("distance_nm") / F.when(F.col("duration_hours") > 0, F.col("duration_hours")), F.lit(0.0)))


class _TripModel:
    label, out = "", ""

    def __init__(self, model: PipelineModel | None = None):
        self.model = model

    def _scaled(self, df: DataFrame) -> str:
        """SQL for the standardised features; deviations are of the whole, not of a sample."""
        r = df.agg(*[f(c).alias(f"{n}{c}") for c in TRIP_FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return ", ".join(f"({c} - ({float(r['m' + c] or 0)!r})) / {float(r['s' + c] or 0) or 1.0!r} AS _{c}" for c in TRIP_FEATURES)

    def fit(self, trips: DataFrame):
        held = trips.persist()  # learners read it again and again, in partitions of some size
        trips = held.coalesce(max(1, held.count() // 50_000))
        names = StringIndexer(inputCol=self.label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
        if trips.where(F.col(self.label).isNotNull()).isEmpty():
            raise ValueError(f"there are no trips with a {self.label}")
        labels = names.fit(trips).labels
        scale = SQLTransformer(statement=f"SELECT *, {self._scaled(trips)} FROM __THIS__")
        rows = StringIndexerModel.from_labels(labels, self.label, "_label", "skip").transform(trips)
        stages = [scale, *self._learner(scale.transform(rows), labels), IndexToString(inputCol="_guess", outputCol=self.out, labels=labels)]
        self.model = Pipeline(stages=stages).fit(rows)
        held.unpersist()
        return self

    @property
    def classes(self) -> list[str]:
        return self.model.stages[-1].getLabels()

    def predict(self, trips: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit or load a model first")
        out = self.model.transform(trips)
        return out.drop(*[c for c in out.columns if c.startswith("_") or c == "rawPrediction"])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str):
        return cls(PipelineModel.load(path))


class GearModel(_TripModel):
    """Gear from trip features: standardised, multinomial logistic regression without penalty; gear_pred."""

    label, out = "gear_label", "gear_pred"

    def _learner(self, rows: DataFrame, labels: list[str]) -> list:
        inputs = VectorAssembler(inputCols=[f"_{c}" for c in TRIP_FEATURES], outputCol="_in")
        return [inputs, LogisticRegression(featuresCol="_in", labelCol="_label", predictionCol="_guess", rawPredictionCol="_raw", probabilityCol="_p", family="multinomial", maxIter=1000, standardization=False)]


class VesselModel(_TripModel):
    """Vessel type from trip features: support vectors under a radial kernel at landmarks, one machine for each pair of types
    (operators/kernel.py).  vessel_type_pred is the type that wins most pairs; vessel_type_prob maps each type to its probability, which
    need not be largest for the predicted type, as in other kernel machines.  A trip without one of its features is an error."""

    label, out = "vessel_type_label", "vessel_type_pred"
    landmarks, gamma, cost = 64, 1.0 / 3, 1.0

    def _learner(self, rows: DataFrame, labels: list[str]) -> list:
        inputs = [f"_{c}" for c in TRIP_FEATURES]
        machine = KernelMachine(inputs, self.gamma, self.cost, self.landmarks).fit(rows, "_label", len(labels))
        names = literal(labels, "array<string>")
        return [*machine.stages(), SQLTransformer(statement=f"SELECT *, map_from_arrays({names}, _prob) AS vessel_type_prob FROM __THIS__")]


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """truth class: precision, recall, f1, support; undefined ratios read 0."""
    c = confusion(df, truth, guess)
    sides = c.select(F.col("truth").alias("label"), "n", F.lit(0).alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")).unionByName(c.select(F.col("guess").alias("label"), F.lit(0).alias("n"), F.col("n").alias("g"), F.lit(0).alias("hit")))
    s = sides.groupBy("label").agg(F.sum("n").alias("support"), F.sum("g").alias("_g"), F.sum("hit").alias("_h"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    s = s.withColumn("precision", ratio("_h", "_g")).withColumn("recall", ratio("_h", "support"))
    both = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.when(both > 0, both), F.lit(0.0))).select("label", "support", "precision", "recall", "f1")


def metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, macro_f1, weighted_f1, n."""
    r = class_report(df, truth, guess)
    return r.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def label_correlation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.agg(*[F.corr(c, label).alias(c) for c in features]).unpivot([], features, "feature", "r")


def k_means(rows: DataFrame, features: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Cluster of each row of a small feature table."""
    from pyspark.ml.clustering import KMeans

    at = rows.withColumn("_v", array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
    return KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(at).transform(at).drop("_v")
