"""Kernel machines at landmarks against NumPy, probabilities on trips held out, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import ml as M
from tidewake.operators.kernel import KernelMachine, kernel, landmarks, lifted, literal, pivots

KINDS = ["canoe", "it's \"raft\"", "motor"]


def rings(n, seed, kinds=3):
    """Trips whose types lie in rings around one centre: no line parts them."""
    rng = np.random.default_rng(seed)
    kind = rng.integers(0, kinds, n)
    turn, far = rng.uniform(0, 2 * np.pi, n), 1.0 + 2 * kind + rng.normal(0, 0.5, n)
    return [(i, float(5 + a), float(9 + b), float(c), KINDS[k]) for i, (a, b, c, k) in enumerate(zip(far * np.cos(turn), far * np.sin(turn), rng.normal(0, 0.3, n), kind, strict=True))]


def table(spark, rows):
    return spark.createDataFrame(rows, "trip_id int, duration_hours double, distance_nm double, mean_sog double, vessel_type_label string").repartition(3)


def test_landmarks_of_all_rows_give_the_kernel_itself(spark):
    x = np.random.default_rng(5).normal(0, 1, (30, 3))
    points = pivots(x, 40, 1 / 3)
    values, vectors = np.linalg.eigh(kernel(points, points, 1 / 3))
    keep = values > 1e-10 * values.max()
    phi = kernel(x, points, 1 / 3) @ vectors[:, keep] / np.sqrt(values[keep])
    assert np.allclose(phi @ phi.T, kernel(x, x, 1 / 3), atol=1e-4)
    df = spark.createDataFrame([tuple(map(float, r)) for r in [*x, *x]], "a double, b double, c double")
    some = landmarks(df, ["a", "b", "c"], 8, 1 / 3)
    assert some.shape == (8, 3) and np.allclose(some, landmarks(df.orderBy("b"), ["a", "b", "c"], 8, 1 / 3))


def test_probabilities_of_trips_held_out(spark, tmp_path):
    train, test = rings(900, 1), rings(400, 2)
    model = M.VesselModel().fit(table(spark, train))
    got = model.predict(table(spark, test)).collect()
    assert len(got) == 400 and model.classes == sorted(KINDS)
    right = np.mean([r.vessel_type_pred == r.vessel_type_label for r in got])
    assert right > 0.9
    sums = [sum(r.vessel_type_prob.values()) for r in got]
    assert np.allclose(sums, 1) and all(set(r.vessel_type_prob) == set(KINDS) for r in got)
    loss = -np.mean([np.log(r.vessel_type_prob[r.vessel_type_label]) for r in got])
    # what a machine without probabilities can say at best: its rate of right answers for the predicted type, the rest shared
    plain = -np.mean([np.log(right if r.vessel_type_pred == r.vessel_type_label else (1 - right) / 2) for r in got])
    assert loss < 0.8 * plain and loss < 0.3
    sure = np.array([max(r.vessel_type_prob.values()) for r in got])
    hit = np.array([max(r.vessel_type_prob, key=r.vessel_type_prob.get) == r.vessel_type_label for r in got])
    assert abs(sure.mean() - hit.mean()) < 0.05  # calibrated on the whole
    model.save(str(tmp_path / "m"))
    again = {r.trip_id: r for r in M.VesselModel.load(str(tmp_path / "m")).predict(table(spark, test)).collect()}
    assert all(again[r.trip_id].vessel_type_prob == r.vessel_type_prob for r in got)


def test_decisions_and_coupling_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b), int(a + b > 0) + int(a > 1)) for a, b in rng.normal(0, 1, (300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = KernelMachine(["a", "b"], 0.5, size=20).fit(df, "y", 3)
    out = df
    for stage in m.stages():
        out = stage.transform(out)
    for r in out.collect():
        k = kernel(np.array([[r.a, r.b]]), m.points, 0.5)[0]
        f = [np.dot(w["w"], k) + w["b"] for w in m.machines]
        p = 1 / (1 + np.exp([s[0] * v + s[1] for s, v in zip(m.sigmoids, f, strict=True)]))
        odds = {0: 1 / p[0] + 1 / p[1], 1: 1 / (1 - p[0]) + 1 / p[2], 2: 1 / (1 - p[1]) + 1 / (1 - p[2])}
        part = np.array([1 / (odds[c] - 1) for c in range(3)])
        won = np.bincount([i if v > 0 else j for (i, j), v in zip(m.pairs, f, strict=True)], minlength=3)
        assert np.allclose(r._f, f, atol=1e-9) and np.allclose(r._prob, part / part.sum(), atol=1e-6) and r._guess == won.argmax()
    z = lambda ab, f: ab[0] * np.array(f) + ab[1]
    assert all(s[0] < 0 for s in m.sigmoids) and np.all(np.diff(1 / (1 + np.exp(z(m.sigmoids[0], [-1, 0, 1])))) > 0)


def test_one_type_few_rows_equal_rows_and_none(spark):
    one = [(i, 1.0 * i, 2.0, 3.0, "canoe") for i in range(6)]
    r = M.VesselModel().fit(table(spark, one)).predict(table(spark, one)).collect()
    assert {x.vessel_type_pred for x in r} == {"canoe"} and all(x.vessel_type_prob == {"canoe": 1.0} for x in r)
    few = [(0, 1.0, 1.0, 1.0, "canoe"), (1, 9.0, 9.0, 9.0, "motor"), (2, 9.0, 9.0, 9.0, None)]
    r = M.VesselModel().fit(table(spark, few)).predict(table(spark, few)).orderBy("trip_id").collect()
    assert [x.vessel_type_pred for x in r] == ["canoe", "motor", "motor"]
    same = [(i, 1.0, 1.0, 1.0, KINDS[i % 2]) for i in range(10)]
    r = M.VesselModel().fit(table(spark, same)).predict(table(spark, same)).collect()
    assert all(abs(p - 0.5) < 0.05 for x in r for p in x.vessel_type_prob.values())
    with pytest.raises(ValueError, match="no trips"):
        M.VesselModel().fit(table(spark, one).limit(0))
    text = ["a'b", 'c"d', "e\\f"]
    assert spark.range(1).select(F.expr(literal(text, "array<string>"))).first()[0] == text


def test_kernel_values_are_lifted_as_matrices(spark):
    root = np.random.default_rng(2).normal(0, 1, (5, 7))
    k = np.random.default_rng(3).normal(0, 1, (40, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(k)], "i int, k array<double>").repartition(3)
    got = {r.i: r.f for r in df.select("i", lifted(root)("k").alias("f")).collect()}
    assert np.allclose([got[i] for i in range(40)], k @ root.T)
    assert df.where("i < 0").select(lifted(root)("k")).count() == 0
