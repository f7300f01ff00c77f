import numpy as np
import pytest

from tidewake.operators.regression import SelfOrganisingMap
from tidewake.operators.som import BatchMap, standardised


def test_error_is_that_of_the_driver_s_map(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 2, (7, 4))
    data = np.concatenate([c + rng.normal(0, 0.5, (60, 4)) for c in centres])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double").repartition(4)
    m = BatchMap(6, 6).fit(df, ["a", "b", "c", "d"])
    single = SelfOrganisingMap(6, 6).fit(data, 10_000)
    assert m.quantisation_error(df) <= 1.05 * single.quantisation_error(data)
    again = BatchMap(6, 6).fit(df.orderBy("d"), ["a", "b", "c", "d"])
    assert np.allclose(m.nodes, again.nodes)
    out = m.assign(df).toPandas()
    d = np.linalg.norm(data[:, None] - m.nodes, axis=2)
    assert np.isclose(out.distance.sum(), d.min(axis=1).sum()) and set(out.node) <= set(range(36))


def test_rows_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, float("nan")), (1.0, 2.0), (5.0, 6.0)], "a double, b double")
    m = BatchMap(2, 2, rounds=3).fit(df, ["a", "b"])
    assert m.assign(df.selectExpr("*", "7 AS node")).count() == 3 and BatchMap(1, 3, rounds=2).fit(df, ["a"]).nodes.shape == (3, 1)
    with pytest.raises(ValueError, match="no rows"):
        BatchMap().fit(df.limit(0), ["a", "b"])
    s = standardised(df.limit(1).unionByName(df.limit(1)), ["a", "b"]).collect()
    assert [tuple(r) for r in s] == [(0.0, 0.0)] * 2
