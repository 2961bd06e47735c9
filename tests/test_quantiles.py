"""Exact quantiles against NumPy."""

import numpy as np
import pytest

from gridloom.operators.quantiles import quantiles


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_quantiles_match_numpy(spark, ranges):
    rng = np.random.default_rng(0)
    groups = {"a": rng.standard_normal(1000), "b": rng.integers(0, 3, 500), None: rng.random(77) * 1e9, "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 40}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {r.k: r for r in quantiles(df.withColumnRenamed("k", "p"), "v", ps, ("p",), ranges).toDF("k", "n", "q").collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v) and got[k].q == pytest.approx(np.quantile(v, ps), rel=1e-12)
    whole = quantiles(df, "v", (0.25, 0.75), ranges=ranges).first()
    every = np.concatenate([np.asarray(v, float) for v in groups.values()])
    assert whole.n == len(every) and whole.p == pytest.approx(np.quantile(every, (0.25, 0.75)))
    assert quantiles(df.limit(0), "v", ps).count() == 0
