"""Projections, rolling factor betas and covariances by blocks against NumPy."""

import datetime

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import risk

DAY = datetime.date(2020, 1, 1)


def _day(i):
    return DAY + datetime.timedelta(days=int(i))


@pytest.mark.parametrize("ones", [True, False])
def test_neutralise_with_collinear_loadings_matches_pinv(spark, ones):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(6):
        for a in range(30):
            x = rng.standard_normal(3)
            v = [None if rng.random() < 0.1 else float(c) for c in (rng.standard_normal(), *x)]
            rows.append((_day(t), f"A{a:02d}", *v, v[1] if v[1] is None else 3 * v[1], 0.0 if t == 3 else 2.5))
    rows += [(_day(7), "A00", 1.0, *[None] * 5), (_day(8), "A00", None, *[None] * 5), (None, "A01", 1.0, *[1.0] * 5)]
    cols = ["v", "a", "b", "c", "dup", "k"]
    df = spark.createDataFrame(rows, "dt date, asset string, v double, a double, b double, c double, dup double, k double")
    got = risk.neutralise(df, "v", cols[1:], ones=ones).toPandas()
    assert len(got) == len(rows) and list(got.columns) == df.columns
    frame = pd.DataFrame(rows, columns=df.columns)
    for dt, g in frame.dropna(subset=["dt"]).groupby("dt"):
        x = g[cols[1:]].fillna(0.0).to_numpy(float)
        x = np.column_stack((x, np.ones(len(x)))) if ones else x
        w = g.v.fillna(0.0).to_numpy(float)
        want = w - x @ (np.linalg.pinv(x.T @ x, rcond=1e-12) @ (x.T @ w))
        mine = got[got["dt"] == dt].set_index("asset").v.loc[g.asset].to_numpy()
        assert mine == pytest.approx(want, abs=1e-10)
    assert got[got["dt"].isna()].v.isna().all()


def test_neutralise_complete_rows_only(spark):
    rows = [(_day(0), "a", 1.0, 1.0), (_day(0), "b", 3.0, 2.0), (_day(0), "c", 8.0, 3.0), (_day(0), "d", 5.0, None), (_day(0), "e", None, 1.0), (_day(1), "a", 1.0, None), (_day(1), "b", 2.0, None)]
    got = {(r["dt"], r.asset): r.v for r in risk.neutralise(spark.createDataFrame(rows, "dt date, asset string, v double, x double"), "v", ["x"], fill=False).collect()}
    fit = np.polynomial.Polynomial.fit([1, 2, 3], [1, 3, 8], 1)
    assert [got[_day(0), n] for n in "abc"] == pytest.approx([1 - fit(1), 3 - fit(2), 8 - fit(3)])
    assert got[_day(0), "d"] is None and got[_day(0), "e"] is None and (got[_day(1), "a"], got[_day(1), "b"]) == (-0.5, 0.5)


@pytest.mark.parametrize("intercept", [True, False])
def test_rolling_factor_betas_match_a_fit_per_window(spark, intercept):
    rng = np.random.default_rng(1)
    t, bars, least = 90, 25, 8
    f = rng.standard_normal((t, 4)) * 0.02 + 0.001
    f[:40, 3] = f[:40, 0] * 2  # collinear windows
    f[50:, 2] = 0.01  # a constant factor
    y = {a: f @ rng.standard_normal(4) + rng.standard_normal(t) * 0.01 for a in ("x", "y")}
    y["y"][rng.random(t) < 0.3] = np.nan
    f[rng.random(t) < 0.1, 1] = np.nan
    rows = [(_day(i), a, None if np.isnan(y[a][i]) else float(y[a][i]), *(None if np.isnan(v) else float(v) for v in f[i])) for a in y for i in range(t)]
    df = spark.createDataFrame(rows, "dt date, asset string, ret double, f0 double, f1 double, f2 double, f3 double").repartition(5)
    got = {(r.asset, (r["dt"] - DAY).days): r.betas for r in risk.rolling_factor_betas(df, "ret", ["f0", "f1", "f2", "f3"], bars, least, intercept).collect()}
    n = 0
    for a in y:
        for i in range(t):
            lo = max(0, i - bars + 1)
            ok = ~np.isnan(f[lo : i + 1]).any(axis=1) & ~np.isnan(y[a][lo : i + 1])
            if ok.sum() < least:
                assert (a, i) not in got
                continue
            x = f[lo : i + 1][ok]
            x = np.column_stack((np.ones(len(x)), x)) if intercept else x
            beta = np.linalg.pinv(x.T @ x, rcond=1e-12, hermitian=True) @ (x.T @ y[a][lo : i + 1][ok])
            assert got[a, i] == pytest.approx(beta[1:] if intercept else beta, abs=1e-6)
            n += 1
    assert n == len(got) > 100
    # a fit at t sees nothing after it
    early = risk.rolling_factor_betas(df.filter(df["dt"] <= _day(60)), "ret", ["f0", "f1", "f2", "f3"], bars, least, intercept).collect()
    assert all(r.betas == pytest.approx(got[r.asset, (r["dt"] - DAY).days], abs=1e-9) for r in early)


def test_covariance_by_blocks_is_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.standard_normal((40, 23)) * 0.03 + 0.01, columns=[f"N{i}" for i in range(23)], index=[_day(i) for i in range(40)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide.iloc[1:, 4] = np.nan  # one day only
    wide.iloc[0, 4] = 0.5
    wide.iloc[:20, 5] = np.nan  # never with N6
    wide.iloc[20:, 6] = np.nan
    rows = [(d, a, None if np.isnan(v) else float(v)) for a in wide for d, v in wide[a].items()]
    df = spark.createDataFrame(rows, "dt date, asset string, ret double")
    want = wide.cov()
    weights = spark.createDataFrame([(f"N{i}", float(w)) for i, w in enumerate(rng.standard_normal(23)) if i != 3] + [("N3", 0.0), ("other", 1.0)], "asset string, w double")
    w = weights.toPandas().set_index("asset").w.reindex(want.index)
    var = np.nansum(np.outer(w, w) * np.where(np.eye(23) > 0, want, 0.8 * want))
    for block, days in ((256, 4096), (4, 4096), (5, 7)):
        got = risk.sample_covariance(df, 0.2, block, days).collect()
        assert len({(r.a, r.b) for r in got}) == len(got) and all(r.a <= r.b for r in got)
        both = (wide.notna().astype(int).T @ wide.notna().astype(int)).to_numpy()
        assert len(got) == int((both[np.triu_indices(23)] > 0).sum())
        for r in got:
            v = want.loc[r.a, r.b]
            assert (r.cov is None) if np.isnan(v) else r.cov == pytest.approx(v if r.a == r.b else 0.8 * v, abs=1e-12)
        assert risk.book_volatility(weights, df, 52, 0.2, block, days).first().vol == pytest.approx(np.sqrt(max(var, 0) * 52))
    empty = spark.createDataFrame([], "dt date, asset string, ret double")
    assert risk.sample_covariance(empty).count() == 0 and risk.book_volatility(weights, empty, 52).first().vol == 0
