"""Boosted trees by distributed histograms against a fit in NumPy."""

import datetime

import numpy as np
import pytest

from gridloom.operators import boosting
from gridloom.operators.boosting import Boosting, walk_forward_boosted


def _fit(x, y, s):
    """The definition: exact greedy splits over the bins, one row at a time."""
    base = y.mean()
    pred, trees = np.full(len(y), base), []
    for _ in range(s.rounds):
        g, tree = pred - y, {}
        node = np.zeros(len(y), dtype=int)
        for level in range(s.depth):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = node == n
                best, where = 1e-7, None
                score = lambda m: g[m].sum() ** 2 / (m.sum() + s.l2)  # noqa: B023, E731
                for f in range(x.shape[1]):
                    for c in range(s.bins - 1):
                        left = rows & (x[:, f] <= c)
                        right = rows & ~left
                        if left.sum() >= s.least and right.sum() >= s.least:
                            gain = round(score(left) + score(right) - score(rows), 9)
                            if gain > best:
                                best, where = gain, (f, c)
                tree[n] = where
                node[rows] = 2 * n + 1 + (x[rows, where[0]] > where[1] if where else 0)
        value = {n: -s.rate * g[node == n].sum() / ((node == n).sum() + s.l2) for n in range(2**s.depth - 1, 2 ** (s.depth + 1) - 1)}
        pred = pred + np.array([value[n] for n in node])
        trees.append((tree, value))
    return base, trees


def _score(base, trees, x, depth):
    out = np.full(len(x), base)
    for tree, value in trees:
        for i, row in enumerate(x):
            n = 0
            for _ in range(depth):
                n = 2 * n + 1 + int(tree[n] is not None and row[tree[n][0]] > tree[n][1])
            out[i] += value[n]
    return out


@pytest.mark.parametrize("fresh", [3, 100])
def test_boosting_matches_numpy(spark, monkeypatch, fresh):
    monkeypatch.setattr(boosting, "FRESH", fresh)
    rng = np.random.default_rng(3)
    bars, assets = 30, 12
    x = rng.standard_normal((bars, assets, 2))
    y = np.sin(2 * x[..., 0]) + (x[..., 1] > 0.3) * x[..., 0] + rng.standard_normal((bars, assets)) * 0.1
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    rows = [(i, day(i), f"A{a:02d}", *map(float, x[i, a]), float(y[i, a])) for i in range(bars) for a in range(assets)]
    rows += [(3, day(3), "none", None, 1.0, 5.0), (25, day(25), "new", 0.5, 0.5, None), (3, day(3), "unlabelled", 0.1, 0.1, None)]
    df = spark.createDataFrame(rows, "pos int, dt date, asset string, a double, b double, y double").repartition(4)
    windows = spark.createDataFrame([(0, 14, 16, 22), (1, 20, 22, 28)], "window_id int, train_end int, test_lo int, test_hi int")
    s = Boosting(rounds=8, rate=0.3, depth=3, bins=8, l2=1.0, least=5)
    got = {(r.window_id, r["dt"], r.asset): r.pred for r in walk_forward_boosted(df, windows, ["a", "b"], "y", s).collect()}
    first = [r for r in rows if r[0] < 14 and None not in r]
    edges = [spark.createDataFrame([(r[3 + k],) for r in first], "v double").selectExpr(f"percentile_approx(v, array({','.join(str(j / 8) for j in range(1, 8))}), 10000) as q").first().q for k in (0, 1)]
    binned = lambda rs: np.array([[sum(e < r[3 + k] for e in edges[k]) for k in (0, 1)] for r in rs])
    n = 0
    for w, end, lo, hi in ((0, 14, 16, 22), (1, 20, 22, 28)):
        train = [r for r in rows if r[0] < end and None not in r]
        base, trees = _fit(binned(train), np.array([r[5] for r in train]), s)
        test = [r for r in rows if lo <= r[0] < hi and None not in r[3:5]]
        for r, want in zip(test, _score(base, trees, binned(test), 3), strict=True):
            assert got[w, r[1], r[2]] == pytest.approx(want, abs=1e-9)
            n += 1
    assert n == len(got) == 12 * 12 + 1
    assert walk_forward_boosted(df, windows.limit(0), ["a", "b"], "y", s).count() == 0


def test_boosting_of_a_constant_or_few_rows(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(i, day, f"A{i}", float(i), 2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "pos int, dt date, asset string, a double, y double")
    windows = spark.createDataFrame([(0, 4, 4, 6)], "window_id int, train_end int, test_lo int, test_hi int")
    assert [r.pred for r in walk_forward_boosted(df, windows, ["a"], "y", Boosting(rounds=2)).collect()] == [2.0, 2.0]


def test_plans_of_later_rounds_are_not_longer(spark, monkeypatch):
    """The plan of the panel and of earlier rounds' predictions is in no job of a fit; the driver would keep them all."""
    monkeypatch.setattr(boosting, "FRESH", 2)
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(i, day, f"A{i}", float(i % 5), float(i % 3)) for i in range(40)], "pos int, dt date, asset string, a double, y double")
    seen, frame = [], type(df)
    collect = frame.collect

    def spy(self):
        plan = self._jdf.queryExecution().logical().toString()
        if "MapInArrow" in plan:
            seen.append(plan)
        return collect(self)

    monkeypatch.setattr(frame, "collect", spy)
    windows = spark.createDataFrame([(0, 30, 30, 40)], "window_id int, train_end int, test_lo int, test_hi int")
    walk_forward_boosted(df, windows, ["a"], "y", Boosting(rounds=9, depth=2))
    assert len(seen) == 18 and all(p.count("MapInArrow") <= 2 and "LogicalRDD" not in p for p in seen)
