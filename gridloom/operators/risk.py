"""Factor risk for any number of factors: projections, rolling betas, covariances by blocks.

Moments are sums in columns; small symmetric systems are solved in Arrow batches
by a pseudo-inverse that leaves out directions without variance, so collinear
factors are fine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset

#: Assets and days of a block of returns.
BLOCK_ASSETS, BLOCK_DAYS = 256, 4096


def symmetric_pinv(gram: np.ndarray, least: float) -> np.ndarray:
    """Pseudo-inverses of a batch of symmetric matrices; eigenvalues up to ``least`` of a matrix's largest count as zero."""
    values, vectors = np.linalg.eigh(gram)
    size = np.abs(values)
    fine = size > least * size.max(axis=-1, keepdims=True)
    inverse = np.where(fine, 1 / np.where(fine, values, 1.0), 0.0)
    return (vectors * inverse[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def _solver(k: int, least: float, scaled: bool):
    """A column function: upper triangle of X'X and X'y, as arrays, to the coefficients."""
    at = np.triu_indices(k)

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        if gram.empty:
            return pd.Series([], dtype=object)
        a = np.zeros((len(gram), k, k))
        a[:, at[0], at[1]] = np.stack(gram.to_numpy())
        a[:, at[1], at[0]] = a[:, at[0], at[1]]
        b = np.stack(right.to_numpy())
        if scaled:  # columns of unit length, where only the fit and not the coefficients must be those of the pseudo-inverse
            unit = np.sqrt(np.einsum("nii->ni", a))
            unit = np.where(unit > 0, unit, 1.0)
            a, b = a / unit[:, :, None] / unit[:, None, :], b / unit
        out = np.einsum("nij,nj->ni", symmetric_pinv(a, least), b)
        return pd.Series(list(out / unit if scaled else out))

    return solve


def _products(xs: list[Column], y: Column) -> tuple[list[Column], list[Column]]:
    return [xs[i] * xs[j] for i in range(len(xs)) for j in range(i, len(xs))], [x * y for x in xs]


def neutralise(df: DataFrame, value: str, loadings: list[str], ones: bool = True, fill: bool = True, keys: tuple[str, ...] = ("dt",)) -> DataFrame:
    """``value`` less its projection on the loadings (and ones) per date: w - L pinv(L'L) L'w.

    With ``fill`` missing values and loadings count 0. Without it rows that lack
    either become null and don't take part; a date that has no complete row is
    demeaned. Moments are one aggregation per date; coefficients come back by a
    join on the date. Rows with a null key become null.
    """
    v = F.col(value)
    whole = v.isNotNull()
    for x in loadings:
        whole = whole & F.col(x).isNotNull()
    clean = (lambda c: F.coalesce(c, F.lit(0.0))) if fill else (lambda c: F.when(F.col("_whole"), c))
    names = [f"_x{i}" for i in range(len(loadings))] + (["_one"] if ones else [])
    d = df.withColumn("_whole", F.lit(True) if fill else whole)
    d = d.withColumns({f"_x{i}": clean(F.col(x).cast("double")) for i, x in enumerate(loadings)} | {"_v": clean(v.cast("double")), "_one": clean(F.lit(1.0))})
    squares, sides = _products([F.col(n) for n in names], F.col("_v"))
    sums = [F.sum(p).alias(f"_s{i}") for i, p in enumerate([*squares, *sides])]
    g = d.groupBy(*keys).agg(*sums, F.avg(v).alias("_mean"), F.count_if(F.col("_whole")).alias("_n"))
    cells = [F.coalesce(f"_s{i}", F.lit(0.0)) for i in range(len(sums))]
    solve = _solver(len(names), 1e-10, True)
    coef = solve(F.array(*cells[: len(squares)]), F.array(*cells[len(squares) :]))
    g = g.select(*(F.col(k).alias(f"_k_{k}") for k in keys), coef.alias("_coef"), "_mean", "_n")
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    d = d.join(g, on, "left")
    fit = F.lit(0.0)
    for i, n in enumerate(names):
        fit = fit + F.col(n) * F.col("_coef")[i]
    out = F.when(F.col("_n") > 0, F.col("_v") - fit).otherwise(v - F.col("_mean"))
    return d.select(*(out.alias(c) if c == value else F.col(c) for c in df.columns))


def rolling_factor_betas(df: DataFrame, y: str, factors: list[str], bars: int, least: int, intercept: bool = True) -> DataFrame:
    """Rows with ``betas`` (one per factor) of a least-squares fit on each asset's trailing ``bars`` rows, those with y and all factors.

    pinv(X'X) X'y, so degenerate windows get the shortest solution. Windows with
    fewer than ``least`` complete rows leave. ``df`` has dt, asset and every bar
    of an asset; moments are running sums and their differences, so a bar costs
    the same whatever the window. Past only.
    """
    whole = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    for f in factors:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    xs = [F.when(whole, F.col(f).cast("double")) for f in factors]
    xs = [F.when(whole, F.lit(1.0)), *xs] if intercept else xs
    squares, sides = _products(xs, F.col(y).cast("double"))
    order = by_asset()
    run = order.rowsBetween(W.unboundedPreceding, 0)
    n = len(squares) + len(sides)
    d = df.withColumns({f"_r{i}": F.coalesce(F.sum(p).over(run), F.lit(0.0)) for i, p in enumerate([*squares, *sides])} | {"_n": F.count_if(whole).over(run)})
    past = lambda c: F.col(c) - F.coalesce(F.lag(c, bars).over(order), F.lit(0))
    d = d.withColumns({f"_m{i}": past(f"_r{i}") for i in range(n)} | {"_w": past("_n")}).filter(F.col("_w") >= least)
    solve = _solver(len(xs), 1e-12, False)
    cells = [F.col(f"_m{i}") for i in range(n)]
    coef = solve(F.array(*cells[: len(squares)]), F.array(*cells[len(squares) :]))
    d = d.select(*df.columns, coef.alias("betas"))
    return d.withColumn("betas", F.slice("betas", 2, len(factors))) if intercept else d


def _pack(table: pa.Table) -> pa.Table:
    """A block's returns as one row: assets, days and a matrix with nan where there is none."""
    names, row = np.unique(table["asset"].to_numpy(zero_copy_only=False), return_inverse=True)
    days, col = np.unique(table["day"].to_numpy(), return_inverse=True)
    x = np.full((len(names), len(days)), np.nan)
    x[row, col] = table["ret"].to_numpy()
    w = np.zeros(len(names))
    w[row] = table["w"].to_numpy()
    out = {"block": table["block"][0], "span": table["span"][0]}
    return pa.table({k: pa.array([v.as_py()], pa.int64()) for k, v in out.items()} | {
        "names": pa.array([names.tolist()], pa.list_(pa.string())), "days": pa.array([days], pa.list_(pa.int64())), "w": pa.array([w], pa.list_(pa.float64())), "x": pa.array([x.tobytes()], pa.binary()),
    })


_SUMS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string())), ("wa", pa.list_(pa.float64())), ("wb", pa.list_(pa.float64())), ("m", pa.binary())])


def _multiply(table: pa.Table) -> pa.Table:
    """Counts and sums of two blocks' pairs over the days both have: four masked matrix products."""
    if table.num_rows == 1 and table["i"][0].as_py() != table["j"][0].as_py():  # nothing in the other block
        return _SUMS.empty_table()
    sides = []
    for k in np.argsort(table["side"].to_numpy(), kind="stable"):
        names, days = table["names"][int(k)].as_py(), table["days"][int(k)].values.to_numpy()
        sides.append((names, table["w"][int(k)].as_py(), days, np.frombuffer(table["x"][int(k)].as_py()).reshape(len(names), len(days))))
    (a, wa, da, x), (b, wb, db, y) = sides[0], sides[-1]
    _, ia, ib = np.intersect1d(da, db, return_indices=True)
    x, y = x[:, ia], y[:, ib]
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    m = np.stack((mx @ my.T, x @ my.T, mx @ y.T, x @ y.T))
    row = {"i": table["i"][0].as_py(), "j": table["j"][0].as_py(), "a": a, "b": b, "wa": wa, "wb": wb, "m": m.tobytes()}
    return pa.Table.from_pylist([row], schema=_SUMS)


def _covariances(table: pa.Table, shrink: float) -> tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Assets of both sides, their covariances over all spans (nan below two days), where pairs exist and count once, products of weights."""
    wa, wb = ({n: w for names, ws in zip(table[s].to_pylist(), table[f"w{s}"].to_pylist(), strict=True) for n, w in zip(names, ws, strict=True)} for s in "ab")
    a, b = sorted(wa), sorted(wb)
    pa_, pb = {n: k for k, n in enumerate(a)}, {n: k for k, n in enumerate(b)}
    total = np.zeros((4, len(a), len(b)))
    for names, other, m in zip(table["a"].to_pylist(), table["b"].to_pylist(), table["m"].to_pylist(), strict=True):
        total[np.ix_(range(4), [pa_[n] for n in names], [pb[n] for n in other])] += np.frombuffer(m).reshape(4, len(names), len(other))
    n, sx, sy, sxy = total
    cov = np.where(n > 1, (sxy - sx * sy / np.maximum(n, 1)) / np.maximum(n - 1, 1), np.nan)
    once = n > 0
    same = np.zeros(n.shape, dtype=bool)
    if table["i"][0].as_py() == table["j"][0].as_py():
        once &= np.triu(np.ones(n.shape, dtype=bool))
        same = np.eye(len(a), dtype=bool)
    cov = np.where(same, cov, cov * (1 - shrink))
    weight = np.outer([wa[x] for x in a], [wb[x] for x in b]) * np.where(same, 1.0, 2.0)
    return a, b, cov, once, weight


def _pair_sums(returns: DataFrame, block: int, days: int):
    """Sums of all pairs of blocks of assets, grouped by the pair. ``returns``: dt, asset, ret, w."""
    d = returns.filter("ret is not null and asset is not null and dt is not null")
    count = d.select("asset").distinct().count()
    blocks = max(1, -(-count // block))
    d = d.select(
        F.pmod(F.xxhash64("asset"), F.lit(blocks)).alias("block"), F.floor(F.unix_date("dt") / days).alias("span"),
        F.col("asset").cast("string").alias("asset"), F.unix_date("dt").cast("long").alias("day"), F.col("ret").cast("double").alias("ret"), F.col("w").cast("double").alias("w"),
    )
    packed = d.groupBy("block", "span").applyInArrow(_pack, "block long, span long, names array<string>, days array<long>, w array<double>, x binary")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = pairs.select(
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "span", (F.col("block") > F.col("other")).cast("int").alias("side"), "names", "days", "w", "x"
    )
    sums = pairs.groupBy("i", "j", "span").applyInArrow(_multiply, "i long, j long, a array<string>, b array<string>, wa array<double>, wb array<double>, m binary")
    return sums.groupBy("i", "j")


def sample_covariance(returns: DataFrame, shrink: float = 0.0, block: int = BLOCK_ASSETS, days: int = BLOCK_DAYS) -> DataFrame:
    """(a, b, cov) for a <= b with a common day: pairwise-complete sample covariances, off-diagonals times 1 - shrink; null over one day.

    Blocks of assets by days meet as matrices, so what is shuffled grows with
    pairs of blocks; only the result has a row per pair of assets. ``returns``:
    dt, asset, ret, a row per day and asset; days are dates.
    """

    def run(table: pa.Table) -> pa.Table:
        a, b, cov, once, _ = _covariances(table, shrink)
        i, j = np.nonzero(once)
        left, right = np.array(a, dtype=object)[i], np.array(b, dtype=object)[j]
        turned = left > right
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "cov": pa.array(cov[i, j], pa.float64(), mask=np.isnan(cov[i, j]))})

    return _pair_sums(returns.select("dt", "asset", "ret", F.lit(0.0).alias("w")), block, days).applyInArrow(run, "a string, b string, cov double")


def book_volatility(weights: DataFrame, returns: DataFrame, periods: int, shrink: float = 0.0, block: int = BLOCK_ASSETS, days: int = BLOCK_DAYS) -> DataFrame:
    """sqrt(w' S w * periods) of one book (asset, w), S as in :func:`sample_covariance`: a number per pair of blocks is added up, no pair of assets is a row."""

    def run(table: pa.Table) -> pa.Table:
        _, _, cov, once, weight = _covariances(table, shrink)
        return pa.table({"v": pa.array([float(np.nansum(np.where(once, cov * weight, 0.0)))])})

    held = weights.filter("w <> 0").select(F.col("asset").alias("_asset"), F.col("w").alias("_w"))
    mine = returns.join(held, F.col("asset") == F.col("_asset")).select("dt", "asset", "ret", F.col("_w").alias("w"))
    total = _pair_sums(mine, block, days).applyInArrow(run, "v double").agg(F.sum("v").alias("v"))
    return total.select(F.sqrt(F.greatest(F.col("v"), F.lit(0.0)) * periods).alias("vol"))
