"""Statistics of signals and strategies: one group per strategy, moments in one aggregation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import average_rank, ratio


def rank_ic(scores: DataFrame, score: str, target: str, least: int = 5, keys: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Spearman correlation per key with averaged ties over complete pairs; smaller dates are dropped."""
    s = scores.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    s = s.withColumns({"_a": average_rank(F.col(score), *keys), "_b": average_rank(F.col(target), *keys)})
    return s.groupBy(*keys).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= least)


def sharpe(ret: str | Column, periods: int) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    return ratio(F.avg(r), F.stddev_samp(r)) * float(np.sqrt(periods))


def summary(returns: DataFrame, periods: int, ret: str = "ret") -> DataFrame:
    """Per strategy: n, annual return, volatility, Sharpe, hit rate, worst and best."""
    r = F.col(ret)
    return returns.groupBy("strategy_id").agg(
        F.count(r).alias("n"), (F.avg(r) * periods).alias("ann_return"), (F.stddev_samp(r) * float(np.sqrt(periods))).alias("ann_vol"),
        sharpe(r, periods).alias("sharpe"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.min(r).alias("worst"), F.max(r).alias("best"),
    )


def newey_west(returns: DataFrame, lags: int, ret: str = "ret") -> DataFrame:
    """(strategy_id, n, mean, t_stat): HAC t of the mean, Bartlett weights, population autocovariances.

    Nulls leave before rows are lagged; fewer than lags + 2 observations give no t.
    """
    w = W.partitionBy("strategy_id").orderBy("dt")
    d = returns.filter(F.col(ret).isNotNull())
    d = d.withColumn("_e", F.col(ret) - F.avg(ret).over(W.partitionBy("strategy_id")))
    d = d.withColumns({f"_p{k}": F.col("_e") * F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    agg = d.groupBy("strategy_id").agg(
        F.count("*").alias("n"), F.avg(ret).alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("g0"),
        *(F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)),
    )
    s = F.col("g0")
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    t = F.when((F.col("n") >= lags + 2) & (s > 0), F.col("mean") / F.sqrt(s / F.col("n") / F.col("n")))
    return agg.select("strategy_id", "n", "mean", t.alias("t_stat"))


def moments(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """n, per-period Sharpe, population skewness and kurtosis (normal: 3) per strategy."""
    return returns.groupBy("strategy_id").agg(
        F.count(ret).alias("n"), ratio(F.avg(ret), F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt")
    )


def psr_z(benchmark: Column | float = 0.0) -> Column:
    """z of the probabilistic Sharpe ratio over :func:`moments` columns; null under 30 observations."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(benchmark)
    spread = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    return F.when((F.col("n") >= 30) & (spread > 0), (F.col("sr") - b) * F.sqrt(F.col("n") - 1) / F.sqrt(spread))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


# Coefficients of Hart's rational approximation of the normal tail (relative error 1e-14)
_TAIL_ABOVE = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BELOW = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# Coefficients of Acklam's rational approximation of the normal quantile (relative error 1e-9 before refinement)
_MID_ABOVE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_MID_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_END_ABOVE = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_END_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def normal_cdf(z: str | Column) -> Column:
    """P(Z <= z) of the standard normal, to 1e-14; null or not a number gives null."""
    z = (F.col(z) if isinstance(z, str) else z).cast("double")
    x = F.least(F.abs(z), F.lit(38.0))
    e = F.exp(-x * x / 2)
    far = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x + k / far
    tail = F.when(x < 7.07, e * _horner(x, _TAIL_ABOVE) / _horner(x, _TAIL_BELOW)).otherwise(e / far / float(np.sqrt(2 * np.pi)))
    return F.when(z.isNull() | F.isnan(z), F.lit(None)).when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: str | Column) -> Column:
    """The z with P(Z <= z) = p; null outside (0, 1). One Newton step refines a rational start on the lower half."""
    p = F.col(p) if isinstance(p, str) else p
    low = F.least(p, 1 - p)
    q = low - 0.5
    r = F.sqrt(-2 * F.ln(low))
    z = F.when(low < 0.02425, _horner(r, _END_ABOVE) / _horner(r, _END_BELOW)).otherwise(_horner(q * q, _MID_ABOVE) * q / _horner(q * q, _MID_BELOW))
    z = F.when((p > 0) & (p < 1), z)
    z = F.transform(F.array(z), lambda v: v - (normal_cdf(v) - low) * float(np.sqrt(2 * np.pi)) * F.exp(v * v / 2))[0]
    return F.when(p > 0.5, -z).otherwise(z)


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected greatest Sharpe of ``trials`` skill-less strategies with this variance of Sharpe ratios."""
    if trials < 2:
        return 0.0
    q, gamma = NormalDist().inv_cdf, 0.5772156649015329
    return float(np.sqrt(variance) * ((1 - gamma) * q(1 - 1 / trials) + gamma * q(1 - 1 / (trials * np.e))))


def deflated_sharpe(returns: DataFrame, trials: int, variance: float) -> DataFrame:
    """Per strategy: moments, psr and dsr, each null under 30 observations."""
    m = moments(returns)
    hurdle = expected_max_sharpe(variance, trials)
    m = m.withColumns({"psr_z": psr_z(), "dsr_z": psr_z(hurdle)})
    return m.withColumns({"psr": normal_cdf("psr_z"), "dsr": normal_cdf("dsr_z")})


def graduation_hurdle(grid: DataFrame, target: float = 0.95, rounds: int = 60) -> DataFrame:
    """Annual Sharpe at which DSR meets ``target`` for each (n, trials, skew, kurt, variance, periods), by fixed point."""
    z, gamma = NormalDist().inv_cdf(target), 0.5772156649015329
    one = F.col("trials").cast("double")
    best = (1 - gamma) * normal_quantile(1 - 1 / one) + gamma * normal_quantile(1 - 1 / (one * float(np.e)))
    g = grid.withColumn("_base", F.when(one >= 2, F.sqrt("variance") * best).when(one.isNotNull(), 0.0))

    def step(sr: Column, _: Column) -> Column:
        spread = F.greatest(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr, F.lit(1e-12))
        return F.col("_base") + z * F.sqrt(spread / F.nullif(F.col("n") - 1, F.lit(0)))

    sr = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("_base"), step)
    return g.withColumn("hurdle", sr * F.sqrt("periods")).drop("_base")


#: Strategies of a block and splits of a product.
PBO_BLOCK, PBO_TILE = 256, 2048


def _split_sharpes(table: pa.Table, blocks: int, splits: np.ndarray):
    """(rows of ``splits``, in-sample and out-of-sample Sharpe ratios as splits x strategies) in tiles, and the strategies; nan without rows on a side, 0 without variance."""
    ids, at = np.unique(table["strategy_id"].to_numpy(zero_copy_only=False), return_inverse=True)
    sums = np.zeros((3, blocks, len(ids)))
    for k, name in enumerate(("n", "s", "q")):
        sums[k, table["block"].to_numpy(), at] = table[name].to_numpy()
    all_ = sums.sum(axis=1)

    def tiles():
        for lo in range(0, len(splits), PBO_TILE):
            mask = (splits[lo : lo + PBO_TILE, None] >> np.arange(blocks) & 1).astype(float)
            inside = np.stack([mask @ sums[k] for k in range(3)])
            sharpe = []
            for n, s, q in (inside, all_[:, None, :] - inside):
                with np.errstate(divide="ignore", invalid="ignore"):
                    var = (q - s * s / n) / (n - 1)
                    sr = np.where((n > 1) & (var > 1e-18), s / n / np.sqrt(var), 0.0)
                sharpe.append(np.where(n > 0, np.round(sr, 12), np.nan))
            yield lo, *sharpe

    return ids, tiles()


def pbo(returns: DataFrame, blocks: int = 16) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation, from block sums.

    ``returns``: dt, strategy_id, ret on a common calendar. Returns one row:
    splits, pbo (share of splits whose in-sample best ranks at or below the
    out-of-sample median), slope of its out-of-sample on in-sample Sharpe, and
    the share with a loss out of sample.

    Strategies go in blocks of 256. A block's sums times the matrix of all
    splits give its Sharpe ratios on both sides. The first pass yields each
    split's best of the block, the second how many of the block are no better
    out of sample than the best of all; a row per split and block each, however
    many strategies. A strategy without rows on a side ranks last there.
    """
    d = returns.filter("ret is not null and strategy_id is not null")
    dates = d.select("dt").distinct()
    n = F.count("*").over(W.partitionBy())
    dates = dates.withColumn("block", F.floor((F.row_number().over(W.orderBy("dt")) - 1) * blocks / n).cast("int"))
    s = d.join(dates, "dt").groupBy("strategy_id", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    s = s.persist()  # read by two passes, released below
    try:
        return _overfitting(s, blocks, returns.schema["strategy_id"].dataType.simpleString())
    finally:
        s.unpersist()


def _overfitting(s: DataFrame, blocks: int, kind: str) -> DataFrame:
    """:func:`pbo` from the sums (strategy_id, block, n, s, q), computed at once."""
    count = s.select("strategy_id").distinct().count()
    s = s.withColumn("part", F.pmod(F.xxhash64("strategy_id"), F.lit(max(1, -(-count // PBO_BLOCK)))))
    splits = np.array([i for i in range(1 << blocks) if i.bit_count() == blocks // 2], dtype=np.int64)

    def best(table: pa.Table) -> pa.Table:
        ids, tiles = _split_sharpes(table, blocks, splits)
        out = []
        for lo, ins, oos in tiles:
            k = np.where(np.isnan(ins), -np.inf, ins).argmax(axis=1)  # the first, and so least, strategy of the greatest
            row = np.arange(len(ins))
            out.append(pa.table({
                "split": pa.array(splits[lo : lo + len(ins)]), "ins": pa.array(ins[row, k], mask=np.isnan(ins[row, k])),
                "strategy_id": pa.array(ids).take(pa.array(k)), "oos": pa.array(oos[row, k], mask=np.isnan(oos[row, k])),
            }))
        return pa.concat_tables(out)

    first = s.groupBy("part").applyInArrow(best, f"split long, ins double, strategy_id {kind}, oos double")
    order = F.struct((-F.coalesce("ins", F.lit(float("-inf")))).alias("a"), "strategy_id", "ins", "oos")
    top = first.groupBy("split").agg(F.min(order).alias("r")).select("split", "r.ins", "r.oos").orderBy("split").collect()  # a row per split: a number fixed by ``blocks``
    # sums made anew may differ in their last bits: a strategy is not to lose to itself
    limit = np.array([-np.inf if r.oos is None else r.oos + 1e-9 for r in top])

    def beaten(table: pa.Table) -> pa.Table:
        _, tiles = _split_sharpes(table, blocks, splits)
        rank = [(np.where(np.isnan(oos), -np.inf, oos) <= limit[lo : lo + len(oos), None]).sum(axis=1) for lo, _, oos in tiles]
        return pa.table({"split": pa.array(splits), "rank": pa.array(np.concatenate(rank).astype(np.int64))})

    spark = s.sparkSession
    rows = spark.createDataFrame([(r.split, r.ins, r.oos) for r in top], "split long, ins double, oos double")
    ranks = s.groupBy("part").applyInArrow(beaten, "split long, rank long").groupBy("split").agg(F.sum("rank").alias("rank"))
    top = rows.join(ranks, "split").withColumn("omega", F.col("rank") / F.lit(count + 1))
    done = top.agg(
        F.count("*").alias("splits"), F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"),
        F.regr_slope("oos", "ins").alias("slope"), F.avg((F.col("oos") < 0).cast("double")).alias("loss_prob"),
    )
    return spark.createDataFrame(done.collect(), done.schema)  # one row


def kelly(mean: Column, variance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(ratio(mean, variance), F.lit(0.0)))


def sharpe_stderr(sr: Column, n: Column) -> Column:
    return F.sqrt((1 + sr * sr / 2) / F.nullif(n, F.lit(0)))


def gram_moments(panel: DataFrame, windows: DataFrame, xs: list[str], y: str) -> list[dict]:
    """Training moments per window, of all rows with bar position below its train_end, as one small record each.

    Each row is summed once, into the first window that trains on it; expanding
    windows add up those of the windows before, a record per window.
    """
    k = len(xs)
    ends = windows.select("window_id", "train_end").orderBy("train_end", "window_id").collect()
    if not ends:
        return []
    sums = [F.count("*").alias("n"), F.sum(y).alias("y")]
    sums += [F.sum(x).alias(f"x{i}") for i, x in enumerate(xs)] + [F.sum(F.col(x) * F.col(y)).alias(f"xy{i}") for i, x in enumerate(xs)]
    sums += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx{i}_{j}") for i in range(k) for j in range(i, k)]
    step = F.size(F.filter(F.lit([w.train_end for w in ends]), lambda e: e <= F.col("pos")))
    rows = panel.filter(F.col("pos") < ends[-1].train_end).groupBy(step.alias("step")).agg(*sums).collect()
    found, total = [], {}
    per = {r["step"]: r.asDict() for r in rows}
    for i, w in enumerate(ends):
        for name, value in per.get(i, {}).items():
            total[name] = total.get(name, 0) + value
        if total.get("n"):
            found.append(total | {"window_id": w.window_id})
    return found


def solve_ridge(row: dict, k: int, alpha: float) -> tuple[float, list[float]]:
    """(intercept, coefficients) of ridge with an unpenalised intercept from one window's moments."""
    n = row["n"]
    mx = np.array([row[f"x{i}"] for i in range(k)]) / n
    my = row["y"] / n
    a = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"xx{i}_{j}"] - n * mx[i] * mx[j]
    b = np.array([row[f"xy{i}"] for i in range(k)]) - n * mx * my
    beta = np.linalg.solve(a + alpha * np.eye(k), b)
    return float(my - mx @ beta), [float(v) for v in beta]


def walk_forward_ridge(panel: DataFrame, windows: DataFrame, xs: list[str], y: str, alpha: float = 10.0) -> DataFrame:
    """Predictions on each window's test rows from a ridge fitted on its training rows.

    ``panel``: pos (0-based bar), dt, asset, features, label. Only one row of
    moments per window reaches the driver; coefficients go back as a small table.
    """
    return ridge_paths(panel, windows, xs, y, (alpha,)).drop("alpha")


def ridge_paths(panel: DataFrame, windows: DataFrame, xs: list[str], y: str, alphas: tuple[float, ...]) -> DataFrame:
    """As :func:`walk_forward_ridge` for several penalties (column alpha) from the same moments."""
    windows = panel.sparkSession.createDataFrame(windows.collect(), windows.schema)  # a row per window
    rows = gram_moments(panel.dropna(subset=[*xs, y]), windows, xs, y)
    fits = [(r["window_id"], a, *solve_ridge(r, len(xs), a)) for r in rows for a in alphas]
    coef = panel.sparkSession.createDataFrame(fits, "window_id int, alpha double, intercept double, beta array<double>")
    # windows and penalties: a few rows each, whatever the panel's size
    test = windows.join(coef, "window_id")
    joined = panel.join(F.broadcast(test), (F.col("pos") >= F.col("test_lo")) & (F.col("pos") < F.col("test_hi")))
    fit = F.col("intercept")
    for i, x in enumerate(xs):
        fit = fit + F.col(x) * F.col("beta")[i]
    return joined.select("window_id", "alpha", "dt", "asset", "pos", fit.alias("pred"), F.col(y).alias("label"))


def select_alpha(
    panel: DataFrame, windows: DataFrame, inner: DataFrame, xs: list[str], y: str,
    grid: tuple[float, ...] = (1.0, 10.0, 100.0, 1000.0), fallback: float = 100.0, least: int = 5,
) -> DataFrame:
    """(window_id, alpha): the penalty with the greatest mean rank IC over a window's inner walk-forward; the first best wins.

    ``inner`` are expanding windows of their own; those whose tests end within a
    window's training bars are its inner walk-forward. As they all train from
    bar 0, each is fitted and scored once for all windows. Windows without an
    inner one get ``fallback``.
    """
    inner = panel.sparkSession.createDataFrame(inner.collect(), inner.schema)
    p = ridge_paths(panel, inner, xs, y, grid)
    ic = rank_ic(p, "pred", "label", least, ("window_id", "alpha", "dt")).groupBy("window_id", "alpha").agg(F.sum("ic").alias("s"), F.count("ic").alias("k"))
    ic = ic.join(inner.select("window_id", F.col("test_hi").alias("last")), "window_id").drop("window_id")
    # a row per window and penalty on both sides
    met = windows.select("window_id", "train_end").join(ic, F.col("last") <= F.col("train_end"))
    score = met.groupBy("window_id", "alpha").agg(F.round(F.sum("s") / F.sum("k"), 12).alias("ic")).filter("ic is not null")
    best = score.groupBy("window_id").agg(F.max_by("alpha", F.struct("ic", -F.col("alpha"))).alias("alpha"))
    return windows.select("window_id").join(best, "window_id", "left").withColumn("alpha", F.coalesce("alpha", F.lit(fallback)))
