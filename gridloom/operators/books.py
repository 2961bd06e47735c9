"""Long-short weights, neutralisers, limits and order lists. Ties go to the smaller asset name on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, last_known, ratio, trailing


def _sides(scores: DataFrame, keys: tuple[str, ...], score: str) -> DataFrame:
    """Non-null scores with n, and ranks from the top and from the bottom, by name among equals."""
    s = scores.filter(F.col(score).isNotNull())
    w = W.partitionBy(*keys)
    return s.withColumns({
        "n": F.count("*").over(w),
        "from_top": F.row_number().over(w.orderBy(F.col(score).desc(), "asset")),
        "from_bottom": F.row_number().over(w.orderBy(F.col(score).asc(), "asset")),
    })


def decile_weights(scores: DataFrame, q: float, every: int, score: str = "score", least: int = 10) -> DataFrame:
    """Equal-weight long-short on every ``every``-th bar: 0.5 / k a side, k = max(1, int(n q)); overlap nets; fewer than ``least`` names give zeros."""
    on = scores.filter((F.col("bar_no") - 1) % every == 0)
    r = _sides(on, ("dt",), score)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * q))
    long = F.when(F.col("from_top") <= k, 0.5 / k).otherwise(0.0)
    short = F.when(F.col("from_bottom") <= k, -0.5 / k).otherwise(0.0)
    w = r.select("dt", "asset", F.when(F.col("n") >= least, long + short).otherwise(0.0).alias("w"))
    return on.select("dt", "bar_no", "asset").join(w, ["dt", "asset"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def quantile_book(
    scores: DataFrame, q: float, every: int, score: str = "score", long_low: bool = False, long_wins: bool = False
) -> DataFrame:
    """k = int(n q) names a side at 0.5 / k, dates with k < 2 skipped, explicit zeros for all other names.

    ``long_low`` buys the low scores. Where a name is on both sides the short
    stands, or the long if ``long_wins``.
    """
    on = scores.filter((F.col("bar_no") - 1) % every == 0)
    r = _sides(on, ("dt",), score).withColumn("k", F.floor(F.col("n") * q)).filter("k >= 2")
    high, low = F.col("from_top") <= F.col("k"), F.col("from_bottom") <= F.col("k")
    long, short = (low, high) if long_low else (high, low)
    one, other = ((long, 0.5), (short, -0.5)) if long_wins else ((short, -0.5), (long, 0.5))
    w = r.select("dt", "asset", F.when(one[0], one[1] / F.col("k")).when(other[0], other[1] / F.col("k")).otherwise(0.0).alias("w"))
    days = w.select("dt").distinct()
    return on.join(days, "dt", "left_semi").select("dt", "bar_no", "asset").join(w, ["dt", "asset"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def threshold_book(scores: DataFrame, q: float) -> DataFrame:
    """(dt, asset, w): 0.5 shared by scores at or above the date's interpolated 1 - q quantile, -0.5 by those at or below its q quantile.

    A name on both thresholds is short. Dates under max(5, ceil(1/q)) names leave.
    """
    cuts = scores.groupBy("dt").agg(F.percentile("score", F.lit([q, 1 - q])).alias("p"), F.count("*").alias("n"))
    cuts = cuts.filter(F.col("n") >= max(5, int(-(-1 // q)))).select("dt", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    long, short = F.col("score") >= F.col("hi"), F.col("score") <= F.col("lo")
    share = lambda side: F.lit(0.5) / F.count_if(side).over(by_date())
    w = F.when(short, -share(short)).when(long, share(long)).otherwise(0.0)
    return scores.join(F.broadcast(cuts), "dt").select("dt", "asset", w.alias("w"))


def value_weighted_book(scores: DataFrame, q: float, score: str = "score", cap: str = "cap") -> DataFrame:
    """Cap-weighted sides of 0.5 each; non-positive caps drop out and the rest is renormalised."""
    r = _sides(scores, ("dt",), score).withColumn("k", F.floor(F.col("n") * q)).filter("k >= 2")
    side = F.when(F.col("from_bottom") <= F.col("k"), -1).when(F.col("from_top") <= F.col("k"), 1)
    r = r.withColumn("side", side).filter(F.col("side").isNotNull() & (F.col(cap) > 0))
    return r.select("dt", "asset", (0.5 * F.col("side") * F.col(cap) / F.sum(cap).over(W.partitionBy("dt", "side"))).alias("w"))


def long_versus_all(scores: DataFrame, q: float, least_count: int = 2, score: str = "score", count: str = "buyers") -> DataFrame:
    """Long the top max(1, int(n q)) of the names with ``least_count`` buyers at 0.5, short all priced names at 0.5."""
    eligible = _sides(scores.filter(F.col(count) >= least_count), ("dt",), score)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * q))
    long = eligible.filter(F.col("from_top") <= k).select("dt", "asset", (0.5 / k).alias("lw"))
    priced = scores.filter(F.col("price").isNotNull())
    short = priced.select("dt", "asset", (-0.5 / F.count("*").over(by_date())).alias("sw"))
    days = long.select("dt").distinct()
    both = short.join(days, "dt", "left_semi").join(long, ["dt", "asset"], "full")
    return both.select("dt", "asset", (F.coalesce("lw", F.lit(0.0)) + F.coalesce("sw", F.lit(0.0))).alias("w"))


def held(weights: DataFrame, dense: DataFrame, limit: int | None = None, lag: int = 0) -> DataFrame:
    """Weights carried forward on the dense grid, at most ``limit`` bars if given, then lagged; null before the first."""
    g = dense.join(weights.select("dt", "asset", "w"), ["dt", "asset"], "left")
    frame = by_asset().rowsBetween(W.unboundedPreceding if limit is None else -limit, 0)
    g = g.withColumn("w", last_known(F.col("w"), frame))
    return g.withColumn("w", F.lag("w", lag).over(by_asset())) if lag else g


def demean(scores: DataFrame, value: str, *keys: str) -> DataFrame:
    return scores.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(*keys)))


def residualise(df: DataFrame, value: str, loading: str, keys: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Value less its least-squares fit on (loading, ones) per date, over rows with both.

    Equal loadings, where the projection is singular, leave the demeaned value,
    as the pseudo-inverse does; a date without loadings is demeaned.
    """
    w = W.partitionBy(*keys)
    x = F.when(F.col(value).isNotNull(), F.col(loading))
    v = F.col(value)
    both = x.isNotNull() & v.isNotNull()
    vx = F.when(both, v)
    mx, mv = F.avg(x).over(w), F.avg(vx).over(w)
    sxx = F.var_pop(x).over(w)
    sxy = F.covar_pop(vx, x).over(w)
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    any_loading = F.count(x).over(w) > 0
    out = F.when(any_loading, F.when(both, v - mv - slope * (x - mx))).otherwise(v - F.avg(v).over(w))
    return df.withColumn(value, out)


def beta_neutral(weights: DataFrame, beta: str = "beta") -> DataFrame:
    """Active weights made orthogonal to ones and beta per date, gross restored.

    Missing betas take the mean of the active ones; fewer than three active
    names stay; equal betas only demean.
    """
    active = F.col("w") != 0
    d = weights.withColumn("_b", F.when(active, F.col(beta)))
    d = d.withColumn("_b", F.when(active, F.coalesce("_b", F.avg("_b").over(by_date()), F.lit(1.0))))
    wa = F.when(active, F.col("w"))
    n = F.count(wa).over(by_date())
    bc = F.col("_b") - F.avg("_b").over(by_date())
    d = d.withColumns({"_n": n, "_g": F.sum(F.abs(wa)).over(by_date()), "_bc": bc, "_d": wa - F.avg(wa).over(by_date())})
    sbb = F.sum(F.col("_bc") * F.col("_bc")).over(by_date())
    sbd = F.sum(F.col("_bc") * F.col("_d")).over(by_date())
    d = d.withColumn("_r", F.col("_d") - F.when(F.sqrt(sbb) > 1e-10, sbd / sbb).otherwise(0.0) * F.col("_bc"))
    gross = F.sum(F.abs("_r")).over(by_date())
    out = F.when((F.col("_n") >= 3) & active, F.when(gross > 1e-12, F.col("_r") * F.col("_g") / gross).otherwise(0.0)).otherwise(F.col("w"))
    return d.withColumn("w", out).drop("_b", "_n", "_g", "_bc", "_d", "_r")


def dollar_neutral(df: DataFrame, value: str) -> DataFrame:
    """(x - mean) / sum of its absolute values, per date."""
    d = df.withColumn("_c", F.col(value) - F.avg(value).over(by_date()))
    return d.withColumn("w", ratio(F.col("_c"), F.sum(F.abs("_c")).over(by_date()))).drop("_c")


def cap_position(w: Column, most: float) -> Column:
    return F.least(F.greatest(w, F.lit(-most)), F.lit(most))


def cap_gross(weights: DataFrame, most: float) -> DataFrame:
    g = F.sum(F.abs("w")).over(by_date())
    return weights.withColumn("w", F.when(g > most, F.col("w") * most / g).otherwise(F.col("w")))


def latest_book(weights: DataFrame, back: int = 0) -> DataFrame:
    """Weights of the latest rebalance (bar_no), or of the one ``back`` rebalances before it."""
    bar = weights.select("bar_no").distinct().orderBy(F.desc("bar_no")).offset(back).limit(1)  # one row
    return weights.join(F.broadcast(bar), "bar_no", "left_semi")


def cap_turnover(now: DataFrame, target: DataFrame, most: float) -> DataFrame:
    """Move from current to target weights by at most ``most`` in total."""
    j = now.select("asset", F.col("w").alias("w0")).join(target.select("asset", F.col("w").alias("w1")), "asset", "full")
    j = j.select("asset", F.coalesce("w0", F.lit(0.0)).alias("w0"), F.coalesce("w1", F.lit(0.0)).alias("w1"))
    total = j.agg(F.sum(F.abs(F.col("w1") - F.col("w0"))).alias("t"))
    scale = F.when(F.col("t") > most, most / F.col("t")).otherwise(1.0)
    return j.crossJoin(total).select("asset", (F.col("w0") + (F.col("w1") - F.col("w0")) * scale).alias("w"))


def size_terciles(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """Equal-count thirds of the first-come rank: 0 if 3(r-1) < n-1, 1 if 3(r-1) < 2(n-1), else 2."""
    s = df.filter(F.col(size).isNotNull())
    w = W.partitionBy(*keys)
    r, n = F.row_number().over(w.orderBy(size, "asset")) - 1, F.count("*").over(w)
    return s.withColumn("tercile", F.when(3 * r < n - 1, 0).when(3 * r < 2 * (n - 1), 1).otherwise(2))


def top_by_adv(dense: DataFrame, n: int, bars: int, least: int, low: int = 1, dollars: str = "dollar_volume") -> DataFrame:
    """Assets ranked ``low``..``n`` per date by trailing mean dollar volume with ``least`` observations."""
    v = F.when(F.count(dollars).over(trailing(bars)) >= least, F.avg(dollars).over(trailing(bars)))
    d = dense.withColumn("adv", v).filter("adv is not null")
    r = F.row_number().over(by_date().orderBy(F.col("adv").desc(), "asset"))
    return d.withColumn("adv_rank", r).filter(F.col("adv_rank").between(low, n))


def target_shares(weights: DataFrame, equity: float) -> DataFrame:
    """Integer shares, halves to even."""
    return weights.withColumn("shares", F.bround(F.col("w") * equity / F.nullif("price", F.lit(0.0))).cast("long"))


def orders_delta(now: DataFrame, target: DataFrame) -> DataFrame:
    j = now.select("asset", F.col("shares").alias("s0")).join(target.select("asset", F.col("shares").alias("s1")), "asset", "full")
    d = F.coalesce("s1", F.lit(0)) - F.coalesce("s0", F.lit(0))
    return j.select("asset", d.alias("delta")).filter("delta <> 0")


def slices(orders: DataFrame, n: int, quantity: str = "qty") -> DataFrame:
    """Parent quantities cut into ``n`` slices; the remainder goes one by one to the earliest; sums are kept."""
    q = F.abs(F.col(quantity))
    part = F.floor(q / n) + F.when(F.col("slice") < q % n, 1).otherwise(0)
    d = orders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return d.withColumn("slice_qty", (F.signum(quantity) * part).cast("long"))


def authorise(intents: DataFrame, state: DataFrame, vol_cap: float, corr_cap: float) -> DataFrame:
    """Each intent becomes an order or one rejection: killed, unregistered, vol or correlation regime, in this order.

    ``intents``: agent, …; ``state``: agent, killed, registered, vol, corr.
    """
    j = intents.join(state, "agent", "left")
    reason = (
        F.when(F.coalesce("killed", F.lit(False)), "killed")
        .when(~F.coalesce("registered", F.lit(False)), "unregistered")
        .when(F.col("vol") > vol_cap, "regime_vol")
        .when(F.col("corr") > corr_cap, "regime_corr")
    )
    return j.withColumn("reason", reason).withColumn("authorised", F.col("reason").isNull())


def sticky_kill(drawdowns: DataFrame, limit: float = -0.03) -> DataFrame:
    """Tripped from the first date with drawdown <= limit on, per strategy."""
    w = W.partitionBy("strategy_id").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return drawdowns.withColumn("tripped", F.max(F.col("drawdown") <= limit).over(w))
