"""Profit and loss of books on dense panels, with linear and square-root costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, ratio, simple_return
from gridloom.operators.books import held


def run_backtest(weights: DataFrame, dense: DataFrame, bps: float) -> DataFrame:
    """(dt, gross, turnover, cost, net): weights carried forward uncapped, earned from the next bar, costs on the lagged change.

    A date without returns earns 0. Turnover is one-way.
    """
    d = held(weights, dense.withColumn("ret", simple_return()), lag=1).withColumn("w", F.coalesce("w", F.lit(0.0)))
    change = F.abs(F.col("w") - F.lag("w").over(by_asset()))
    d = d.withColumn("_t", F.coalesce(change, F.lit(0.0)))
    out = d.groupBy("dt").agg(F.coalesce(F.sum(F.col("w") * F.col("ret")), F.lit(0.0)).alias("gross"), F.sum("_t").alias("traded"))
    cost = F.col("traded") * bps / 10000
    return out.select("dt", "gross", (F.col("traded") / 2).alias("turnover"), cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def carry_backtest(weights: DataFrame, dense: DataFrame, bps: float, limit: int) -> DataFrame:
    """(dt, gross, price_pnl, funding_pnl, cost, net): returns less funding, weights filled ``limit`` bars, costs at the change itself.

    A date on which nothing earns is dropped.
    """
    d = held(weights, dense.withColumn("ret", simple_return()), limit=limit)
    before = F.lag("w").over(by_asset())
    d = d.withColumns({"prev": before, "_t": F.coalesce(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce(before, F.lit(0.0))), F.lit(0.0))})
    first = F.col("bar_no") == 1
    fund = F.coalesce("funding", F.lit(0.0))
    agg = d.groupBy("dt").agg(
        F.sum(F.col("prev") * (F.col("ret") - fund)).alias("gross"),
        F.sum(F.when(F.col("ret").isNotNull(), F.col("prev") * F.col("ret"))).alias("price_pnl"),
        F.sum(F.when(F.col("ret").isNotNull(), -F.col("prev") * fund)).alias("funding_pnl"),
        F.sum(F.when(~first, F.col("_t")).otherwise(0.0)).alias("traded"),
    )
    cost = F.col("traded") * bps / 10000
    return agg.filter("gross is not null").select("dt", "gross", "price_pnl", "funding_pnl", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def period_backtest(weights: DataFrame, panel: DataFrame, bps: float, ret: str = "fwd") -> DataFrame:
    """(dt, gross, cost, net) of weights at t that earn the return t to t+1 in ``ret``; all-null dates are dropped."""
    d = panel.join(weights.select("dt", "asset", "w"), ["dt", "asset"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    change = F.coalesce(F.abs(F.col("w") - F.lag("w").over(by_asset())), F.lit(0.0))
    agg = d.withColumn("_t", change).groupBy("dt").agg(F.sum(F.col("w") * F.col(ret)).alias("gross"), F.sum("_t").alias("traded"))
    cost = F.col("traded") * bps / 10000
    return agg.filter("gross is not null").select("dt", "gross", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def cash_and_carry(pairs: DataFrame, on: str, rebalance_bps: float, round_trip_bps: float) -> DataFrame:
    """Per asset and date: spot return less perp return plus funding while ``on`` held the bar before, else 0.

    A rebalance cost each held bar, one round trip on the first bar of an episode.
    """
    rs, rp = ratio(F.col("spot"), F.lag("spot").over(by_asset())) - 1, ratio(F.col("perp"), F.lag("perp").over(by_asset())) - 1
    live = F.coalesce(F.lag(on).over(by_asset()), F.lit(False))
    d = pairs.withColumns({"_live": live, "_gross": rs - rp + F.coalesce("funding", F.lit(0.0))})
    start = F.col("_live") & ~F.coalesce(F.lag("_live").over(by_asset()), F.lit(False))
    cost = F.lit(rebalance_bps / 10000) + F.when(start, round_trip_bps / 10000).otherwise(0.0)
    return d.select(
        "dt", "asset", F.col("_live").alias("held"), start.alias("episode_start"),
        F.when(F.col("_live"), F.coalesce("_gross", F.lit(0.0))).otherwise(0.0).alias("gross"),
        F.when(F.col("_live"), F.coalesce("_gross", F.lit(0.0)) - cost).otherwise(0.0).alias("net"),
    )


def impact_costs(trades: DataFrame, aums: list[float], half_spread: float, k: float) -> DataFrame:
    """Cost per (dt, aum): |dw| (spread + k sigma sqrt(|dw| aum / adv)); a missing adv takes the date's median.

    ``trades``: dt, asset, dw, sigma, adv.
    """
    spark = trades.sparkSession
    sizes = spark.createDataFrame([(float(a),) for a in aums], "aum double")
    adv = F.coalesce("adv", F.percentile("adv", F.lit(0.5)).over(by_date()))
    d = trades.withColumn("adv", adv).crossJoin(F.broadcast(sizes))
    a = F.abs("dw")
    c = a * (half_spread + k * F.coalesce("sigma", F.lit(0.0)) * F.sqrt(F.coalesce(ratio(a * F.col("aum"), F.col("adv")), F.lit(0.0))))
    return d.groupBy("dt", "aum").agg(F.sum(c).alias("cost"))


def capacity_zero(curve: DataFrame, value: str = "sharpe") -> DataFrame:
    """The smallest AUM at which ``value`` is no longer positive; null if it always is."""
    return curve.agg(F.min(F.when(F.col(value) <= 0, F.col("aum"))).alias("dead_aum"))


def event_pnl(windows: DataFrame, bps: float, bars: int) -> DataFrame:
    """(dt, ret): mean over overlapping events of side times return, costs on the first and last bar; null returns stay out."""
    edge = F.col("step").isin(1, bars)
    r = F.col("side") * F.col("ret") - F.when(edge, bps / 10000).otherwise(0.0)
    return windows.withColumn("_r", r).groupBy("dt").agg(F.avg("_r").alias("ret"), F.count("_r").alias("live")).filter("ret is not null")


def sides_on_bars(events: DataFrame, returns: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """``returns`` (bar_no, asset, ...) with ``<span>_side`` and ``<span>_n`` per span (first, last): the sum of sides and the number of the asset's events that entered ``first`` to ``last`` bars before.

    Events (bar_no, asset, side) are added up by asset and bar and meet the
    returns in windows over the asset's bars; none is expanded over the bars it holds.
    """
    e = events.groupBy("asset", "bar_no").agg(F.sum("side").alias("_s"), F.count("*").alias("_n"))
    both = returns.withColumn("_own", F.lit(True)).unionByName(e, allowMissingColumns=True)
    by = W.partitionBy("asset").orderBy("bar_no")
    cols = {}
    for name, (first, last) in spans.items():
        w = by.rangeBetween(-last, -first)
        cols |= {f"{name}_side": F.coalesce(F.sum("_s").over(w), F.lit(0)), f"{name}_n": F.coalesce(F.sum("_n").over(w), F.lit(0))}
    return both.withColumns(cols).filter("_own").drop("_own", "_s", "_n")


def lagged_weights(weights: DataFrame, cal: DataFrame, lags: list[int]) -> DataFrame:
    """Each weight row on every entry lag: (lag, dt, asset, w)."""
    d = weights.join(cal, "dt") if "bar_no" not in weights.columns else weights
    d = d.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("bar_no", F.col("bar_no") + F.col("lag")).drop("dt")
    return d.join(cal, "bar_no").select("lag", "dt", "asset", "w")


def drawdown(returns: DataFrame) -> DataFrame:
    """Equity over its running peak less 1, per strategy; returns at or below -1 end the curve at 0."""
    w = W.partitionBy("strategy_id").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    equity = F.exp(F.sum(F.log1p(F.greatest(F.col("ret"), F.lit(-0.999999)))).over(w))
    d = returns.withColumn("equity", equity)
    peak = F.greatest(F.max("equity").over(w), F.lit(0.0))
    return d.withColumn("drawdown", F.col("equity") / peak - 1)
