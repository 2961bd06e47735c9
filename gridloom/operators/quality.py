"""Snapshot differences, continuity, maturity and live diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import gated, ratio

CHANGED, NOISE = 1e-6, 1e-9


def prior_tags(tags: DataFrame) -> DataFrame:
    """Each tag with the latest one strictly before it."""
    return tags.select("tag", F.lag("tag").over(W.orderBy("tag")).alias("prior"))


def snapshot_cells(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of two snapshots on their shared dates and assets, with relative price change and both returns on the shared calendar.

    A cell is changed beyond 1e-6, noise within (1e-9, 1e-6], appeared or vanished.
    """
    k = list(keys)
    shared = lambda c: old.select(*k, c).distinct().join(new.select(*k, c).distinct(), [*k, c])
    o = old.select(*k, "dt", "asset", F.col("price").alias("p0"))
    n = new.select(*k, "dt", "asset", F.col("price").alias("p1"))
    c = o.join(n, [*k, "dt", "asset"], "full").join(shared("dt"), [*k, "dt"], "left_semi").join(shared("asset"), [*k, "asset"], "left_semi")
    w = W.partitionBy(*k, "asset").orderBy("dt")
    rel = ratio(F.abs(F.col("p1") - F.col("p0")), F.abs(F.col("p0")))
    c = c.withColumns({"rel": rel, "r0": ratio(F.col("p0"), F.lag("p0").over(w)) - 1, "r1": ratio(F.col("p1"), F.lag("p1").over(w)) - 1})
    kind = F.when(F.col("p0").isNull() & F.col("p1").isNotNull(), "appeared").when(F.col("p0").isNotNull() & F.col("p1").isNull(), "vanished")
    kind = kind.when(F.col("rel") > CHANGED, "changed").when(F.col("rel") > NOISE, "noise").otherwise("same")
    return c.withColumns({"kind": kind, "ret_changed": F.coalesce(F.abs(F.col("r1") - F.col("r0")) > CHANGED, F.lit(False))})


def snapshot_summary(cells: DataFrame, *keys: str) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), *map(count, ("changed", "noise", "appeared", "vanished")), F.count_if("ret_changed").alias("ret_changed"))


def top_revised(cells: DataFrame, n: int = 10) -> DataFrame:
    """Assets with the most changed cells."""
    g = cells.groupBy("asset").agg(F.count_if(F.col("kind") == "changed").alias("changed")).filter("changed > 0")
    return g.orderBy(F.desc("changed"), "asset").limit(n)


def business_days(bounds: DataFrame) -> DataFrame:
    """Weekdays from ``lo`` to ``hi`` of a one-row table."""
    d = bounds.select(F.explode(F.sequence("lo", "hi")).alias("dt"))
    return d.filter(~F.dayofweek("dt").isin(1, 7))


def continuity(bounds: DataFrame, logged: DataFrame) -> DataFrame:
    """(dt, logged) for every weekday."""
    return business_days(bounds).join(logged.select("dt").distinct().withColumn("_l", F.lit(True)), "dt", "left").select("dt", F.coalesce("_l", F.lit(False)).alias("logged"))


def realized(predictions: DataFrame, dense: DataFrame, horizon: int) -> DataFrame:
    """Logged predictions with the return over the next ``horizon`` bars; immature ones are left out."""
    w = W.partitionBy("asset").orderBy("dt")
    top = dense.agg(F.max("bar_no").alias("_top"))
    f = dense.select("dt", "asset", "bar_no", (ratio(F.lead("price", horizon).over(w), F.col("price")) - 1).alias("fwd"))
    return predictions.join(f.crossJoin(F.broadcast(top)).filter(F.col("bar_no") + horizon <= F.col("_top")).drop("_top"), ["dt", "asset"])


def regression(pairs: DataFrame, y: str, x: str) -> DataFrame:
    """beta, se, alpha, corr, variance share and residual volatility of y on x."""
    p = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = p.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.corr(y, x).alias("corr"), F.var_samp(y).alias("vy"), F.var_samp(x).alias("vx"))
    resid = (F.col("n") - 1) * F.col("vy") * (1 - F.col("corr") * F.col("corr")) / (F.col("n") - 2)
    return a.select("n", "beta", F.sqrt(resid / ((F.col("n") - 1) * F.col("vx"))).alias("se"), "alpha", "corr", (F.col("corr") * F.col("corr")).alias("share"), F.sqrt(resid).alias("resid_vol"))


def rolling_slope(y: str, x: str, n: int, window: W) -> Column:
    return gated(F.regr_slope(y, x), F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.lit(1)), n, window)


def compounded(returns: DataFrame, cycles: DataFrame) -> DataFrame:
    """Daily returns compounded over (previous cycle date, cycle date]."""
    w = W.orderBy("dt")
    c = cycles.select(F.col("dt").alias("cycle"), F.lag("dt").over(W.orderBy("dt")).alias("prev"))
    grown = returns.filter("ret is not null").select("dt", F.log1p(F.greatest("ret", F.lit(-0.999999))).alias("g"))
    # the cycle that a date belongs to is the first at or after it
    marks = grown.select("dt", "g", F.lit(None).cast("date").alias("cycle")).unionByName(c.select(F.col("cycle").alias("dt"), F.lit(None).cast("double").alias("g"), "cycle"))
    own = F.first("cycle", ignorenulls=True).over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    d = marks.withColumn("c", own).filter("g is not null and c is not null").groupBy(F.col("c").alias("cycle")).agg((F.exp(F.sum("g")) - 1).alias("ret"))
    return d.join(c.filter("prev is not null"), "cycle").select("cycle", "prev", "ret")
