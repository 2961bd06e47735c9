"""Windows and guarded frames over long panels (dt, asset, ...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_asset() -> WindowSpec:
    """One asset through time."""
    return W.partitionBy("asset").orderBy("dt")


def by_date() -> WindowSpec:
    """One date across assets."""
    return W.partitionBy("dt")


def trailing(n: int, lag: int = 0) -> WindowSpec:
    """The last ``n`` bars of an asset up to ``lag`` bars ago."""
    return by_asset().rowsBetween(-(n - 1) - lag, -lag)


def gated(value: Column, counted: Column, least: int, window: WindowSpec) -> Column:
    """``value`` over ``window``, null unless ``least`` non-null values of ``counted`` lie in it."""
    return F.when(F.count(counted).over(window) >= least, value.over(window))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def simple_return(price: str | Column = "price") -> Column:
    """Return on the dense calendar; null if either price is missing, never filled."""
    p = F.col(price) if isinstance(price, str) else price
    return ratio(p, F.lag(p).over(by_asset())) - 1


def zscore(x: Column, window: WindowSpec | None = None) -> Column:
    """(x - mean) / (sample deviation + 1e-12)."""
    window = window or by_date()
    return (x - F.avg(x).over(window)) / (F.stddev_samp(x).over(window) + 1e-12)


def zscore_or_zero(x: Column, window: WindowSpec | None = None) -> Column:
    """z-score where a zero deviation and every missing value give 0."""
    window = window or by_date()
    return F.coalesce(ratio(x - F.avg(x).over(window), F.stddev_samp(x).over(window)), F.lit(0.0))


def average_rank(x: Column, *keys: str) -> Column:
    """Rank with ties averaged, within ``keys``."""
    peers = W.partitionBy(*keys, x)
    return F.rank().over(W.partitionBy(*keys).orderBy(x)) + (F.count("*").over(peers) - 1) / 2


def last_known(x: Column, window: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(window)
