"""Dense panels, features, labels and walk-forward windows.

Shifts are positional on the shared calendar, so every lag runs on the output of
:func:`densify`. A missing price gives a missing return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, gated, ratio, simple_return, trailing, zscore


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def calendar(panel: DataFrame) -> DataFrame:
    """(dt, bar_no): distinct dates numbered from 1. The one global window, over dates only."""
    return panel.select("dt").distinct().withColumn("bar_no", F.row_number().over(W.orderBy("dt")))


def densify(panel: DataFrame) -> DataFrame:
    """Every asset on every date of the panel, with bar_no; absent cells are null."""
    grid = calendar(panel).crossJoin(panel.select("asset").distinct())
    return grid.join(panel, ["dt", "asset"], "left")


def coverage_filter(panel: DataFrame, min_coverage: float, value: str = "price") -> DataFrame:
    """Assets with at least int(dates * min_coverage) non-null values."""
    dates = panel.agg(F.count_distinct("dt").alias("n"))
    kept = panel.groupBy("asset").agg(F.count(value).alias("k")).crossJoin(dates)
    kept = kept.filter(F.col("k") >= F.floor(F.col("n") * min_coverage))
    return panel.join(kept.select("asset"), "asset", "left_semi")


def market(dense: DataFrame, ret: str = "ret") -> DataFrame:
    """Equal-weight mean return per date over the assets that have one."""
    return dense.groupBy("dt").agg(F.avg(ret).alias("mkt"))


def with_market(dense: DataFrame, ret: str = "ret") -> DataFrame:
    return dense.withColumn("mkt", F.avg(ret).over(by_date()))


def rolling_beta(ret: str, mkt: str, n: int, least: int) -> Column:
    """Covariance on bars with both, over the variance of all market bars in the window."""
    w = trailing(n)
    both = F.when(F.col(ret).isNotNull() & F.col(mkt).isNotNull(), F.lit(1))
    cov = gated(F.covar_samp(ret, mkt), both, least, w)
    var = gated(F.var_samp(mkt), F.col(mkt), least, w)
    return ratio(cov, var)


def momentum(price: str, far: int, near: int) -> Column:
    """Log price ``near`` bars ago minus ``far`` bars ago."""
    p = F.ln(F.when(F.col(price) > 0, F.col(price)))
    at = lambda k: F.lag(p, k).over(by_asset()) if k else p
    return at(near) - at(far)


def features(dense: DataFrame, far: int = 52, mid: int = 26, near: int = 4, vol: int = 13) -> DataFrame:
    """Five price features on a dense panel, unscaled."""
    d = dense.withColumn("ret", simple_return())
    return d.select(
        "dt", "asset", "bar_no", "price", "ret",
        momentum("price", far, near).alias("mom_long"),
        momentum("price", mid, near).alias("mom_mid"),
        momentum("price", near, 0).alias("reversal"),
        gated(F.stddev_samp("ret"), F.col("ret"), vol, trailing(vol)).alias("vol"),
        (ratio(F.col("price"), gated(F.max("price"), F.col("price"), far, trailing(far))) - 1).alias("high_ratio"),
    )


FEATURES = ("mom_long", "mom_mid", "reversal", "vol", "high_ratio")


def build_features(dense: DataFrame, mask: Column | None = None, **spans: int) -> DataFrame:
    """Features z-scored per date among members (``mask``); non-members are null."""
    f = features(dense, **spans)
    if mask is not None:
        f = f.withColumns({c: F.when(mask, F.col(c)) for c in FEATURES})
    return f.select("dt", "asset", "bar_no", *(zscore(F.col(c)).alias(c) for c in FEATURES))


def build_labels(dense: DataFrame, horizon: int, residual: bool = False, beta_bars: int = 26, least: int = 13) -> DataFrame:
    """Forward return over ``horizon`` bars, optionally less past-only beta times the market's, z-scored per date.

    The market compounds with missing days as 0.
    """
    fwd = ratio(F.lead("price", horizon).over(by_asset()), F.col("price")) - 1
    d = dense.withColumn("ret", simple_return()).withColumn("fwd", fwd)
    if residual:
        d = with_market(d)
        ahead = by_asset().rowsBetween(1, horizon)
        grown = F.exp(F.sum(F.log1p(F.greatest(F.coalesce("mkt", F.lit(0.0)), F.lit(-0.999)))).over(ahead)) - 1
        full = F.count("*").over(ahead) == horizon
        d = d.withColumn("fwd", F.col("fwd") - rolling_beta("ret", "mkt", beta_bars, least) * F.when(full, grown))
    return d.select("dt", "asset", "bar_no", zscore(F.col("fwd")).alias("label"))


def stack_panel(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows with a label and nothing missing."""
    return feats.join(labels.drop("bar_no"), ["dt", "asset"]).dropna()


def walk_forward_windows(bars: DataFrame, start: int, span: int, embargo: int) -> DataFrame:
    """(window_id, train_end, test_lo, test_hi) over bar positions 0..n-1: expanding training [0, start - embargo), full test spans only."""
    n = bars.agg(F.max("bar_no").alias("n"))
    lo = F.explode(F.when(F.col("n") - span >= start, F.sequence(F.lit(start), F.col("n") - span, F.lit(span))).otherwise(F.array().cast("array<int>")))
    w = n.select(lo.alias("test_lo"))
    return w.select(
        F.floor((F.col("test_lo") - start) / span).cast("int").alias("window_id"),
        (F.col("test_lo") - embargo).alias("train_end"), "test_lo", (F.col("test_lo") + span).alias("test_hi"),
    )


def resample_last(panel: DataFrame, period: Column, *values: str) -> DataFrame:
    """Last non-null value of each column per asset and period."""
    at = [F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col("dt"))).alias(v) for v in values]
    return panel.groupBy("asset", period.alias("period")).agg(*at)


def month_ends(panel: DataFrame) -> DataFrame:
    """(dt): the last day of every month from the panel's first to its last, months without rows too."""
    months = F.sequence(F.date_trunc("month", F.min("dt")).cast("date"), F.date_trunc("month", F.max("dt")).cast("date"), F.expr("interval 1 month"))
    return panel.agg(months.alias("m")).select(F.explode("m").alias("m")).select(F.last_day("m").alias("dt"))


def dedupe_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by ``order``, deterministically."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
