"""Signals from filings, transactions, surprises and carry, as known at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_date, ratio, zscore


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """owner, ticker, filed, traded, code, shares, value from order lines; dates ordered so that filing is never first."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    j = spark.read.parquet(f"{d}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.concat(F.lit("O"), (F.col("o_custkey") % 50).cast("string")).alias("owner"),
        F.expr("'S' || lpad(cast(l_suppkey as string), 5, '0')").alias("ticker"),
        F.greatest("o_orderdate", "l_shipdate").cast("date").alias("filed"),
        F.least("o_orderdate", "l_shipdate").cast("date").alias("traded"),
        F.col("l_returnflag").alias("code"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("value"),
    )


def routine(txn: DataFrame, years: int = 3) -> DataFrame:
    """Adds ``routine``: strictly earlier filings already show trades in one calendar month of ``years`` consecutive years.

    Set-based, with one shuffle by owner and ticker: the first filings of a month's
    trades in a year and in the years after it are least values over ranges of
    years; the least of the runs' latest filing is when the owner became routine.
    """
    known = F.col("owner").isNotNull() & F.col("ticker").isNotNull() & F.col("traded").isNotNull()
    t = txn.repartition("owner", "ticker").withColumns({"_mo": F.month("traded"), "_y": F.year("traded")})
    years_of = W.partitionBy("owner", "ticker", "_mo").orderBy("_y")
    t = t.withColumns({f"_f{k}": F.min("filed").over(years_of.rangeBetween(k, k)) for k in range(years)})
    run = known
    for k in range(years):
        run = run & F.col(f"_f{k}").isNotNull()
    since = F.min(F.when(run, F.greatest(*(f"_f{k}" for k in range(years))) if years > 1 else F.col("_f0"))).over(W.partitionBy("owner", "ticker"))
    t = t.withColumn("routine", F.coalesce(F.col("filed") > since, F.lit(False)))
    return t.select(*txn.columns, "routine")


def distinct_owner_counts(txn: DataFrame, grid: DataFrame, days: int) -> DataFrame:
    """(t, ticker, owners): distinct owners with a filing in (t - days, t]."""
    from gridloom.operators.joins import trailing_window

    w = trailing_window(txn.select("owner", "ticker", "filed").distinct(), grid, "filed", days)
    return w.select("t", "ticker", "owner").distinct().groupBy("t", "ticker").agg(F.count("*").alias("owners"))


def net_cluster(txn: DataFrame, grid: DataFrame, days: int, buy: str = "R", sell: str = "A") -> DataFrame:
    """(t, ticker, buyers, sellers, net): distinct buyers less sellers in the trailing window.

    One shuffle by ticker. In the order of time an owner's filing counts on the
    grid dates that it reaches and the filing before does not, so that each owner
    is counted once a date without a table of owners and dates.
    """
    from gridloom.operators.joins import reached

    rows, cal = reached(txn.filter(F.col("code").isin(buy, sell)).select("owner", "ticker", "filed", "code"), grid, "filed", days)
    before = F.lag("hi").over(W.partitionBy("ticker", "owner", "code").orderBy("filed"))
    new = rows.repartition("ticker").withColumn("lo", F.greatest("lo", before + 1)).filter("lo <= hi")
    each = new.select("ticker", "owner", "code", F.explode(F.sequence("lo", "hi")).alias("pos"))
    j = each.groupBy("ticker", "pos").agg(F.count_if(F.col("code") == buy).alias("buyers"), F.count_if(F.col("code") == sell).alias("sellers"))
    return j.join(F.broadcast(cal), "pos").select("t", "ticker", "buyers", "sellers", (F.col("buyers") - F.col("sellers")).alias("net"))


def latest_surprise(s: DataFrame, grid: DataFrame, days: int) -> DataFrame:
    """(t, ticker, sue): each ticker's latest surprise in (t - days, t] by (ann_date, o_orderkey).

    Of the surprises that first count on one grid date, the latest wins on all
    later ones too; it counts until the next such winner's first date or its own last.
    """
    from gridloom.operators.joins import reached

    rows, cal = reached(s.select("ticker", "ann_date", "o_orderkey", "sue"), grid, "ann_date", days)
    best = F.row_number().over(W.partitionBy("ticker", "lo").orderBy(F.desc("ann_date"), F.desc("o_orderkey")))
    x = rows.repartition("ticker").withColumn("_k", best).filter("_k = 1")
    until = F.least("hi", F.lead("lo").over(W.partitionBy("ticker").orderBy("lo")) - 1)
    x = x.withColumn("hi", until).select("ticker", "sue", F.explode(F.sequence("lo", "hi")).alias("pos"))
    return x.join(F.broadcast(cal), "pos").select("t", "ticker", "sue")


def surprises(spark: SparkSession, d: str) -> DataFrame:
    """ticker, ann_date, actual, est, std: an order's total against its customer's earlier orders, on its lines' suppliers."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    o = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ann_date"), F.col("o_totalprice").alias("actual"), F.avg("o_totalprice").over(w).alias("est"), F.stddev_samp("o_totalprice").over(w).alias("std"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("'S' || lpad(cast(l_suppkey as string), 5, '0')").alias("ticker"))
    line = line.repartition("o_orderkey").distinct()  # one shuffle serves the join too
    return o.join(line, "o_orderkey").select("o_orderkey", "ticker", "ann_date", "actual", "est", "std")


def compute_sue(s: DataFrame) -> DataFrame:
    """Standardised surprise and its method: by the estimates' deviation, else by the estimate, else by the actual; non-finite rows leave."""
    gap = F.col("actual") - F.col("est")
    by = F.when(F.col("std") > 0, "std").when(F.abs("est") > 0, "est").otherwise("raw")
    sue = F.when(by == "std", gap / F.nullif("std", F.lit(0.0))).when(by == "est", gap / F.nullif(F.abs("est"), F.lit(0.0))).otherwise(gap)
    return s.withColumns({"sue": sue, "method": by}).filter("sue is not null and not isnan(sue)")


def cohort_cuts(s: DataFrame, q: float) -> DataFrame:
    """Rows with their month cohort's q and 1 - q interpolated quantiles; cohorts under max(5, ceil(1/q)) leave."""
    c = s.withColumn("cohort", F.date_trunc("month", "ann_date").cast("date"))
    cuts = c.groupBy("cohort").agg(F.percentile("sue", F.lit([q, 1 - q])).alias("p"), F.count("*").alias("n"))
    cuts = cuts.select("cohort", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"), "n")
    least = max(5, int(-(-1 // q)))
    return c.join(cuts.filter(F.col("n") >= least), "cohort")


def sue_book(s: DataFrame, asof, vol: DataFrame, floor: float = 1.5, gross: float = 1.0) -> DataFrame:
    """Latest visible surprise per ticker with |SUE| > ``floor``, signed inverse-volatility weights of total ``gross``."""
    seen = s.filter(F.col("ann_date") <= asof).groupBy("ticker").agg(F.max_by("sue", F.struct("ann_date", "o_orderkey")).alias("sue"))
    j = seen.filter(F.abs("sue") > floor).join(vol, "ticker").filter("vol > 0").withColumn("_i", F.signum("sue") / F.col("vol"))
    total = j.agg(F.sum(F.abs("_i")).alias("_t"))
    return j.crossJoin(total).select("ticker", "sue", (F.lit(gross) * F.col("_i") / F.col("_t")).alias("w"))


def combine(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of per-date z-scores over the sum of |weights|; a missing signal counts 0, a name without any stays null."""
    cols = {c: zscore(F.col(c)) for c in weights}
    z = signals.withColumns({f"_z_{c}": e for c, e in cols.items()})
    total = sum(abs(v) for v in weights.values())
    blend = sum((F.coalesce(f"_z_{c}", F.lit(0.0)) * v for c, v in weights.items()), F.lit(0.0)) / total
    some = F.coalesce(*(F.col(f"_z_{c}") for c in weights)).isNotNull()
    return z.withColumn("signal", F.when(some, blend)).drop(*(f"_z_{c}" for c in weights))


def deploy_signal(carry: DataFrame, costs: DataFrame, n: int, periods: int, floor: float, multiple: float) -> DataFrame:
    """Per asset, over its latest ``n`` funding rows: net annual carry above ``floor`` and sum above ``multiple`` times the round trip.

    ``costs``: bucket, roundtrip_bps; ``carry``: asset, bucket, dt, funding.
    """
    r = F.row_number().over(W.partitionBy("asset").orderBy(F.desc("dt")))
    g = carry.filter("funding is not null").withColumn("_r", r).filter(F.col("_r") <= n)
    g = g.groupBy("asset", "bucket").agg(F.sum("funding").alias("total"), F.count("*").alias("obs")).join(F.broadcast(costs), "bucket")
    cost = F.col("roundtrip_bps") / 10000
    annual = (F.col("total") - cost) / F.col("obs") * periods
    return g.select("asset", "bucket", "obs", "total", annual.alias("net_annual"), ((annual > floor) & (F.col("total") > multiple * cost)).alias("deploy"))


def fundamentals(spark: SparkSession, d: str) -> DataFrame:
    """entity, filed, assets, gp, ni, cfo: yearly-like figures per customer and order date from orders and their lines."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("filed"), "o_totalprice")
    line = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("ni"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("cfo"), F.sum("l_extendedprice").alias("gp")
    )
    j = o.join(line, "o_orderkey", "left")
    return j.groupBy("entity", "filed").agg(F.round(F.sum("o_totalprice"), 4).alias("assets"), F.round(F.sum("gp"), 4).alias("gp"), F.round(F.sum("ni"), 4).alias("ni"), F.round(F.sum("cfo"), 4).alias("cfo"))


def ratios(f: DataFrame) -> DataFrame:
    """Gross profit, accruals and cash-based profitability over assets, each leg carried forward over the entity's filing dates."""
    w = W.partitionBy("entity").orderBy("filed").rowsBetween(W.unboundedPreceding, 0)
    c = {k: F.last(k, ignorenulls=True).over(w) for k in ("assets", "gp", "ni", "cfo")}
    x = f.withColumns(c)
    acc = F.col("ni") - F.col("cfo")
    return x.select("entity", "filed", ratio(F.col("gp"), F.col("assets")).alias("gp_a"), ratio(acc, F.col("assets")).alias("acc_a"), ratio(F.col("gp") - acc, F.col("assets")).alias("cbop_a"))


def quality(df: DataFrame, good: str, bad: str) -> DataFrame:
    """z(good) - z(bad) per date; one missing leg counts 0, both missing stay null."""
    a, b = zscore(F.col(good), by_date()), zscore(F.col(bad), by_date())
    x = df.withColumns({"_a": a, "_b": b})
    q = F.when(F.coalesce("_a", "_b").isNotNull(), F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return x.withColumn("quality", q).drop("_a", "_b")
