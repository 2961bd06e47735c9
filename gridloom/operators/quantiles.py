"""Exact interpolated quantiles of whole tables, of which no task holds more than a range of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a key's distinct values are cut into.
RANGES = 256


def quantiles(df: DataFrame, value: str, ps: tuple[float, ...], keys: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """Per key (one row without keys): n, the non-null values, and p, their quantiles at ``ps`` in order, linear between neighbours.

    Equal values are counted first. A sketch of the distinct values gives bounds
    of ranges; the counts of ranges say which of them hold the wanted ranks, and
    only those are sorted, each apart. The result doesn't depend on the bounds.
    Null keys are a key of their own; nan counts as null; keys without values
    and empty tables give no rows.
    """
    at = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    d = df.select(*(F.col(k).alias(a) for k, a in zip(keys, at, strict=False)), *([] if keys else [F.lit(0).alias("_k0")]), F.col(value).cast("double").alias("_v"))
    c = d.filter("_v is not null and not isnan(_v)").groupBy(*at, "_v").agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx("_v", F.lit([k / ranges for k in range(1, ranges)]), F.lit(10_000))
    bounds = c.groupBy(*at).agg(cuts.alias("_cuts")).select(*(F.col(a).alias(f"{a}b") for a in at), "_cuts")
    met = lambda left, right, mark: [left[a].eqNullSafe(right[f"{a}{mark}"]) for a in at]
    x = c.join(bounds, met(c, bounds, "b")).select(*at, "_v", "_n", F.size(F.filter("_cuts", lambda b: b < F.col("_v"))).alias("_range"))
    # a row per key and range from here on
    per = x.groupBy(*at, "_range").agg(F.sum("_n").alias("_m"))
    by = W.partitionBy(*at)
    per = per.withColumn("_before", F.sum("_m").over(by.orderBy("_range")) - F.col("_m")).withColumn("_total", F.sum("_m").over(by))
    per = per.select("*", F.posexplode(F.lit([float(p) for p in ps])).alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_total") - 1))
    per = per.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    per = per.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
    wanted = per.select(*(F.col(a).alias(f"{a}w") for a in at), F.col("_range").alias("_r"), "_before", "_total", "_i", "_at", "_rank")
    open_ = wanted.select(*(F.col(f"{a}w").alias(f"{a}o") for a in at), F.col("_r").alias("_ro")).distinct()
    held = x.join(open_, [*met(x, open_, "o"), F.col("_range") == F.col("_ro")], "left_semi")
    held = held.withColumn("_upto", F.sum("_n").over(W.partitionBy(*at, "_range").orderBy("_v")))
    found = held.join(wanted, [*met(held, wanted, "w"), F.col("_range") == F.col("_r")])
    rank = F.col("_rank") - F.col("_before")
    found = found.filter((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")))
    one = found.groupBy(*at, "_total", "_i", "_at").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    one = one.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
    out = one.groupBy(*at, "_total").agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_qs"))
    return out.select(*(F.col(a).alias(k) for k, a in zip(keys, at, strict=False)), F.col("_total").alias("n"), F.col("_qs._q").alias("p"))
