"""Panel views over the given tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.windows import simple_return
from gridloom.operators.panel import densify

_ASSET = {"w": "p_brand", "m": "p_brand", "s": "'S' || lpad(cast(l_suppkey as string), 5, '0')"}
_UNIT = {"w": "week", "m": "month", "s": "week"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def panel(spark: SparkSession, d: str, kind: str = "w") -> DataFrame:
    """Weekly brands (w), monthly brands (m) or weekly suppliers with sector (s): price, volume, dollars, funding, nav."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    # integer cents and units: sums are exact, so any partitioning gives the same panel
    whole = F.round("l_quantity").cast("long")
    q = F.sum(whole)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    e = F.sum(cents("l_extendedprice"))
    p = j.groupBy(F.date_trunc(_UNIT[kind], "l_shipdate").cast("date").alias("dt"), F.expr(_ASSET[kind]).alias("asset")).agg(
        (e / (F.lit(100.0) * q)).alias("price"), q.cast("double").alias("volume"), (e / F.lit(100.0)).alias("dollar_volume"),
        (F.sum(cents("l_discount")) / (F.lit(100.0) * F.count("*")) - 0.05).alias("funding"),
        (F.sum(cents("p_retailprice") * whole) / (F.lit(100.0) * q)).alias("nav"),
    )
    if kind == "s":
        p = p.join(sectors(spark, d), "asset")
    return p


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """(asset, sector): a supplier's region."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.expr("'S' || lpad(cast(s_suppkey as string), 5, '0')").alias("asset"), F.col("r_name").alias("sector"))


def dense(spark: SparkSession, d: str, kind: str = "w") -> DataFrame:
    return densify(panel(spark, d, kind))


def returns(spark: SparkSession, d: str, kind: str = "w") -> DataFrame:
    return dense(spark, d, kind).withColumn("ret", simple_return())


def r(c: str | Column, name: str | None = None, n: int = 6) -> Column:
    """Rounded, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, n) + 0.0).alias(name or c)


def sql_panel(kind: str = "w") -> str:
    asset = _ASSET[kind].replace("as string", "as varchar")
    sector = ""
    if kind == "s":
        sector = (
            ", sectors as (select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as asset, r_name as sector from supplier "
            "join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
        )
    return f"""panel as (select cast(date_trunc('{_UNIT[kind]}', l_shipdate) as date) as dt, {asset} as asset,
  sum(cast(round(l_extendedprice * 100) as bigint)) / (100.0::double * sum(cast(round(l_quantity) as bigint))) as price, sum(cast(round(l_quantity) as bigint))::double as volume,
  sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0::double as dollar_volume,
  sum(cast(round(l_discount * 100) as bigint)) / (100.0::double * count(*)) - 0.05::double as funding,
  sum(cast(round(p_retailprice * 100) as bigint) * cast(round(l_quantity) as bigint)) / (100.0::double * sum(cast(round(l_quantity) as bigint))) as nav
  from lineitem join part on l_partkey = p_partkey group by 1, 2){sector},
cal as (select dt, row_number() over (order by dt) as bar_no from (select distinct dt from panel)),
dense as (select c.dt, a.asset, bar_no, price, volume, dollar_volume, funding, nav{", sector" if kind == "s" else ""}
  from cal c cross join (select distinct asset from panel) a left join panel p on p.dt = c.dt and p.asset = a.asset
  {"left join sectors s on s.asset = p.asset" if kind == "s" else ""}),
rets as (select *, price / nullif(lag(price) over (partition by asset order by dt), 0) - 1 as ret from dense)"""


def on_panel(kind: str, body: str) -> str:
    """SQL over the views ``panel``, ``cal``, ``dense`` and ``rets`` of a kind; ``body`` may start with more views."""
    return f"with {sql_panel(kind)}{' ' if body.lstrip().startswith('select') else ', '}{body}"
