"""Weights, P&L, limits, orders and execution."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, gated, ratio, trailing, zscore
from gridloom.operators import books, panel, pnl, risk, signals, stats
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r, returns, table
from gridloom.plans.views import panel as weekly

_A = "over (partition by asset order by dt)"
_MOM = f"sc as (select dt, bar_no, asset, round(ln(lag(price, 4) {_A}) - ln(lag(price, 26) {_A}), 9) as score from dense)"


def momentum_scores(s, d, kind="w"):
    return dense(s, d, kind).select("dt", "bar_no", "asset", F.round(panel.momentum("price", 26, 4), 9).alias("score"))


def _decile_sql(q, every, least=10, source="sc"):
    return f"""rk as (select *, count(*) over (partition by dt) as n, row_number() over (partition by dt order by score desc, asset) as hi, row_number() over (partition by dt order by score, asset) as lo
  from {source} where score is not null and (bar_no - 1) % {every} = 0),
wt as (select o.dt, o.bar_no, o.asset, case when n >= {least} then case when hi <= greatest(1, floor(n * {q})) then 0.5 / greatest(1, floor(n * {q})) else 0 end
  - case when lo <= greatest(1, floor(n * {q})) then 0.5 / greatest(1, floor(n * {q})) else 0 end else 0 end as w
  from {source} o left join rk on rk.dt = o.dt and rk.asset = o.asset where (o.bar_no - 1) % {every} = 0)"""


_DECILE = _decile_sql(0.1, 4)
_LAST = "(select max(bar_no) from wt)"
_PREV = f"(select max(bar_no) from wt where bar_no < {_LAST})"
_HELD = """h as (select d.dt, d.asset, d.bar_no, d.ret, last_value(t.w ignore nulls) over (partition by d.asset order by d.dt) as w from rets d left join wt t on t.dt = d.dt and t.asset = d.asset),
l as (select *, coalesce(lag(w) over (partition by asset order by dt), 0) as lw from h),
e as (select *, coalesce(abs(lw - lag(lw) over (partition by asset order by dt)), 0) as tr from l)"""
_BT = f"{_HELD}, bt as (select dt, coalesce(sum(lw * ret), 0) as gross, sum(tr) / 2 as turnover, sum(tr) * 10 / 10000 as cost, coalesce(sum(lw * ret), 0) - sum(tr) * 10 / 10000 as net from e group by dt)"


@query("decile_weights", on_panel("w", f"{_MOM}, {_DECILE} select dt, asset, round(w, 6) + 0.0 as w from wt"))
def decile_weights(s, d):
    return books.decile_weights(momentum_scores(s, d), 0.1, 4).select("dt", "asset", r("w"))


@query("run_backtest", on_panel("w", f"{_MOM}, {_DECILE}, {_BT} select dt, round(gross, 6) + 0.0 as gross, round(turnover, 6) + 0.0 as turnover, round(cost, 6) + 0.0 as cost, round(net, 6) + 0.0 as net from bt"))
def run_backtest(s, d):
    return pnl.run_backtest(books.decile_weights(momentum_scores(s, d), 0.1, 4), dense(s, d), 10).select("dt", *(r(c) for c in ("gross", "turnover", "cost", "net")))


_MOM_M = f"sc as (select dt, bar_no, asset, round(ln(lag(price, 1) {_A}) - ln(lag(price, 12) {_A}), 9) as score from dense)"


@query("momentum_baseline", on_panel("m", f"{_MOM_M}, {_decile_sql(0.1, 1)}, {_BT} select dt, round(net, 6) + 0.0 as net from bt"))
def momentum_baseline(s, d):
    x = dense(s, d, "m")
    scores = x.select("dt", "bar_no", "asset", F.round(panel.momentum("price", 12, 1), 9).alias("score"))
    return pnl.run_backtest(books.decile_weights(scores, 0.1, 1), x, 10).select("dt", r("net"))


def _quantile_sql(q, every, long_low=False, long_wins=False, source="sc"):
    hi, lo = f"hi <= floor(n * {q})", f"lo <= floor(n * {q})"
    long, short = (lo, hi) if long_low else (hi, lo)
    first, second = ((long, 0.5), (short, -0.5)) if long_wins else ((short, -0.5), (long, 0.5))
    return f"""rk as (select *, count(*) over (partition by dt) as n, row_number() over (partition by dt order by score desc, asset) as hi, row_number() over (partition by dt order by score, asset) as lo
  from {source} where score is not null and (bar_no - 1) % {every} = 0),
ok as (select * from rk where floor(n * {q}) >= 2),
wt as (select o.dt, o.bar_no, o.asset, case when {first[0]} then {first[1]} / floor(n * {q}) when {second[0]} then {second[1]} / floor(n * {q}) else 0 end as w
  from {source} o left join ok on ok.dt = o.dt and ok.asset = o.asset where o.dt in (select dt from ok))"""


_CARRY = "sc as (select dt, bar_no, asset, round(case when count(funding) over f >= 7 then avg(funding) over f end, 9) as score from dense window f as (partition by asset order by dt rows between 6 preceding and current row))"


def carry_scores(s, d):
    return dense(s, d).select("dt", "bar_no", "asset", F.round(gated(F.avg("funding"), F.col("funding"), 7, trailing(7)), 9).alias("score"))


@query("quartile_carry_weights", on_panel("w", f"{_CARRY}, {_quantile_sql(0.25, 4, long_low=True, long_wins=True)} select dt, asset, round(w, 6) + 0.0 as w from wt"))
def quartile_carry_weights(s, d):
    return books.quantile_book(carry_scores(s, d), 0.25, 4, long_low=True, long_wins=True).select("dt", "asset", r("w"))


@query("carry_backtest", on_panel("w", f"""{_CARRY}, {_quantile_sql(0.25, 4, long_low=True, long_wins=True)},
h as (select d.dt, d.asset, d.bar_no, d.ret, coalesce(d.funding, 0) as fu, last_value(t.w ignore nulls) over (partition by d.asset order by d.dt rows between 3 preceding and current row) as w from rets d left join wt t on t.dt = d.dt and t.asset = d.asset),
l as (select *, lag(w) {_A} as pw, coalesce(abs(coalesce(w, 0) - coalesce(lag(w) {_A}, 0)), 0) as tr from h)
select dt, round(sum(pw * (ret - fu)), 6) + 0.0 as gross, round(sum(case when ret is not null then pw * ret end), 6) + 0.0 as price_pnl, round(sum(case when ret is not null then -pw * fu end), 6) + 0.0 as funding_pnl,
 round(sum(case when bar_no > 1 then tr else 0 end) * 7 / 10000, 6) + 0.0 as cost, round(sum(pw * (ret - fu)) - sum(case when bar_no > 1 then tr else 0 end) * 7 / 10000, 6) + 0.0 as net
from l group by dt having sum(pw * (ret - fu)) is not null"""))
def carry_backtest(s, d):
    w = books.quantile_book(carry_scores(s, d), 0.25, 4, long_low=True, long_wins=True)
    return pnl.carry_backtest(w, dense(s, d), 7, 3).select("dt", *(r(c) for c in ("gross", "price_pnl", "funding_pnl", "cost", "net")))


_DISC = "sc as (select dt, bar_no, asset, round((disc - case when count(disc) over f >= 13 then avg(disc) over f end) / (stddev_samp(disc) over f + 1e-12), 7) as score from (select *, price / nullif(nav, 0) - 1 as disc from dense) window f as (partition by asset order by dt rows between 25 preceding and current row))"


def discount_scores(s, d):
    x = dense(s, d).withColumn("disc", ratio(F.col("price"), F.col("nav")) - 1)
    w = trailing(26)
    z = (F.col("disc") - gated(F.avg("disc"), F.col("disc"), 13, w)) / (F.stddev_samp("disc").over(w) + 1e-12)
    return x.select("dt", "bar_no", "asset", F.round(z, 7).alias("score"))


@query("reversion_weights", on_panel("w", f"{_DISC}, {_quantile_sql(0.2, 1, long_low=True)} select dt, asset, round(w, 6) + 0.0 as w from wt"))
def reversion_weights(s, d):
    return books.quantile_book(discount_scores(s, d), 0.2, 1, long_low=True).select("dt", "asset", r("w"))


_PERIOD = f"""pb as (select o.dt, o.asset, lead(o.price) over (partition by o.asset order by o.dt) / nullif(o.price, 0) - 1 as fwd, coalesce(t.w, 0) as w from dense o left join wt t on t.dt = o.dt and t.asset = o.asset),
pt as (select *, coalesce(abs(w - lag(w) {_A}), 0) as tr from pb),
pp as (select dt, sum(w * fwd) as gross, sum(tr) * 25 / 10000 as cost from pt group by dt having sum(w * fwd) is not null)"""
_PERIOD_OUT = "select dt, round(gross, 6) + 0.0 as gross, round(cost, 6) + 0.0 as cost, round(gross - cost, 6) + 0.0 as net from pp"


def _period(weights, x):
    fwd = ratio(F.lead("price").over(by_asset()), F.col("price")) - 1
    return pnl.period_backtest(weights, x.withColumn("fwd", fwd), 25).select("dt", *(r(c) for c in ("gross", "cost", "net")))


@query("reversion_backtest", on_panel("w", f"{_DISC}, {_quantile_sql(0.2, 1, long_low=True)}, {_PERIOD} {_PERIOD_OUT}"))
def reversion_backtest(s, d):
    return _period(books.quantile_book(discount_scores(s, d), 0.2, 1, long_low=True), dense(s, d))


_QUAL = "sc as (select dt, bar_no, asset, round(nav / nullif(price, 0), 9) as score, dollar_volume as cap, price from dense)"


def value_scores(s, d, kind="m"):
    return dense(s, d, kind).select("dt", "bar_no", "asset", F.round(ratio(F.col("nav"), F.col("price")), 9).alias("score"), F.col("dollar_volume").alias("cap"), "price")


@query("quintile_weights", on_panel("m", f"{_QUAL}, {_quantile_sql(0.2, 1)} select dt, asset, round(w, 6) + 0.0 as w from wt"))
def quintile_weights(s, d):
    return books.quantile_book(value_scores(s, d), 0.2, 1).select("dt", "asset", r("w"))


@query("quality_backtest", on_panel("m", f"{_QUAL}, {_quantile_sql(0.2, 1)}, {_PERIOD} {_PERIOD_OUT}"))
def quality_backtest(s, d):
    return _period(books.quantile_book(value_scores(s, d), 0.2, 1), dense(s, d, "m"))


@query("vw_quintile_weights", on_panel("m", f"""{_QUAL}, rk as (select *, count(*) over (partition by dt) as n, row_number() over (partition by dt order by score desc, asset) as hi, row_number() over (partition by dt order by score, asset) as lo from sc where score is not null),
sd as (select dt, asset, cap, case when lo <= floor(n * 0.2) then -1 when hi <= floor(n * 0.2) then 1 end as side from rk where floor(n * 0.2) >= 2)
select dt, asset, round(0.5 * side * cap / sum(cap) over (partition by dt, side), 6) + 0.0 as w from sd where side is not null and cap > 0"""))
def vw_quintile_weights(s, d):
    return books.value_weighted_book(value_scores(s, d), 0.2).select("dt", "asset", r("w"))


_TXN_M = """t as (select distinct 'O' || cast(o_custkey % 50 as varchar) as owner, 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(greatest(o_orderdate, l_shipdate) as date) as filed, l_returnflag as code
  from lineitem join orders on l_orderkey = o_orderkey),
g as (select distinct cast(date_trunc('month', l_shipdate) as date) as t from lineitem),
bc as (select t, ticker, count(distinct owner) as buyers from t join g on filed <= t and filed > t - 90 where code = 'R' group by 1, 2),
se as (select t, ticker, count(distinct owner) as sellers from t join g on filed <= t and filed > t - 90 where code = 'A' group by 1, 2),
nc as (select coalesce(bc.t, se.t) as t, coalesce(bc.ticker, se.ticker) as ticker, coalesce(buyers, 0) as buyers, coalesce(sellers, 0) as sellers, coalesce(buyers, 0) - coalesce(sellers, 0) as net from bc full join se on bc.t = se.t and bc.ticker = se.ticker)"""


def month_grid(s, d):
    return table(s, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("dt")).distinct()


@query("distinct_owner_counts", f"with {_TXN_M} select t, ticker, buyers as owners from bc")
def distinct_owner_counts(s, d):
    return signals.distinct_owner_counts(signals.transactions(s, d).filter("code = 'R'"), month_grid(s, d), 90)


@query("net_cluster_signal", f"""with {_TXN_M}, sectors as (select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
dm as (select t, ticker, buyers, net, net - avg(net) over (partition by t, sector) as x from nc join sectors using (ticker))
select t, ticker, buyers, net, round(coalesce((x - avg(x) over (partition by t)) / nullif(stddev_samp(x) over (partition by t), 0), 0), 6) + 0.0 as signal from dm""")
def net_cluster_signal(s, d):
    from gridloom.functions.windows import zscore_or_zero
    from gridloom.plans.views import sectors

    n = signals.net_cluster(signals.transactions(s, d), month_grid(s, d), 90).join(sectors(s, d).withColumnRenamed("asset", "ticker"), "ticker")
    x = books.demean(n.withColumn("x", F.col("net").cast("double")), "x", "t", "sector")
    return x.select("t", "ticker", "buyers", "net", r(zscore_or_zero(F.col("x"), W.partitionBy("t")), "signal"))


@query("long_vs_ew_weights", f"""with {_TXN_M}, el as (select *, count(*) over (partition by t) as n, row_number() over (partition by t order by net desc, ticker) as hi from nc where buyers >= 2),
lo as (select t, ticker, 0.5 / greatest(1, floor(n * 0.2)) as lw from el where hi <= greatest(1, floor(n * 0.2))),
sh as (select t, ticker, -0.5 / count(*) over (partition by t) as sw from nc where t in (select t from lo))
select t, ticker, round(coalesce(lw, 0) + coalesce(sw, 0), 6) + 0.0 as w from sh full join lo using (t, ticker)""")
def long_vs_ew_weights(s, d):
    n = signals.net_cluster(signals.transactions(s, d), month_grid(s, d), 90)
    x = n.select(F.col("t").alias("dt"), F.col("ticker").alias("asset"), F.col("net").alias("score"), "buyers", F.lit(1.0).alias("price"))
    return books.long_versus_all(x, 0.2).select(F.col("dt").alias("t"), F.col("asset").alias("ticker"), r("w"))


@query("cluster_backtest", f"""with {_TXN_M}, pm as (select cast(date_trunc('month', l_shipdate) as date) as t, 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, round(sum(l_extendedprice) / sum(l_quantity), 4) as price from lineitem group by 1, 2),
gr as (select g.t, a.ticker, price from g cross join (select distinct ticker from pm) a left join pm on pm.t = g.t and pm.ticker = a.ticker),
fr as (select t, ticker, lead(price) over (partition by ticker order by t) / nullif(price, 0) - 1 as fwd from gr),
el as (select *, count(*) over (partition by t) as n, row_number() over (partition by t order by net desc, ticker) as hi, row_number() over (partition by t order by net, ticker) as lo from nc where net <> 0),
wt as (select t, ticker, case when lo <= floor(n * 0.2) then -0.5 / floor(n * 0.2) when hi <= floor(n * 0.2) then 0.5 / floor(n * 0.2) else 0 end as w from el where floor(n * 0.2) >= 2)
select t, round(sum(coalesce(w, 0) * fwd), 6) + 0.0 as gross from fr left join wt using (t, ticker) group by t having sum(coalesce(w, 0) * fwd) is not null""")
def cluster_backtest(s, d):
    n = signals.net_cluster(signals.transactions(s, d), month_grid(s, d), 90).filter("net <> 0")
    w = books.quantile_book(n.select(F.col("t").alias("dt"), F.lit(1).alias("bar_no"), F.col("ticker").alias("asset"), F.col("net").alias("score")), 0.2, 1)
    p = table(s, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("dt"), F.expr("'S' || lpad(cast(l_suppkey as string), 5, '0')").alias("asset")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("price"))
    x = panel.densify(p)
    fwd = ratio(F.lead("price").over(by_asset()), F.col("price")) - 1
    return pnl.period_backtest(w, x.withColumn("fwd", fwd), 0).select(F.col("dt").alias("t"), r("gross"))


_SUE = """o as (select o_orderkey, cast(o_orderdate as date) as ann_date, o_totalprice as actual, avg(o_totalprice) over f as est, stddev_samp(o_totalprice) over f as std from orders window f as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)),
ln as (select distinct l_orderkey as o_orderkey, 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker from lineitem),
su as (select o_orderkey, ticker, ann_date, case when std > 0 then (actual - est) / std when abs(est) > 0 then (actual - est) / abs(est) else actual - est end as sue, case when std > 0 then 'std' when abs(est) > 0 then 'est' else 'raw' end as method from o join ln using (o_orderkey)),
sue as (select * from su where sue is not null)"""


@query("compute_sue", f"with {_SUE} select o_orderkey, ticker, ann_date, round(sue, 5) + 0.0 as sue, method from sue")
def compute_sue(s, d):
    return signals.compute_sue(signals.surprises(s, d)).select("o_orderkey", "ticker", "ann_date", r("sue", n=5), "method")


@query("cohort_quantiles", f"""with {_SUE}, c as (select *, cast(date_trunc('month', ann_date) as date) as cohort from sue)
select cohort, count(*) as n, round(quantile_cont(sue, 0.2), 5) + 0.0 as lo, round(quantile_cont(sue, 0.8), 5) + 0.0 as hi from c group by cohort having count(*) >= 5""")
def cohort_quantiles(s, d):
    x = signals.cohort_cuts(signals.compute_sue(signals.surprises(s, d)), 0.2)
    return x.select("cohort", "n", r("lo", n=5), r("hi", n=5)).distinct()


@query("sue_book", f"""with {_SUE}, v as (select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, stddev_samp(l_discount) as vol from lineitem group by 1),
b as (select ticker, arg_max(sue, {{'a': ann_date, 'k': o_orderkey}}) as sue from sue where ann_date <= date '1999-06-30' group by ticker),
i as (select ticker, sue, sign(sue) / vol as x from b join v using (ticker) where abs(sue) > 1.5 and vol > 0)
select ticker, round(sue, 5) + 0.0 as sue, round(x / sum(abs(x)) over (), 6) + 0.0 as w from i""")
def sue_book(s, d):
    vol = table(s, d, "lineitem").groupBy(F.expr("'S' || lpad(cast(l_suppkey as string), 5, '0')").alias("ticker")).agg(F.stddev_samp("l_discount").alias("vol"))
    return signals.sue_book(signals.compute_sue(signals.surprises(s, d)), F.lit("1999-06-30").cast("date"), vol).select("ticker", r("sue", n=5), r("w"))


@query("threshold_book_monthly", f"""with {_SUE}, g as (select distinct cast(date_trunc('month', l_shipdate) as date) as t from lineitem),
l as (select t, ticker, arg_max(sue, {{'a': ann_date, 'k': o_orderkey}}) as sue from sue join g on ann_date <= t and ann_date > t - 90 group by 1, 2),
q as (select t, quantile_cont(sue, 0.2) as lo, quantile_cont(sue, 0.8) as hi, count(*) as n from l group by t)
select t, ticker, case when sue >= hi then 1 when sue <= lo then -1 else 0 end as side from l join q using (t) where n >= 5""")
def threshold_book_monthly(s, d):
    x = signals.latest_surprise(signals.compute_sue(signals.surprises(s, d)), month_grid(s, d), 90)
    q = x.groupBy("t").agg(F.percentile("sue", F.lit([0.2, 0.8])).alias("p"), F.count("*").alias("n")).filter("n >= 5")
    q = q.select("t", F.get("p", F.lit(0)).alias("lo"), F.get("p", F.lit(1)).alias("hi"))
    return x.join(F.broadcast(q), "t").select("t", "ticker", F.when(F.col("sue") >= F.col("hi"), 1).when(F.col("sue") <= F.col("lo"), -1).otherwise(0).alias("side"))


@query("threshold_book_backtest", on_panel("s", f"""{_SUE}, mp as (select last_day(dt) as dt, asset, arg_max(price, dt) as price from panel where price is not null group by 1, 2),
mo as (select last_day(cast(m as date)) as dt from (select unnest(generate_series(date_trunc('month', min(dt)), date_trunc('month', max(dt)), interval 1 month)) as m from mp)),
fr as (select mo.dt, a.asset, lead(price) over (partition by a.asset order by mo.dt) / nullif(price, 0) - 1 as fwd from mo cross join (select distinct asset from mp) a left join mp on mp.dt = mo.dt and mp.asset = a.asset),
la as (select dt, ticker as asset, arg_max(round(sue, 9), {{'a': ann_date, 'k': o_orderkey}}) as sue from sue join mo on ann_date <= dt and ann_date > dt - 90 where ticker in (select asset from mp) group by 1, 2),
q as (select dt, quantile_cont(sue, 0.2) as lo, quantile_cont(sue, 0.8) as hi from la group by dt having count(*) >= 5),
wt as (select dt, asset, case when sue <= lo then -0.5 / count(case when sue <= lo then 1 end) over (partition by dt) when sue >= hi then 0.5 / count(case when sue >= hi then 1 end) over (partition by dt) else 0 end as w from la join q using (dt)),
pb as (select dt, asset, fwd, coalesce(w, 0) as w from fr left join wt using (dt, asset)),
pt as (select *, coalesce(abs(w - lag(w) {_A}), 0) as tr from pb)
select dt, round(sum(w * fwd), 6) + 0.0 as gross, round(sum(tr) * 10 / 10000, 6) + 0.0 as cost, round(sum(w * fwd) - sum(tr) * 10 / 10000, 6) + 0.0 as net from pt group by dt having sum(w * fwd) is not null"""))
def threshold_book_backtest(s, d):
    """The month-end book of ``threshold_book_monthly``'s rule: weights of the latest surprises earn the next month's return, less costs."""
    p = panel.resample_last(weekly(s, d, "s").filter("price is not null"), F.last_day("dt"), "price").withColumnRenamed("period", "dt")
    months = panel.month_ends(p)
    priced = p.select(F.col("asset").alias("ticker")).distinct()
    seen = signals.latest_surprise(signals.compute_sue(signals.surprises(s, d)).join(priced, "ticker", "left_semi"), months, 90)
    w = books.threshold_book(seen.select(F.col("t").alias("dt"), F.col("ticker").alias("asset"), F.round("sue", 9).alias("score")), 0.2)
    x = months.crossJoin(p.select("asset").distinct()).join(p, ["dt", "asset"], "left")
    fwd = ratio(F.lead("price").over(by_asset()), F.col("price")) - 1
    return pnl.period_backtest(w, x.withColumn("fwd", fwd), 10).select("dt", *(r(c) for c in ("gross", "cost", "net")))


# neutralisers
_BW = f"""{_MOM}, {_DECILE}, mk as (select *, avg(ret) over (partition by dt) as mkt from rets),
bb as (select dt, asset, covar_samp(ret, mkt) over f / nullif(var_samp(mkt) over f, 0) as b0, count(ret) over f as k from mk window f as (partition by asset order by dt rows between 25 preceding and current row)),
bx as (select wt.dt, wt.asset, w, case when k >= 13 then b0 end as beta from wt join bb on bb.dt = wt.dt and bb.asset = wt.asset)"""


def _with_beta(s, d):
    w = books.decile_weights(momentum_scores(s, d), 0.1, 4)
    b = panel.with_market(returns(s, d)).select("dt", "asset", panel.rolling_beta("ret", "mkt", 26, 13).alias("beta"))
    return w.join(b, ["dt", "asset"])


@query("beta_neutralize", on_panel("w", f"""{_BW}, a as (select *, case when w <> 0 then coalesce(beta, avg(case when w <> 0 then beta end) over (partition by dt), 1) end as b, count(case when w <> 0 then 1 end) over (partition by dt) as n, sum(abs(w)) over (partition by dt) as g from bx),
c as (select *, b - avg(b) over (partition by dt) as bc, case when w <> 0 then w end - avg(case when w <> 0 then w end) over (partition by dt) as dd from a),
p as (select *, dd - case when sqrt(sum(bc * bc) over (partition by dt)) > 1e-10 then sum(bc * dd) over (partition by dt) / sum(bc * bc) over (partition by dt) else 0 end * bc as rr from c)
select dt, asset, round(case when n >= 3 and w <> 0 then case when sum(abs(rr)) over (partition by dt) > 1e-12 then rr * g / sum(abs(rr)) over (partition by dt) else 0 end else w end, 5) + 0.0 as w from p"""))
def beta_neutralize(s, d):
    return books.beta_neutral(_with_beta(s, d)).select("dt", "asset", r("w", n=5))


_RES = """rs as (select *, avg(x) over (partition by dt) as mx, avg(case when x is not null then v end) over (partition by dt) as mv, var_pop(x) over (partition by dt) as sxx, covar_pop(case when x is not null then v end, x) over (partition by dt) as sxy, count(x) over (partition by dt) as kx from rv)
select dt, asset, round(case when kx > 0 then case when x is not null and v is not null then v - mv - case when sxx > 1e-12 then sxy / sxx else 0 end * (x - mx) end else v - avg(v) over (partition by dt) end, 6) + 0.0 as w from rs"""


@query("neutralize_pinv", on_panel("s", f"rv as (select dt, asset, ret as v, case when ret is not null then funding end as x from rets), {_RES}"))
def neutralize_pinv(s, d):
    x = returns(s, d, "s").select("dt", "asset", F.col("ret").alias("v"), "funding")
    return risk.neutralise(x, "v", ["funding"], fill=False).select("dt", "asset", r("v", "w"))


def _residual_sql(loadings: list[str], start: str) -> str:
    """Views that take one loading after the other out of v and out of the loadings after it, per date; what is left of a dependent one is skipped."""
    views, last = [], start
    for k, x in enumerate(loadings):
        rest = ["v", *loadings[k + 1 :]]
        slope = lambda c: f"case when sum({x} * {x}) over p > 1e-9 * sum({x}_0 * {x}_0) over p then sum({c} * {x}) over p / sum({x} * {x}) over p else 0 end"  # noqa: B023, E731
        views.append(f"n{k} as (select dt, asset, {', '.join(f'{c} - {slope(c)} * {x} as {c}' for c in rest)}{''.join(f', {c}_0' for c in loadings[k + 1:])} from {last} window p as (partition by dt))")
        last = f"n{k}"
    return ", ".join(views)


@query("neutralize_pinv_k5", on_panel("s", f"""x as (select dt, asset, coalesce(ret, 0) as v, 1.0::double as o, coalesce(funding, 0) * 20 as a, coalesce(ln(dollar_volume) - 10, 0) as b, coalesce(funding, 0) * 7 as c, coalesce(nav / nullif(price, 0), 0) as e from rets),
z as (select *, o as o_0, a as a_0, b as b_0, c as c_0, e as e_0 from x), {_residual_sql(list("oabce"), "z")} select dt, asset, round(v, 6) + 0.0 as w from n4"""))
def neutralize_pinv_k5(s, d):
    """Returns made neutral to dollars, funding (twice, so that the loadings are collinear), size and value."""
    x = returns(s, d, "s").select(
        "dt", "asset", F.col("ret").alias("v"), (F.col("funding") * 20).alias("a"), (F.ln("dollar_volume") - 10).alias("b"), (F.col("funding") * 7).alias("c"), ratio(F.col("nav"), F.col("price")).alias("e")
    )
    return risk.neutralise(x, "v", ["a", "b", "c", "e"]).select("dt", "asset", r("v", "w"))


@query("value_neutral", on_panel("m", f"""z as (select dt, asset, (q - avg(q) over (partition by dt)) / (stddev_samp(q) over (partition by dt) + 1e-12) as v, ln(dollar_volume) as l from (select *, nav / nullif(price, 0) as q from dense)),
rv as (select dt, asset, v, case when v is not null then l end as x from z), {_RES}"""))
def value_neutral(s, d):
    x = dense(s, d, "m").withColumn("q", ratio(F.col("nav"), F.col("price")))
    x = x.select("dt", "asset", zscore(F.col("q")).alias("v"), F.ln("dollar_volume").alias("l"))
    return books.residualise(x, "v", "l").select("dt", "asset", r("v", "w"))


@query("dollar_neutral_gross1", on_panel("s", "c as (select dt, asset, ret - avg(ret) over (partition by dt) as x from rets) select dt, asset, round(x / nullif(sum(abs(x)) over (partition by dt), 0), 6) + 0.0 as w from c"))
def dollar_neutral_gross1(s, d):
    return books.dollar_neutral(returns(s, d, "s"), "ret").select("dt", "asset", r("w"))


@query("combine_signals", on_panel("w", f"""x as (select dt, asset, (ret - avg(ret) over (partition by dt)) / (stddev_samp(ret) over (partition by dt) + 1e-12) as a, (funding - avg(funding) over (partition by dt)) / (stddev_samp(funding) over (partition by dt) + 1e-12) as b from rets)
select dt, asset, round(case when coalesce(a, b) is not null then (coalesce(a, 0) * 0.6 + coalesce(b, 0) * -0.4) / 1.0 end, 6) + 0.0 as signal from x"""))
def combine_signals(s, d):
    return signals.combine(returns(s, d), {"ret": 0.6, "funding": -0.4}).select("dt", "asset", r("signal"))


@query("join_outer_blend", on_panel("w", """a as (select dt, asset, ret from rets where ret is not null), b as (select dt, asset, funding from dense where funding is not null and volume > 300)
select dt, asset, round(coalesce(ret, 0) - coalesce(funding, 0), 6) + 0.0 as v from a full join b using (dt, asset)"""))
def join_outer_blend(s, d):
    x = returns(s, d)
    a, b = x.filter("ret is not null").select("dt", "asset", "ret"), x.filter("funding is not null and volume > 300").select("dt", "asset", "funding")
    return a.join(b, ["dt", "asset"], "full").select("dt", "asset", r(F.coalesce("ret", F.lit(0.0)) - F.coalesce("funding", F.lit(0.0)), "v"))


_NET = f"{_MOM}, {_DECILE}, {_BT}"


def _net(s, d):
    return pnl.run_backtest(books.decile_weights(momentum_scores(s, d), 0.1, 4), dense(s, d), 10).withColumn("strategy_id", F.lit("mom"))


@query("leverage_confidence", on_panel("w", f"""{_NET}, m as (select dt, case when count(net) over f >= 13 then avg(net) over f end as mu, case when count(net) over f >= 13 then stddev_samp(net) over f end as sd from bt window f as (order by dt rows between 25 preceding and current row)),
lv as (select dt, 0.1 / nullif(sd * sqrt(52), 0) * least(greatest((mu / nullif(sd, 0) - 1.0 / sqrt(26)) / nullif(mu / nullif(sd, 0), 0), 0), 1) as lev from m)
select dt, round(lag(lev) over (order by dt), 5) + 0.0 as lev from lv"""))
def leverage_confidence(s, d):
    w = W.partitionBy("strategy_id").orderBy("dt")
    f = w.rowsBetween(-25, 0)
    mu, sd = gated(F.avg("net"), F.col("net"), 13, f), gated(F.stddev_samp("net"), F.col("net"), 13, f)
    sr = ratio(mu, sd)
    conf = F.least(F.greatest(ratio(sr - 1.0 / 26**0.5, sr), F.lit(0.0)), F.lit(1.0))
    x = _net(s, d).withColumn("lev", ratio(F.lit(0.1), sd * 52**0.5) * conf)
    return x.select("dt", r(F.lag("lev").over(w), "lev", 5))


@query("cap_position", on_panel("s", "c as (select dt, asset, ret - avg(ret) over (partition by dt) as x from rets), w as (select dt, asset, x / nullif(sum(abs(x)) over (partition by dt), 0) as w from c) select dt, asset, round(least(greatest(w, -0.05), 0.05), 6) + 0.0 as w from w where w is not null"))
def cap_position(s, d):
    return books.dollar_neutral(returns(s, d, "s"), "ret").filter("w is not null").select("dt", "asset", r(books.cap_position(F.col("w"), 0.05), "w"))


@query("cap_gross", on_panel("s", "g as (select dt, asset, funding as w, sum(abs(funding)) over (partition by dt) as g from dense) select dt, asset, round(case when g > 1 then w * 1.0 / g else w end, 6) + 0.0 as w from g"))
def cap_gross(s, d):
    return books.cap_gross(dense(s, d, "s").select("dt", "asset", F.col("funding").alias("w")), 1.0).select("dt", "asset", r("w"))


@query("cap_turnover", on_panel("w", """a as (select asset, funding as w from dense where bar_no = (select max(bar_no) - 1 from cal) and funding is not null), b as (select asset, funding as w from dense where bar_no = (select max(bar_no) from cal) and funding is not null),
j as (select asset, coalesce(a.w, 0) as w0, coalesce(b.w, 0) as w1 from a full join b using (asset)), t as (select sum(abs(w1 - w0)) as t from j)
select asset, round(w0 + (w1 - w0) * case when t > 0.1 then 0.1 / t else 1 end, 6) + 0.0 as w from j, t"""))
def cap_turnover(s, d):
    x = dense(s, d).withColumn("w", F.col("funding"))
    now, target = (books.latest_book(x, back).filter("w is not null") for back in (1, 0))
    return books.cap_turnover(now, target, 0.1).select("asset", r("w"))


@query("drawdown_scale", on_panel("w", f"""{_NET}, eqt as (select dt, exp(sum(ln(1 + greatest(net, -0.999999))) over (order by dt)) as eq from bt), dd as (select dt, eq / greatest(max(eq) over (order by dt), 0) - 1 as dd from eqt)
select dt, round(least(greatest(1 + dd / 0.5, 0), 1), 5) + 0.0 as scale from dd"""))
def drawdown_scale(s, d):
    x = pnl.drawdown(_net(s, d).withColumn("ret", F.col("net")))
    return x.select("dt", r(F.least(F.greatest(1 + F.col("drawdown") / 0.5, F.lit(0.0)), F.lit(1.0)), "scale", 5))


_ENG = """x as (select dt, asset, bar_no, ret, (ret - avg(ret) over (partition by dt)) / (stddev_samp(ret) over (partition by dt) + 1e-12) as a, (funding - avg(funding) over (partition by dt)) / (stddev_samp(funding) over (partition by dt) + 1e-12) as b from rets),
sg as (select dt, asset, bar_no, ret, case when coalesce(a, b) is not null then (coalesce(a, 0) * 0.5 + coalesce(b, 0) * -0.5) end as s0 from x),
dn as (select *, s0 - avg(s0) over (partition by dt) as c from sg),
w1 as (select *, least(greatest(c / nullif(sum(abs(c)) over (partition by dt), 0), -0.1), 0.1) as w from dn),
w2 as (select dt, asset, bar_no, ret, case when sum(abs(w)) over (partition by dt) > 0.8 then w * 0.8 / sum(abs(w)) over (partition by dt) else w end as w from w1)"""


def engine_weights(s, d):
    """Blend, dollar-neutral, position cap, gross cap."""
    x = signals.combine(returns(s, d), {"ret": 0.5, "funding": -0.5})
    x = books.dollar_neutral(x, "signal").withColumn("w", books.cap_position(F.col("w"), 0.1))
    return books.cap_gross(x, 0.8)


@query("engine_build", on_panel("w", f"{_ENG} select dt, asset, round(w, 6) + 0.0 as w from w2"))
def engine_build(s, d):
    return engine_weights(s, d).select("dt", "asset", r("w"))


@query("engine_backtest", on_panel("w", f"""{_ENG}, l as (select *, coalesce(lag(w) {_A}, 0) as pw, coalesce(abs(w - lag(w) {_A}), 0) as tr from w2)
select dt, round(sum(pw * ret), 6) + 0.0 as gross, round(sum(tr) * 10 / 10000, 6) + 0.0 as cost from l group by dt having sum(pw * ret) is not null"""))
def engine_backtest(s, d):
    x = engine_weights(s, d)
    x = x.withColumns({"pw": F.coalesce(F.lag("w").over(by_asset()), F.lit(0.0)), "tr": F.coalesce(F.abs(F.col("w") - F.lag("w").over(by_asset())), F.lit(0.0))})
    out = x.groupBy("dt").agg(F.sum(F.col("pw") * F.col("ret")).alias("gross"), (F.sum("tr") * 10 / 10000).alias("cost")).filter("gross is not null")
    return out.select("dt", r("gross"), r("cost"))


@query("target_shares", on_panel("w", f"{_MOM}, {_DECILE}, w0 as (select wt.asset, wt.w, price from wt join dense d on d.dt = wt.dt and d.asset = wt.asset where wt.bar_no = {_LAST}) select asset, cast(round_even(w * 1000000 / nullif(price, 0), 0) as bigint) as shares from w0"))
def target_shares(s, d):
    return _targets(s, d).select("asset", "shares")


def _targets(s, d, back=0):
    w = books.latest_book(books.decile_weights(momentum_scores(s, d), 0.1, 4), back)
    return books.target_shares(w.join(dense(s, d).select("dt", "asset", "price"), ["dt", "asset"]), 1_000_000)


_SH = f"""sh as (select wt.bar_no, wt.asset, price, cast(round_even(wt.w * 1000000 / nullif(price, 0), 0) as bigint) as shares from wt join dense d on d.dt = wt.dt and d.asset = wt.asset where wt.bar_no in ({_LAST}, {_PREV})),
od as (select asset, coalesce(b.shares, 0) - coalesce(a.shares, 0) as delta, b.price from (select * from sh where bar_no = {_PREV}) a full join (select * from sh where bar_no = {_LAST}) b using (asset))"""


@query("orders_delta", on_panel("w", f"{_MOM}, {_DECILE}, {_SH} select asset, delta from od where delta <> 0"))
def orders_delta(s, d):
    return books.orders_delta(_targets(s, d, 1), _targets(s, d))


@query("execution_plan", on_panel("w", f"{_MOM}, {_DECILE}, {_SH} select asset, delta, case when delta > 0 then 'buy' else 'sell' end as side, round(abs(delta) * price, 2) + 0.0 as notional from od where delta <> 0 and price is not null"))
def execution_plan(s, d):
    o = books.orders_delta(_targets(s, d, 1), _targets(s, d)).join(_targets(s, d).select("asset", "price"), "asset")
    return o.filter("price is not null").select("asset", "delta", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"), r(F.abs("delta") * F.col("price"), "notional", 2))


@query("turnover_cost", on_panel("w", f"{_MOM}, {_DECILE}, {_SH} select count(*) as orders, round(sum(abs(delta) * price), 2) + 0.0 as traded, round(sum(abs(delta) * price) * 10 / 10000, 4) + 0.0 as cost from od where delta <> 0 and price is not null"))
def turnover_cost(s, d):
    x = execution_plan(s, d).join(_targets(s, d).select("asset", "price"), "asset").withColumn("v", F.abs("delta") * F.col("price"))
    return x.agg(F.count("*").alias("orders"), r(F.sum("v"), "traded", 2), r(F.sum("v") * 10 / 10000, "cost", 4))


@query("orders_truncated", on_panel("w", f"{_MOM}, {_DECILE}, w0 as (select wt.asset, least(greatest(wt.w, -0.05), 0.05) as w, price from wt join dense d on d.dt = wt.dt and d.asset = wt.asset where wt.bar_no = {_LAST} and price > 0) select asset, cast(trunc(w * 1000000 / price) as bigint) as shares from w0"))
def orders_truncated(s, d):
    w = books.latest_book(books.decile_weights(momentum_scores(s, d), 0.1, 4)).join(dense(s, d).select("dt", "asset", "price"), ["dt", "asset"]).filter("price > 0")
    return w.select("asset", (books.cap_position(F.col("w"), 0.05) * 1_000_000 / F.col("price")).cast("long").alias("shares"))


@query("slice_quantity", "select o_orderkey, i as slice, cast(case when o_custkey % 2 = 0 then 1 else -1 end * (q // 7 + case when i < q % 7 then 1 else 0 end) as bigint) as slice_qty from (select o_orderkey, o_custkey, cast(floor(o_totalprice) as bigint) as q from orders), (select unnest(range(7)) as i)")
def slice_quantity(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.floor("o_totalprice") * F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(-1)).alias("qty"))
    return books.slices(o, 7).select("o_orderkey", F.col("slice").cast("long").alias("slice"), "slice_qty")


@query("book_exposure", on_panel("w", f"{_MOM}, {_DECILE} select dt, round(sum(abs(w)), 6) + 0.0 as gross, round(sum(w), 6) + 0.0 as net, round(max(abs(w)), 6) + 0.0 as largest from wt group by dt"))
def book_exposure(s, d):
    w = books.decile_weights(momentum_scores(s, d), 0.1, 4)
    return w.groupBy("dt").agg(r(F.sum(F.abs("w")), "gross"), r(F.sum("w"), "net"), r(F.max(F.abs("w")), "largest"))


@query("authorize_intents", """with st as (select c_custkey as agent, c_acctbal < -900 as killed, c_mktsegment <> 'BUILDING' as registered, abs(c_acctbal) / 10000 as vol, c_nationkey / 25.0 as corr from customer where c_nationkey <> 3)
select o_orderkey, case when coalesce(killed, false) then 'killed' when not coalesce(registered, false) then 'unregistered' when vol > 0.8 then 'regime_vol' when corr > 0.9 then 'regime_corr' end as reason from orders left join st on o_custkey = agent""")
def authorize_intents(s, d):
    c = table(s, d, "customer").filter("c_nationkey <> 3")
    st = c.selectExpr("c_custkey as agent", "c_acctbal < -900 as killed", "c_mktsegment <> 'BUILDING' as registered", "abs(c_acctbal) / 10000 as vol", "c_nationkey / 25.0D as corr")
    return books.authorise(table(s, d, "orders").withColumn("agent", F.col("o_custkey")), st, 0.8, 0.9).select("o_orderkey", "reason")


@query("sticky_kill", on_panel("w", f"""{_NET}, eqt as (select dt, exp(sum(ln(1 + greatest(net, -0.999999))) over (order by dt)) as eq from bt), dd as (select dt, eq / greatest(max(eq) over (order by dt), 0) - 1 as dd from eqt)
select dt, bool_or(dd <= -0.03) over (order by dt) as tripped from dd"""))
def sticky_kill(s, d):
    return books.sticky_kill(pnl.drawdown(_net(s, d).withColumn("ret", F.col("net")))).select("dt", "tripped")


_PAIRS = "pr as (select dt, asset, nav as spot, price as perp, funding, coalesce(funding > 0, false) as live from dense)"


@query("cash_and_carry", on_panel("w", f"""{_PAIRS}, a as (select *, spot / nullif(lag(spot) {_A}, 0) - 1 - (perp / nullif(lag(perp) {_A}, 0) - 1) + coalesce(funding, 0) as g, coalesce(lag(live) {_A}, false) as held from pr),
b as (select *, held and not coalesce(lag(held) {_A}, false) as st from a)
select dt, asset, held, st as episode_start, round(case when held then coalesce(g, 0) else 0 end, 6) + 0.0 as gross, round(case when held then coalesce(g, 0) - 0.0002 - case when st then 0.002 else 0 end else 0 end, 6) + 0.0 as net from b"""))
def cash_and_carry(s, d):
    return carry_rows(s, d).select("dt", "asset", "held", "episode_start", r("gross"), r("net"))


def carry_rows(s, d):
    x = dense(s, d).select("dt", "asset", F.col("nav").alias("spot"), F.col("price").alias("perp"), "funding", F.coalesce(F.col("funding") > 0, F.lit(False)).alias("live"))
    return pnl.cash_and_carry(x, "live", 2, 20)


@query("deploy_signal", on_panel("w", """c as (select asset, dt, funding, row_number() over (partition by asset order by dt desc) as k from dense where funding is not null),
g as (select asset, case when cast(substr(asset, 7, 1) as int) <= 2 then 'liquid' else 'tail' end as bucket, sum(funding) as total, count(*) as obs from c where k <= 30 group by 1, 2)
select asset, bucket, obs, round(total, 6) + 0.0 as total, round((total - case bucket when 'liquid' then 0.0014 else 0.004 end) / obs * 52, 6) + 0.0 as net_annual,
 (total - case bucket when 'liquid' then 0.0014 else 0.004 end) / obs * 52 > 0.02 and total > 3 * case bucket when 'liquid' then 0.0014 else 0.004 end as deploy from g"""))
def deploy_signal(s, d):
    costs = s.createDataFrame([("liquid", 14.0), ("tail", 40.0)], "bucket string, roundtrip_bps double")
    x = dense(s, d).withColumn("bucket", F.when(F.substring("asset", 7, 1).cast("int") <= 2, "liquid").otherwise("tail"))
    return signals.deploy_signal(x, costs, 30, 52, 0.02, 3).select("asset", "bucket", "obs", r("total"), r("net_annual"), "deploy")


_IMP = f"""{_MOM}, {_DECILE}, {_HELD}, v as (select dt, asset, case when count(ret) over f >= 6 then stddev_samp(ret) over f end as sigma, case when count(dollar_volume) over f >= 6 then avg(dollar_volume) over f end as adv from rets window f as (partition by asset order by dt rows between 12 preceding and current row)),
tr as (select e.dt, e.asset, e.tr as dw, sigma, coalesce(adv, median(adv) over (partition by e.dt)) as adv from e join v on v.dt = e.dt and v.asset = e.asset),
au as (select unnest([1e3, 1e5, 1e7]) as aum),
ic as (select dt, aum, sum(dw * (0.0005 + 0.01 * coalesce(sigma, 0) * sqrt(coalesce(dw * aum / nullif(adv, 0), 0)))) as cost from tr, au group by dt, aum)"""


def _impact(s, d):
    x = returns(s, d)
    w = trailing(13)
    vol = x.select("dt", "asset", gated(F.stddev_samp("ret"), F.col("ret"), 6, w).alias("sigma"), gated(F.avg("dollar_volume"), F.col("dollar_volume"), 6, w).alias("adv"))
    h = books.held(books.decile_weights(momentum_scores(s, d), 0.1, 4), x, lag=1).withColumn("w", F.coalesce("w", F.lit(0.0)))
    dw = h.select("dt", "asset", F.coalesce(F.abs(F.col("w") - F.lag("w").over(by_asset())), F.lit(0.0)).alias("dw"))
    return pnl.impact_costs(dw.join(vol, ["dt", "asset"]), [1e3, 1e5, 1e7], 0.0005, 0.01)


@query("impact_costs", on_panel("w", f"{_IMP} select dt, aum, round(cost, 6) + 0.0 as cost from ic"))
def impact_costs(s, d):
    return _impact(s, d).select("dt", "aum", r("cost"))


_CURVE = f"{_IMP}, bt as (select dt, coalesce(sum(lw * ret), 0) as gross from e group by dt), cv as (select aum, avg(gross - cost) / nullif(stddev_samp(gross - cost), 0) * sqrt(52) as sharpe from ic join bt using (dt) group by aum)"


def _curve(s, d):
    g = _net(s, d).select("dt", "gross")
    return _impact(s, d).join(g, "dt").withColumn("net", F.col("gross") - F.col("cost")).groupBy("aum").agg(stats.sharpe("net", 52).alias("sharpe"))


@query("capacity_curve", on_panel("w", f"{_CURVE} select aum, round(sharpe, 5) + 0.0 as sharpe from cv"))
def capacity_curve(s, d):
    return _curve(s, d).select("aum", r("sharpe", n=5))


@query("capacity_zero", on_panel("w", f"{_CURVE} select min(case when sharpe <= 0 then aum end) as dead_aum from cv"))
def capacity_zero(s, d):
    return pnl.capacity_zero(_curve(s, d))


@query("entry_lag_sweep", on_panel("w", f"""{_MOM}, {_DECILE}, lg as (select unnest([0, 1, 2, 3]) as lag), lw as (select lag, c.dt, wt.asset, w from wt, lg, cal c where c.bar_no = wt.bar_no + lag)
select lag, count(*) as n, round(sum(w * ret), 5) + 0.0 as pnl from lw join (select dt, asset, lead(ret) {_A} as ret from rets) r on r.dt = lw.dt and r.asset = lw.asset group by lag"""))
def entry_lag_sweep(s, d):
    w = pnl.lagged_weights(books.decile_weights(momentum_scores(s, d), 0.1, 4), panel.calendar(panel_of(s, d)), [0, 1, 2, 3])
    f = returns(s, d).select("dt", "asset", F.lead("ret").over(by_asset()).alias("ret"))
    return w.join(f, ["dt", "asset"]).groupBy("lag").agg(F.count("*").alias("n"), r(F.sum(F.col("w") * F.col("ret")), "pnl", 5))


def panel_of(s, d, kind="w"):
    from gridloom.plans.views import panel as view

    return view(s, d, kind)


@query("survivorship_bound", on_panel("s", f"""sc as (select dt, bar_no, asset, funding as score from dense), {_decile_sql(0.1, 1)},
f as (select dt, asset, lead(price) {_A} / nullif(price, 0) - 1 as fwd from dense)
select wt.dt, round(sum(w * case when w > 0 and fwd is null then -0.3 else fwd end), 6) + 0.0 as bound from wt join f on f.dt = wt.dt and f.asset = wt.asset group by wt.dt"""))
def survivorship_bound(s, d):
    x = dense(s, d, "s")
    w = books.decile_weights(x.withColumn("score", F.col("funding")), 0.1, 1)
    f = x.select("dt", "asset", (ratio(F.lead("price").over(by_asset()), F.col("price")) - 1).alias("fwd"))
    loss = F.when((F.col("w") > 0) & F.col("fwd").isNull(), -0.3).otherwise(F.col("fwd"))
    return w.join(f, ["dt", "asset"]).groupBy("dt").agg(r(F.sum(F.col("w") * loss), "bound"))


@query("delisting_scenario", on_panel("s", """l as (select asset, max(bar_no) as last_bar, arg_max(price, bar_no) as price, (select max(bar_no) from cal) as top from dense where price is not null group by asset)
select asset, c.dt, round(l.price * 0.7, 4) + 0.0 as price from l join cal c on c.bar_no = last_bar + 1 where last_bar < top"""))
def delisting_scenario(s, d):
    x = dense(s, d, "s")
    cal = panel.calendar(x).withColumn("top", F.max("bar_no").over(W.partitionBy()))
    last = x.filter("price is not null").groupBy("asset").agg(F.max("bar_no").alias("last_bar"), F.max_by("price", "bar_no").alias("price"))
    return last.join(cal, F.col("bar_no") == F.col("last_bar") + 1).filter("last_bar < top").select("asset", "dt", r(F.col("price") * 0.7, "price", 4))


@query("drift_scenario", on_panel("w", """ev as (select asset, bar_no as b0 from dense where bar_no % 60 = 1 and price is not null),
jj as (select d.dt, d.asset, d.price, ev.b0, case when ev.b0 is null then 1 else pow(1.02, least(d.bar_no - ev.b0, 10) / 10.0) end as m from dense d left join ev on ev.asset = d.asset and ev.b0 < d.bar_no)
select dt, asset, round(price * coalesce(product(m), 1), 4) + 0.0 as price from jj group by dt, asset, price"""))
def drift_scenario(s, d):
    x = dense(s, d)
    hit = F.when((F.col("bar_no") % 60 == 1) & F.col("price").isNotNull(), F.col("bar_no"))
    # a hit's ramp grows for ten bars and then stays: hits of the last ten bars by their bars since, earlier ones in full
    old, new = by_asset().rowsBetween(W.unboundedPreceding, -11), by_asset().rowsBetween(-10, -1)
    recent = F.coalesce(F.count(hit).over(new) * F.col("bar_no") - F.sum(hit).over(new), F.lit(0))
    ramp = F.coalesce(F.count(hit).over(old), F.lit(0)) + recent / 10.0
    return x.select("dt", "asset", r(F.col("price") * F.pow(F.lit(1.02), ramp), "price", 4))


@query("shuffle_placebo", on_panel("w", """x as (select dt, asset, ret from rets where ret is not null), a as (select dt, asset, row_number() over (partition by dt order by asset) as k from x),
b as (select dt, ret, row_number() over (partition by dt order by md5(asset || '|' || strftime(dt, '%Y-%m-%d') || '|7')) as k from x) select dt, asset, round(ret, 6) + 0.0 as ret from a join b using (dt, k)"""))
def shuffle_placebo(s, d):
    """Values dealt anew among a date's assets by hash order: the same multiset on every run."""
    x = returns(s, d).filter("ret is not null").select("dt", "asset", "ret")
    a = x.withColumn("k", F.row_number().over(by_date().orderBy("asset"))).select("dt", "asset", "k")
    b = x.withColumn("k", F.row_number().over(by_date().orderBy(F.md5(F.concat_ws("|", "asset", F.date_format("dt", "yyyy-MM-dd"), F.lit("7")))))).select("dt", "k", "ret")
    return a.join(b, ["dt", "k"]).select("dt", "asset", r("ret"))


@query("drop_top3", on_panel("w", f"{_MOM}, {_DECILE}, t as (select asset, avg(abs(w)) as m from wt group by asset), k as (select asset, row_number() over (order by round(m, 9) desc, asset) as k from t) select asset from k where k > 3"))
def drop_top3(s, d):
    w = books.decile_weights(momentum_scores(s, d), 0.1, 4).groupBy("asset").agg(F.round(F.avg(F.abs("w")), 9).alias("m"))
    top = w.orderBy(F.desc("m"), "asset").limit(3)
    return w.join(top, "asset", "left_anti").select("asset")


@query("diff_weights", on_panel("w", f"{_MOM}, {_DECILE} select asset, round(b.w - a.w, 6) + 0.0 as dw from (select asset, w from wt where bar_no = {_PREV}) a join (select asset, w from wt where bar_no = {_LAST}) b using (asset) order by round(abs(b.w - a.w), 9) desc, asset limit 10"))
def diff_weights(s, d):
    w = books.decile_weights(momentum_scores(s, d), 0.1, 4)
    a, b = books.latest_book(w, 1).select("asset", F.col("w").alias("w0")), books.latest_book(w).select("asset", "w")
    x = a.join(b, "asset").withColumn("dw", F.col("w") - F.col("w0"))
    return x.orderBy(F.round(F.abs("dw"), 9).desc(), "asset").limit(10).select("asset", r("dw"))
