"""Snapshot differences, monitoring and live diagnosis."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import ratio
from gridloom.operators import books, pnl, quality, stats
from gridloom.plans.q_aggregates import ic_sql, nw_sql
from gridloom.plans.q_books import _BT, _DECILE, _HELD, _MOM, momentum_scores
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r, returns, table
from gridloom.plans.views import panel as view

_A = "over (partition by asset order by dt)"

# the later snapshot: brands of one digit revised in some weeks, a wobble in others, cells gone and added
_EDIT = "case when week % 11 = 3 and length(asset) = 7 then price * 1.01 when week % 7 = 2 then price * (1 + 1e-7) else price end"
_SNAP = f"""wk as (select p.dt, p.asset, price, cast((p.dt - date '1995-01-02') / 7 as bigint) as week from panel p where price is not null),
s0 as (select dt, asset, price from wk where not (week % 29 = 5 and asset = 'Brand#3')),
s1 as (select dt, asset, {_EDIT} as price from wk where not (week % 23 = 4 and asset = 'Brand#5')),
sd as (select distinct a.dt from s0 a join s1 b on a.dt = b.dt), sa as (select distinct a.asset from s0 a join s1 b on a.asset = b.asset),
c0 as (select coalesce(a.dt, b.dt) as dt, coalesce(a.asset, b.asset) as asset, a.price as p0, b.price as p1 from s0 a full join s1 b on a.dt = b.dt and a.asset = b.asset),
ce as (select *, abs(p1 - p0) / nullif(abs(p0), 0) as rel, p0 / nullif(lag(p0) over w, 0) - 1 as r0, p1 / nullif(lag(p1) over w, 0) - 1 as r1 from c0 where dt in (select dt from sd) and asset in (select asset from sa) window w as (partition by asset order by dt)),
ck as (select *, case when p0 is null and p1 is not null then 'appeared' when p0 is not null and p1 is null then 'vanished' when rel > 1e-6 then 'changed' when rel > 1e-9 then 'noise' else 'same' end as kind, coalesce(abs(r1 - r0) > 1e-6, false) as ret_changed from ce)"""


def snapshots(s, d):
    week = F.floor(F.datediff("dt", F.lit("1995-01-02").cast("date")) / 7).alias("week")
    p = view(s, d).filter("price is not null").select("dt", "asset", "price", week)
    old = p.filter("not (week % 29 = 5 and asset = 'Brand#3')").select("dt", "asset", "price")
    new = p.filter("not (week % 23 = 4 and asset = 'Brand#5')").select("dt", "asset", F.expr(_EDIT.replace("1.01", "1.01D").replace("1e-7", "1e-7D")).alias("price"))
    return old, new


@query("snapshot_diff", on_panel("w", f"{_SNAP} select count(*) as cells, count_if(kind = 'changed') as changed, count_if(kind = 'noise') as noise, count_if(kind = 'appeared') as appeared, count_if(kind = 'vanished') as vanished, count_if(ret_changed) as ret_changed from ck"))
def snapshot_diff(s, d):
    return quality.snapshot_summary(quality.snapshot_cells(*snapshots(s, d)))


@query("top_revised", on_panel("w", f"{_SNAP} select asset, count_if(kind = 'changed') as changed from ck group by 1 having count_if(kind = 'changed') > 0 order by changed desc, asset limit 10"))
def top_revised(s, d):
    return quality.top_revised(quality.snapshot_cells(*snapshots(s, d)))


@query("revision_series", on_panel("w", f"""{_SNAP}, yc as (select *, year(dt) as pair from ck) select pair, count(*) as cells, count_if(kind = 'changed') as changed, count_if(kind = 'noise') as noise, count_if(kind = 'appeared') as appeared, count_if(kind = 'vanished') as vanished, count_if(ret_changed) as ret_changed from yc group by pair"""))
def revision_series(s, d):
    return quality.snapshot_summary(quality.snapshot_cells(*snapshots(s, d)).withColumn("pair", F.year("dt")), "pair")


_LOG = "lg as (select distinct cast(o_orderdate as date) as dt from orders where o_orderpriority <> '5-LOW' and o_totalprice > 150000)"


@query("cycle_continuity", f"with {_LOG}, b as (select min(dt) as lo, max(dt) as hi from lg), d as (select cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 day)) as date) as dt from b) select d.dt, lg.dt is not null as logged from d left join lg on lg.dt = d.dt where dayofweek(d.dt) not in (0, 6)")
def cycle_continuity(s, d):
    lg = _logged(s, d)
    return quality.continuity(lg.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")), lg)


def _logged(s, d):
    return table(s, d, "orders").filter("o_orderpriority <> '5-LOW' and o_totalprice > 150000").select(F.col("o_orderdate").cast("date").alias("dt")).distinct()


@query("cycle_staleness", f"with {_LOG}, b as (select max(dt) as last from lg), n as (select max(cast(l_shipdate as date)) as today from lineitem), d as (select cast(unnest(generate_series(cast(last + 1 as timestamp), cast(today as timestamp), interval 1 day)) as date) as dt from b, n) select last, today, (select count(*) from d where dayofweek(dt) not in (0, 6)) as business_days from b, n")
def cycle_staleness(s, d):
    b = _logged(s, d).agg(F.max("dt").alias("last")).crossJoin(table(s, d, "lineitem").agg(F.max("l_shipdate").cast("date").alias("today")))
    n = quality.business_days(b.select(F.date_add("last", 1).alias("lo"), F.col("today").alias("hi"))).agg(F.count("*").alias("business_days"))
    return b.crossJoin(n)


@query("panel_staleness", on_panel("s", "select asset, max(dt) as last, (select max(dt) from cal) - max(dt) as days_behind from panel where price is not null group by asset"))
def panel_staleness(s, d):
    p = view(s, d, "s").filter("price is not null")
    top = p.agg(F.max("dt").alias("top"))
    return p.groupBy("asset").agg(F.max("dt").alias("last")).crossJoin(top).select("asset", "last", F.datediff("top", "last").cast("long").alias("days_behind"))


_REAL = f"{_MOM}, fw as (select sc.dt, sc.asset, score, fwd, bar_no from sc join (select dt, asset, lead(price, 4) {_A} / nullif(price, 0) - 1 as fwd from dense) using (dt, asset) where bar_no + 4 <= (select max(bar_no) from cal))"


@query("realized_ic", on_panel("w", f"{_REAL}, {ic_sql('score', 'fwd', 20, 'fw')} select dt, round(ic, 6) + 0.0 as ic, n from ic"))
def realized_ic(s, d):
    p = momentum_scores(s, d).select("dt", "asset", "score")
    return stats.rank_ic(quality.realized(p, dense(s, d), 4), "score", "fwd", 20).select("dt", r("ic"), "n")


@query("maturity_facts", on_panel("w", f"{_REAL}, al as (select count(*) as logged from sc where score is not null) select logged, count(*) as matured, logged - count(*) as pending from fw, al where score is not null group by logged"))
def maturity_facts(s, d):
    p = momentum_scores(s, d).filter("score is not null").select("dt", "asset", "score")
    m = quality.realized(p, dense(s, d), 4).agg(F.count("*").alias("matured"))
    return p.agg(F.count("*").alias("logged")).crossJoin(m).select("logged", "matured", (F.col("logged") - F.col("matured")).alias("pending"))


_LIVE = f"{_MOM}, {_DECILE}, {_BT}, sp as (select case when dt < date '2000-01-01' then 'backtest' else 'live' end as strategy_id, dt, net as ret from bt)"


def _live(s, d):
    b = pnl.run_backtest(books.decile_weights(momentum_scores(s, d), 0.1, 4), dense(s, d), 10)
    return b.select(F.when(F.col("dt") < "2000-01-01", "backtest").otherwise("live").alias("strategy_id"), "dt", F.col("net").alias("ret"))


@query("live_vs_backtest", on_panel("w", f"{_LIVE}, {nw_sql('sp', 4)} select b.n as n_backtest, l.n as n_live, round(l.mean - b.mean, 6) + 0.0 as gap, round(b.t_stat, 5) + 0.0 as t_backtest, round(l.t_stat, 5) + 0.0 as t_live from nw b, nw l where b.strategy_id = 'backtest' and l.strategy_id = 'live'"))
def live_vs_backtest(s, d):
    w = stats.newey_west(_live(s, d), 4)
    b, x = w.filter("strategy_id = 'backtest'"), w.filter("strategy_id = 'live'").toDF(*(f"l_{c}" for c in w.columns))
    return b.crossJoin(x).select(F.col("n").alias("n_backtest"), F.col("l_n").alias("n_live"), r(F.col("l_mean") - F.col("mean"), "gap"), r("t_stat", "t_backtest", 5), r("l_t_stat", "t_live", 5))


@query("book_marks", on_panel("w", f"{_MOM}, {_DECILE}, {_HELD} select dt, round(sum(lw * ret), 6) + 0.0 as pnl from l group by dt having sum(lw * ret) is not null"))
def book_marks(s, d):
    h = books.held(books.decile_weights(momentum_scores(s, d), 0.1, 4), returns(s, d), lag=1).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return h.groupBy("dt").agg(r(F.sum(F.col("w") * F.col("ret")), "pnl")).filter("pnl is not null")


@query("split_valid_records", "select count(*) filter (where text is not null and lang is not null and source is not null) as valid, count(*) filter (where text is null or lang is null or source is null) as skipped from documents")
def split_valid_records(s, d):
    ok = F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("source").isNotNull()
    return table(s, d, "documents").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"))


_EQ = "eq as (select cast(o_orderdate as date) as dt, sum(cast(round(o_totalprice * 100) as bigint)) / 100.0::double as equity from orders group by 1), br as (select dt, equity / nullif(lag(equity) over (order by dt), 0) - 1 as ret from eq)"


def _equity(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("dt")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0)).alias("equity"))


def _broker(s, d):
    w = W.partitionBy("book").orderBy("dt")
    e = _equity(s, d).withColumn("book", F.lit("b"))
    return e.withColumn("ret", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)


@query("broker_returns", f"with {_EQ} select dt, round(ret, 6) + 0.0 as ret from br where ret is not null")
def broker_returns(s, d):
    return _broker(s, d).filter("ret is not null").select("dt", r("ret"))


@query("execution_gap", on_panel("w", f"{_LIVE}, {_EQ.replace('eq as', 'eqx as').replace('from eq)', 'from eqx)').replace('br as', 'brx as')}, bw as (select cast(date_trunc('week', dt) as date) as dt, avg(ret) as bret from brx group by 1), g as (select sp.dt, (bret - sp.ret) / 100 as gap from sp join bw using (dt) where bret is not null) select dt, round(gap, 6) + 0.0 as gap, round(sum(gap) over (order by dt), 5) + 0.0 as cumulative from g"))
def execution_gap(s, d):
    b = _broker(s, d).groupBy(F.date_trunc("week", "dt").cast("date").alias("dt")).agg(F.avg("ret").alias("bret")).filter("bret is not null")
    g = _live(s, d).join(b, "dt").withColumn("gap", (F.col("bret") - F.col("ret")) / 100).withColumn("book", F.lit("b"))
    w = W.partitionBy("book").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return g.select("dt", r("gap"), r(F.sum("gap").over(w), "cumulative", 5))


_PAIR = "mk as (select dt, avg(ret) as m, avg(case when funding > 0 then ret end) as y from rets group by dt)"


def _pair(s, d):
    return returns(s, d).groupBy("dt").agg(F.avg("ret").alias("m"), F.avg(F.when(F.col("funding") > 0, F.col("ret"))).alias("y"))


@query("beta_decomposition", on_panel("w", f"{_PAIR}, a as (select count(*) as n, regr_slope(y, m) as beta, regr_intercept(y, m) as alpha, corr(y, m) as c, var_samp(y) as vy, var_samp(m) as vx from mk where y is not null and m is not null) select n, round(beta, 5) + 0.0 as beta, round(sqrt((n - 1) * vy * (1 - c * c) / (n - 2) / ((n - 1) * vx)), 5) as se, round(alpha, 6) + 0.0 as alpha, round(c, 5) as corr, round(c * c, 5) as share, round(sqrt((n - 1) * vy * (1 - c * c) / (n - 2)), 5) as resid_vol from a"))
def beta_decomposition(s, d):
    x = quality.regression(_pair(s, d), "y", "m")
    return x.select("n", r("beta", n=5), r("se", n=5), r("alpha"), r("corr", n=5), r("share", n=5), r("resid_vol", n=5))


@query("rolling_beta_series", on_panel("w", f"{_PAIR}, p as (select * from mk where y is not null and m is not null) select dt, round(case when count(*) over f >= 15 then regr_slope(y, m) over f end, 5) + 0.0 as beta from p window f as (order by dt rows between 14 preceding and current row)"))
def rolling_beta_series(s, d):
    p = _pair(s, d).filter("y is not null and m is not null").withColumn("book", F.lit("b"))
    w = W.partitionBy("book").orderBy("dt").rowsBetween(-14, 0)
    return p.select("dt", r(quality.rolling_slope("y", "m", 15, w), "beta", 5))


@query("cycle_compound", f"""with {_EQ}, cy as (select distinct cast(date_trunc('quarter', dt) as date) as cycle from eq where dt > date '1995-06-01'), c2 as (select cycle, lag(cycle) over (order by cycle) as prev from cy)
select cycle, prev, round(exp(sum(ln(1 + greatest(ret / 1000, -0.999999)))) - 1, 6) + 0.0 as ret from c2 join br on dt > prev and dt <= cycle where ret is not null group by 1, 2""")
def cycle_compound(s, d):
    b = _broker(s, d).select("dt", (F.col("ret") / 1000).alias("ret"))
    c = _equity(s, d).filter("dt > date '1995-06-01'").select(F.date_trunc("quarter", "dt").cast("date").alias("dt")).distinct()
    x = quality.compounded(b, c)
    first = c.agg(F.min("dt").alias("f"))
    return x.crossJoin(first).filter("cycle > f").select("cycle", "prev", r("ret"))


@query("worst_gaps", on_panel("w", f"{_PAIR} select dt, round(y - m, 6) + 0.0 as gap from mk where y is not null and m is not null order by round(y - m, 9), dt limit 5"))
def worst_gaps(s, d):
    x = _pair(s, d).filter("y is not null and m is not null").withColumn("gap", F.col("y") - F.col("m"))
    return x.orderBy(F.round("gap", 9), "dt").limit(5).select("dt", r("gap"))


@query("gap_census", on_panel("s", "select asset, count(*) filter (where price is null) as gaps, count(price) as bars from dense group by asset"))
def gap_census(s, d):
    return dense(s, d, "s").groupBy("asset").agg(F.count_if(F.col("price").isNull()).alias("gaps"), F.count("price").alias("bars"))


