"""Point-in-time, interval, event and identifier joins."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, ratio
from gridloom.operators import joins, panel, pnl, signals
from gridloom.plans.q_books import _SUE, _TXN_M, month_grid
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r, returns, table
from gridloom.plans.views import panel as view


@query("align_inner", on_panel("w", "a as (select dt, asset, price from panel where volume > 100), b as (select dt, asset, funding from panel where funding > 0) select a.dt, a.asset, price, funding from a join b using (dt, asset)"))
def align_inner(s, d):
    p = view(s, d)
    return p.filter("volume > 100").select("dt", "asset", "price").join(p.filter("funding > 0").select("dt", "asset", "funding"), ["dt", "asset"]).dropna()


@query("join_equi_left", "select l_orderkey, l_linenumber, l_quantity, o_custkey, c_mktsegment from lineitem left join (select * from orders where o_orderstatus = 'F') o on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey")
def join_equi_left(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    j = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_quantity", "o_custkey", "c_mktsegment")


@query("join_semi", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def join_semi(s, d):
    c = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("join_anti_diff", "(select c_custkey as id, 'no_order' as side from customer where c_custkey not in (select o_custkey from orders)) union all (select distinct o_custkey as id, 'no_customer' as side from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 20))")
def join_anti_diff(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").select("o_custkey")
    a = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.lit("no_order").alias("side"))
    b = o.join(c.filter("c_nationkey < 20"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").distinct()
    return a.unionByName(b.select(F.col("o_custkey").alias("id"), F.lit("no_customer").alias("side")))


_FIL = "fl as (select o_custkey as entity, cast(o_orderdate as date) as filed, max(o_totalprice) as value from orders group by 1, 2)"
_GRID = "g as (select distinct entity, cast(t as date) as t from (select distinct entity from fl), (select unnest(generate_series(timestamp '1995-06-30', timestamp '2001-06-30', interval 6 month)) as t))"


def filings(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("asset"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.max("o_totalprice").alias("value"))


def half_year_grid(s, d):
    dates = s.sql("select explode(sequence(date '1995-06-30', date '2001-06-30', interval 6 month)) as dt")
    return table(s, d, "orders").select(F.col("o_custkey").alias("asset")).distinct().crossJoin(dates)


_ASOF = f"with {_FIL}, {_GRID}, a as (select g.entity, g.t, f.value, f.filed from g asof left join fl f on f.entity = g.entity and f.filed <= g.t)"


@query("asof_ffill", f"{_ASOF} select entity, t, value, filed as source_dt from a")
def asof_ffill(s, d):
    return joins.asof(half_year_grid(s, d), filings(s, d), "value").select(F.col("asset").alias("entity"), F.col("dt").alias("t"), "value", "source_dt")


@query("asof_tolerance", f"{_ASOF} select entity, t, case when t - filed <= 200 then value end as value, case when t - filed <= 200 then filed end as source_dt from a")
def asof_tolerance(s, d):
    return joins.asof(half_year_grid(s, d), filings(s, d), "value", tolerance_days=200).select(F.col("asset").alias("entity"), F.col("dt").alias("t"), "value", "source_dt")


@query("asof_no_stale_delist", f"{_ASOF}, l as (select entity, max(filed) - 0 as last_print from fl group by entity) select a.entity, t, case when t <= last_print then value end as value from a join l using (entity)")
def asof_no_stale_delist(s, d):
    f = filings(s, d)
    g = half_year_grid(s, d).join(f.groupBy("asset").agg(F.max("dt").alias("last_print")), "asset")
    return joins.asof(g, f, "value", last_print="last_print").select(F.col("asset").alias("entity"), F.col("dt").alias("t"), "value")


@query("pit_value", """with f as (select o_custkey as entity, o_orderpriority as tag, cast(o_orderdate as date) as filed, o_totalprice as value, o_orderkey as period_end from orders),
b as (select entity, tag, filed, arg_max(value, period_end) as value from f group by 1, 2, 3), a as (select unnest([date '1996-12-31', date '1998-12-31', date '2000-12-31']) as asof),
k as (select * from (select distinct entity, tag from f), a)
select k.asof, k.entity, k.tag, b.value, b.filed from k asof join b on b.entity = k.entity and b.tag = k.tag and b.filed <= k.asof""")
def pit_value(s, d):
    f = table(s, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("period_end"))
    a = s.sql("select explode(array(date '1996-12-31', date '1998-12-31', date '2000-12-31')) as asof")
    return joins.pit_value(a, f)


_IV = "iv as (select c_custkey as asset, date '1995-01-02' + cast(c_custkey * 7 % 900 as int) as valid_from, case when c_custkey % 5 <> 0 then date '1995-01-02' + cast(c_custkey * 7 % 900 + 100 + c_custkey % 700 as int) end as valid_to from customer)"


def intervals(s, d):
    lo = F.expr("date_add(date '1995-01-02', cast(c_custkey * 7 % 900 as int))")
    hi = F.expr("case when c_custkey % 5 <> 0 then date_add(date '1995-01-02', cast(c_custkey * 7 % 900 + 100 + c_custkey % 700 as int)) end")
    return table(s, d, "customer").select(F.col("c_custkey").alias("asset"), lo.alias("valid_from"), hi.alias("valid_to"))


@query("interval_membership", f"with {_IV}, g as (select distinct cast(date_trunc('month', l_shipdate) as date) as dt from lineitem) select dt, asset from g join iv on dt >= valid_from and (valid_to is null or dt < valid_to)")
def interval_membership(s, d):
    return joins.interval_members(month_grid(s, d), intervals(s, d))


_CHG = """ch as (select o_custkey as asset, cast(date_trunc('month', o_orderdate) as date) as dt, max(case when o_totalprice > 50000 then 1 else 0 end) as rem from orders where o_orderstatus = 'F' and cast(date_trunc('month', o_orderdate) as date) > date '1995-06-01' group by 1, 2),
td as (select c_custkey as asset from customer where c_acctbal > 3000)"""


@query("membership_intervals", f"""with {_CHG}, nm as (select asset from td union select asset from ch),
en as (select asset, dt, rem from ch union all select nm.asset, null, case when td.asset is not null then 1 else 0 end from nm left join td using (asset)),
w as (select asset, dt, rem, coalesce(lag(dt) over (partition by asset order by dt nulls last), date '1995-06-01') as valid_from from en)
select asset, valid_from, dt as valid_to from w where rem = 1""")
def membership_intervals(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'F'")
    ch = o.select(F.col("o_custkey").alias("asset"), F.date_trunc("month", "o_orderdate").cast("date").alias("dt"), F.when(F.col("o_totalprice") > 50000, "remove").otherwise("add").alias("action"))
    today = table(s, d, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("asset"))
    return joins.membership_intervals(today, ch, F.lit("1995-06-01").cast("date"))


_EV = """ev as (select o_orderkey as event_id, cast(o_orderdate as date) as edate, 'Brand#' || (1 + o_custkey % 25) as asset from orders),
eb as (select event_id, asset, edate, c.bar_no + 1 as bar_no from ev asof join cal c on c.dt <= ev.edate where c.bar_no + 1 <= (select max(bar_no) from cal))"""


def events(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("date").alias("edate"), F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("asset"))


def event_bars(s, d):
    return joins.events_to_bars(events(s, d), panel.calendar(view(s, d)), "edate", 1)


@query("events_to_calendar", on_panel("w", f"{_EV} select event_id, asset, bar_no from eb"))
def events_to_calendar(s, d):
    return event_bars(s, d).select("event_id", "asset", F.col("bar_no").cast("long").alias("bar_no"))


_EW = f"{_EV}, ew as (select event_id, asset, i as step, bar_no + i as bar_no from eb, (select unnest(range(1, 7)) as i))"


@query("event_window", on_panel("w", f"{_EW} select e.event_id, step, r.dt, round(ret, 6) + 0.0 as ret from ew e join rets r on r.bar_no = e.bar_no and r.asset = e.asset"))
def event_window(s, d):
    x = joins.event_window(event_bars(s, d), 6).join(returns(s, d).select("dt", "bar_no", "asset", "ret"), ["bar_no", "asset"])
    return x.select("event_id", F.col("step").cast("long").alias("step"), "dt", r("ret"))


@query("event_portfolio", on_panel("w", f"{_EW} select r.dt, round(avg(ret), 6) + 0.0 as ret, count(ret) as live from ew e join rets r on r.bar_no = e.bar_no and r.asset = e.asset group by r.dt"))
def event_portfolio(s, d):
    x = joins.event_window(event_bars(s, d), 6).join(returns(s, d).select("dt", "bar_no", "asset", "ret"), ["bar_no", "asset"])
    return x.groupBy("dt").agg(r(F.avg("ret"), "ret"), F.count("ret").alias("live"))


@query("trailing_window_join", f"with {_TXN_M} select t, ticker, count(*) as filings from (select distinct owner, ticker, filed from t) x join g on filed <= t and filed > t - 60 group by 1, 2")
def trailing_window_join(s, d):
    x = signals.transactions(s, d).select("owner", "ticker", "filed").distinct()
    return joins.trailing_window(x, month_grid(s, d), "filed", 60).groupBy("t", "ticker").agg(F.count("*").alias("filings"))


_FT = """ft as (select bar_no, asset, round((l - avg(l) over (partition by bar_no)) / (stddev_samp(l) over (partition by bar_no) + 1e-12), 7) as size, round((m - avg(m) over (partition by bar_no)) / (stddev_samp(m) over (partition by bar_no) + 1e-12), 7) as mom
  from (select bar_no, asset, ln(dollar_volume) as l, ln(price) - ln(lag(price, 13) over (partition by asset order by dt)) as m from dense)),
kn as (select e.event_id, e.bar_no, e.asset as event_asset, f.asset, round(sqrt(pow(f.size - o.size, 2) + pow(f.mom - o.mom, 2)), 9) as distance from eb e join ft o on o.bar_no = e.bar_no and o.asset = e.asset join ft f on f.bar_no = e.bar_no and f.asset <> e.asset),
kk as (select *, row_number() over (partition by event_id order by distance, asset) as k from kn where distance is not null)"""


def match_features(s, d):
    from gridloom.functions.windows import zscore

    w = W.partitionBy("bar_no")
    x = dense(s, d).select("bar_no", "asset", F.ln("dollar_volume").alias("l"), (F.ln("price") - F.ln(F.lag("price", 13).over(by_asset()))).alias("m"))
    return x.select("bar_no", "asset", F.round(zscore(F.col("l"), w), 7).alias("size"), F.round(zscore(F.col("m"), w), 7).alias("mom"))


@query("knn_controls", on_panel("w", f"{_EV}, {_FT} select event_id, event_asset, asset, k from kk where k <= 3"))
def knn_controls(s, d):
    return joins.nearest(event_bars(s, d), match_features(s, d), 3).select("event_id", "event_asset", "asset", F.col("k").cast("long").alias("k"))


_STUDY = f"""{_EV}, {_FT}, st as (select unnest(range(1, 7)) as step),
ow as (select event_id, step, r.dt, r.ret from eb e, st join rets r on r.bar_no = e.bar_no + step and r.asset = e.asset),
co as (select k.event_id, step, avg(r.ret) as cret from kk k, st join rets r on r.bar_no = k.bar_no + step and r.asset = k.asset where k.k <= 3 group by 1, 2),
ex as (select ow.dt, ow.ret - cret - case when ow.step in (1, 6) then 0.001 else 0 end as x from ow join co using (event_id, step))"""


@query("event_study", on_panel("w", f"{_STUDY} select dt, round(avg(x), 6) + 0.0 as ret, count(x) as live from ex group by dt having avg(x) is not null"))
def event_study(s, d):
    e = event_bars(s, d)
    ret = returns(s, d).select("dt", "bar_no", "asset", "ret")
    own = joins.event_window(e, 6).join(ret, ["bar_no", "asset"]).select("event_id", "step", "dt", "ret")
    k = joins.nearest(e, match_features(s, d), 3)
    ctl = joins.event_window(k.drop("k"), 6).join(ret, ["bar_no", "asset"]).groupBy("event_id", "step").agg(F.avg("ret").alias("cret"))
    x = own.join(ctl, ["event_id", "step"]).withColumn("ret", F.col("ret") - F.col("cret")).withColumn("side", F.lit(1))
    return pnl.event_pnl(x, 10, 6).select("dt", r("ret"), "live")


_PEAD = f"""{_SUE}, su2 as (select *, cast(date_trunc('month', ann_date) as date) as cohort from sue),
cq as (select cohort, quantile_cont(sue, 0.2) as lo, quantile_cont(sue, 0.8) as hi from su2 group by cohort having count(*) >= 5),
sd as (select o_orderkey, ticker, ann_date, case when sue >= hi then 1 else -1 end as side from su2 join cq using (cohort) where sue >= hi or sue <= lo)"""


def _sides(s, d):
    x = signals.cohort_cuts(signals.compute_sue(signals.surprises(s, d)), 0.2)
    return x.filter("sue >= hi or sue <= lo").withColumn("side", F.when(F.col("sue") >= F.col("hi"), 1).otherwise(-1)).withColumnRenamed("ticker", "asset")


@query("pead_event_study", on_panel("s", f"""{_PEAD}, eb as (select o_orderkey, ticker, side, c.bar_no from sd asof join cal c on c.dt <= sd.ann_date), st as (select unnest(range(1, 5)) as step)
select r.dt, round(avg(side * ret - case when step in (1, 4) then 0.001 else 0 end), 5) + 0.0 as ret, count(ret) as live from eb, st join rets r on r.bar_no = eb.bar_no + step and r.asset = eb.ticker group by r.dt having avg(side * ret) is not null"""))
def pead_event_study(s, d):
    x = returns(s, d, "s").select("dt", "bar_no", "asset", "ret").filter("ret is not null")
    e = joins.events_to_bars(_sides(s, d), panel.calendar(view(s, d, "s")), "ann_date", 0)
    x = pnl.sides_on_bars(e.select("bar_no", "asset", "side"), x, {"held": (1, 4), "entered": (1, 1), "leaving": (4, 4)}).filter("held_n > 0")
    total = F.sum(F.col("held_side") * F.col("ret") - (F.col("entered_n") + F.col("leaving_n")) * (10 / 10000))
    return x.groupBy("dt").agg(r(total / F.sum("held_n"), "ret", 5), F.sum("held_n").alias("live"))


@query("drift_vs_reaction", on_panel("s", f"""{_PEAD}, eb as (select o_orderkey, ticker, side, c.bar_no from sd asof join cal c on c.dt <= sd.ann_date), lg as (select unnest([0, 1, 2]) as lag), st as (select unnest(range(1, 5)) as step)
select lag, count(ret) as n, round(avg(side * ret), 5) + 0.0 as mean from eb, lg, st join rets r on r.bar_no = eb.bar_no + lag + step and r.asset = eb.ticker where eb.bar_no + lag <= (select max(bar_no) from cal) group by lag"""))
def drift_vs_reaction(s, d):
    x = returns(s, d, "s").select("dt", "bar_no", "asset", "ret")
    e = joins.events_to_bars(_sides(s, d), panel.calendar(view(s, d, "s")), "ann_date", 0)
    x = pnl.sides_on_bars(e.select("bar_no", "asset", "side"), x, {f"lag{k}": (k + 1, k + 4) for k in range(3)})
    lags = F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"lag{k}_side").alias("side"), F.col(f"lag{k}_n").alias("n")) for k in range(3))))
    x = x.select("ret", lags).filter("n > 0")
    n = F.coalesce(F.sum(F.when(F.col("ret").isNotNull(), F.col("n"))), F.lit(0))
    return x.groupBy("lag").agg(n.alias("n"), r(F.try_divide(F.sum(F.col("side") * F.col("ret")), n), "mean", 5))


_NAMES = """a as (select distinct upper(split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2)) as name from part),
b as (select upper(p_name) as book_name, min(p_partkey) as id from part where p_size > 10 group by 1)"""


@query("name_match", f"""with {_NAMES}, ex as (select name, id, 'exact' as how from a join b on name = book_name),
nr as (select name, count(distinct book_name) as k, min(id) as id from a join b on split_part(name, ' ', 1) = split_part(book_name, ' ', 1) and (starts_with(name, book_name || ' ') or starts_with(book_name, name || ' ')) where name not in (select name from ex) group by name)
select * from ex union all select name, id, 'prefix' as how from nr where k = 1""")
def name_match(s, d):
    p = table(s, d, "part")
    a = p.select(F.upper(F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("name")).distinct()
    b = p.filter("p_size > 10").groupBy(F.upper("p_name").alias("book_name")).agg(F.min("p_partkey").alias("id"))
    return joins.name_match(a, b)


@query("operating_entity", """with o as (select o_custkey % 97 as name_id, o_custkey as entity, max(cast(o_orderdate as date)) as last_filing, count_if(o_orderpriority = '1-URGENT') as annuals from orders group by 1, 2)
select name_id, arg_max(entity, {'l': last_filing, 'e': entity}) as entity from o where annuals > 0 and last_filing <= date '2001-01-01' + cast(name_id as int) group by 1""")
def operating_entity(s, d):
    o = table(s, d, "orders").groupBy((F.col("o_custkey") % 97).alias("name_id"), F.col("o_custkey").alias("entity")).agg(F.max(F.col("o_orderdate").cast("date")).alias("last_filing"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("annuals"))
    ok = o.filter("annuals > 0").filter(F.expr("last_filing <= date_add(date '2001-01-01', cast(name_id as int))"))
    return ok.groupBy("name_id").agg(F.max_by("entity", F.struct("last_filing", "entity")).alias("entity"))


@query("resolve_id_fallback", "select o_orderkey, coalesce(c_custkey, s_suppkey) as id, case when c_custkey is not null then 'map' when s_suppkey is not null then 'name' end as how from orders left join (select c_custkey from customer where c_acctbal > 3000) c on o_custkey = c_custkey left join (select s_suppkey from supplier) s on o_custkey % 150 = s_suppkey")
def resolve_id_fallback(s, d):
    c, u = table(s, d, "customer").filter("c_acctbal > 3000").select("c_custkey"), table(s, d, "supplier").select("s_suppkey")
    j = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(u, F.col("o_custkey") % 150 == F.col("s_suppkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_custkey", "s_suppkey").alias("id"), F.when(F.col("c_custkey").isNotNull(), "map").when(F.col("s_suppkey").isNotNull(), "name").alias("how"))


@query("rekey_by_id", "with m as (select c_nationkey as id, arg_min(c_mktsegment, c_custkey) as symbol from customer where c_mktsegment <> 'MACHINERY' group by 1) select s_suppkey, symbol from supplier join m on s_nationkey = id")
def rekey_by_id(s, d):
    m = table(s, d, "customer").filter("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_nationkey").alias("id")).agg(F.min_by("c_mktsegment", "c_custkey").alias("symbol"))
    return table(s, d, "supplier").join(m, F.col("s_nationkey") == F.col("id")).select("s_suppkey", "symbol")


@query("field_first_nonempty", """with c as (select o_custkey as entity, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end as rank, o_orderkey, o_totalprice as value from orders),
m as (select *, min(rank) over (partition by entity) as best from c where rank is not null) select entity, rank, o_orderkey, value from m where rank = best""")
def field_first_nonempty(s, d):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).when(p == "3-MEDIUM", 3)
    c = table(s, d, "orders").select(F.col("o_custkey").alias("entity"), rank.alias("rank"), "o_orderkey", F.col("o_totalprice").alias("value")).filter("rank is not null")
    return c.withColumn("best", F.min("rank").over(W.partitionBy("entity"))).filter("rank = best").drop("best")


_FU = """f0 as (select o_orderkey, o_custkey as entity, cast(o_orderdate as date) as filed, o_totalprice from orders),
fl0 as (select l_orderkey as o_orderkey, sum(l_extendedprice * l_discount) as ni, sum(l_extendedprice * l_tax) as cfo, sum(l_extendedprice) as gp from lineitem group by 1),
f1 as (select entity, filed, round(sum(o_totalprice), 4) as assets, round(sum(gp), 4) as gp, round(sum(ni), 4) as ni, round(sum(cfo), 4) as cfo from f0 left join fl0 using (o_orderkey) group by 1, 2),
f2 as (select entity, filed, last_value(assets ignore nulls) over w as assets, last_value(gp ignore nulls) over w as gp, last_value(ni ignore nulls) over w as ni, last_value(cfo ignore nulls) over w as cfo from f1 window w as (partition by entity order by filed)),
rt as (select entity, filed, gp / nullif(assets, 0) as gp_a, (ni - cfo) / nullif(assets, 0) as acc_a, (gp - (ni - cfo)) / nullif(assets, 0) as cbop_a from f2)"""

for _name, _col in (("gp_over_assets", "gp_a"), ("accruals_over_assets", "acc_a"), ("cbop_over_assets", "cbop_a")):

    def _one(s, d, c=_col):
        return signals.ratios(signals.fundamentals(s, d)).select("entity", "filed", r(c, "value", 5))

    query(_name, f"with {_FU} select entity, filed, round({_col}, 5) + 0.0 as value from rt")(_one)


_PIT = f"with {_FU}, g as (select * from (select distinct entity from f1), (select unnest([date '1996-12-31', date '1998-12-31', date '2000-12-31']) as dt)), pf as (select g.dt, g.entity, gp_a, acc_a, cbop_a from g asof left join rt on rt.entity = g.entity and rt.filed <= g.dt)"


def _pit(s, d):
    x = signals.ratios(signals.fundamentals(s, d)).select(F.col("entity").alias("asset"), F.col("filed").alias("dt"), F.struct("gp_a", "acc_a", "cbop_a").alias("v"))
    g = x.select("asset").distinct().crossJoin(s.sql("select explode(array(date '1996-12-31', date '1998-12-31', date '2000-12-31')) as dt"))
    return joins.asof(g, x, "v").select("dt", F.col("asset").alias("entity"), "v.gp_a", "v.acc_a", "v.cbop_a")


@query("pit_feature_panel", f"{_PIT} select dt, entity, round(gp_a, 5) + 0.0 as gp_a, round(acc_a, 5) + 0.0 as acc_a from pf")
def pit_feature_panel(s, d):
    return _pit(s, d).select("dt", "entity", r("gp_a", n=5), r("acc_a", n=5))


def _z(c):
    return f"({c} - avg({c}) over (partition by dt)) / (stddev_samp({c}) over (partition by dt) + 1e-12)"


@query("quality_signal", f"{_PIT}, z as (select dt, entity, {_z('gp_a')} as a, {_z('acc_a')} as b from pf) select dt, entity, round(case when coalesce(a, b) is not null then coalesce(a, 0) - coalesce(b, 0) end, 5) + 0.0 as quality from z")
def quality_signal(s, d):
    return signals.quality(_pit(s, d), "gp_a", "acc_a").select("dt", "entity", r("quality", n=5))


@query("cbop_signal", f"{_PIT} select dt, entity, round({_z('cbop_a')}, 5) + 0.0 as signal from pf")
def cbop_signal(s, d):
    from gridloom.functions.windows import zscore

    return _pit(s, d).select("dt", "entity", r(zscore(F.col("cbop_a")), "signal", 5))


@query("build_transactions", "select 'O' || cast(o_custkey % 50 as varchar) as owner, 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(greatest(o_orderdate, l_shipdate) as date) as filed, case l_returnflag when 'R' then 'buy' when 'A' then 'sell' end as side, l_quantity as shares, l_extendedprice as value from lineitem join orders on l_orderkey = o_orderkey where l_returnflag in ('A', 'R')")
def build_transactions(s, d):
    t = signals.transactions(s, d).filter("code in ('A', 'R')")
    return t.select("owner", "ticker", "filed", F.when(F.col("code") == "R", "buy").otherwise("sell").alias("side"), "shares", "value")


@query("hml_loading_asof", on_panel("w", """m as (select dt, asset, ret, avg(funding) over (partition by dt) as f from rets),
b as (select dt, asset, covar_pop(ret, case when ret is not null then f end) over w / nullif(var_pop(case when ret is not null then f end) over w, 0) as loading, count(ret) over w as n from m window w as (partition by asset order by dt rows between 25 preceding and current row)),
l as (select dt, asset, loading from b where n >= 13 and loading is not null), g as (select * from (select distinct asset from panel), (select distinct cast(date_trunc('month', l_shipdate) as date) as dt from lineitem))
select g.dt, g.asset, round(loading, 3) + 0.0 as loading from g asof left join l on l.asset = g.asset and l.dt <= g.dt"""))
def hml_loading_asof(s, d):
    from gridloom.functions.windows import trailing

    x = returns(s, d).withColumn("f", F.avg("funding").over(by_date())).withColumn("f", F.when(F.col("ret").isNotNull(), F.col("f")))
    w = trailing(26)
    x = x.withColumn("loading", ratio(F.covar_pop("ret", "f").over(w), F.var_pop("f").over(w))).withColumn("n", F.count("ret").over(w)).filter("n >= 13")
    g = view(s, d).select("asset").distinct().crossJoin(month_grid(s, d))
    return joins.asof(g, x, "loading").select("dt", "asset", r("loading", n=3))


@query("member_gate", on_panel("w", f"{_IV}, sc as (select dt, asset, price from panel) select dt, p.asset, price from sc p where exists (select 1 from iv where 'Brand#' || (1 + iv.asset % 25) = p.asset and p.dt >= valid_from and (valid_to is null or p.dt < valid_to))"))
def member_gate(s, d):
    iv = intervals(s, d).withColumn("asset", F.concat(F.lit("Brand#"), (1 + F.col("asset") % 25).cast("string")))
    p = view(s, d).select("dt", "asset", "price")
    return p.join(joins.interval_members(p.select("dt"), iv), ["dt", "asset"], "left_semi")


