"""Aggregations, set operations, statistics and censuses."""

from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, by_date, gated, ratio, trailing
from gridloom.operators import books, panel, pnl, risk, signals, stats
from gridloom.operators.quantiles import quantiles
from gridloom.plans.q_books import _BT, _CARRY, _DECILE, _DISC, _MOM, _TXN_M, carry_rows, carry_scores, discount_scores, momentum_scores, month_grid
from gridloom.plans.q_books import _BW, _PAIRS, _A, _with_beta
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r, returns, table
from gridloom.plans.views import panel as view


@query("coverage_filter", on_panel("s", "n as (select count(*) as n from cal), k as (select asset, count(price) as k from panel group by asset) select p.dt, p.asset, price from panel p join k using (asset), n where k >= floor(n * 0.82)"))
def coverage_filter(s, d):
    return panel.coverage_filter(view(s, d, "s"), 0.82).select("dt", "asset", "price")


@query("cs_mean", on_panel("s", "select dt, round(avg(case when sector <> 'ASIA' then ret end), 6) + 0.0 as mkt from rets group by dt"))
def cs_mean(s, d):
    return returns(s, d, "s").groupBy("dt").agg(r(F.avg(F.when(F.col("sector") != "ASIA", F.col("ret"))), "mkt"))


def ic_sql(score, target, least, source, keys="dt"):
    return f"""ir as (select {keys}, rank() over (partition by {keys} order by {score}) + (count(*) over (partition by {keys}, {score}) - 1) / 2.0 as a, rank() over (partition by {keys} order by {target}) + (count(*) over (partition by {keys}, {target}) - 1) / 2.0 as b
  from {source} where {score} is not null and {target} is not null),
ic as (select {keys}, corr(a, b) as ic, count(*) as n from ir group by {keys} having count(*) >= {least})"""


_FW = f"fw as (select sc.dt, sc.asset, score, lead(price, 4) over (partition by d.asset order by d.dt) / nullif(price, 0) - 1 as fwd from sc join dense d on d.dt = sc.dt and d.asset = sc.asset)"


def _scored(s, d, scores):
    f = dense(s, d).select("dt", "asset", (ratio(F.lead("price", 4).over(by_asset()), F.col("price")) - 1).alias("fwd"))
    return scores(s, d).select("dt", "asset", "score").join(f, ["dt", "asset"])


@query("rank_ic", on_panel("w", f"{_MOM}, {_FW}, {ic_sql('score', 'fwd', 5, 'fw')} select dt, round(ic, 6) + 0.0 as ic, n from ic"))
def rank_ic(s, d):
    return stats.rank_ic(_scored(s, d, momentum_scores), "score", "fwd").select("dt", r("ic"), "n")


@query("rank_ic_min6", on_panel("w", f"{_CARRY}, {_FW}, {ic_sql('score', 'fwd', 6, 'fw')} select dt, round(ic, 6) + 0.0 as ic, n from ic"))
def rank_ic_min6(s, d):
    return stats.rank_ic(_scored(s, d, carry_scores), "score", "fwd", 6).select("dt", r("ic"), "n")


@query("trailing_ic", on_panel("w", f"{_DISC}, {_FW}, {ic_sql('score', 'fwd', 6, 'fw')} select dt, round(case when count(ic) over f >= 6 then avg(ic) over f end, 6) + 0.0 as trailing_ic from ic window f as (order by dt rows between 12 preceding and 1 preceding)"))
def trailing_ic(s, d):
    ic = stats.rank_ic(_scored(s, d, discount_scores), "score", "fwd", 6).withColumn("strategy_id", F.lit("disc"))
    w = W.partitionBy("strategy_id").orderBy("dt").rowsBetween(-12, -1)
    return ic.select("dt", r(gated(F.avg("ic"), F.col("ic"), 6, w), "trailing_ic"))


_FEAT = f"""ft as (select dt, asset, bar_no, unnest(['mom', 'rev']) as feature, unnest([round(ln(lag(price, 4) {_A}) - ln(lag(price, 26) {_A}), 9), round(ln(price) - ln(lag(price, 4) {_A}), 9)]) as score, lead(price, 4) {_A} / nullif(price, 0) - 1 as fwd from dense),
fk as (select *, dt || feature as dk, (bar_no - 1) // 52 as window_id from ft)"""


def _feature_ics(s, d):
    x = dense(s, d).withColumns({"mom": F.round(panel.momentum("price", 26, 4), 9), "rev": F.round(panel.momentum("price", 4, 0), 9), "fwd": ratio(F.lead("price", 4).over(by_asset()), F.col("price")) - 1})
    x = x.withColumn("window_id", F.floor((F.col("bar_no") - 1) / 52)).unpivot(["dt", "asset", "window_id", "fwd"], ["mom", "rev"], "feature", "score")
    ic = stats.rank_ic(x, "score", "fwd", 5, ("feature", "window_id", "dt"))
    return ic.groupBy("feature", "window_id").agg(F.avg("ic").alias("ic"))


_FIC = f"{_FEAT}, {ic_sql('score', 'fwd', 5, 'fk', 'feature, window_id, dt')}, fi as (select feature, window_id, avg(ic) as ic from ic group by 1, 2)"


@query("feature_window_ics", on_panel("w", f"{_FIC} select feature, window_id, round(ic, 6) + 0.0 as ic from fi"))
def feature_window_ics(s, d):
    return _feature_ics(s, d).select("feature", "window_id", r("ic"))


@query("ic_sign_consistency", on_panel("w", f"{_FIC} select feature, round(avg(case when sign(ic) = sign(m) then 1.0 else 0 end), 6) as consistency from (select *, avg(ic) over (partition by feature) as m from fi) group by feature"))
def ic_sign_consistency(s, d):
    x = _feature_ics(s, d).withColumn("m", F.avg("ic").over(W.partitionBy("feature")))
    return x.groupBy("feature").agg(r(F.avg((F.signum("ic") == F.signum("m")).cast("double")), "consistency"))


_COV = "cv as (select x.asset as a, y.asset as b, covar_samp(x.ret, y.ret) * case when x.asset = y.asset then 1 else 0.8 end as cov from rets x join rets y on x.dt = y.dt and x.asset <= y.asset where x.ret is not null and y.ret is not null group by 1, 2)"


@query("sample_cov", on_panel("w", f"{_COV} select a, b, round(cov, 5) + 0.0 as cov from cv"))
def sample_cov(s, d):
    return risk.sample_covariance(returns(s, d).select("dt", "asset", "ret"), 0.2).select("a", "b", r("cov", n=5))


@query("predicted_vol", on_panel("w", f"{_MOM}, {_DECILE}, {_COV}, b0 as (select asset, w from wt where bar_no = (select max(bar_no) from wt)), fc as (select a, b, cov from cv union all select b, a, cov from cv where a <> b) select round(sqrt(sum(x.w * cov * y.w) * 52), 5) + 0.0 as vol from fc join b0 x on x.asset = a join b0 y on y.asset = b"))
def predicted_vol(s, d):
    w = books.latest_book(books.decile_weights(momentum_scores(s, d), 0.1, 4))
    return risk.book_volatility(w, returns(s, d).select("dt", "asset", "ret"), 52, 0.2).select(r("vol", n=5))


@query("net_exposure", on_panel("w", f"{_MOM}, {_DECILE} select wt.dt, round(sum(w), 6) + 0.0 as net, round(sum(w * funding), 6) + 0.0 as funding_load, round(sum(w * ln(dollar_volume)), 5) + 0.0 as size_load from wt join dense d on d.dt = wt.dt and d.asset = wt.asset group by wt.dt"))
def net_exposure(s, d):
    w = books.decile_weights(momentum_scores(s, d), 0.1, 4).join(dense(s, d).select("dt", "asset", "funding", "dollar_volume"), ["dt", "asset"])
    return w.groupBy("dt").agg(r(F.sum("w"), "net"), r(F.sum(F.col("w") * F.col("funding")), "funding_load"), r(F.sum(F.col("w") * F.ln("dollar_volume")), "size_load", 5))


_SW = "c as (select dt, asset, sector, ret - avg(ret) over (partition by dt) as x from rets), sw as (select dt, asset, sector, x / nullif(sum(abs(x)) over (partition by dt), 0) as w from c)"


@query("sector_net", on_panel("s", f"{_SW} select dt, sector, round(sum(w), 6) + 0.0 as net from sw where w is not null group by 1, 2"))
def sector_net(s, d):
    return books.dollar_neutral(returns(s, d, "s"), "ret").filter("w is not null").groupBy("dt", "sector").agg(r(F.sum("w"), "net"))


@query("risk_report", on_panel("w", f"""{_BW}, {_BT}, mm as (select dt, avg(ret) as mkt from rets group by dt),
q as (select bt.dt, net, mkt, case when count(net) over f >= 13 then covar_samp(net, mkt) over f / nullif(var_samp(mkt) over f, 0) end as beta from bt join mm using (dt) where mkt is not null window f as (order by bt.dt rows between 25 preceding and current row))
select round(corr(net, mkt), 5) + 0.0 as market_corr, round(avg(beta), 5) + 0.0 as mean_beta, round(quantile_cont(abs(beta), 0.95), 5) + 0.0 as p95_abs_beta from q"""))
def risk_report(s, d):
    n = pnl.run_backtest(books.decile_weights(momentum_scores(s, d), 0.1, 4), dense(s, d), 10)
    m = returns(s, d).groupBy("dt").agg(F.avg("ret").alias("mkt")).filter("mkt is not null")
    w = W.partitionBy("one").orderBy("dt").rowsBetween(-25, 0)
    x = n.join(m, "dt").withColumn("one", F.lit(1))
    beta = F.when(F.count("net").over(w) >= 13, ratio(F.covar_samp("net", "mkt").over(w), F.var_samp("mkt").over(w)))
    x = x.withColumn("beta", beta)
    return x.agg(r(F.corr("net", "mkt"), "market_corr", 5), r(F.avg("beta"), "mean_beta", 5), r(F.percentile(F.abs("beta"), F.lit(0.95)), "p95_abs_beta", 5))


@query("coverage_report", "with m as (select distinct c_nationkey as k from customer), p as (select distinct s_nationkey as k from supplier where s_acctbal > 0) select count(*) as members, count(p.k) as priced, coalesce(list_sort(list(m.k) filter (p.k is null)), []) as missing from m left join p on m.k = p.k")
def coverage_report(s, d):
    m = table(s, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    p = table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("p")).distinct()
    j = m.join(p, F.col("k") == F.col("p"), "left")
    return j.agg(F.count("*").alias("members"), F.count("p").alias("priced"), F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.col("k")))).alias("missing"))


@query("members_ever", "select distinct o_custkey as asset from orders union select distinct c_custkey as asset from customer where c_acctbal > 5000")
def members_ever(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("asset")).union(table(s, d, "customer").filter("c_acctbal > 5000").select("c_custkey")).distinct()


@query("sector_map", "select c_custkey as asset, coalesce(n_name, 'UNKNOWN') as sector from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def sector_map(s, d):
    n = table(s, d, "nation").filter("n_regionkey < 3")
    return table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("asset"), F.coalesce("n_name", F.lit("UNKNOWN")).alias("sector"))


@query("feed_snapshot", "select count(*) as rows_all, count(distinct l_suppkey) as names, round(quantile_cont(l_discount, 0.5), 6) as p50, round(quantile_cont(l_discount, 0.9), 6) as p90, round(quantile_cont(l_discount, 0.99), 6) as p99, count(*) filter (where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000)) as universe_rows from lineitem")
def feed_snapshot(s, d):
    u = table(s, d, "supplier").filter("s_acctbal > 5000").select("s_suppkey")
    j = table(s, d, "lineitem").join(u, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    x = j.agg(F.count("*").alias("rows_all"), F.count_distinct("l_suppkey").alias("names"), F.count("s_suppkey").alias("universe_rows"))
    x = x.crossJoin(quantiles(table(s, d, "lineitem"), "l_discount", (0.5, 0.9, 0.99)).select("p"))  # a row each
    return x.select("rows_all", "names", r(F.col("p")[0], "p50"), r(F.col("p")[1], "p90"), r(F.col("p")[2], "p99"), "universe_rows")


@query("ew_forward_baseline", on_panel("m", f"f as (select dt, lead(price) {_A} / nullif(price, 0) - 1 as fwd from dense) select dt, round(avg(fwd), 6) + 0.0 as ret, count(fwd) as names from f group by dt having count(fwd) > 0"))
def ew_forward_baseline(s, d):
    x = dense(s, d, "m").withColumn("fwd", ratio(F.lead("price").over(by_asset()), F.col("price")) - 1)
    return x.groupBy("dt").agg(r(F.avg("fwd"), "ret"), F.count("fwd").alias("names")).filter("names > 0")


@query("universe_filters", "with q as (select quantile_cont(c_acctbal, 0.9) as cut from customer where c_acctbal > 0) select c_custkey from customer, q where c_acctbal > 0 and c_acctbal < cut and c_mktsegment <> 'MACHINERY' and c_nationkey in (select n_nationkey from nation where n_regionkey <> 2)")
def universe_filters(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0")
    cut = quantiles(c, "c_acctbal", (0.9,)).select(F.col("p")[0].alias("cut"))  # one row
    n = table(s, d, "nation").filter("n_regionkey <> 2")
    x = c.crossJoin(cut).filter("c_acctbal < cut and c_mktsegment <> 'MACHINERY'")
    return x.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("filer_ids", "select distinct o_custkey as entity from orders")
def filer_ids(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("entity")).distinct()


def strategies(s, d, kind="w"):
    """Three return series: the market, the high-funding and the low-funding half."""
    x = returns(s, d, kind).filter("ret is not null")
    half = F.when(F.col("funding") > 0, "carry_high").otherwise("carry_low")
    a = x.groupBy("dt").agg(F.avg("ret").alias("ret")).withColumn("strategy_id", F.lit("market"))
    b = x.groupBy("dt", half.alias("strategy_id")).agg(F.avg("ret").alias("ret"))
    return a.unionByName(b)


_STR = """st as (select 'market' as strategy_id, dt, avg(ret) as ret from rets where ret is not null group by dt union all
select case when funding > 0 then 'carry_high' else 'carry_low' end, dt, avg(ret) from rets where ret is not null group by 1, 2)"""
_SR = "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52)"


@query("by_year", on_panel("w", f"{_STR} select strategy_id, year(dt) as year, count(*) as n, round({_SR}, 5) + 0.0 as sharpe from st group by 1, 2"))
def by_year(s, d):
    return strategies(s, d).groupBy("strategy_id", F.year("dt").alias("year")).agg(F.count("*").alias("n"), r(stats.sharpe("ret", 52), "sharpe", 5))


@query("by_subperiod", on_panel("w", f"{_STR} select strategy_id, dt < date '1998-07-01' as early, count(*) as n, round({_SR}, 5) + 0.0 as sharpe from st group by 1, 2"))
def by_subperiod(s, d):
    return strategies(s, d).groupBy("strategy_id", (F.col("dt") < "1998-07-01").alias("early")).agg(F.count("*").alias("n"), r(stats.sharpe("ret", 52), "sharpe", 5))


@query("ex_months", on_panel("w", f"{_STR} select strategy_id, count(*) as n, round({_SR}, 5) + 0.0 as sharpe from st where month(dt) not in (12, 1) group by 1"))
def ex_months(s, d):
    return strategies(s, d).filter(~F.month("dt").isin(12, 1)).groupBy("strategy_id").agg(F.count("*").alias("n"), r(stats.sharpe("ret", 52), "sharpe", 5))


@query("sharpe", on_panel("w", f"{_STR} select strategy_id, round({_SR}, 5) + 0.0 as sharpe from st group by 1"))
def sharpe(s, d):
    return strategies(s, d).groupBy("strategy_id").agg(r(stats.sharpe("ret", 52), "sharpe", 5))


@query("summary_stats", on_panel("w", f"{_STR} select strategy_id, count(*) as n, round(avg(ret) * 52, 5) + 0.0 as ann_return, round(stddev_samp(ret) * sqrt(52), 5) + 0.0 as ann_vol, round({_SR}, 5) + 0.0 as sharpe, round(avg(case when ret > 0 then 1.0 else 0 end), 6) as hit_rate, round(min(ret), 6) + 0.0 as worst, round(max(ret), 6) + 0.0 as best from st group by 1"))
def summary_stats(s, d):
    x = stats.summary(strategies(s, d), 52)
    return x.select("strategy_id", "n", r("ann_return", n=5), r("ann_vol", n=5), r("sharpe", n=5), r("hit_rate"), r("worst"), r("best"))


@query("summarize_daily", on_panel("w", f"{_PAIRS}, a as (select *, spot / nullif(lag(spot) {_A}, 0) - 1 - (perp / nullif(lag(perp) {_A}, 0) - 1) + coalesce(funding, 0) as g, coalesce(lag(live) {_A}, false) as held from pr), b as (select asset, case when held then coalesce(g, 0) else 0 end as x from a) select asset, count(*) as n, round(avg(x) * 365, 5) + 0.0 as ann_return, round(stddev_samp(x) * sqrt(365), 5) + 0.0 as ann_vol, round(case when stddev_samp(x) > 0 then avg(x) / stddev_samp(x) * sqrt(365) else 0 end, 5) + 0.0 as sharpe from b group by 1"))
def summarize_daily(s, d):
    x = carry_rows(s, d).withColumnRenamed("asset", "strategy_id")
    m = stats.summary(x, 365, "gross")
    return m.select(F.col("strategy_id").alias("asset"), "n", r("ann_return", n=5), r("ann_vol", n=5), r(F.coalesce("sharpe", F.lit(0.0)), "sharpe", 5))


def nw_sql(source, lags):
    ps = ", ".join(f"e * lag(e, {k}) over w as p{k}" for k in range(1, lags + 1))
    s = "sum(e * e)" + "".join(f" + 2 * {1 - k / (lags + 1)!r} * coalesce(sum(p{k}), 0)" for k in range(1, lags + 1))
    return f"""nd as (select strategy_id, dt, ret, ret - avg(ret) over (partition by strategy_id) as e from {source} where ret is not null),
np as (select *, {ps} from nd window w as (partition by strategy_id order by dt)),
nw as (select strategy_id, count(*) as n, avg(ret) as mean, case when count(*) >= {lags + 2} and {s} > 0 then avg(ret) / sqrt(({s}) / count(*) / count(*)) end as t_stat from np group by 1)"""


@query("newey_west", on_panel("w", f"{_STR}, {nw_sql('st', 4)} select strategy_id, n, round(mean, 6) + 0.0 as mean, round(t_stat, 5) + 0.0 as t_stat from nw"))
def newey_west(s, d):
    return stats.newey_west(strategies(s, d), 4).select("strategy_id", "n", r("mean"), r("t_stat", n=5))


_MO = """mo as (select strategy_id, count(*) as n, avg(ret) / stddev_samp(ret) as sr, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) as skew, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) as kurt
  from (select *, avg(ret) over (partition by strategy_id) as m from st) group by 1)"""


def _psr_sql(b):
    return f"case when n >= 30 and 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 then (sr - {b!r}) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) end"


@query("psr", on_panel("w", f"{_STR}, {_MO} select strategy_id, n, round(skew, 5) + 0.0 as skew, round(kurt, 5) + 0.0 as kurt, round({_psr_sql(0.0)}, 5) + 0.0 as z from mo"))
def psr(s, d):
    return stats.moments(strategies(s, d)).select("strategy_id", "n", r("skew", n=5), r("kurt", n=5), r(stats.psr_z(), "z", 5))


@query("expected_max_sharpe", on_panel("w", f"{_STR}, {_MO} select strategy_id, round(sr - {stats.expected_max_sharpe(0.002, 20)!r}, 6) + 0.0 as excess from mo"))
def expected_max_sharpe(s, d):
    return stats.moments(strategies(s, d)).select("strategy_id", r(F.col("sr") - stats.expected_max_sharpe(0.002, 20), "excess"))


@query("dsr", on_panel("w", f"{_STR}, {_MO} select strategy_id, round({_psr_sql(stats.expected_max_sharpe(0.002, 20))}, 5) + 0.0 as dsr_z from mo"))
def dsr(s, d):
    return stats.deflated_sharpe(strategies(s, d), 20, 0.002).select("strategy_id", r("dsr_z", n=5))


def _cdf_sql(z):
    """The normal distribution as its series z^(2k+1) / (2k+1)!!, of positive terms, at up to 8 deviations."""
    t = f"list_sum(list_transform(range(200), lambda k: exp((2 * k + 1) * ln(greatest(least(abs({z}), 8), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5))))"
    return f"case when {z} is not null then 0.5 + sign({z}) * exp(-pow(least(abs({z}), 8), 2) / 2) / sqrt(2) * {t} end"


_DSR_SQL = f"dz as (select strategy_id, {_psr_sql(0.0)} as z0, {_psr_sql(stats.expected_max_sharpe(0.002, 20))} as z1 from mo)"


@query("dsr_probability", on_panel("w", f"{_STR}, {_MO}, {_DSR_SQL} select strategy_id, round({_cdf_sql('z0')}, 8) + 0.0 as psr, round({_cdf_sql('z1')}, 8) + 0.0 as dsr from dz"))
def dsr_probability(s, d):
    return stats.deflated_sharpe(strategies(s, d), 20, 0.002).select("strategy_id", r("psr", n=8), r("dsr", n=8))


_TRIALS = (1, 5, 20, 100)
_HURDLE = f"""tb as (select * from (values {', '.join(f'({t}, {stats.expected_max_sharpe(0.002, t)!r}::double)' for t in _TRIALS)}) v(trials, base)),
hs as (select strategy_id, trials, list_reduce([base] || list_transform(range(60), lambda i: base), lambda x, y: y + {NormalDist().inv_cdf(0.95)!r}::double * sqrt(greatest(1 - skew * x + (kurt - 1) / 4 * x * x, 1e-12) / (n - 1))) as sr from mo, tb)"""


@query("graduation_hurdle", on_panel("w", f"{_STR}, {_MO}, {_HURDLE} select strategy_id, trials, round(sr * sqrt(52), 8) as hurdle from hs"))
def graduation_hurdle(s, d):
    """Hurdles for the measured length and shape of each strategy over a grid of trial counts."""
    grid = stats.moments(strategies(s, d)).withColumn("trials", F.explode(F.array(*map(F.lit, _TRIALS))))
    grid = grid.withColumns({"variance": F.lit(0.002), "periods": F.lit(52)})
    return stats.graduation_hurdle(grid).select("strategy_id", "trials", r("hurdle", n=8))


@query("pbo_cscv", on_panel("w", f"""{_STR}, s5 as (select * from st where ret is not null),
dd as (select dt, cast(floor((row_number() over (order by dt) - 1) * 16 / count(*) over ()) as int) as block from (select distinct dt from s5)),
bs as (select strategy_id, block, count(*) as n, sum(ret) as s, sum(ret * ret) as q from s5 join dd using (dt) group by 1, 2),
sp as (select i as split from range(65536) t(i) where bit_count(i) = 8),
ss as (select split, strategy_id, (split >> block) & 1 as side, sum(n) as n, sum(s) as s, sum(q) as q from sp, bs group by 1, 2, 3),
sh as (select split, strategy_id, side, case when (q - s * s / n) / (n - 1) > 1e-18 then s / n / sqrt((q - s * s / n) / (n - 1)) else 0 end as sr from ss),
pr2 as (select split, strategy_id, max(case when side = 1 then sr end) as ins, max(case when side = 0 then sr end) as oos from sh group by 1, 2),
rk2 as (select *, row_number() over (partition by split order by round(ins, 12) desc, strategy_id) as best, count(*) over (partition by split order by round(oos, 12)) as rank, count(*) over (partition by split) as m from pr2)
select count(*) as splits, round(avg(case when rank / (m + 1.0) <= 0.5 then 1.0 else 0 end), 5) as pbo, round(regr_slope(oos, ins), 5) + 0.0 as slope, round(avg(case when oos < 0 then 1.0 else 0 end), 5) as loss_prob from rk2 where best = 1"""))
def pbo_cscv(s, d):
    return stats.pbo(strategies(s, d)).select("splits", r("pbo", n=5), r("slope", n=5), r("loss_prob", n=5))


@query("kelly_fraction", on_panel("w", f"{_STR} select strategy_id, round(greatest(0, coalesce(avg(ret) / nullif(var_samp(ret), 0), 0)), 5) + 0.0 as f from st group by 1"))
def kelly_fraction(s, d):
    return strategies(s, d).groupBy("strategy_id").agg(r(stats.kelly(F.avg("ret"), F.var_samp("ret")), "f", 5))


@query("sr_stderr", on_panel("w", f"{_STR}, {_MO} select strategy_id, round(sqrt((1 + sr * sr / 2) / n), 6) as se from mo"))
def sr_stderr(s, d):
    return stats.moments(strategies(s, d)).select("strategy_id", r(stats.sharpe_stderr(F.col("sr"), F.col("n")), "se"))


@query("kelly_uncertain", on_panel("w", f"{_STR}, {_MO} select strategy_id, round(0.5 * greatest(0, sr - 1.0 * sqrt((1 + sr * sr / 2) / n)), 6) + 0.0 as f from mo"))
def kelly_uncertain(s, d):
    m = stats.moments(strategies(s, d))
    return m.select("strategy_id", r(0.5 * F.greatest(F.lit(0.0), F.col("sr") - stats.sharpe_stderr(F.col("sr"), F.col("n"))), "f"))


@query("vol_target", on_panel("w", f"{_STR} select strategy_id, round(0.1 / nullif(stddev_samp(ret) * sqrt(52), 0), 6) + 0.0 as scale from st group by 1"))
def vol_target(s, d):
    return strategies(s, d).groupBy("strategy_id").agg(r(ratio(F.lit(0.1), F.stddev_samp("ret") * 52**0.5), "scale"))


@query("size_book", on_panel("w", f"{_STR}, {_MO}, z as (select strategy_id, stddev_samp(ret) * sqrt(52) as v from st group by 1) select strategy_id, round(0.1 / nullif(v, 0) * 0.5 * greatest(0, sr - sqrt((1 + sr * sr / 2) / n)), 6) + 0.0 as size from mo join z using (strategy_id)"))
def size_book(s, d):
    x = strategies(s, d)
    v = x.groupBy("strategy_id").agg((F.stddev_samp("ret") * 52**0.5).alias("v"))
    k = 0.5 * F.greatest(F.lit(0.0), F.col("sr") - stats.sharpe_stderr(F.col("sr"), F.col("n")))
    return stats.moments(x).join(v, "strategy_id").select("strategy_id", r(ratio(F.lit(0.1), F.col("v")) * k, "size"))


@query("census_quantiles", "select c_mktsegment as bucket, count(*) as n, round(quantile_cont(c_acctbal, 0.1), 4) + 0.0 as p10, round(quantile_cont(c_acctbal, 0.5), 4) + 0.0 as p50, round(quantile_cont(c_acctbal, 0.9), 4) + 0.0 as p90 from customer group by 1")
def census_quantiles(s, d):
    x = quantiles(table(s, d, "customer").withColumnRenamed("c_mktsegment", "bucket"), "c_acctbal", (0.1, 0.5, 0.9), ("bucket",))
    return x.select("bucket", "n", r(F.col("p")[0], "p10", 4), r(F.col("p")[1], "p50", 4), r(F.col("p")[2], "p90", 4))


@query("staleness_by_cat", "with l as (select o_custkey, max(o_orderdate) as last from orders group by 1) select c_mktsegment as category, count(*) as n, round(avg(case when last is null or last < timestamp '2001-01-01' then 1.0 else 0 end), 6) as stale_share from customer left join l on c_custkey = o_custkey group by 1")
def staleness_by_cat(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    j = table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    stale = F.col("last").isNull() | (F.col("last") < F.lit("2001-01-01").cast("timestamp"))
    return j.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), r(F.avg(stale.cast("double")), "stale_share"))


@query("reason_census", "select o_orderpriority as bucket, year(o_orderdate) as year, count(*) as n from orders group by rollup(o_orderpriority, year(o_orderdate))")
def reason_census(s, d):
    return table(s, d, "orders").rollup(F.col("o_orderpriority").alias("bucket"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("dead_fund_census", """with e as (select o_custkey, arg_min(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) as st, min(o_orderdate) as first from orders group by 1), c as (select case when st = 'F' then 'merged' when st = 'P' then 'liquidated' else 'unknown' end as outcome, first from e)
select outcome, count(*) as n, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share, cast(min(first) as date) as earliest from c group by outcome""")
def dead_fund_census(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("st"), F.min("o_orderdate").alias("first"))
    out = F.when(F.col("st") == "F", "merged").when(F.col("st") == "P", "liquidated").otherwise("unknown")
    g = o.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"), F.min("first").cast("date").alias("earliest"))
    return g.select("outcome", "n", r(F.col("n") / F.sum("n").over(W.partitionBy()), "share"), "earliest")


@query("id_coverage", "select count(*) as n, round(avg(case when c_custkey is not null then 1.0 else 0 end), 6) as mapped, round(avg(case when c_custkey is null and s_suppkey is not null then 1.0 else 0 end), 6) as recovered, round(avg(case when c_custkey is null and s_suppkey is null then 1.0 else 0 end), 6) as residual from orders left join (select c_custkey from customer where c_acctbal > 0) on o_custkey = c_custkey left join (select s_suppkey from supplier) on o_custkey % 150 = s_suppkey")
def id_coverage(s, d):
    c, u = table(s, d, "customer").filter("c_acctbal > 0").select("c_custkey"), table(s, d, "supplier").select("s_suppkey")
    j = table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(u, F.col("o_custkey") % 150 == F.col("s_suppkey"), "left")
    a, b = F.col("c_custkey").isNotNull(), F.col("s_suppkey").isNotNull()
    share = lambda c, n: r(F.avg(c.cast("double")), n)
    return j.agg(F.count("*").alias("n"), share(a, "mapped"), share(~a & b, "recovered"), share(~a & ~b, "residual"))


@query("power_gate", f"""with {_TXN_M}, e as (select t, count(*) as names from bc where buyers >= 2 group by t) select count(*) as months, round(median(names), 4) as median, round(quantile_cont(names, 0.9), 4) as p90, max(names) as most, median(names) >= 20 as passes from e""")
def power_gate(s, d):
    return _gate(signals.distinct_owner_counts(signals.transactions(s, d).filter("code = 'R'"), month_grid(s, d), 90))


def _gate(counts):
    e = counts.filter("owners >= 2").groupBy("t").agg(F.count("*").alias("names"))
    p = F.percentile("names", F.array(F.lit(0.5), F.lit(0.9)))
    x = e.agg(F.count("*").alias("months"), p.alias("p"), F.max("names").alias("most"))
    return x.select("months", r(F.col("p")[0], "median", 4), r(F.col("p")[1], "p90", 4), "most", (F.col("p")[0] >= 20).alias("passes"))


@query("sampled_power", f"""with {_TXN_M}, nm as (select distinct ticker from bc), sm as (select ticker from nm order by (cast(substr(ticker, 2) as bigint) * 7919 + 104729) % 1000003, ticker limit 40), e as (select t, count(*) as names from bc where buyers >= 2 and ticker in (select ticker from sm) group by t)
select count(*) as months, round(median(names) * (select count(*) from nm) / 40, 4) as scaled_median from e""")
def sampled_power(s, d):
    c = signals.distinct_owner_counts(signals.transactions(s, d).filter("code = 'R'"), month_grid(s, d), 90)
    names = c.select("ticker").distinct()
    h = (F.substring("ticker", 2, 9).cast("long") * 7919 + 104729) % 1000003
    pick = names.orderBy(h, "ticker").limit(40)
    total = names.agg(F.count("*").alias("all"))
    e = c.filter("owners >= 2").join(pick, "ticker", "left_semi").groupBy("t").agg(F.count("*").alias("names"))
    x = e.agg(F.count("*").alias("months"), F.percentile("names", F.lit(0.5)).alias("m")).crossJoin(total)
    return x.select("months", r(F.col("m") * F.col("all") / 40, "scaled_median", 4))


_LQ = "lq as (select asset, dt, dollar_volume, row_number() over (partition by asset order by dt desc) as k from panel), av as (select asset, avg(dollar_volume) as adv from lq where k <= 90 group by 1), lk as (select asset, adv, row_number() over (order by adv desc, asset) as rank from av)"


@query("liquidity_rank", on_panel("s", f"{_LQ} select asset, rank, case when rank <= 10 then 'top' when rank <= 30 then 'mid' else 'tail' end as bucket from lk where rank <= 60"))
def liquidity_rank(s, d):
    p = view(s, d, "s").withColumn("k", F.row_number().over(W.partitionBy("asset").orderBy(F.desc("dt")))).filter("k <= 90")
    a = p.groupBy("asset").agg(F.avg("dollar_volume").alias("adv")).orderBy(F.desc("adv"), "asset").limit(60).withColumn("rank", F.row_number().over(W.orderBy(F.desc("adv"), "asset")))
    b = F.when(F.col("rank") <= 10, "top").when(F.col("rank") <= 30, "mid").otherwise("tail")
    return a.select("asset", F.col("rank").cast("long").alias("rank"), b.alias("bucket"))


_CC = f"{_PAIRS}, a as (select *, spot / nullif(lag(spot) {_A}, 0) - 1 - (perp / nullif(lag(perp) {_A}, 0) - 1) + coalesce(funding, 0) as g, coalesce(lag(live) {_A}, false) as held from pr), b as (select *, held and not coalesce(lag(held) {_A}, false) as st, case when held then coalesce(g, 0) - 0.0002 - case when held and not coalesce(lag(held) {_A}, false) then 0.002 else 0 end else 0 end as net from a)"


@query("asset_audit", on_panel("w", f"{_CC} select asset, count_if(held) as held_days, count_if(st) as episodes, round(avg(case when held then 1.0 else 0 end), 6) as share_held, round(avg(net) * 52, 5) + 0.0 as net_annual, round(median(case when held then net end), 6) + 0.0 as median_net from b group by 1"))
def asset_audit(s, d):
    x = carry_rows(s, d)
    return x.groupBy("asset").agg(
        F.count_if("held").alias("held_days"), F.count_if("episode_start").alias("episodes"), r(F.avg(F.col("held").cast("double")), "share_held"),
        r(F.avg("net") * 52, "net_annual", 5), r(F.percentile(F.when(F.col("held"), F.col("net")), F.lit(0.5)), "median_net"),
    )


@query("bucket_summary", on_panel("w", f"{_CC}, ag as (select asset, avg(net) * 52 as net from b group by 1) select case when cast(substr(asset, 7) as int) <= 10 then 'top' else 'tail' end as bucket, count(*) as n, round(avg(net), 5) + 0.0 as mean, round(median(net), 5) + 0.0 as median, case when median(net) > 0.02 then 'go' else 'kill' end as verdict from ag group by 1"))
def bucket_summary(s, d):
    a = carry_rows(s, d).groupBy("asset").agg((F.avg("net") * 52).alias("net"))
    b = F.when(F.substring("asset", 7, 9).cast("int") <= 10, "top").otherwise("tail")
    m = F.percentile("net", F.lit(0.5))
    return a.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), r(F.avg("net"), "mean", 5), r(m, "median", 5), F.when(m > 0.02, "go").otherwise("kill").alias("verdict"))


@query("episode_count", on_panel("w", f"{_CC} select asset, count_if(st) as episodes from b group by 1"))
def episode_count(s, d):
    return carry_rows(s, d).groupBy("asset").agg(F.count_if("episode_start").alias("episodes"))


@query("convergence_ratio", on_panel("w", f"""bz as (select dt, asset, price / nullif(nav, 0) - 1 as basis, funding from dense), cg as (select asset, lead(basis, 4) {_A} - basis as db, sum(funding) over (partition by asset order by dt rows between 1 following and 4 following) as f, count(funding) over (partition by asset order by dt rows between 1 following and 4 following) as k from bz)
select asset, round(median(db / f), 4) + 0.0 as ratio, round(regr_slope(db, f), 4) + 0.0 as slope, round(regr_r2(db, f), 5) + 0.0 as r2 from cg where k = 4 and abs(f) > 0.001 and db is not null group by 1"""))
def convergence_ratio(s, d):
    x = dense(s, d).withColumn("basis", ratio(F.col("price"), F.col("nav")) - 1)
    w = by_asset().rowsBetween(1, 4)
    x = x.select("asset", (F.lead("basis", 4).over(by_asset()) - F.col("basis")).alias("db"), F.sum("funding").over(w).alias("f"), F.count("funding").over(w).alias("k"))
    x = x.filter("k = 4 and abs(f) > 0.001 and db is not null")
    return x.groupBy("asset").agg(r(F.percentile(F.col("db") / F.col("f"), F.lit(0.5)), "ratio", 4), r(F.regr_slope("db", "f"), "slope", 4), r(F.regr_r2("db", "f"), "r2", 5))


@query("hurdle_availability", on_panel("w", f"hu as (select asset, sum(funding) over (partition by asset order by dt rows between 2 preceding and current row) as f from dense) select asset, round(avg(case when abs(f) > 3 * 0.001 then 1.0 else 0 end), 6) as share from hu where f is not null group by 1"))
def hurdle_availability(s, d):
    x = dense(s, d).withColumn("f", F.sum("funding").over(trailing(3))).filter("f is not null")
    return x.groupBy("asset").agg(r(F.avg((F.abs("f") > 3 * 0.001).cast("double")), "share"))


@query("arm_metrics", on_panel("w", f"{_STR}, {_MO}, {nw_sql('st', 4)} select mo.strategy_id, mo.n, round(sr * sqrt(52), 5) + 0.0 as sharpe, round(t_stat, 5) + 0.0 as t_stat, round({_psr_sql(stats.expected_max_sharpe(0.002, 3)).replace('case when n', 'case when mo.n').replace('sqrt(n', 'sqrt(mo.n')}, 5) + 0.0 as dsr_z from mo join nw using (strategy_id)"))
def arm_metrics(s, d):
    x = strategies(s, d)
    t = stats.newey_west(x, 4).select("strategy_id", "t_stat")
    m = stats.moments(x).withColumn("z", stats.psr_z(stats.expected_max_sharpe(0.002, 3)))
    return m.join(t, "strategy_id").select("strategy_id", "n", r(F.col("sr") * 52**0.5, "sharpe", 5), r("t_stat", n=5), r("z", "dsr_z", 5))


@query("period_summary", on_panel("w", f"{_STR} select strategy_id, cast(date_trunc('quarter', dt) as date) as period, round(exp(sum(ln(1 + greatest(ret, -0.999)))) - 1, 5) + 0.0 as total, round(stddev_samp(ret), 6) + 0.0 as vol from st group by 1, 2"))
def period_summary(s, d):
    x = strategies(s, d)
    return x.groupBy("strategy_id", F.date_trunc("quarter", "dt").cast("date").alias("period")).agg(r(F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999))))) - 1, "total", 5), r(F.stddev_samp("ret"), "vol"))


@query("static_beta", on_panel("w", "m as (select *, avg(ret) over (partition by dt) as mkt from rets) select asset, round(covar_samp(ret, mkt) / nullif(var_samp(case when ret is not null then mkt end), 0), 5) + 0.0 as beta from m group by 1"))
def static_beta(s, d):
    x = panel.with_market(returns(s, d))
    return x.groupBy("asset").agg(r(ratio(F.covar_samp("ret", "mkt"), F.var_samp(F.when(F.col("ret").isNotNull(), F.col("mkt")))), "beta", 5))


@query("concept_coverage", "select round(avg(case when u then 1.0 else 0 end), 6) as urgent, round(avg(case when h then 1.0 else 0 end), 6) as high, round(avg(case when u and h then 1.0 else 0 end), 6) as both from (select o_custkey, bool_or(o_orderpriority = '1-URGENT') as u, bool_or(o_orderpriority = '2-HIGH') as h from orders group by 1)")
def concept_coverage(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.bool_or(F.col("o_orderpriority") == "2-HIGH").alias("h"))
    share = lambda c, n: r(F.avg(c.cast("double")), n)
    return g.agg(share(F.col("u"), "urgent"), share(F.col("h"), "high"), share(F.col("u") & F.col("h"), "both"))


@query("filing_lag", "with x as (select l_shipdate::date - o_orderdate::date as lag, l_returnflag as form from lineitem join orders on l_orderkey = o_orderkey) select form, count(*) as n, round(median(lag), 4) as median, round(quantile_cont(lag, 0.9), 4) as p90 from x where lag > 0 and lag < 400 group by 1")
def filing_lag(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = j.select(F.datediff("l_shipdate", "o_orderdate").alias("lag"), F.col("l_returnflag").alias("form")).filter("lag > 0 and lag < 400")
    return quantiles(x, "lag", (0.5, 0.9), ("form",)).select("form", "n", r(F.col("p")[0], "median", 4), r(F.col("p")[1], "p90", 4))


@query("gate_pair", on_panel("w", f"""{_STR}, y as (select strategy_id, year(dt) as seed, {_SR} as m from st group by 1, 2), p as (select seed, max(case when strategy_id = 'carry_low' then m end) - max(case when strategy_id = 'market' then m end) as diff from y group by 1)
select count(*) as seeds, round(min(diff), 5) + 0.0 as worst, min(diff) > -0.5 as passes, bool_and(diff > -2) as verdict from p"""))
def gate_pair(s, d):
    y = strategies(s, d).groupBy("strategy_id", F.year("dt").alias("seed")).agg(stats.sharpe("ret", 52).alias("m"))
    p = y.groupBy("seed").agg((F.max(F.when(F.col("strategy_id") == "carry_low", F.col("m"))) - F.max(F.when(F.col("strategy_id") == "market", F.col("m")))).alias("diff"))
    return p.agg(F.count("*").alias("seeds"), r(F.min("diff"), "worst", 5), (F.min("diff") > -0.5).alias("passes"), F.bool_and(F.col("diff") > -2).alias("verdict"))


@query("set_union", "select c_nationkey as k from customer where c_acctbal > 0 union select s_nationkey from supplier")
def set_union(s, d):
    return table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "select o_custkey as k from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderpriority = '2-HIGH'")
def set_intersect(s, d):
    o = table(s, d, "orders")
    return o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).intersect(o.filter("o_orderpriority = '2-HIGH'").select("o_custkey"))


@query("set_except", "select o_custkey as k from orders except select c_custkey from customer where c_mktsegment = 'BUILDING'")
def set_except(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).subtract(table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("dedupe_last", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1")
def dedupe_last(s, d):
    return panel.dedupe_last(table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("resample_last", on_panel("s", "select asset, last_day(dt) as period, arg_max(price, dt) as price, arg_max(funding, dt) as funding from dense where price is not null group by 1, 2"))
def resample_last(s, d):
    return panel.resample_last(dense(s, d, "s").filter("price is not null"), F.last_day("dt"), "price", "funding")


@query("exante_beta", on_panel("w", f"{_BW} select dt, round(sum(w * coalesce(beta, mb)), 5) + 0.0 as beta from (select *, avg(beta) over (partition by dt) as mb from bx) group by dt having sum(w * coalesce(beta, mb)) is not null"))
def exante_beta(s, d):
    x = _with_beta(s, d).withColumn("mb", F.avg("beta").over(by_date()))
    return x.groupBy("dt").agg(r(F.sum(F.col("w") * F.coalesce("beta", "mb")), "beta", 5)).filter("beta is not null")


@query("names_per_date", on_panel("w", "select dt, count(ret) as names from rets group by dt having count(ret) > 0"))
def names_per_date(s, d):
    return returns(s, d).groupBy("dt").agg(F.count("ret").alias("names")).filter("names > 0")


