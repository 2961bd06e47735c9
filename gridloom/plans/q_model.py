"""Features, labels, walk-forward models."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, ratio
from gridloom.operators import boosting, books, panel, stats
from gridloom.plans.q_aggregates import ic_sql
from gridloom.plans.q_books import _decile_sql
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r

_A = "over (partition by asset order by dt)"


def _z(c):
    return f"({c} - avg({c}) over (partition by dt)) / (stddev_samp({c}) over (partition by dt) + 1e-12)"


_FEATURES = f"""f0 as (select dt, asset, bar_no, price, ln(lag(price, 4) {_A}) - ln(lag(price, 52) {_A}) as mom_long, ln(lag(price, 4) {_A}) - ln(lag(price, 26) {_A}) as mom_mid, ln(price) - ln(lag(price, 4) {_A}) as reversal,
  case when count(ret) over v >= 13 then stddev_samp(ret) over v end as vol, price / case when count(price) over h >= 52 then max(price) over h end - 1 as high_ratio, lead(price, 4) {_A} / nullif(price, 0) - 1 as fwd from rets
  window v as (partition by asset order by dt rows between 12 preceding and current row), h as (partition by asset order by dt rows between 51 preceding and current row)),
f1 as (select dt, asset, bar_no, {', '.join(f'{_z(c)} as {c}' for c in panel.FEATURES)}, {_z('fwd')} as label from f0)"""


@query("build_features", on_panel("w", f"{_FEATURES} select dt, asset, {', '.join(f'round({c}, 5) + 0.0 as {c}' for c in panel.FEATURES)} from f1"))
def build_features(s, d):
    return panel.build_features(dense(s, d)).select("dt", "asset", *(r(c, n=5) for c in panel.FEATURES))


@query("build_labels", on_panel("w", f"{_FEATURES} select dt, asset, round(label, 5) + 0.0 as label from f1"))
def build_labels(s, d):
    return panel.build_labels(dense(s, d), 4).select("dt", "asset", r("label", n=5))


_STACK = f"{_FEATURES}, sk as (select * from f1 where label is not null and " + " and ".join(f"{c} is not null" for c in panel.FEATURES) + ")"


def stacked(s, d):
    x = dense(s, d)
    return panel.stack_panel(panel.build_features(x), panel.build_labels(x, 4))


@query("stack_panel", on_panel("w", f"{_STACK} select dt, asset, round(mom_long, 5) + 0.0 as mom_long, round(label, 5) + 0.0 as label from sk"))
def stack_panel(s, d):
    return stacked(s, d).select("dt", "asset", r("mom_long", n=5), r("label", n=5))


@query("walk_forward_windows", on_panel("w", "n as (select max(bar_no) as n from cal), w as (select unnest(range(150, n - 26 + 1, 26)) as lo from n) select cast((lo - 150) // 26 as int) as window_id, lo - 8 as train_end, lo as test_lo, lo + 26 as test_hi from w"))
def walk_forward_windows(s, d):
    w = _windows(s, d)
    return w.select("window_id", *(F.col(c).cast("long").alias(c) for c in ("train_end", "test_lo", "test_hi")))


def _windows(s, d):
    return panel.walk_forward_windows(panel.calendar(dense(s, d)), 150, 26, 8)


_XS = list(panel.FEATURES)


def _ridge_sql(alpha, windows="wn", by="window_id", test="sk"):
    """Ridge with an unpenalised intercept on all features: window moments, then Gaussian elimination, one step a table."""
    k = len(_XS)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    cell = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    moments = [f"count(*) * covar_pop({_XS[i]}, {_XS[j]}){f' + {alpha}' if i == j else ''} as {cell(i, j)}" for i, j in at]
    moments += [f"count(*) * covar_pop({x}, label) as b{i}" for i, x in enumerate(_XS)] + [f"avg({x}) as m{i}" for i, x in enumerate(_XS)]
    tables = [f"e0 as (select {by}, avg(label) as my, {', '.join(moments)} from sk join {windows} on bar_no - 1 < train_end group by {by})"]
    for p in range(k - 1):
        factor = lambda i: f"{cell(p, i)} / {cell(p, p)}"  # noqa: B023, E731
        new = [f"{cell(i, j)} - {factor(i)} * {cell(p, j)} as {cell(i, j)}" for i, j in at if i > p]
        new += [f"b{i} - {factor(i)} * b{p} as b{i}" for i in range(p + 1, k)]
        tables.append(f"e{p + 1} as (select * replace ({', '.join(new)}) from e{p})")
    last = f"e{k - 1}"
    for p in reversed(range(k)):
        rest = "".join(f" - {cell(p, j)} * w{j}" for j in range(p + 1, k))
        tables.append(f"s{p} as (select *, (b{p}{rest}) / {cell(p, p)} as w{p} from {last})")
        last = f"s{p}"
    fit = "my" + "".join(f" + w{i} * (k.{x} - m{i})" for i, x in enumerate(_XS))
    return f"{', '.join(tables)}, pr as (select {by}, k.dt, k.asset, {fit} as pred, label from {test} k join {windows} w on k.bar_no - 1 >= test_lo and k.bar_no - 1 < test_hi join s0 using ({by}))"


_WN = "n as (select max(bar_no) as n from cal), wn as (select cast((lo - 150) // 26 as int) as window_id, lo - 8 as train_end, lo as test_lo, lo + 26 as test_hi from (select unnest(range(150, n - 26 + 1, 26)) as lo from n))"
_RIDGE = f"{_STACK}, {_WN}, {_ridge_sql(10)}"


def predictions(s, d, alpha=10.0):
    p = stacked(s, d).withColumn("pos", F.col("bar_no") - 1)
    return stats.walk_forward_ridge(p, _windows(s, d), _XS, "label", alpha)


@query("walk_forward_ridge", on_panel("w", f"{_RIDGE} select window_id, dt, asset, round(pred, 5) + 0.0 as pred from pr"))
def walk_forward_ridge(s, d):
    return predictions(s, d).select("window_id", "dt", "asset", r("pred", n=5))


@query("walk_forward_ic", on_panel("w", f"{_RIDGE}, pq as (select dt, asset, round(pred, 9) as p, round(label, 9) as l from pr), {ic_sql('p', 'l', 5, 'pq')} select dt, round(ic, 5) + 0.0 as ic, n from ic"))
def walk_forward_ic(s, d):
    p = predictions(s, d).select("dt", "asset", F.round("pred", 9).alias("p"), F.round("label", 9).alias("l"))
    return stats.rank_ic(p, "p", "l").select("dt", r("ic", n=5), "n")


_ALPHAS = f"""{_STACK}, {_WN}, wi as (select cast((lo - 78) // 26 as int) as window_id, lo - 8 as train_end, lo as test_lo, lo + 26 as test_hi, alpha from (select unnest(range(78, n - 26 + 1, 26)) as lo from n), (select unnest([1.0, 10.0, 100.0, 1000.0]::double[]) as alpha)),
{_ridge_sql("alpha", "wi", "window_id, alpha")}, {ic_sql('pred', 'label', 5, 'pr', 'window_id, alpha, dt')},
gd as (select w.window_id, wi.alpha, round(avg(ic), 12) as score from ic join wi using (window_id, alpha) join wn w on wi.test_hi <= w.train_end group by 1, 2),
ch as (select window_id, alpha, row_number() over (partition by window_id order by score desc, alpha) as k from gd where score is not null)"""


@query("ridge_alpha_select", on_panel("w", f"{_ALPHAS} select window_id, coalesce(alpha, 100.0::double) as alpha from wn left join (from ch where k = 1) using (window_id)"))
def ridge_alpha_select(s, d):
    """The grid value chosen per window by an inner expanding walk-forward within its training bars."""
    p = stacked(s, d).withColumn("pos", F.col("bar_no") - 1)
    inner = panel.walk_forward_windows(panel.calendar(dense(s, d)), 78, 26, 8)
    return stats.select_alpha(p, _windows(s, d), inner, _XS, "label")


@query("walk_forward_gbt")
def walk_forward_gbt(s, d):
    """Boosted trees of depth 3, 200 rounds of rate 0.05 with L2, per window on all features, fitted on its training rows and scored on its test rows."""
    p = stacked(s, d).withColumn("pos", F.col("bar_no") - 1)
    return boosting.walk_forward_boosted(p, _windows(s, d), _XS, "label", boosting.Boosting()).select("window_id", "dt", "asset", r("pred"))


_LIVE = f"""{_STACK}, ft as (select * from f1 where {' and '.join(f'{c} is not null' for c in panel.FEATURES)}),
wn as (select 0 as window_id, max(bar_no) - 4 as train_end, max(bar_no) - 1 as test_lo, max(bar_no) as test_hi from ft), {_ridge_sql(10, test="ft")},
sc as (select dt, 1 as bar_no, asset, round(pred - avg(pred) over (partition by dt, substr(asset, 1, 7)), 9) as score from pr), {_decile_sql(0.1, 1)}"""


@query("live_scores", on_panel("w", f"{_LIVE} select dt, asset, round(score, 6) + 0.0 as score, round(w, 6) + 0.0 as w from wt join sc using (dt, asset)"))
def live_scores(s, d):
    """One fit on fully labelled rows; scores of the last date with features, less the mean of their sector (a brand's manufacturer), and decile weights."""
    x = dense(s, d)
    f = panel.build_features(x).dropna(subset=_XS)
    top = f.agg(F.max("bar_no").alias("top")).first().top or 0
    w = s.createDataFrame([(0, top - 4, top - 1, top)], "window_id int, train_end int, test_lo int, test_hi int")
    p = f.join(panel.build_labels(x, 4).drop("bar_no"), ["dt", "asset"], "left").withColumn("pos", F.col("bar_no") - 1)
    pred = stats.walk_forward_ridge(p, w, _XS, "label")
    pred = pred.withColumn("pred", F.col("pred") - F.avg("pred").over(W.partitionBy("dt", F.substring("asset", 1, 7))))
    sc = pred.select("dt", F.lit(1).alias("bar_no"), "asset", F.round("pred", 9).alias("score"))
    return books.decile_weights(sc, 0.1, 1).join(sc.select("asset", "score"), "asset").select("dt", "asset", r("score"), r("w"))


@query("leak_probe", on_panel("w", f"f as (select dt, asset, round(lead(price, 4) {_A} / nullif(price, 0) - 1, 9) as fwd from dense), {ic_sql('fwd', 'fwd', 5, 'f')} select dt, round(ic, 6) + 0.0 as ic from ic"))
def leak_probe(s, d):
    x = dense(s, d).select("dt", "asset", F.round(ratio(F.lead("price", 4).over(by_asset()), F.col("price")) - 1, 9).alias("fwd"))
    return stats.rank_ic(x.withColumn("leak", F.col("fwd")), "leak", "fwd").select("dt", r("ic"))


@query("regime_probs")
def regime_probs(s, d):
    """P(calm) per asset and bar from a two-state Gaussian hidden Markov model refit on expanding windows, filtered only."""
    from gridloom.operators.regime import regime_probabilities

    x = dense(s, d).withColumn("ret", F.ln("price") - F.ln(F.lag("price").over(by_asset()))).filter("ret is not null")
    return regime_probabilities(x.select("asset", "dt", "ret"), refit=52, least=104)
