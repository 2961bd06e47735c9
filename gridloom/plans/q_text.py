"""Scalar classification and normalisation over text made of the tables' columns."""

from pyspark.sql import functions as F

from gridloom.functions import scalars as sc
from gridloom.functions.windows import by_asset, ratio
from gridloom.plans.registry import query
from gridloom.plans.views import dense, on_panel, r, table

_A = "over (partition by asset order by dt)"
#: Phrases by a key's remainder; the same text in both engines.
_REASON = """case o_orderkey % 9 when 0 then 'Acquired by ' || o_orderpriority when 1 then 'Filed for Chapter 11' when 2 then 'Moved to S&P SmallCap 600' when 3 then 'Market capitalization no longer representative'
 when 4 then 'Spun off from parent' when 5 then '' when 6 then 'Merger; was also delisted' when 7 then o_orderpriority || ' constituent swap' else o_orderstatus end"""
_NAME = "case p_size % 4 when 0 then 'The ' || p_name || ' Holdings, Inc.' when 1 then p_name || ' Corp /DE/' when 2 then p_name || ' Group  Co Ltd' else p_name end"


def _like(words):
    return " or ".join(f"contains(lower(t), '{w}')" for w in words)


@query("normalize_symbol", "select p_partkey, replace(upper(trim(' ' || replace(p_brand, '#', '.') || ' ')), '.', '-') as symbol from part")
def normalize_symbol(s, d):
    return table(s, d, "part").select("p_partkey", sc.normalize_symbol(F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit(" "))).alias("symbol"))


_PERP = "case p_size % 3 when 0 then '1000' when 1 then '100' else '' end || upper(replace(p_brand, '#', '')) || 'USDT'"


@query("perp_to_spot", f"select p_partkey, regexp_replace({_PERP}, '^(1000+|100)([A-Z][A-Z0-9]*USDT)$', '\\2') as spot from part")
def perp_to_spot(s, d):
    return table(s, d, "part").select("p_partkey", sc.perp_to_spot(F.expr(_PERP)).alias("spot"))


_SUF = "|".join(sc.SUFFIXES)


@query("normalize_name", f"""with n as (select p_partkey, trim(regexp_replace(upper(regexp_replace(split_part({_NAME}, '/', 1), '[^A-Za-z0-9 ]', ' ', 'g')), '\\s+', ' ', 'g')) as n from part)
select p_partkey, regexp_replace(regexp_replace(n, '^THE( |$)', ''), '(^|\\s)({_SUF})(\\s+({_SUF}))*$', '') as name from n""")
def normalize_name(s, d):
    return table(s, d, "part").select("p_partkey", sc.normalize_name(F.expr(_NAME)).alias("name"))


@query("clean_entity_name", "select p_partkey, p_name as name from part")
def clean_entity_name(s, d):
    raw = F.concat("p_name", F.lit("  ("), F.upper(F.translate("p_brand", "#", "")), F.when(F.col("p_partkey") % 2 == 0, ")  (CIK ").otherwise(")  (CIK   "), F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.lit(")"))
    return table(s, d, "part").select("p_partkey", sc.clean_entity_name(raw).alias("name"))


@query("classify_reason", f"with x as (select o_orderkey, {_REASON} as t from orders) select o_orderkey, case when t = '' then 'unknown' " + " ".join(f"when {_like(w)} then '{b}'" for b, w in sc.REASONS.items()) + " else 'unknown' end as bucket from x")
def classify_reason(s, d):
    return table(s, d, "orders").select("o_orderkey", sc.classify_reason(F.expr(_REASON)).alias("bucket"))


@query("is_fund_name", f"select p_partkey, regexp_matches(case p_size % 3 when 0 then p_name || ' Income Fund' when 1 then p_name || ' Refunding' else p_name end, '{sc.FUND_NAME}') as fund from part")
def is_fund_name(s, d):
    x = F.expr("case p_size % 3 when 0 then p_name || ' Income Fund' when 1 then p_name || ' Refunding' else p_name end")
    return table(s, d, "part").select("p_partkey", sc.is_fund_name(x).alias("fund"))


@query("text_has_distress", f"select doc_id, regexp_matches(coalesce(text, ''), '{sc.DISTRESS}') as distress from documents")
def text_has_distress(s, d):
    return table(s, d, "documents").select("doc_id", sc.text_has_distress(F.col("text")).alias("distress"))


_FORMS = "case o_orderpriority when '1-URGENT' then 'N-2' when '2-HIGH' then 'N-8F' when '3-MEDIUM' then 'N-CSR' when '5-LOW' then '10-K' else '8-K' end"


@query("classify_death", f"""with f as (select o_custkey, list({_FORMS}) as forms from orders group by 1), x as (select c_custkey, c_acctbal > 8000 as listed, case when c_nationkey < 3 then 'target-term 2030' else c_mktsegment end as name, coalesce(forms, []) as forms from customer left join f on o_custkey = c_custkey),
o as (select c_custkey, case when not list_contains(forms, 'N-2') then 'not_a_closed_end_fund' when listed then 'security_redemption_fund_alive' when name like 'target-term%' then 'term_liquidation' when list_contains(forms, 'N-8F') then 'liquidation_or_merger' when list_contains(forms, 'N-CSR') then 'open_ending_or_conversion' else 'delisted_unknown' end as outcome from x)
select o.*, list_contains(forms, 'N-2') as is_cef_or_bdc, list_contains(forms, 'N-2') and list_contains(forms, '10-K') as is_bdc, not listed as fully_delisted, case when outcome in ('term_liquidation', 'liquidation_or_merger', 'open_ending_or_conversion') then true end as nav_event from o join x using (c_custkey)""")
def classify_death(s, d):
    f = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.expr(_FORMS)).alias("forms"))
    c = table(s, d, "customer").join(f, F.col("o_custkey") == F.col("c_custkey"), "left")
    c = c.withColumn("forms", F.coalesce("forms", F.array().cast("array<string>"))).withColumn("name", F.when(F.col("c_nationkey") < 3, "target-term 2030").otherwise(F.col("c_mktsegment")))
    flags = sc.death_flags(F.col("forms"), F.col("c_acctbal") > 8000)
    return c.select("c_custkey", *(v.alias(k) for k, v in flags.items()), sc.classify_death(F.col("name"), F.col("forms"), F.col("c_acctbal") > 8000).alias("outcome")).withColumn("nav_event", sc.nav_event(F.col("outcome")))


@query("role_tag", "select c_custkey, case when c_acctbal > 8000 then 'officer' when c_mktsegment = 'BUILDING' then 'director' when c_nationkey < 5 then 'tenpct' else 'insider' end as role from customer")
def role_tag(s, d):
    return table(s, d, "customer").select("c_custkey", sc.role_tag(F.col("c_acctbal") > 8000, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 5).alias("role"))


@query("classify_resolution", "with l as (select o_custkey, max(o_orderdate)::date as last, max(case when o_orderpriority = '1-URGENT' then o_orderdate end)::date - 600 as deleted from orders group by 1) select o_custkey, case when last is null or deleted is null then 'unknown' when last <= deleted + 540 then 'plausible_dead' else 'possible_reassignment' end as verdict from l")
def classify_resolution(s, d):
    g = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last"), F.date_sub(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).cast("date"), 600).alias("deleted"))
    return g.select("o_custkey", sc.classify_resolution(F.col("last"), F.col("deleted")).alias("verdict"))


@query("owner_norm_key", "select p_partkey, upper(regexp_replace(trim('  ' || replace(p_name, ' ', '   ') || ' '), '\\s+', ' ', 'g')) as key, round(p_retailprice, 4) + 0.0 as shares from part")
def owner_norm_key(s, d):
    x = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" "))
    return table(s, d, "part").select("p_partkey", sc.owner_key(x).alias("key"), r("p_retailprice", "shares", 4))


@query("fund_discount", on_panel("s", "select dt, asset, round((price - nav) / nullif(nav, 0), 6) + 0.0 as discount from dense"))
def fund_discount(s, d):
    return dense(s, d, "s").select("dt", "asset", r(sc.discount(F.col("price"), F.col("nav")), "discount"))


@query("basis", on_panel("w", "select dt, asset, round((price - nav) / nullif(nav, 0), 6) + 0.0 as basis from dense where price is not null"))
def basis(s, d):
    return dense(s, d).filter("price is not null").select("dt", "asset", r(sc.discount(F.col("price"), F.col("nav")), "basis"))


@query("total_return_dist", on_panel("w", f"select dt, asset, round((price + coalesce(case when funding > 0 then funding * price end, 0)) / nullif(lag(price) {_A}, 0) - 1, 6) + 0.0 as tr from dense"))
def total_return_dist(s, d):
    x = dense(s, d).withColumn("dist", F.when(F.col("funding") > 0, F.col("funding") * F.col("price")))
    return x.select("dt", "asset", r(sc.total_return_dist("price", "dist"), "tr"))


@query("total_return_funding", on_panel("s", "select dt, asset, round(ret - coalesce(funding, 0), 6) + 0.0 as tr from rets"))
def total_return_funding(s, d):
    x = dense(s, d, "s")
    ret = ratio(F.col("price"), F.lag("price").over(by_asset())) - 1
    return x.select("dt", "asset", r(ret - F.coalesce("funding", F.lit(0.0)), "tr"))
