"""Parsers on lines made of the tables' rows: the damaged ones must vanish or be counted, the rest come back."""

from pyspark.sql import functions as F

from gridloom.operators.quality import prior_tags
from gridloom.plans.registry import query
from gridloom.plans.views import on_panel, table
from gridloom.plans.views import panel as view
from gridloom.sources import parsers as ps


def _line(df, *cols, sep="\t"):
    return F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols))


@query("panel_load", on_panel("s", "select dt, asset, price, volume, dollar_volume from panel where price is not null"))
def panel_load(s, d):
    return view(s, d, "s").filter("price is not null").select("dt", "asset", "price", "volume", "dollar_volume")


@query("prices_any_layout", "select cast(o_orderdate as date) as dt, o_orderpriority as asset, round(avg(o_totalprice), 4) as price from orders group by 1, 2")
def prices_any_layout(s, d):
    x = table(s, d, "orders").select(F.col("o_orderdate").alias("Date"), F.col("o_orderpriority").alias("ticker"), F.col("o_totalprice").alias("PRC"))
    return ps.prices_any_layout(x).select("dt", "asset", F.round("price", 4).alias("price"))


@query("prices_wide_layout", "select cast(o_orderdate as date) as dt, case o_orderstatus when 'F' then 'F' when 'O' then 'O' else 'P' end as asset, round(avg(o_totalprice), 4) as price from orders group by 1, 2")
def prices_wide_layout(s, d):
    w = table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return ps.prices_any_layout(w).select("dt", "asset", F.round("price", 4).alias("price"))


@query("feed_pipe_parse", "select case when c_nationkey = 7 then 'short' else cast(c_custkey as varchar) end as symbol, case when c_nationkey = 7 then null when c_mktsegment = 'BUILDING' then null else c_acctbal end as rebate_rate, case when c_nationkey = 7 then null else c_nationkey / 4.0 end as fee_rate, case when c_nationkey = 7 then 0 else c_custkey * 10 end as available, c_nationkey <> 7 and c_acctbal > 5000 as capped, c_nationkey <> 7 as ok from customer")
def feed_pipe_parse(s, d):
    c = table(s, d, "customer")
    line = _line(c, "c_custkey", F.lit("USD"), F.lit("name"), F.lit("con"), F.lit("isin"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string")), (F.col("c_nationkey") / 4.0).cast("string"), F.concat(F.when(F.col("c_acctbal") > 5000, ">").otherwise(""), (F.col("c_custkey") * 10).cast("string")), F.lit(""), sep="|")
    lines = c.select(F.when(F.col("c_nationkey") == 7, "short|USD|line").otherwise(line).alias("line"))
    heads = s.createDataFrame([("#BOF|2026.06.12|16:07:43",), ("#SYM|CUR|NAME|CON|ISIN|REBATERATE|FEERATE|AVAILABLE|FIGI|",), ("",)], "line string")
    return ps.parse_pipe_feed(lines.unionByName(heads))


@query("filings_tsv_sub", "select 'A' || cast(o_orderkey as varchar) as adsh, o_custkey as cik, o_orderpriority as form, cast(o_orderdate as date) as filed from orders where o_orderstatus <> 'P'")
def filings_tsv_sub(s, d):
    o = table(s, d, "orders")
    good = _line(o, F.concat(F.lit("A"), F.col("o_orderkey").cast("string")), "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyyMMdd"))
    bad = _line(o, "o_orderkey", "o_custkey")
    return ps.parse_filings(o.select(F.when(F.col("o_orderstatus") == "P", bad).otherwise(good).alias("line")))


@query("filings_tsv_num", "select 'A' || cast(l_orderkey as varchar) as adsh, l_returnflag as tag, cast(l_shipdate as date) as ddate, l_extendedprice as value from lineitem where l_linestatus = 'F'")
def filings_tsv_num(s, d):
    li = table(s, d, "lineitem")
    value = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice").cast("string")).otherwise("n/a")
    return ps.parse_facts(li.select(_line(li, F.concat(F.lit("A"), F.col("l_orderkey").cast("string")), "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"), value).alias("line")))


@query("tsv_submission", "select cast(o_orderkey as varchar) as accession, cast(o_orderdate as date) as filed, lpad(cast(o_custkey as varchar), 10, '0') as issuer_id, case when o_orderpriority <> '5-LOW' then o_orderpriority end as ticker from orders where o_orderstatus = 'F'")
def tsv_submission(s, d):
    o = table(s, d, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "4").when(F.col("o_orderstatus") == "O", "4/A").otherwise("5")
    sym = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" ")).otherwise(F.col("o_orderpriority"))
    return ps.parse_submissions(o.select(_line(o, "o_orderkey", F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")), form, "o_custkey", sym).alias("line")))


@query("tsv_owner", "select cast(o_custkey as varchar) as accession, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as owner_seq, 'Owner ' || o_orderkey as owner, o_orderstatus = 'F' as is_officer, o_orderstatus in ('F', 'O') as is_director, o_orderstatus = 'P' as is_tenpct from orders")
def tsv_owner(s, d):
    o = table(s, d, "orders")
    rel = F.when(F.col("o_orderstatus") == "F", "Officer,Director").when(F.col("o_orderstatus") == "O", "Director").otherwise("TenPercentOwner")
    return ps.parse_owners(o.select(F.col("o_orderkey").alias("line_no"), _line(o, "o_custkey", F.concat(F.lit("Owner "), F.col("o_orderkey").cast("string")), rel).alias("line")))


@query("tsv_owner_files", "select cast(o_custkey as varchar) as accession, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as owner_seq, 'Owner ' || o_orderkey as owner, o_orderstatus = 'F' as is_officer, o_orderstatus in ('F', 'O') as is_director, o_orderstatus = 'P' as is_tenpct from orders")
def tsv_owner_files(s, d):
    """Owners written to text files in the order of their keys and read back: the order of lines is the files' own."""
    from gridloom.plans.q_streams import _folder

    o = table(s, d, "orders")
    rel = F.when(F.col("o_orderstatus") == "F", "Officer,Director").when(F.col("o_orderstatus") == "O", "Director").otherwise("TenPercentOwner")
    path = _folder(s, "owners")
    lines = o.select("o_orderkey", _line(o, "o_custkey", F.concat(F.lit("Owner "), F.col("o_orderkey").cast("string")), rel).alias("line"))
    lines.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("line").write.text(path)
    return ps.read_owners(s, path)


@query("tsv_trans", "select cast(l_orderkey as varchar) as accession, l_returnflag as code, l_linestatus as disposed, l_quantity as shares, case when l_discount > 0.02 then l_extendedprice end as price, cast(l_shipdate as date) as traded from lineitem")
def tsv_trans(s, d):
    li = table(s, d, "lineitem")
    price = F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice").cast("string"))
    return ps.parse_transactions(li.select(_line(li, "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", price, F.upper(F.date_format("l_shipdate", "dd-MMM-yyyy"))).alias("line")))


@query("kline_csv", "select event_type as asset, cast(ts as date) as dt, arg_max(value, {'t': epoch_ms(ts), 'v': value}) as close, round(sum(value), 4) as quote_volume from events group by 1, 2")
def kline_csv(s, d):
    e = table(s, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    t = F.when(F.col("event_id") % 2 == 0, ms * 1000).otherwise(ms)
    lines = e.select(F.col("event_type").alias("asset"), _line(e, t, F.lit("1"), F.lit("1"), F.lit("1"), "value", F.lit("1"), F.lit("1"), "value", sep=",").alias("line"))
    heads = e.select(F.col("event_type").alias("asset"), F.lit("open_time,open,high,low,close,volume,close_time,quote_volume").alias("line")).distinct()
    return ps.parse_klines(lines.unionByName(heads)).select("asset", "dt", "close", F.round("quote_volume", 4).alias("quote_volume"))


@query("funding_daily_sum", "select event_type as asset, cast(ts as date) as dt, round(sum(value), 4) + 0.0 as funding from events group by 1, 2")
def funding_daily_sum(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("asset"), F.col("ts").cast("date").alias("dt")).agg((F.round(F.sum("value"), 4) + 0.0).alias("funding"))


_PER = "case o_orderpriority when '1-URGENT' then '10-K' when '2-HIGH' then '10-Q' when '3-MEDIUM' then '10-K/A' else '8-K' end"


@query("concept_json", f"""with x as (select o_custkey as entity, cast(o_orderdate as date) as filed, o_totalprice as value, {_PER} as form, strftime(o_orderdate - to_days(cast(o_orderkey % 90 as int)), '%Y-%m-%d') || '#' || lpad(cast(o_orderkey as varchar), 12, '0') as "end" from orders)
select entity, filed, arg_max(value, "end") as value, arg_max(form, "end") as form, max("end") as "end" from x where form <> '8-K' group by 1, 2""")
def concept_json(s, d):
    o = table(s, d, "orders")
    end = F.concat(F.date_format(F.date_sub("o_orderdate", (F.col("o_orderkey") % 90).cast("int")), "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), end.alias("end"), F.expr(_PER).alias("form"), F.col("o_totalprice").alias("val"))
    docs = o.groupBy(F.col("o_custkey").alias("entity")).agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("USD")).alias("units"))).alias("json"))
    return ps.concept_rows(docs)


@query("id_map_json", "select upper(p_name) as ticker, lpad(cast(p_partkey as varchar), 10, '0') as id from part")
def id_map_json(s, d):
    p = table(s, d, "part").select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.lower("p_name").alias("ticker"), F.col("p_partkey").alias("cik_str")))).alias("json"))
    return ps.id_map(p)


@query("name_lookup_txt", "select upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) as name, list_sort(list(distinct lpad(cast(p_partkey as varchar), 10, '0'))) as ids from part where p_size > 3 group by 1")
def name_lookup_txt(s, d):
    p = table(s, d, "part")
    good = F.concat(F.upper("p_name"), F.lit(" INC:"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.lit(":"))
    return ps.name_lookup(p.select(F.when(F.col("p_size") > 3, good).otherwise(F.col("p_name")).alias("line")))


@query("form4_xml", """with t as (select *, row_number() over w as txn, first_value(l_suppkey) over w as supp, first_value(l_partkey) over w as part
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_shipdate, l_returnflag))
select l_orderkey as doc_id, cast(txn as int) as txn, lpad(cast(supp as varchar), 10, '0') as issuer_id, 'S' || supp as ticker, 'Owner ' || part as owner, part % 2 = 0 as is_officer, part % 3 = 0 as is_director, false as is_tenpct,
  l_returnflag as code, l_quantity as shares, case when l_discount > 0.02 then l_extendedprice end as price, case when l_tax > 0.01 then l_linestatus end as acq_disp, cast(l_shipdate as date) as traded
from t where l_orderkey % 7 <> 0""")
def form4_xml(s, d):
    """Documents of an order's lines: prices and codes missing from some, two owners, a cut document for every seventh order."""
    li = table(s, d, "lineitem")
    tag = lambda n, *v: F.concat(F.lit(f"<{n}>"), *v, F.lit(f"</{n}>"))
    val = lambda n, c: tag(n, tag("value", c.cast("string")))
    price = lambda r: F.when(r["l_discount"] > 0.02, val("transactionPricePerShare", r["l_extendedprice"])).otherwise("<transactionPricePerShare><footnoteId id='F1'/></transactionPricePerShare>")
    side = lambda r: F.when(r["l_tax"] > 0.01, val("transactionAcquiredDisposedCode", r["l_linestatus"])).otherwise("")
    txn = lambda r: tag(
        "nonDerivativeTransaction", val("transactionDate", F.date_format(r["l_shipdate"], "yyyy-MM-dd")), tag("transactionCoding", tag("transactionCode", r["l_returnflag"])),
        tag("transactionAmounts", val("transactionShares", r["l_quantity"]), price(r), side(r)),
    )
    # lines are shuffled as they are: their text is many times as long
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    lines = li.select("l_orderkey", line.alias("r")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    supp, part = F.col("r")[0]["l_suppkey"].cast("string"), F.col("r")[0]["l_partkey"]
    flag = lambda n, k: tag(n, F.when(part % k == 0, "true").otherwise("0"))
    owner = tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerName", F.lit("Owner "), part.cast("string"))), tag("reportingOwnerRelationship", flag("isOfficer", 2), flag("isDirector", 3)))
    other = F.lit("<reportingOwner><reportingOwnerId><rptOwnerName>Other</rptOwnerName></reportingOwnerId></reportingOwner>")
    issuer = tag("issuer", tag("issuerCik", F.lpad(supp, 10, "0")), tag("issuerTradingSymbol", F.lit("S"), supp))
    rows = tag("nonDerivativeTable", F.array_join(F.transform("r", txn), ""))
    xml = F.concat(F.lit("<ownershipDocument>"), issuer, owner, other, rows, F.when(F.col("l_orderkey") % 7 == 0, "").otherwise("</ownershipDocument>"))
    return ps.ownership_xml(lines.select(F.col("l_orderkey").alias("doc_id"), xml.alias("xml")))


@query("accession_list", "select o_custkey as entity, cast(o_orderkey as varchar) as accession, cast(o_orderdate as date) as filed from orders where o_orderstatus = 'F'")
def accession_list(s, d):
    o = table(s, d, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "4").otherwise("4/A")
    a = F.sort_array(F.collect_list(F.struct("o_orderkey", form.alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t"))))
    docs = o.groupBy(F.col("o_custkey").alias("entity")).agg(a.alias("a"))
    docs = docs.select("entity", F.to_json(F.struct(F.col("a.f").alias("form"), F.transform("a", lambda x: x["o_orderkey"].cast("string")).alias("accession"), F.col("a.t").alias("date"))).alias("json"))
    return ps.accession_list(docs)


@query("delist_hits_json", "select cast(c_custkey as varchar) as id, c_mktsegment || ' Fund' as name, date '2020-01-01' + cast(c_custkey % 900 as int) as filed from customer where c_nationkey not in (3, 4)")
def delist_hits_json(s, d):
    c = table(s, d, "customer")
    cik = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    name = F.concat("c_mktsegment", F.lit(" Fund  (ABC)  (CIK "), cik, F.lit(")"))
    hit = F.struct(F.when(F.col("c_nationkey") != 3, F.array(cik, F.lit("x"))).otherwise(F.array()).alias("ciks"), F.when(F.col("c_nationkey") != 4, F.array(name)).alias("display_names"), F.date_format(F.expr("date_add(date '2020-01-01', cast(c_custkey % 900 as int))"), "yyyy-MM-dd").alias("file_date"))
    return ps.delist_hits(c.select(F.to_json(F.struct(F.struct(F.array(F.struct(hit.alias("_source"))).alias("hits")).alias("hits"))).alias("json")))


@query("fund_snapshot", "select c_custkey, round(abs(c_acctbal) * 10 * c_nationkey, 4) + 0.0 as dollar_adv, c_nationkey as nav_lag_days from customer where c_mktsegment <> 'BUILDING'")
def fund_snapshot(s, d):
    c = table(s, d, "customer")
    price = F.when(F.col("c_mktsegment") != "BUILDING", F.abs("c_acctbal").cast("string")).otherwise("N/A")
    raw = c.select("c_custkey", price.alias("price"), (F.col("c_nationkey") * 10).cast("string").alias("vol"), F.lit("2024-03-01").alias("asof"), F.expr("cast(date_sub(date '2024-03-01', cast(c_nationkey as int)) as string)").alias("nav_date"))
    x = raw.select("c_custkey", (F.round(F.col("price").try_cast("double") * F.col("vol").try_cast("double"), 4) + 0.0).alias("dollar_adv"), F.datediff(F.col("asof").try_cast("date"), F.col("nav_date").try_cast("date")).cast("long").alias("nav_lag_days"))
    return x.filter("dollar_adv is not null")


@query("price_nav_history", "select o_custkey as fund, cast(o_orderdate as date) as dt, arg_max(o_totalprice, o_orderkey) as price from orders group by 1, 2")
def price_nav_history(s, d):
    o = table(s, d, "orders")
    docs = o.groupBy(F.col("o_custkey").alias("fund")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_totalprice").alias("p"))).alias("rows"))
    docs = docs.select("fund", F.to_json("rows").alias("json"))
    x = docs.select("fund", F.explode(F.from_json("json", "array<struct<k:bigint,d:string,p:double>>")).alias("r"))
    return x.groupBy("fund", F.to_date("r.d").alias("dt")).agg(F.max_by("r.p", "r.k").alias("price"))


@query("eod_json", "select o_custkey as ticker, cast(o_orderdate as date) as dt, max(o_totalprice) as close from orders group by 1, 2")
def eod_json(s, d):
    o = table(s, d, "orders").select("o_custkey", F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.col("o_totalprice").alias("close"))).alias("json"))
    x = o.select("o_custkey", F.from_json("json", "struct<date:string,close:double>").alias("r"))
    return x.groupBy(F.col("o_custkey").alias("ticker"), F.to_date(F.substring("r.date", 1, 10)).alias("dt")).agg(F.max("r.close").alias("close"))


@query("ticker_catalog", "select upper(p_name) as ticker, p_type as kind from part where p_size <= 25 and p_brand in ('Brand#1', 'Brand#2', 'Brand#3')")
def ticker_catalog(s, d):
    p = table(s, d, "part")
    lines = p.select(_line(p, F.lower("p_name"), "p_brand", "p_type", F.when(F.col("p_size") <= 25, "2010-01-04"), sep="\t").alias("line"))
    x = ps.parse_tsv(lines, ["ticker", "exchange", "kind", "start"])
    return x.filter(F.col("exchange").isin("Brand#1", "Brand#2", "Brand#3") & F.col("start").try_cast("date").isNotNull()).select(F.upper("ticker").alias("ticker"), "kind")


@query("factor_csv", "with m as (select last_day(cast(o_orderdate as date)) as dt, o_orderpriority as name, (sum(cast(round(o_totalprice * 100) as bigint)) // (count(*) * 10)) / 10000.0::double as a, cast(count(*) as double) as b from orders group by 1, 2) select name, dt, round(a / 100, 8) as mkt_rf, round(b / 100, 8) as smb, round((a + b) / 100, 6) as hml from m")
def factor_csv(s, d):
    m = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyyMM").alias("k")).agg((F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (F.count("*") * 10)) / F.lit(10000.0)).alias("a"), F.count("*").cast("double").alias("b"))
    body = F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "k", "a", "b", (F.col("a") + F.col("b")).cast("string")))), "\n")
    docs = m.groupBy("name").agg(F.concat(F.lit("created by\n\n ,Mkt-RF,SMB,HML\n"), body, F.lit("\n\n Annual Factors\n,Mkt-RF,SMB,HML\n1995,1,2,3\n199501,9,9,9\n")).alias("text"))
    return ps.factor_section(docs).select("name", "dt", F.round("mkt_rf", 8).alias("mkt_rf"), F.round("smb", 8).alias("smb"), F.round("hml", 6).alias("hml"))


@query("summary_json_scan", "select cast(o_orderdate as date) as asof, o_totalprice as equity, o_custkey as orders_sent, case when o_orderstatus = 'P' then 7 else (o_orderkey % 3) end as n_failed, cast(ceil((o_orderkey % 3) / 2.0) as int) as failed_buys, cast(floor((o_orderkey % 3) / 2.0) as int) as failed_sells from orders")
def summary_json_scan(s, d):
    o = table(s, d, "orders")
    fails = F.transform(F.slice(F.array(F.lit("buy"), F.lit("sell"), F.lit("buy")), 1, (F.col("o_orderkey") % 3).cast("int")), lambda x: F.struct(F.lit("X").alias("symbol"), x.alias("side")))
    j = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("asof"), F.col("o_totalprice").alias("equity"), F.col("o_custkey").alias("orders_sent"), F.when(F.col("o_orderstatus") == "P", 7).alias("n_failed"), fails.alias("orders_failed")))
    return ps.summary_logs(o.select(j.alias("json")))


_TAGS = "tg as (select distinct strftime(o_orderdate, '%Y-%m') as tag from orders)"


@query("snapshot_list", f"with {_TAGS} select tag from tg")
def snapshot_list(s, d):
    return table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("tag")).distinct()


@query("snapshot_prior", f"with {_TAGS} select tag, lag(tag) over (order by tag) as prior from tg")
def snapshot_prior(s, d):
    return prior_tags(snapshot_list(s, d))


@query("parse_surprise_csv", "select upper(p_brand) as ticker, cast(o_orderdate as date) as ann_date, o_totalprice as actual_eps, cast(o_custkey as double) as est_eps, cast(null as double) as std_est from orders join part on p_partkey = o_custkey where o_orderstatus <> 'P'")
def parse_surprise_csv(s, d):
    j = table(s, d, "orders").join(table(s, d, "part"), F.col("p_partkey") == F.col("o_custkey"))
    when = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    raw = j.select(F.lower("p_brand").alias(" Ticker "), when.alias("ANN_DATE"), F.col("o_totalprice").cast("string").alias("actual_eps"), F.col("o_custkey").cast("string").alias("est_eps "))
    return ps.surprises(raw).select("ticker", "ann_date", "actual_eps", "est_eps", "std_est")


def _extract(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_orderkey").alias("period_end"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("Q").alias("freq"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("gp"), (F.col("o_totalprice") * 2).alias("revt"), F.col("o_totalprice").alias("cogs"), F.col("o_totalprice").alias("at"))


@query("compustat_fundamentals", "select o_custkey as ticker, cast(o_orderdate as date) as filed, o_totalprice as assets from orders")
def compustat_fundamentals(s, d):
    return ps.require_filing_dates(_extract(s, d)).select("ticker", "filed", F.col("at").alias("assets"))


@query("compustat_field", "select o_custkey as ticker, cast(o_orderdate as date) as filed, arg_max(o_totalprice, o_orderkey) as value from orders where o_orderstatus = 'F' group by 1, 2")
def compustat_field(s, d):
    return ps.compustat_field(_extract(s, d), "gross_profit", annual=True)
