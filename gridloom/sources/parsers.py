"""Parsers from rows of text lines to typed rows, and file readers over them.

Each ``parse_*`` takes a DataFrame with a string column ``line`` (other columns
ride along) and needs no file; ``read_*`` adds the scan. Cells that don't parse
become null, lines that can't be rows are dropped or counted as stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: periodic filing forms
PERIODIC_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")


def _num(c: Column, kind: str = "double") -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as rows with their file name."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as rows with their file and ``line_no``, from 0 in each file's order, however files are split among tasks.

    Each split counts its lines; what lies before a split in its file is added
    to the place of a line in its split. Splits, not lines, go through a window.
    """
    d = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    )
    parts = d.groupBy("_path", "_start").agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    before = W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("_path").alias("_p"), F.col("_start").alias("_s"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    d = d.join(parts, (F.col("_path") == F.col("_p")) & (F.col("_start") == F.col("_s")))
    return d.select("line", F.element_at(F.split("_path", "/"), -1).alias("file"), (F.col("_at") + F.col("_shift")).alias("line_no"))


def read_owners(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_owners` of tab-separated files, an accession's owners in the order of their lines."""
    return parse_owners(read_numbered_lines(spark, path).select("line", F.struct("file", "line_no").alias("line_no")))


def parse_pipe_feed(lines: DataFrame) -> DataFrame:
    """Availability feed: symbol, rebate_rate, fee_rate, available, capped, ok. Comment and empty lines leave; short or malformed ones have ok false."""
    d = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("_c", F.split("line", r"\|"))
    cell = lambda i: F.trim(F.get("_c", F.lit(i)))
    rest = F.regexp_replace(cell(7), "^>+", "")
    blank = lambda i: (cell(i) == "") | cell(i).try_cast("double").isNotNull()
    ok = (F.size("_c") >= 8) & blank(5) & blank(6) & ((rest == "") | rest.try_cast("bigint").isNotNull())
    return d.select(
        *[c for c in lines.columns if c != "line"], F.col("_c")[0].alias("symbol"), _num(cell(5)).alias("rebate_rate"), _num(cell(6)).alias("fee_rate"),
        F.coalesce(_num(rest, "bigint"), F.lit(0)).alias("available"), F.coalesce(F.startswith(cell(7), F.lit(">")), F.lit(False)).alias("capped"), F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def feed_stamp(lines: DataFrame) -> DataFrame:
    """The feed's own clock from its #BOF line."""
    b = lines.filter(F.startswith("line", F.lit("#BOF"))).withColumn("_c", F.split("line", r"\|")).filter(F.size("_c") >= 3)
    return b.select(F.concat(F.replace(F.col("_c")[1], F.lit("."), F.lit("-")), F.lit(" "), F.col("_c")[2]).alias("stamp"))


def parse_tsv(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated cells by position; lines with another number of cells are dropped."""
    d = lines.withColumn("_c", F.split("line", "\t")).filter(F.size("_c") == len(columns))
    return d.select(*[c for c in lines.columns if c != "line"], *(F.col("_c")[i].alias(n) for i, n in enumerate(columns)))


def yyyymmdd(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")


def dd_mmm_yyyy(c: Column) -> Column:
    return F.try_to_timestamp(F.initcap(F.lower(c)), F.lit("dd-MMM-yyyy")).cast("date")


def parse_filings(lines: DataFrame) -> DataFrame:
    """adsh, cik, form, filed of a submissions file."""
    d = parse_tsv(lines, ["adsh", "cik", "form", "filed"])
    return d.select("adsh", _num(F.col("cik"), "bigint").alias("cik"), "form", yyyymmdd(F.col("filed")).alias("filed")).filter("cik is not null and filed is not null")


def parse_facts(lines: DataFrame) -> DataFrame:
    """adsh, tag, ddate, value of a numeric facts file."""
    d = parse_tsv(lines, ["adsh", "tag", "ddate", "value"])
    return d.select("adsh", "tag", yyyymmdd(F.col("ddate")).alias("ddate"), _num(F.col("value")).alias("value")).filter("value is not null")


def parse_submissions(lines: DataFrame, amendments: bool = False) -> DataFrame:
    """accession, filed, issuer_id (ten digits), ticker of ownership submissions of form 4 (and 4/A)."""
    d = parse_tsv(lines, ["accession", "filed", "form", "issuer", "symbol"])
    d = d.filter(F.col("form").isin(*(["4", "4/A"] if amendments else ["4"])))
    s = F.trim("symbol")
    return d.select(F.trim("accession").alias("accession"), dd_mmm_yyyy(F.col("filed")).alias("filed"), F.lpad(F.trim("issuer"), 10, "0").alias("issuer_id"), F.when(~s.isin("", "nan", "NONE"), s).alias("ticker"))


def parse_owners(lines: DataFrame) -> DataFrame:
    """accession, owner_seq (position in the file within the accession), owner, flags; lines carry ``line_no``."""
    d = parse_tsv(lines, ["accession", "owner", "relationship"])
    rel = F.lower("relationship")
    seq = F.row_number().over(W.partitionBy("accession").orderBy("line_no"))
    return d.select("accession", seq.alias("owner_seq"), F.trim("owner").alias("owner"), F.contains(rel, F.lit("officer")).alias("is_officer"), F.contains(rel, F.lit("director")).alias("is_director"), F.contains(rel, F.lit("tenpercent")).alias("is_tenpct"))


def parse_transactions(lines: DataFrame) -> DataFrame:
    d = parse_tsv(lines, ["accession", "code", "disposed", "shares", "price", "traded"])
    return d.select("accession", "code", "disposed", _num(F.col("shares")).alias("shares"), _num(F.col("price")).alias("price"), dd_mmm_yyyy(F.col("traded")).alias("traded"))


def parse_klines(lines: DataFrame) -> DataFrame:
    """Daily close and quote volume per asset from positional CSV bars; header lines leave, microsecond epochs are scaled. Of bars at one time the greater close is the later."""
    d = lines.filter(~F.rlike(F.lower("line"), F.lit("^open[_ ]time"))).withColumn("_c", F.split("line", ","))
    t = F.col("_c")[0].try_cast("bigint")
    ms = F.when(t >= 10**14, F.expr("try_cast(_c[0] as bigint) div 1000")).otherwise(t)
    d = d.select("asset", ms.alias("ms"), F.get("_c", F.lit(4)).try_cast("double").alias("close"), F.get("_c", F.lit(7)).try_cast("double").alias("qv")).filter("ms is not null")
    return d.groupBy("asset", F.timestamp_millis("ms").cast("date").alias("dt")).agg(F.max_by("close", F.struct("ms", "close")).alias("close"), F.sum("qv").alias("quote_volume"))


def concept_rows(docs: DataFrame, unit: str = "USD") -> DataFrame:
    """(entity, filed, value, form, end) of JSON concept documents (entity, json): periodic forms, latest period end per filing date."""
    shape = "struct<units:map<string,array<struct<filed:string,`end`:string,form:string,val:double>>>>"
    d = docs.select("entity", F.explode(F.from_json("json", shape)["units"][unit]).alias("r"))
    d = d.filter(F.col("r.form").isin(*PERIODIC_FORMS) & F.col("r.filed").isNotNull() & F.col("r.val").isNotNull())
    best = d.groupBy("entity", F.to_date("r.filed").alias("filed")).agg(F.max_by("r", F.coalesce("r.end", F.lit(""))).alias("r"))
    return best.select("entity", "filed", F.col("r.val").alias("value"), F.col("r.form").alias("form"), F.col("r.end").alias("end"))


def id_map(docs: DataFrame) -> DataFrame:
    """(ticker, id) of JSON objects {k: {ticker, cik_str}}, ids padded to ten digits."""
    d = docs.select(F.explode(F.from_json("json", "map<string,struct<ticker:string,cik_str:bigint>>")).alias("k", "v"))
    return d.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("id"))


def name_lookup(lines: DataFrame) -> DataFrame:
    """(name, ids) of ``NAME:0000000000:`` lines by normalised name."""
    from gridloom.functions.scalars import normalize_name

    d = lines.select(F.regexp_extract("line", r"^(.*):(\d{10}):\s*$", 1).alias("n"), F.regexp_extract("line", r"^(.*):(\d{10}):\s*$", 2).alias("id")).filter("id <> ''")
    return d.withColumn("name", normalize_name(F.col("n"))).filter("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("id")).alias("ids"))


_VALUE = "struct<value:string>"
_OWNERSHIP = f"""
  issuer struct<issuerCik:string,issuerTradingSymbol:string>,
  reportingOwner array<struct<reportingOwnerId:struct<rptOwnerName:string>,
    reportingOwnerRelationship:struct<isOfficer:string,isDirector:string,isTenPercentOwner:string>>>,
  nonDerivativeTable struct<nonDerivativeTransaction:array<struct<
    transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,
    transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>>>>
"""


def ownership_xml(docs: DataFrame) -> DataFrame:
    """One row per non-derivative transaction element of ownership documents (doc_id, xml), in document order by ``txn``.

    doc_id, txn (from 1), issuer_id, ticker, owner, is_officer, is_director,
    is_tenpct (of the first owner; false if missing), code, shares, price,
    acq_disp, traded. An element that a transaction lacks is null in its row and
    no other; so is a number or date that doesn't parse. Namespaces are ignored.
    Null, malformed and cut documents, and those without the table, give no rows.
    """
    # the last closing tag alone is looked at: a pattern over the text tries each of its tags
    closed = F.rlike(F.substring_index("xml", "</", -1), F.lit(r"^([^\s:>]+:)?ownershipDocument\s*>\s*$"))
    d = docs.filter(closed).select("doc_id", F.from_xml(F.ltrim("xml"), _OWNERSHIP, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("d"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    owner = F.get("d.reportingOwner", F.lit(0))
    flag = lambda n: F.coalesce(F.lower(F.trim(owner["reportingOwnerRelationship"][n])).isin("1", "true"), F.lit(False))
    d = d.select(
        "doc_id", text(F.col("d.issuer.issuerCik")).alias("issuer_id"), text(F.col("d.issuer.issuerTradingSymbol")).alias("ticker"),
        text(owner["reportingOwnerId"]["rptOwnerName"]).alias("owner"), flag("isOfficer").alias("is_officer"), flag("isDirector").alias("is_director"),
        flag("isTenPercentOwner").alias("is_tenpct"), F.posexplode("d.nonDerivativeTable.nonDerivativeTransaction").alias("txn", "t"),
    )
    amount = lambda n: F.col(f"t.transactionAmounts.{n}.value")
    return d.select(
        "doc_id", (F.col("txn") + 1).alias("txn"), "issuer_id", "ticker", "owner", "is_officer", "is_director", "is_tenpct",
        text(F.col("t.transactionCoding.transactionCode")).alias("code"), _num(amount("transactionShares")).alias("shares"),
        _num(amount("transactionPricePerShare")).alias("price"), text(amount("transactionAcquiredDisposedCode")).alias("acq_disp"),
        F.trim("t.transactionDate.value").try_cast("date").alias("traded"),
    )


def accession_list(docs: DataFrame) -> DataFrame:
    """(entity, accession, filed) of form 4 from JSON arrays form, accession, date."""
    d = docs.select("entity", F.from_json("json", "struct<form:array<string>,accession:array<string>,date:array<string>>").alias("j"))
    d = d.select("entity", F.explode(F.arrays_zip("j.form", "j.accession", "j.date")).alias("z")).filter("z.form = '4'")
    return d.select("entity", F.col("z.accession").alias("accession"), F.to_date("z.date").alias("filed"))


def delist_hits(docs: DataFrame) -> DataFrame:
    """(id, name, filed) of search hits, the first of each list: ids as plain numbers, hits without an id or a name skipped."""
    from gridloom.functions.scalars import clean_entity_name

    shape = "struct<hits:struct<hits:array<struct<_source:struct<ciks:array<string>,display_names:array<string>,file_date:string>>>>>"
    d = docs.select(F.explode(F.from_json("json", shape)["hits"]["hits"]).alias("x")).select(F.col("x._source").alias("h")).filter("size(h.ciks) > 0 and size(h.display_names) > 0")
    number = F.get("h.ciks", F.lit(0)).try_cast("bigint").cast("string")
    return d.select(number.alias("id"), clean_entity_name(F.get("h.display_names", F.lit(0))).alias("name"), F.col("h.file_date").try_cast("date").alias("filed"))


def factor_section(docs: DataFrame) -> DataFrame:
    """(month_end, values…) of a sectioned factor file held whole in ``text``: the first run of YYYYMM lines after the header, percent to decimal."""
    d = docs.select("name", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    w = W.partitionBy("name").orderBy("i")
    head = F.startswith(F.ltrim("line"), F.lit(",Mkt-RF"))
    d = d.withColumns({"after": F.max(head.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), "m": F.rlike("line", F.lit(r"^\s*\d{6}\s*,"))}).filter("after = 1")
    d = d.withColumn("seen", F.max(F.col("m").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("broken", F.max(((F.col("seen") == 1) & ~F.col("m")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("m and broken = 0")
    c = F.split("line", ",")
    return d.select("name", F.last_day(F.to_date(F.trim(c[0]), "yyyyMM")).alias("dt"), *((_num(c[k + 1]) / 100).alias(n) for k, n in enumerate(("mkt_rf", "smb", "hml"))))


def prices_any_layout(df: DataFrame) -> DataFrame:
    """(dt, asset, price) of a wide (date, A, B, …) or long (date, ticker, prc|price) table; duplicates average; a table without a date first is refused."""
    cols = {c.lower(): c for c in df.columns}
    price = cols.get("prc") or cols.get("price")
    if "date" not in cols:
        raise ValueError("no date column")
    if "ticker" in cols and price:
        out = df.select(F.col(cols["date"]).cast("date").alias("dt"), F.col(cols["ticker"]).alias("asset"), F.col(price).cast("double").alias("price"))
    elif df.columns[0].lower() == "date":
        rest = df.columns[1:]
        out = df.select(F.col(df.columns[0]).cast("date").alias("dt"), *(F.col(c).cast("double") for c in rest)).unpivot("dt", rest, "asset", "price")
    else:
        raise ValueError("the first column of a wide table must be the date")
    return out.filter("price is not null").groupBy("dt", "asset").agg(F.avg("price").alias("price"))


def surprises(df: DataFrame) -> DataFrame:
    """Surprise table: trimmed lower-case headers, optional columns added as nulls, upper-case tickers, malformed rows dropped."""
    d = df.toDF(*(c.strip().lower() for c in df.columns))
    for c in ("ticker", "ann_date", "actual_eps", "est_eps"):
        if c not in d.columns:
            raise ValueError(f"missing column {c}")
    for c in ("period", "surprise_pct", "num_est", "std_est"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    d = d.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("ann_date").try_cast("date").alias("ann_date"), *(F.col(c).try_cast("double").alias(c) for c in ("actual_eps", "est_eps", "surprise_pct", "num_est", "std_est")), "period")
    return d.filter("ticker <> '' and ann_date is not null and actual_eps is not null and est_eps is not null")


def require_filing_dates(df: DataFrame, column: str = "filed") -> DataFrame:
    """Refuse an extract with missing filing dates: period ends are not a substitute."""
    if column not in df.columns:
        raise ValueError(f"the extract lacks {column}")
    if not df.filter(F.col(column).isNull()).isEmpty():
        raise ValueError(f"rows without {column}")
    return df


# fixed values: logical fields and their extract columns
FIELDS = {"assets": "at", "net_income": "ni", "cfo": "oancf", "revenue": "revt", "cogs": "cogs", "gross_profit": "gp"}


def compustat_field(df: DataFrame, field: str, annual: bool = False) -> DataFrame:
    """(ticker, filed, value): gross profit falls back to revenue less cost of goods; one value per filing date, the latest period's."""
    v = F.col(FIELDS[field]) if FIELDS[field] in df.columns else F.lit(None).cast("double")
    if field == "gross_profit":
        v = F.coalesce(v, F.col("revt") - F.col("cogs"))
    d = df.filter(F.col("freq") == "A") if annual else df
    d = d.withColumn("_v", v).filter("_v is not null")
    return d.groupBy("ticker", "filed").agg(F.max_by("_v", "period_end").alias("value"))


def log_dir(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Rows of ``<prefix>_YYYY-MM-DD.csv`` files with the date of the name."""
    d = spark.read.option("header", True).csv(f"{folder}/{prefix}_*.csv")
    return d.withColumn("asof", F.to_date(F.regexp_extract("_metadata.file_name", rf"{prefix}_(\d{{4}}-\d\d-\d\d)\.csv$", 1)))


def summary_logs(docs: DataFrame) -> DataFrame:
    """equity, orders_sent, n_failed, failed_buys, failed_sells of JSON daily summaries (json)."""
    s = F.from_json("json", "struct<asof:string,equity:double,orders_sent:bigint,n_failed:bigint,orders_failed:array<struct<symbol:string,side:string>>>")
    d = docs.select(s.alias("j"))
    side = lambda x: F.size(F.filter(F.coalesce("j.orders_failed", F.array().cast("array<struct<symbol:string,side:string>>")), lambda o: o["side"] == x))
    n = F.coalesce("j.n_failed", F.size(F.coalesce("j.orders_failed", F.array().cast("array<struct<symbol:string,side:string>>"))).cast("bigint"))
    return d.select(F.to_date("j.asof").alias("asof"), "j.equity", "j.orders_sent", n.alias("n_failed"), side("buy").alias("failed_buys"), side("sell").alias("failed_sells"))
