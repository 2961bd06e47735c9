"""Scalar classification and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.windows import by_asset, ratio

# fixed values: keywords of removal reasons, by bucket in order of precedence
REASONS = {
    "corporate_action": [
        "acquir", "merg", "taken private", "private equity", "takeover", "taken over", "purchas", "bought", "spun off",
        "spin-off", "spinoff", "spins off", "spinning off", "split into", "split-off", "separated into",
    ],
    "distress": ["bankrupt", "chapter 11", "delist", "liquidat", "receivership"],
    "migration": ["midcap", "mid cap", "smallcap", "small cap", "600", "constituent swap", "moved to"],
    "discretionary": ["market cap", "market capitalization", "representat", "no longer", "committee", "index balance", "eligib"],
}
# fixed values: legal-form suffixes
SUFFIXES = "INC INCORPORATED CORP CORPORATION CO COMPANY COMPANIES LTD LIMITED PLC LLC LP LLP HOLDINGS HOLDING GROUP GP SA NV AG SE".split()
# fixed values: name and text patterns
FUND_NAME = (
    r"(?i)\b(fund|trust|income|municipal|muni|term|capital|strateg\w*|opportunit\w*|dividend|yield|portfolio|closed[- ]?end|bdc|"
    r"infrastructure|energy|credit|bond|equit\w*|growth|value|senior|floating|tax|advantage|premium|global|intermediate|target|"
    r"select|holdings|investors?)\b"
)
TERM_NAME = r"(?i)\b(target[- ]?term|term (fund|trust)|20\d\d (target|term))\b"
CIK_TAG = r"\s*\(CIK\s*\d+\)\s*$"
TICKER_TAG = r"\s*\([A-Z0-9.\-, ]+\)\s*$"
DISTRESS = (
    r"(?i)(bankrupt|chapter 11|chapter 7|deficienc|delinquen|noncompliance|non-compliance|minimum (bid|market)|going concern|fraud|receiver)"
)


def normalize_symbol(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))


def perp_to_spot(c: Column) -> Column:
    """Drop a leading multiplier of 100 or 1000 and more from a USDT pair."""
    return F.regexp_replace(c, r"^(1000+|100)([A-Z][A-Z0-9]*USDT)$", "$2")


def normalize_name(c: Column) -> Column:
    """Part before a slash, alphanumeric words in upper case, without a leading THE and trailing legal forms."""
    s = F.upper(F.regexp_replace(F.split(c, "/")[0], "[^A-Za-z0-9 ]", " "))
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^THE( |$)", "")
    return F.regexp_replace(s, rf"(^|\s)({'|'.join(SUFFIXES)})(\s+({'|'.join(SUFFIXES)}))*$", "")


def clean_entity_name(c: Column) -> Column:
    """Drop a trailing (CIK n), then a trailing (TICKER)."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, CIK_TAG, ""), TICKER_TAG, ""))


def classify_reason(c: Column) -> Column:
    """Bucket of the first keyword list that occurs in the text."""
    low, out = F.lower(c), None
    for bucket, words in REASONS.items():
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(out.otherwise("unknown"))


def is_fund_name(c: Column) -> Column:
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(FUND_NAME))


def text_has_distress(c: Column) -> Column:
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(DISTRESS))


def classify_death(name: Column, forms: Column, listed: Column) -> Column:
    """Outcome of a delisted entity from its filing forms; ``listed`` is whether it still has tickers."""
    has = lambda p: F.exists(forms, lambda f: F.startswith(F.upper(f), F.lit(p)))
    return (
        F.when(~has("N-2"), "not_a_closed_end_fund").when(listed, "security_redemption_fund_alive")
        .when(F.rlike(F.coalesce(name, F.lit("")), F.lit(TERM_NAME)), "term_liquidation").when(has("N-8F"), "liquidation_or_merger")
        .when(has("N-CEN") | has("N-CSR"), "open_ending_or_conversion").otherwise("delisted_unknown")
    )


def death_flags(forms: Column, listed: Column) -> dict[str, Column]:
    """Whether the entity files as a closed-end fund or business development company, as the latter, and has no ticker left."""
    n2 = F.exists(forms, lambda f: F.startswith(F.upper(f), F.lit("N-2")))
    yearly = F.exists(forms, lambda f: F.upper(f).isin("10-K", "10-K405"))
    return {"is_cef_or_bdc": n2, "is_bdc": n2 & yearly, "fully_delisted": ~listed}


def nav_event(outcome: Column) -> Column:
    """True for outcomes that pay net asset value, else unknown."""
    return F.when(outcome.isin("term_liquidation", "liquidation_or_merger", "open_ending_or_conversion"), True)


def role_tag(officer: Column, director: Column, tenpct: Column) -> Column:
    return F.when(officer, "officer").when(director, "director").when(tenpct, "tenpct").otherwise("insider")


def classify_resolution(last_filing: Column, deleted: Column, grace: int = 540) -> Column:
    out = F.when(last_filing <= F.date_add(deleted, grace), "plausible_dead").otherwise("possible_reassignment")
    return F.when(last_filing.isNull() | deleted.isNull(), "unknown").otherwise(out)


def owner_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))


def discount(price: Column, nav: Column) -> Column:
    return ratio(price - nav, nav)


def total_return_dist(price: str, dist: str) -> Column:
    """(P + D) / previous P - 1 along an asset; no distribution counts 0."""
    return ratio(F.col(price) + F.coalesce(dist, F.lit(0.0)), F.lag(price).over(by_asset())) - 1
