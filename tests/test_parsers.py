"""Parsers on documents with missing, repeated and malformed parts."""

import datetime
import json

import pytest

from gridloom.sources import parsers as ps

ISSUER = "<issuer><issuerCik>0000320193</issuerCik><issuerTradingSymbol> AB </issuerTradingSymbol></issuer>"


def _txn(code, shares, price="", side="A"):
    return (
        f"<nonDerivativeTransaction><transactionDate><value>2024-01-0{shares}</value></transactionDate><transactionCoding><transactionFormType>4</transactionFormType>"
        f"<transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares>{price}"
        f"<transactionAcquiredDisposedCode><value>{side}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    )


def _price(v):
    return f"<transactionPricePerShare><value>{v}</value></transactionPricePerShare>"


def _owner(name, director):
    return f"<reportingOwner><reportingOwnerId><rptOwnerName>{name}</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>{director}</isDirector></reportingOwnerRelationship></reportingOwner>"


def _doc(*parts):
    return "<ownershipDocument>" + "".join(parts) + "</ownershipDocument>"


def _table(*parts):
    return "<nonDerivativeTable>" + "".join(parts) + "</nonDerivativeTable>"


def _rows(spark, *docs):
    got = ps.ownership_xml(spark.createDataFrame(list(enumerate(docs)), "doc_id int, xml string")).collect()
    return sorted(got, key=lambda r: (r.doc_id, r.txn))


def test_each_transaction_keeps_its_own_price(spark):
    footnote = "<transactionPricePerShare><footnoteId id='F1'/></transactionPricePerShare>"
    table = _table(_txn("A", 1, footnote), _txn("P", 2, _price(22.5)), "<nonDerivativeHolding><x/></nonDerivativeHolding>", _txn("S", 3, _price(33.5), "D"))
    rows = _rows(spark, '<?xml version="1.0"?>\n' + _doc(ISSUER, _owner("Jo", "true"), _owner("Al", "0"), table, "<derivativeTable>" + _txn("M", 4) + "</derivativeTable>"))
    assert [(r.txn, r.code, r.shares, r.price, r.acq_disp, r.traded) for r in rows] == [
        (1, "A", 1.0, None, "A", datetime.date(2024, 1, 1)), (2, "P", 2.0, 22.5, "A", datetime.date(2024, 1, 2)), (3, "S", 3.0, 33.5, "D", datetime.date(2024, 1, 3)),
    ]
    assert {(r.issuer_id, r.ticker, r.owner, r.is_officer, r.is_director, r.is_tenpct) for r in rows} == {("0000320193", "AB", "Jo", False, True, False)}


@pytest.mark.parametrize("xml", [
    "<ownershipDocument><a></ownershipDocument>", "junk", "", None, _doc(ISSUER), _doc(ISSUER, "<nonDerivativeTable/>"),
    _doc(ISSUER, _table(_txn("P", 1)))[:-20], _doc(ISSUER, _table(_txn("P", 1)), "<b>"), _doc(_table(_txn("P", 1))) + " more", "<html>" + ISSUER + "</html>",
])
def test_malformed_documents_give_no_rows(spark, xml):
    assert _rows(spark, xml) == []


def test_missing_parts_namespaces_and_bad_numbers(spark):
    bare = _doc(_table("<nonDerivativeTransaction></nonDerivativeTransaction>", _txn("P &amp; Q", 1, _price("x"))))
    spaced = _doc(ISSUER, _table(_txn("P", 1, _price(" 5 ")))).replace("<", "<n:").replace("<n:/", "</n:").replace("<n:ownershipDocument>", '<n:ownershipDocument xmlns:n="u">')
    rows = _rows(spark, bare, spaced)
    assert [(r.doc_id, r.code, r.shares, r.price, r.ticker, r.is_director) for r in rows[-2:]] == [(0, "P & Q", 1.0, None, None, False), (1, "P", 1.0, 5.0, "AB", False)]


def test_hits_without_an_id_or_name_are_skipped(spark):
    hit = lambda ciks, names: {"_source": {"ciks": ciks, "display_names": names, "file_date": "2024-01-05"}}
    body = {"hits": {"hits": [hit(["0001234567", "9"], ["Some Fund  (ABC)  (CIK 0001234567)"]), hit([], ["x"]), hit(["1"], []), hit(None, None), {}]}}
    docs = spark.createDataFrame([(json.dumps(body),), ("{}",), ("junk",), (None,)], "json string")
    assert [tuple(r) for r in ps.delist_hits(docs).collect()] == [("1234567", "Some Fund", datetime.date(2024, 1, 5))]


def test_ownership_documents_are_written_after_their_shuffle(spark):
    from gridloom.plans.registry import QUERIES
    from tests.conftest import SF

    plan = QUERIES["form4_xml"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    head, _, below = plan.partition("Aggregate [")
    assert "<nonDerivativeTransaction>" in head and "<nonDerivativeTransaction>" not in below


def test_a_document_ends_with_its_own_tag(spark):
    whole = _doc(ISSUER, _table(_txn("P", 1)))
    ends = [whole + " \n" * 50, whole[:-1] + " \n>", whole + "<!-- x -->", whole + whole[-10:]]
    assert [r.doc_id for r in _rows(spark, *ends)] == [0, 1]
