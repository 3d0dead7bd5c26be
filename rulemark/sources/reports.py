"""Whole fund reports and series listings: one parsed document a row, its parts as tables.

A document is parsed once into nested columns with a given schema (a CUSIP of
digits is no number); header, returns, flows, gains and holdings are projections
of it. Blank text and ``N/A`` are null; a malformed number, date or flag raises
with the name of its field. No step shuffles but ``one_a_date``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulemark.functions import identifiers as ids

_HOLDING = (
    "name: string, lei: string, title: string, cusip: string, identifiers: struct<isin: array<struct<_value: string>>, ticker: array<struct<_value: string>>, other: array<struct<_value: string, _otherDesc: string>>>, "
    "balance: string, units: string, curCd: string, currencyConditional: struct<_curCd: string, _exchangeRt: string>, valUSD: string, pctVal: string, payoffProfile: string, assetCat: string, assetConditional: struct<_assetCat: string>, "
    "issuerCat: string, issuerConditional: struct<_issuerCat: string>, invCountry: string, isRestrictedSec: string, fairValLevel: string, "
    "securityLending: struct<isLoanByFund: string, loanByFundCondition: struct<_isLoanByFund: string, _loanVal: string>>, derivativeInfo: string"
)
_FLOW = "struct<_sales: string, _reinvestment: string, _redemption: string>"
_GAIN = "struct<_netRealizedGain: string, _netUnrealizedAppr: string>"
_REPORT = (
    "headerData struct<submissionType: string, filerInfo: struct<seriesClassInfo: array<struct<classId: array<string>>>>>, "
    "formData struct<genInfo: struct<regName: string, regCik: string, regLei: string, regFileNumber: string, seriesName: string, seriesId: string, seriesLei: string, repPdEnd: string, repPdDate: string, isFinalFiling: string>, "
    "fundInfo: struct<totAssets: string, totLiabs: string, netAssets: string, assetsAttrMiscSec: string, cshNotRptdInCorD: string, "
    f"returnInfo: struct<monthlyTotReturns: struct<monthlyTotReturn: array<struct<_classId: string, _rtn1: string, _rtn2: string, _rtn3: string>>>, othMon1: {_GAIN}, othMon2: {_GAIN}, othMon3: {_GAIN}>, "
    f"mon1Flow: {_FLOW}, mon2Flow: {_FLOW}, mon3Flow: {_FLOW}>"
)
#: A report, with its positions and without them.
REPORT, SHORT_REPORT = f"{_REPORT}, invstOrSecs: struct<invstOrSec: array<struct<{_HOLDING}>>>>", f"{_REPORT}>"
FEED = "`company-info` struct<cik: string, `conformed-name`: string, `fiscal-year-end`: string>, entry array<struct<content: struct<`accession-number`: string, `filing-type`: string, `filing-date`: string, `filing-href`: string>>>"


def clean(raw: Column) -> Column:
    """Text trimmed; null where it is blank or N/A."""
    text = F.trim(raw, F.lit(" \t\r\n"))
    return F.when(~text.isin("", "N/A", "n/a", "N/a", "n/A"), text)  # these are all: upper casing each value costs more than reading it


def _read(raw: Column, kind: str, what: str, shape: str | None = None) -> Column:
    """The cleaned text as a value of a type; text that is none raises."""
    text = clean(raw)
    value = lambda t: t.try_cast(kind) if shape is None else F.when(t.rlike(shape), t.try_cast(kind))
    # Text that is a value as it stands is not trimmed first.
    return F.coalesce(value(raw), value(text), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit(f"{what}: no {kind}: "), text)).cast(kind)))


def number(raw: Column, what: str) -> Column:
    return _read(raw, "double", what)


def day(raw: Column, what: str) -> Column:
    return _read(raw, "date", what, r"^\d{4}-\d{2}-\d{2}$")


def flag(raw: Column, what: str) -> Column:
    return F.coalesce(F.when(raw == "Y", True).when(raw == "N", False), _read(F.upper(clean(raw)), "boolean", what, "^[YN]$"))


def cik(raw: Column, what: str) -> Column:
    text = clean(raw)
    return F.when(text.isNull() | text.rlike(r"^\d+$"), F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: no CIK: "), text)))


def _document(rows: DataFrame, xml: str, schema: str, root: str) -> Column:
    """The parsed document; text with another root element, or that is not well-formed, raises."""
    # Mostly the root stands first, or after the declaration alone; else it is what follows comments, instructions and the document type.
    plain = F.regexp_extract(F.col(xml), r"^\s*(?:<\?[^>]*\?>\s*)?<(?:[\w.-]+:)?([\w.-]+)", 1)
    bare = F.regexp_replace(F.col(xml), r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    first = F.when(plain != "", plain).otherwise(F.regexp_extract(bare, r"<(?:[\w.-]+:)?([\w.-]+)", 1))
    checked = F.when(first == root, F.col(xml)).otherwise(F.raise_error(F.concat(F.lit(f"root element is not {root}: "), first)).cast("string"))
    return F.from_xml(checked, schema, {"mode": "FAILFAST", "ignoreNamespace": "true"})


def reports(rows: DataFrame, xml: str = "xml", positions: bool = True) -> DataFrame:
    """rows with the parsed ``report`` and its ``report_date`` in place of the XML; null text gives no row.

    Without ``positions`` the whole document is read as well, and raises where it is
    malformed, but its positions, most of its text, are not made into columns.
    """
    # Exploded from an array of one, so that the optimizer does not parse once a field.
    a = rows.where(F.col(xml).isNotNull()).withColumn("report", F.explode(F.array(_document(rows, xml, REPORT if positions else SHORT_REPORT, "edgarSubmission")))).drop(xml)
    kind = clean(F.col("report.headerData.submissionType"))
    date = day(F.col("report.formData.genInfo.repPdDate"), "repPdDate")
    known = F.when(kind.isNotNull() & ~F.upper(kind).startswith("NPORT"), F.raise_error(F.concat(F.lit("submissionType: "), kind)).cast("date")).otherwise(date)
    return a.withColumn("report_date", F.coalesce(known, F.raise_error(F.lit("repPdDate is missing")).cast("date")))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, report, report_date) of all report files under a path."""
    return reports(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")))


def one_a_date(parsed: DataFrame, by: list[str] | None = None, order: str = "file") -> DataFrame:
    """The last report, by ``order``, of each report date."""
    w = Window.partitionBy(*(by or []), "report_date").orderBy(F.col(order).desc())
    return parsed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _keep(parsed: DataFrame) -> list[str]:
    return [c for c in parsed.columns if c != "report"]


def header(parsed: DataFrame) -> DataFrame:
    """One row a report: registrant, series, classes, dates and totals."""
    gen, fund = "report.formData.genInfo.", "report.formData.fundInfo."
    text = {"registrant_name": "regName", "registrant_lei": "regLei", "file_number": "regFileNumber", "series_name": "seriesName", "series_id": "seriesId", "series_lei": "seriesLei"}
    sums = {"total_assets": "totAssets", "total_liabilities": "totLiabs", "net_assets": "netAssets", "misc_securities_assets": "assetsAttrMiscSec", "cash_not_reported": "cshNotRptdInCorD"}
    classes = F.flatten(F.transform("report.headerData.filerInfo.seriesClassInfo", lambda s: F.coalesce(s["classId"], F.array().cast("array<string>"))))
    return parsed.select(
        *_keep(parsed), clean(F.col("report.headerData.submissionType")).alias("submission_type"), *(clean(F.col(gen + c)).alias(n) for n, c in text.items()), cik(F.col(gen + "regCik"), "regCik").alias("registrant_cik"),
        F.coalesce(F.filter(F.transform(classes, clean), lambda c: c.isNotNull()), F.array().cast("array<string>")).alias("class_ids"), day(F.col(gen + "repPdEnd"), "repPdEnd").alias("fiscal_year_end"),
        flag(F.col(gen + "isFinalFiling"), "isFinalFiling").alias("is_final_filing"), *(number(F.col(fund + c), c).alias(n) for n, c in sums.items()),
    )


def _month_end(month: int) -> Column:
    return F.last_day(F.add_months("report_date", month - 3))


def monthly_returns(parsed: DataFrame) -> DataFrame:
    """Three rows a share class (percent), null where the report is silent."""
    a = parsed.select(*_keep(parsed), F.explode("report.formData.fundInfo.returnInfo.monthlyTotReturns.monthlyTotReturn").alias("r"))
    months = F.array(*(F.struct(F.lit(m).alias("month"), _month_end(m).alias("month_end"), number(F.col(f"r._rtn{m}"), f"rtn{m}").alias("return_pct")) for m in (1, 2, 3)))
    return a.select(*_keep(parsed), clean(F.col("r._classId")).alias("class_id"), F.inline(months))


def flows(parsed: DataFrame) -> DataFrame:
    """Always three rows a report: sales, reinvestment and redemption of each month."""
    at = lambda m, c: number(F.col(f"report.formData.fundInfo.mon{m}Flow._{c}"), f"mon{m}Flow {c}").alias(c)
    months = F.array(*(F.struct(F.lit(m).alias("month"), _month_end(m).alias("month_end"), *(at(m, c) for c in ("sales", "reinvestment", "redemption"))) for m in (1, 2, 3)))
    return parsed.select(*_keep(parsed), F.inline(months))


def gains(parsed: DataFrame) -> DataFrame:
    """Always three rows a report: realised gain and unrealised appreciation of each month."""
    at = lambda m, c: number(F.col(f"report.formData.fundInfo.returnInfo.othMon{m}._{c}"), f"othMon{m} {c}")
    months = F.array(*(F.struct(F.lit(m).alias("month"), at(m, "netRealizedGain").alias("net_realized_gain"), at(m, "netUnrealizedAppr").alias("net_unrealized_appreciation")) for m in (1, 2, 3)))
    return parsed.select(*_keep(parsed), F.inline(months))


def report_holdings(parsed: DataFrame) -> DataFrame:
    """One row a position, in the report's order, with its place in the document (``locator``)."""
    a = parsed.select(*_keep(parsed), F.posexplode("report.formData.invstOrSecs.invstOrSec").alias("row_index", "h"))
    text = lambda c: clean(F.col(f"h.{c}"))
    num = lambda c: number(F.col(f"h.{c}"), c)
    given = lambda kind: F.get(F.filter(f"h.identifiers.{kind}", lambda x: clean(x["_value"]).isNotNull()), F.lit(0))  # noqa: E731  the first that has a value
    other, lending, loan = given("other"), "h.securityLending.", "h.securityLending.loanByFundCondition."
    return a.select(
        *_keep(parsed), "row_index", F.format_string("invstOrSecs/invstOrSec[%d]", F.col("row_index") + 1).alias("locator"), text("name").alias("issuer_name"), text("lei").alias("issuer_lei"), text("title").alias("title"), text("cusip").alias("cusip"),
        clean(given("isin")["_value"]).alias("isin"), clean(given("ticker")["_value"]).alias("ticker"), clean(other["_value"]).alias("other_id"), clean(other["_otherDesc"]).alias("other_id_desc"), num("balance").alias("balance"), text("units").alias("units"),
        F.coalesce(text("curCd"), text("currencyConditional._curCd")).alias("currency"), num("currencyConditional._exchangeRt").alias("exchange_rate"), num("valUSD").alias("value_usd"), num("pctVal").alias("pct_net_assets"), text("payoffProfile").alias("payoff_profile"),
        F.coalesce(text("assetCat"), text("assetConditional._assetCat")).alias("asset_category"), F.coalesce(text("issuerCat"), text("issuerConditional._issuerCat")).alias("issuer_category"), text("invCountry").alias("country"),
        flag(F.col("h.isRestrictedSec"), "isRestrictedSec").alias("is_restricted"), text("fairValLevel").alias("fair_value_level"),
        F.when(F.col(loan[:-1]).isNotNull(), flag(F.col(loan + "_isLoanByFund"), "isLoanByFund")).otherwise(flag(F.col(lending + "isLoanByFund"), "isLoanByFund")).alias("is_loaned"), number(F.col(loan + "_loanVal"), "loanVal").alias("loan_value"),
        F.col("h.derivativeInfo").isNotNull().alias("has_derivative_info"),
    )


def series_filings(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Filings of series listings (Atom): (kept columns, cik, entity_name, accession, form, filing_date, is_amendment, index_url); an entry without number, form or date raises."""
    keep = [c for c in rows.columns if c != xml]
    a = rows.where(F.col(xml).isNotNull()).select(*keep, F.explode(F.array(_document(rows, xml, FEED, "feed"))).alias("f"))
    a = a.select(*keep, cik(F.col("f.`company-info`.cik"), "cik").alias("cik"), clean(F.col("f.`company-info`.`conformed-name`")).alias("entity_name"), F.posexplode("f.entry.content").alias("place", "e"))
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(f"an entry has no {what}")).cast("string"))
    form = need(clean(F.col("e.`filing-type`")), "filing-type")
    date = day(need(clean(F.col("e.`filing-date`")), "filing-date"), "filing-date")
    number_ = need(ids.accession(need(clean(F.col("e.`accession-number`")), "accession-number")), "valid accession-number")
    return a.select(*keep, F.coalesce("cik", F.raise_error(F.lit("the listing has no cik")).cast("string")).alias("cik"), "entity_name", "place", number_.alias("accession"), form.alias("form"), date.alias("filing_date"), form.endswith("/A").alias("is_amendment"), clean(F.col("e.`filing-href`")).alias("index_url"))


def _element(name: str, value: Column) -> Column:
    """<name>value</name>, nothing where the value is null."""
    text = value.cast("string")
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def _attributes(name: str, values: dict[str, Column]) -> Column:
    """<name a="1" b="2"/>, null attributes left out."""
    safe = lambda v: F.replace(F.replace(F.replace(v.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit(f"<{name}"), *(F.coalesce(F.concat(F.lit(f' {a}="'), safe(v), F.lit('"')), F.lit("")) for a, v in values.items()), F.lit("/>"))


def report_xml(general: dict[str, Column], totals: dict[str, Column], month_flows: list[dict[str, Column]], positions: Column, form: str = "NPORT-P") -> Column:
    """A report document: elements of genInfo and fundInfo by name, the attributes of three flows, and positions (an array of ``position_xml`` texts). What ``reports`` reads back is what was given, numbers to the last bit."""
    return F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><edgarSubmission><headerData><submissionType>{form}</submissionType></headerData><formData><genInfo>'), *(_element(n, v) for n, v in general.items()), F.lit("</genInfo><fundInfo>"),
        *(_element(n, v) for n, v in totals.items()), *(_attributes(f"mon{m}Flow", v) for m, v in enumerate(month_flows, 1)), F.lit("</fundInfo><invstOrSecs>"), F.array_join(positions, ""), F.lit("</invstOrSecs></formData></edgarSubmission>"),
    )


def position_xml(fields: dict[str, Column]) -> Column:
    """One position's element."""
    return F.concat(F.lit("<invstOrSec>"), *(_element(n, v) for n, v in fields.items()), F.lit("</invstOrSec>"))
