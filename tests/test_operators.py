"""Operators on hand-made rows: the cases that decide a branch."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from rulemark.functions import identifiers as ids
from rulemark.functions.numbers import number_appears, numbers_in
from rulemark.operators import documents, joins, prices, regions, rules, sampling, store
from rulemark.sources import readers, reports

D0, D1 = dt.date(2020, 3, 31), dt.date(2020, 6, 30)


def test_holding_changes_cases(spark):
    prev = {"X": (100, 10000), "I": (100, 20000), "D": (200, 20000), "U": (50, 10000), "S": (100, 20000), "F": (100, 20000)}
    curr = {"I": (150, 30000), "D": (150, 13500), "U": (50, 10500), "S": (200, 20400), "F": (95, 19000), "N": (30, 3000)}
    rows = [("f", d, k, float(b), float(v)) for d, side in ((D0, prev), (D1, curr)) for k, (b, v) in side.items()]
    df = spark.createDataFrame(rows, "fund string, report_date date, asset_id string, balance double, value double")
    out = prices.holding_changes(prices.paired(df, ["fund"], how="full"), ["fund", "start"])
    got = {r["asset_id"]: r for r in out.collect()}
    assert {k: r["change"] for k, r in got.items()} == {"X": "exit", "I": "increase", "D": "decrease", "U": "unchanged", "S": "unchanged", "F": "decrease", "N": "new"}
    assert got["S"]["factor"] == 2.0 and got["S"]["implied_return"] == pytest.approx(0.02)
    assert sum(r["w1"] for r in got.values()) == pytest.approx(1) and got["N"]["drift"] == 0 and got["X"]["drift"] is None


def test_null_position_stays_null(spark):
    df = spark.createDataFrame([("f", D0, "A", 10.0, None), ("f", D1, "A", 10.0, 5.0)], "fund string, report_date date, asset_id string, balance double, value double")
    row = prices.holding_changes(prices.paired(df, ["fund"], how="full"), ["fund", "start"]).first()
    assert row["w0"] is None and row["implied_return"] is None


def test_ladder_branches(spark):
    # Share ratios around a median of one: steady, a ten-for-one split, a plain change, an unexplained one.
    cases = {"a": (100, 100.0, 100, 110.0), "b": (100, 100.0, 1000, 105.0), "c": (100, 100.0, 130, 130.0), "d": (100, 100.0, 700, 20.0), "e": (100, 100.0, 100, 90.0), "g": (100, 100.0, 100, 100.0), "h": (100, 100.0, 100, 100.0)}
    rows = [(1, k, float(b0), v0, float(b1), v1) for k, (b0, v0, b1, v1) in cases.items()]
    df = spark.createDataFrame(rows, "start int, asset_id string, balance0 double, value0 double, balance1 double, value1 double")
    got = {r["asset_id"]: r for r in prices.implied_returns(df, passive_by=["start"]).collect()}
    assert got["a"]["status"] == "derived" and got["a"]["ret"] == pytest.approx(0.10)
    assert got["b"]["split_adjusted"] and got["b"]["ret"] == pytest.approx(0.05)
    assert got["c"]["status"] == "assumed" and got["c"]["share_count_changed"] and got["c"]["ret"] == pytest.approx(0.0)
    assert got["d"]["status"] == "unknown" and got["d"]["ret"] is None
    active = {r["asset_id"]: r for r in prices.implied_returns(df).collect()}
    assert active["b"]["ret"] is None and active["a"]["status"] == "derived"


def test_as_of_takes_the_latest_within_tolerance(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    left = spark.createDataFrame([(1, "a", day(10)), (2, "a", day(3)), (3, "b", day(10)), (4, "a", None)], "id int, k string, at timestamp")
    right = spark.createDataFrame([("a", day(1), 1, 1.0), ("a", day(9), 2, 2.0), ("a", day(9), 3, 3.0), ("a", day(11), 4, 4.0), ("b", day(2), 5, 5.0)], "k string, ts timestamp, n int, v double")
    got = {r["id"]: r["v"] for r in joins.as_of(left, right, ["k"], "at", "ts", ["v"], tolerance=F.lit(3 * 86400.0), tie="n").collect()}
    assert got == {1: 3.0, 2: 1.0, 3: None, 4: None}


def test_capped_weights_equal_repeated_capping(spark):
    w = {1: 0.5, 2: 0.2, 3: 0.15, 4: 0.1, 5: 0.05}
    held = spark.createDataFrame([(0, k, v) for k, v in w.items()], "sample_id int, asset_id int, w double")
    got = {r["asset_id"]: r["w"] for r in sampling.capped(held, 0.25).collect()}
    fixed: set = set()
    while True:
        rest = sum(v for k, v in w.items() if k not in fixed)
        now = {k: 0.25 if k in fixed else v * (1 - 0.25 * len(fixed)) / rest for k, v in w.items()}
        over = {k for k, v in now.items() if v > 0.25 + 1e-12}
        if not over:
            break
        fixed |= over
    assert got == pytest.approx(now) and sum(got.values()) == pytest.approx(1)
    assert all(r["w"] is None for r in sampling.capped(held, 0.1).collect())


def test_subsets_are_uniform_enough_and_repeatable(spark):
    a = spark.range(6).withColumnRenamed("id", "asset_id")
    one = sorted((r["sample_id"], r["asset_id"]) for r in sampling.k_subsets(a, 3, 400, 5).collect())
    assert one == sorted((r["sample_id"], r["asset_id"]) for r in sampling.k_subsets(a.repartition(3), 3, 400, 5).collect())
    sets = {k: tuple(x for _, x in g) for k, g in itertools.groupby(one, key=lambda r: r[0])}
    assert len(set(sets.values())) == 20 and all(len(s) == 3 for s in sets.values())
    assert sampling.combinations(a, 3).count() == 20


def test_rules_on_empty_and_missing(spark):
    held = spark.createDataFrame([(0, 0.6, 10.0, "T"), (0, 0.4, None, "E"), (1, 0.5, 10.0, "T"), (1, 0.5, 30.0, "E")], "sample_id int, w double, esg double, sector string")
    got = {r["sample_id"]: r.asDict() for r in rules.evaluate(held, [rules.weighted_average("esg", 10.0, None), rules.weighted_average("esg", 10.0, None, "renormalise"), rules.min_groups("sector", 2)]).collect()}
    assert not got[0]["average_ineligible"] and got[0]["average_renormalise"] and got[1]["ok"] and not got[0]["ok"]
    assert rules.share_to_count(0.3, 10, "max") == 3 and rules.share_to_count(0.31, 10, "min") == 4


def test_check_digits(spark):
    rows = spark.createDataFrame([("037833100", "US0378331005", "5493001KJTIIGC8Y1R12"), (" 037833101", "US0378331006", "5493001KJTIIGC8Y1R13"), ("000000000", "N/A", ""), (None, None, None)], "c string, i string, l string")
    got = rows.select(ids.cusip_valid(F.col("c")), ids.isin_valid(F.col("i")), ids.lei_valid(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False), (False, False, False)]


def test_security_key_order(spark):
    rows = spark.createDataFrame([("037833100", None, None, "t", "n"), (None, "US0378331005", None, "t", "n"), (None, "DE0007164600", None, "t", "n"), (None, None, "5493001KJTIIGC8Y1R12", "Note 1", "n"), (None, None, None, None, "A.B. & Co"), (None, None, None, None, None)], "c string, i string, l string, t string, n string")
    got = [r[0] for r in rows.select(ids.security_key(*(F.col(c) for c in "ciltn"))).collect()]
    assert got == ["cusip:037833100", "cusip:037833100", "isin:DE0007164600", "lei:5493001KJTIIGC8Y1R12|NOTE 1", "name:AB CO|", "unknown:"]


def test_upsert_keeps_what_is_known(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "id int, name string, x double")
    new = spark.createDataFrame([(1, "b", None), (2, "c", 5.0), (3, "d", 6.0)], "id int, name string, x double")
    got = {r["id"]: (r["name"], r["x"]) for r in store.upsert(old, new, ["id"], frozen=["name"]).collect()}
    assert got == {1: ("a", 1.0), 2: ("c", 5.0), 3: ("d", 6.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,mu,sector,esg_score,carbon,flag_tobacco,attr_cap\nA,0.1,Tech,10,20,1,5\nB,0.2,Energy,,400,0,\n")
    u = {r["ticker"]: r for r in readers.universe(spark, str(tmp_path / "u.csv")).collect()}
    assert u["A"]["flags"] == {"tobacco": True} and u["B"]["esg_score"] is None and u["B"]["attributes"] == {"cap": None}
    (tmp_path / "r.csv").write_text("period,A,B\n1,0.1,0.2\n2,0.3,0.4\n")
    assert readers.returns(spark, str(tmp_path / "r.csv")).count() == 4
    (tmp_path / "bad.csv").write_text("period,A\n1,\n")
    with pytest.raises(Exception, match="empty cell"):
        readers.returns(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "n.xml").write_text("<edgarSubmission><invstOrSecs><invstOrSec><name>Acme</name><cusip>037833100</cusip><balance>10</balance><valUSD>50.5</valUSD><identifiers><isin value=\"US0378331005\"/></identifiers></invstOrSec></invstOrSecs></edgarSubmission>")
    row = readers.fund_report_holdings(spark, str(tmp_path / "n.xml")).first()
    assert (row["cusip"], row["balance"], row["value_usd"]) == ("037833100", 10.0, 50.5)
    (tmp_path / "l.txt").write_bytes("ACME: A CO:0001:\nCAF\xc9:0002:\n".encode("latin-1"))
    assert {(r["name"], r["cik"]) for r in readers.cik_lookup(spark, str(tmp_path / "l.txt")).collect()} == {("ACME: A CO", "0001"), ("CAFÉ", "0002")}


def test_numbers_in_words():
    assert numbers_in("33 1/3 of rule 35d-1 and any one issuer") == pytest.approx([100 / 3])
    assert numbers_in("twenty-five percent, 1,250.5 and one hundred; two-thirds; three-quarters, 1/3") == pytest.approx([25, 1250.5, 100, 0.75, 1 / 3])
    assert numbers_in("N-14, 10-K, S000000856, 12b, one-third, one fund of one hundred, sixth, .5 or 7/40 of 80.") == pytest.approx([1 / 3, 1, 100, 0.5, 7, 40, 80])
    assert number_appears(0.8, "at least 80% of") and number_appears(80, "80 per cent") and not number_appears(0.8, "80 names") and number_appears(25, "one-quarter")
    assert numbers_in(None) == numbers_in("") == []


def test_intake_appends_once(spark, tmp_path):
    from rulemark.streaming.intake import intake

    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("u1", "h1"), ("u1", "h1"), ("u2", "h2")], "url string, sha string").coalesce(1).write.json(src)
    for _ in range(2):
        intake(spark, src, out, mark, "url string, sha string", ["url", "sha"]).awaitTermination()
    spark.createDataFrame([("u2", "h2"), ("u3", "h3")], "url string, sha string").write.mode("append").json(src)
    intake(spark, src, out, mark, "url string, sha string", ["url", "sha"]).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


def test_quotes_of_any_length_and_surrounding(spark):
    """Against plain containment: short quotes, and ones beside brackets, quotation marks and full stops."""
    texts = ["He said (the cost of carry is high), twice.", "“the cost of carry” is high; part of it: 80% of x", "The Fund may\tnot borrow.", "a  b c d e, f", "état civil — 日本語", "", None, "the cost of carry the cost of carry"]
    quotes = ["the cost of carry", "the cost of carry is", "cost", "art of", "(the", "%", "80% of x", "may\tnot", "may not", "b c d e", "b c d e,", "tat", "日本", " of ", "e, f", "cost of", "", None, "carry is high), twice."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    got = {(r["doc_id"], r["item_id"]): (r["char_start"], r["n"]) for r in documents.quoted(docs, items, "doc_id", "text", "item_id", "quote").collect()}
    assert got == {(d, i): (t.index(q), t.count(q)) for d, t in enumerate(texts) for i, q in enumerate(quotes) if t and q and q in t}


def test_identifier_conversions(spark):
    from rulemark.functions import identifiers as ids

    a = spark.createDataFrame([("037833100", "us"), ("03783310X", "US"), (None, "US")], "c string, k string")
    a = a.withColumn("isin", ids.cusip_to_isin(F.col("c"), F.col("k"))).withColumn("back", ids.isin_to_cusip(F.col("isin")))
    assert [(r["isin"], r["back"]) for r in a.collect()] == [("US0378331005", "037833100"), (None, None), (None, None)]


def test_spec_problems_and_compilation(spark):
    from rulemark.operators import spec as specs

    said = {"source": "", "note": ""}
    assert specs.problems([]) and specs.problems({"rules": [{"kind": "odd"}]}) == ["rule 0: unknown kind 'odd'"]
    found = specs.problems({"rules": [{"kind": "position_cap", "max_weight": 15, **said}, {"kind": "holdings", "min": 1.5, "max": 3, "extra": 1, **said}]})
    assert found == ["rule 0 (position_cap): max_weight is a share above 0, up to 1", "rule 1 (holdings): min cannot be 1.5", "rule 1 (holdings): extra is unexpected"]
    assets = spark.createDataFrame([(k, "AB"[k % 2], float(k), k % 3 == 0) for k in range(10)], "asset_id long, sector string, esg double, coal boolean")
    u = specs.Universe(assets, labels=("sector",), numeric=("esg",), flags=("coal",))
    spec = {"rules": [
        {"kind": "exclude", "by": "flag", "values": ["Coal"], **said}, {"kind": "require", "by": "sector", "values": ["a"], **said}, {"kind": "exclude", "by": "ticker", "values": ["77"], **said},
        {"kind": "group_limit", "by": "sector", "values": ["b"], "bound": "max", "limit": 0.1, "unit": "weight", **said}, {"kind": "exclude_threshold", "metric": "ESG", "side": "below", "value": 0.5, "basis": "relative_to_mean", "scope": "universe", **said},
    ]}
    out, k, warnings = specs.compile_spec(specs.read_spec(specs.write_spec(spec)), u, 3)
    assert [(c.status, c.members) for c in out] == [("mapped", 4), ("mapped", 5), ("unmapped", 0), ("mapped", 5), ("mapped", 3)] and k == 3 and warnings == ["exclusions leave 2 assets, fewer than k = 3"]
    held = assets.where("asset_id IN (4, 8)").withColumn("fund", F.lit(1))
    assert {r["rule_no"]: r["ok"] for r in specs.obeys(held, out, "fund").collect()} == {0: True, 1: True, 3: True, 4: True}
    with pytest.raises(ValueError, match="needs k"):
        specs.compile_spec(spec, u)


def test_first_draws_are_the_heads_of_the_orders(spark):
    assets = spark.range(200).select(F.col("id").alias("asset_id"), (F.col("id") % 7).alias("x"))
    for k in (1, 5, 60, 200, 500):
        head = sampling.ordered_draws(assets, 9, 3).where(F.col("rank") <= k).select("sample_id", "rank", "asset_id", "x")
        got = sampling.first_draws(assets, spark.createDataFrame([(k,)], "k int"), 9, 3).select(*head.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, head.collect()))
    assert sampling.k_subsets(assets.limit(0), 3, 4, 1).count() == 0


def test_first_draws_beyond_the_threshold(spark, monkeypatch):
    """Samples with too few keys below the threshold are drawn again whole."""
    assets = spark.range(50).select(F.col("id").alias("asset_id"))
    monkeypatch.setattr(sampling, "uniform", lambda digest: F.when(F.substring(digest, 1, 1) < "8", 2.0).otherwise(0.0))
    head = sampling.ordered_draws(assets, 6, 3).where(F.col("rank") <= 40).select("sample_id", "rank", "asset_id")
    got = sampling.first_draws(assets, spark.createDataFrame([(40,)], "k int"), 6, 3).select(*head.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, head.collect()))


def test_paired_keys_that_pause(spark):
    """A key absent at one of the group's dates meets nothing there; null keys meet nothing at all."""
    rows = [("f", "2024-03-31", "a", 1.0, 10.0), ("f", "2024-06-30", "b", 2.0, 20.0), ("f", "2024-09-30", "a", 3.0, 30.0), ("f", "2024-06-30", None, 4.0, 40.0), ("f", "2024-09-30", None, 5.0, 50.0)]
    df = spark.createDataFrame(rows, "fund string, report_date string, asset_id string, balance double, value double")
    assert prices.paired(df, ["fund"]).count() == 0
    full = {(r.start[5:7], r.asset_id, r.balance0, r.balance1) for r in prices.paired(df, ["fund"], how="full").collect()}
    assert full == {("03", "a", 1.0, None), ("03", "b", None, 2.0), ("03", None, None, 4.0), ("06", "b", 2.0, None), ("06", "a", None, 3.0), ("06", None, 4.0, None), ("06", None, None, 5.0)}


REPORT = """<?xml version="1.0"?><!-- <made> up -->
<edgarSubmission xmlns="http://example.org/report" xmlns:c="http://example.org/common"><headerData><submissionType>NPORT-P</submissionType><filerInfo><seriesClassInfo><classId>C1</classId><classId> </classId><classId>C2</classId></seriesClassInfo></filerInfo></headerData>
<formData><genInfo><regName>Made Up Trust</regName><regCik>42</regCik><seriesName>N/A</seriesName><repPdEnd>2025-12-31</repPdEnd><repPdDate>2025-03-31</repPdDate><isFinalFiling>N</isFinalFiling></genInfo>
<fundInfo><totAssets>110.5</totAssets><netAssets>100</netAssets><returnInfo><monthlyTotReturns><monthlyTotReturn classId="C1" rtn1="1.5" rtn2="N/A" rtn3="-2"/></monthlyTotReturns><othMon2 netRealizedGain="7" netUnrealizedAppr="-1"/></returnInfo><mon1Flow sales="10" redemption="4"/></fundInfo>
<invstOrSecs><invstOrSec><name>One Co</name><cusip>000000117</cusip><identifiers><isin value=" "/><isin value="US1"/><other otherDesc="SEDOL" value="B1"/></identifiers><balance>5</balance><units>NS</units><currencyConditional curCd="EUR" exchangeRt="0.9"/><valUSD>50</valUSD>
<assetConditional assetCat="OTHER" desc="x"/><isRestrictedSec>Y</isRestrictedSec><securityLending><loanByFundCondition isLoanByFund="Y" loanVal="3"/></securityLending><derivativeInfo><c:kind>swap</c:kind></derivativeInfo></invstOrSec>
<invstOrSec><name>Two Co</name><identifiers><isin value="N/A"/></identifiers><curCd>USD</curCd><assetCat>EC</assetCat><securityLending><isLoanByFund>N</isLoanByFund></securityLending></invstOrSec></invstOrSecs></formData></edgarSubmission>"""


def test_report_parts(spark):
    doc = reports.reports(spark.createDataFrame([(1, REPORT), (2, None)], "id int, xml string"))
    h = reports.header(doc).collect()
    assert len(h) == 1 and (h[0].id, h[0].registrant_name, h[0].registrant_cik, h[0].series_name, h[0].class_ids, h[0].is_final_filing, h[0].net_assets, h[0].total_liabilities) == (1, "Made Up Trust", "0000000042", None, ["C1", "C2"], False, 100.0, None)
    assert [(r.class_id, r.month, r.month_end, r.return_pct) for r in reports.monthly_returns(doc).collect()] == [("C1", 1, dt.date(2025, 1, 31), 1.5), ("C1", 2, dt.date(2025, 2, 28), None), ("C1", 3, dt.date(2025, 3, 31), -2.0)]
    assert [(r.sales, r.reinvestment, r.redemption) for r in reports.flows(doc).orderBy("month").collect()] == [(10.0, None, 4.0), (None, None, None), (None, None, None)]
    assert [(r.net_realized_gain, r.net_unrealized_appreciation) for r in reports.gains(doc).orderBy("month").collect()] == [(None, None), (7.0, -1.0), (None, None)]
    a, b = reports.report_holdings(doc).orderBy("row_index").collect()
    assert (a.locator, a.cusip, a.isin, a.other_id, a.other_id_desc, a.currency, a.exchange_rate, a.asset_category, a.is_restricted, a.is_loaned, a.loan_value, a.has_derivative_info) == ("invstOrSecs/invstOrSec[1]", "000000117", "US1", "B1", "SEDOL", "EUR", 0.9, "OTHER", True, True, 3.0, True)
    assert (b.currency, b.asset_category, b.balance, b.is_loaned, b.has_derivative_info, b.isin) == ("USD", "EC", None, False, False, None)


@pytest.mark.parametrize("old, new", [("110.5", "many"), ("2025-03-31<", "31 March<"), ("edgarSubmission", "other"), ("NPORT-P", "10-K"), ("<repPdDate>2025-03-31</repPdDate>", ""), (">42<", ">x42<"), ("<isFinalFiling>N", "<isFinalFiling>maybe"), ("</formData>", "")])
def test_malformed_reports_raise(spark, old, new):
    doc = spark.createDataFrame([(REPORT.replace(old, new),)], "xml string")
    with pytest.raises(Exception):
        reports.header(reports.reports(doc)).collect()


@pytest.mark.parametrize("old, new", [("<units>NS</units>", "<units>NS</unit>"), ("</invstOrSecs>", ""), ("110.5", "many"), ("edgarSubmission", "other")])
def test_reports_without_positions_raise_as_well(spark, old, new):
    short = lambda text: reports.reports(spark.createDataFrame([(text,)], "xml string"), positions=False)
    assert "invstOrSecs" not in short(REPORT).schema["report"].simpleString() and reports.header(short(REPORT)).collect() == reports.header(reports.reports(spark.createDataFrame([(REPORT,)], "xml string"))).collect()
    with pytest.raises(Exception):
        reports.header(short(REPORT.replace(old, new))).collect()


def test_report_values_as_they_stand_or_trimmed(spark):
    """The short ways read what the long ones read; no upper casing of each value, no search of the whole text for comments."""
    c = F.col("t")
    rows = [(" 1.5 ", 1.5), ("1.5", 1.5), ("n/A", None), (" N/a\t", None), ("", None), (None, None), ("1e3", 1000.0)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert df.select("want", reports.number(c, "x").alias("got")).where("want IS DISTINCT FROM got").count() == 0
    flags = spark.createDataFrame([("Y", True), ("N", False), (" y\n", True), ("n", False), ("n/a", None), (None, None)], "t string, want boolean")
    assert flags.select("want", reports.flag(c, "x").alias("got")).where("want IS DISTINCT FROM got").count() == 0
    days = spark.createDataFrame([("2025-03-31", "2025-03-31"), (" 2025-03-31\n", "2025-03-31"), ("N/A", None)], "t string, want string")
    assert days.select("want", reports.day(c, "x").cast("string").alias("got")).where("want IS DISTINCT FROM got").count() == 0
    assert "upper(" not in str(reports.clean(c)).lower()
    for bad in ("2025-3-1", "2025-03-31x"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(reports.day(c, "x")).collect()


def test_report_files_keep_the_last_of_a_date(spark, tmp_path):
    (tmp_path / "a.xml").write_text(REPORT)
    (tmp_path / "b.xml").write_text(REPORT.replace("Made Up", "Later"))
    (tmp_path / "c.xml").write_text(REPORT.replace("2025-03-31", "2025-06-30"))
    got = reports.header(reports.one_a_date(reports.report_files(spark, str(tmp_path)))).orderBy("report_date").collect()
    assert [(r.registrant_name, r.file[-5:]) for r in got] == [("Later Trust", "b.xml"), ("Made Up Trust", "c.xml")]


def test_series_filings(spark):
    entry = "<entry><content type='text/xml'><accession-number>{}</accession-number><filing-type>{}</filing-type><filing-date>{}</filing-date></content></entry>"
    feed = "<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><company-info><cik>7</cik><conformed-name>Made Up</conformed-name></company-info>{}</feed>"
    good = feed.format(entry.format("0000000007-25-000001", "NPORT-P", "2025-05-01") + entry.format("000000000725000002", "NPORT-P/A", "2025-06-01"))
    df = lambda x: reports.series_filings(spark.createDataFrame([(x,)], "xml string"))
    got = df(good).orderBy("place").collect()
    assert [(r.cik, r.accession, r.form, r.filing_date, r.is_amendment) for r in got] == [("0000000007", "0000000007-25-000001", "NPORT-P", dt.date(2025, 5, 1), False), ("0000000007", "0000000007-25-000002", "NPORT-P/A", dt.date(2025, 6, 1), True)]
    assert df(feed.format("")).count() == 0
    with pytest.raises(Exception):
        df(feed.format(entry.format("", "NPORT-P", "2025-05-01"))).collect()


def test_mandates_against_region_rules(spark):
    fund = spark.createDataFrame([("a", "US", "Tech Leaders", True, False), ("b", "EU", "Green Paris", False, True), ("c", "US", None, False, False)], "fund_id string, region string, fund_name string, diversified boolean, claims_pab boolean")
    need = regions.applicable(fund)
    assert sorted(r.rule_id for r in need.where("fund_id = 'a'").collect()) == ["us_concentration_25", "us_diversified_75_5", "us_names_rule_80", "us_ric_issuer_25"]
    assert need.where("fund_id = 'b'").count() == 10 and need.where("fund_id = 'c'").count() == 2
    own = [("a", "k1", 1, "hard", "position_cap", 0.3, "weight", "max", None, None), ("a", "k2", 2, "soft", "position_cap", 0.25, "weight", "max", None, None), ("a", "k3", 3, "hard", "sector_cap", 0.4, "weight", "max", [" * "], None), ("a", "k4", 4, "hard", "sector_cap", 0.5, "weight", "max", [], None),
           ("a", "k5", 5, "hard", "sector_cap", 0.1, "weight", "max", ["Energy"], None), ("a", "k6", 6, "regulatory", "group_limit", 0.9, "weight", "min", None, None), ("b", "k7", 7, "hard", "exclude", None, None, None, ["x", "TOBACCO"], None), ("b", "k8", 8, "hard", "portfolio_average", 0.5, None, "max", ["Carbon"], "relative_to_mean")]
    mandate = spark.createDataFrame(own, "fund_id string, constraint_id string, place int, constraint_type string, kind string, limit double, unit string, bound string, about array<string>, basis string")
    got = {(r.fund_id, r.rule_id): (r.verdict, r.matched_constraint) for r in regions.compared(need, mandate).collect()}
    assert got["a", "us_ric_issuer_25"] == ("at least as strict", "k2") and got["a", "us_concentration_25"] == ("weaker", "k4") and got["a", "us_names_rule_80"] == ("silent", None) and got["a", "us_diversified_75_5"] == ("not comparable", None)
    assert got["b", "eu_excl_tobacco"] == ("at least as strict", "k7") and got["b", "eu_excl_coal_1pct"] == ("silent", None) and got["b", "eu_pab_intensity_50"] == ("at least as strict", "k8") and len(got) == 16
    with pytest.raises(Exception):
        regions.applicable(fund.withColumn("region", F.lit("UK"))).collect()


def test_check_digits_work_out_their_text_once(spark):
    """A text is worked out once, not once a character; the digits are those of a plain reading."""
    rows = spark.range(300).select(F.substring(F.upper(F.md5(F.col("id").cast("string"))), 1, 11).alias("b"))

    def luhn(b):
        back = "".join(str(ids.ALPHABET.index(c)) for c in b)[::-1]
        return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(back)) % 10

    def products(b):
        return -sum(sum(divmod(ids.ALPHABET.index(c) * (1 + i % 2), 10)) for i, c in enumerate(b[:8])) % 10

    got = rows.select("b", ids.isin_digit(F.col("b")), ids.cusip_digit(F.substring("b", 1, 8))).collect()
    assert [tuple(r) for r in got] == [(r["b"], luhn(r["b"]), products(r["b"])) for r in got]
    body = F.reverse(F.sha1(F.col("id").cast("string").cast("binary")))
    for digit in (ids.isin_digit, ids.cusip_digit, ids.mod97):
        assert spark.range(5).select(digit(body).alias("x"))._jdf.queryExecution().analyzed().toString().count("sha1(") == 1
    assert spark.range(5).select(ids.cusip_to_isin(body, F.lit("US")).alias("x"))._jdf.queryExecution().analyzed().toString().count("sha1(") <= 12


@pytest.mark.parametrize("spare", [(6, 20), (-1, 0)])  # with the second, most samples are drawn again
def test_first_draws_of_groups_are_the_first_of_the_whole_order(spark, monkeypatch, spare):
    monkeypatch.setattr(sampling, "SPARE", spare)
    assets = spark.range(400).select(F.when(F.col("id") < 300, "a").when(F.col("id") < 395, "b").otherwise("c").alias("g"), F.col("id").alias("asset_id"))
    k = {"a": 9, "b": 40, "c": 5}
    got = sampling.first_draws_by(assets, spark.createDataFrame(list(k.items()), "g string, k long"), ["g"], 6, 1).collect()
    want = set()
    for g, ids in (("a", range(300)), ("b", range(300, 395)), ("c", range(395, 400))):
        for s in range(6):
            order = sorted(ids, key=lambda i: hashlib.md5(f"1|{s}|{g}|{i}".encode()).hexdigest())  # noqa: B023
            want |= {(g, s, n + 1, i) for n, i in enumerate(order[: k[g]])}
    assert {(r.g, r.sample_id, r["rank"], r.asset_id) for r in got} == want and len(got) == len(want)


def test_percentile_history_shuffles_only_first_names(spark, monkeypatch):
    """Draws that are sorted are of the largest fund's size, not of the whole universe."""
    from rulemark.plans import registry

    where = "/root/testdata/sf0.01"
    seen, cut = [], sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    registry.QUERIES["fund_percentile_history"](spark, where)
    (low,) = [df for df in seen if "_key" in df.columns]
    assert low.count() < 25 * 23625 / 2
