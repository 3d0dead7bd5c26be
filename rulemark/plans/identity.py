"""Queries on identifiers, issuer names and industry codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemark.functions import identifiers as ids
from rulemark.operators import joins
from rulemark.plans.registry import query
from rulemark.sources.tables import read

# Industry code ranges of the exclusion list, in order.
EXCLUDED_INDUSTRIES = [
    ("fossil", 1200, 1299), ("fossil", 1300, 1399), ("fossil", 2900, 2999), ("tobacco", 2100, 2199), ("alcohol", 2082, 2082), ("alcohol", 2084, 2085),
    ("weapons", 3480, 3489), ("weapons", 3760, 3769), ("weapons", 3795, 3795),
]

ALPHABET_SQL = f"'{ids.ALPHABET}'"
DIGIT_SQL = f"""(10 - list_sum(list_transform(range(1, 9), lambda i: (
    ((instr({ALPHABET_SQL}, substr(body, i, 1)) - 1) * (2 - i % 2)) // 10 + ((instr({ALPHABET_SQL}, substr(body, i, 1)) - 1) * (2 - i % 2)) % 10))) % 10) % 10"""
CODES_SQL = f"""
    WITH b AS (SELECT p_partkey AS id, p_name, p_type, lpad(upper(printf('%x', p_partkey * 7919 + 1048576)), 8, '3') AS body FROM part),
    d AS (SELECT *, CAST({DIGIT_SQL} AS INT) AS digit FROM b),
    codes AS (SELECT id, p_name, p_type, body, digit, ' ' || lower(body) || CASE WHEN id % 5 = 0 THEN (digit + 1) % 10 ELSE digit END || ' ' AS cusip FROM d)"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a nine-character code each; every fifth check digit is off by one."""
    body = F.lpad(F.hex(F.col("p_partkey") * 7919 + 1048576), 8, "3")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", body.alias("body"))
    rows = rows.withColumn("digit", ids.cusip_digit(F.col("body")))
    off = F.when(F.col("id") % 5 == 0, (F.col("digit") + 1) % 10).otherwise(F.col("digit"))
    return rows.withColumn("cusip", F.concat(F.lit(" "), F.lower("body"), off.cast("string"), F.lit(" ")))


@query("cusip_check", CODES_SQL + " SELECT id, upper(trim(cusip)) AS code, digit, right(trim(cusip), 1) = CAST(digit AS VARCHAR) AS valid FROM codes")
def cusip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select("id", ids.clean(F.col("cusip")).alias("code"), "digit", ids.cusip_valid(F.col("cusip")).alias("valid"))


ISIN_SQL = f"""
    WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'DE' ELSE 'US' END || lpad(upper(printf('%x', p_partkey * 7919 + 1048576)), 9, '0') AS body FROM part),
    e AS (SELECT *, reverse(array_to_string(list_transform(range(1, 12), lambda i: CAST(instr({ALPHABET_SQL}, substr(body, i, 1)) - 1 AS VARCHAR)), '')) AS back FROM b),
    d AS (SELECT *, CAST((10 - list_sum(list_transform(range(1, len(back) + 1), lambda i: (
        (CAST(substr(back, i, 1) AS INT) * (1 + i % 2)) // 10 + (CAST(substr(back, i, 1) AS INT) * (1 + i % 2)) % 10))) % 10) % 10 AS INT) AS digit FROM e)
    SELECT id, body || digit AS isin, digit, id % 7 <> 0 AS valid FROM d"""


@query("isin_check", ISIN_SQL)
def isin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_partkey") % 2 == 0, "DE").otherwise("US")
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(head, F.lpad(F.hex(F.col("p_partkey") * 7919 + 1048576), 9, "0")).alias("body"))
    b = b.withColumn("digit", ids.isin_digit(F.col("body")))
    given = F.concat("body", F.when(F.col("id") % 7 == 0, (F.col("digit") + 3) % 10).otherwise(F.col("digit")).cast("string"))
    return b.select("id", F.concat("body", F.col("digit").cast("string")).alias("isin"), "digit", ids.isin_valid(given).alias("valid"))


@query("lei_check", f"""
    WITH b AS (SELECT s_suppkey AS id, 'LEI' || lpad(CAST(s_suppkey * 104729 AS VARCHAR), 15, '0') AS body FROM supplier),
    r AS (SELECT *, CAST(array_to_string(list_transform(range(1, 19), lambda i: CAST(instr({ALPHABET_SQL}, substr(body, i, 1)) - 1 AS VARCHAR)), '') || '00' AS HUGEINT) % 97 AS rest FROM b)
    SELECT id, body || lpad(CAST(98 - rest AS VARCHAR), 2, '0') AS lei, id % 4 <> 0 AS valid FROM r""")
def lei_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("LEI"), F.lpad((F.col("s_suppkey") * 104729).cast("string"), 15, "0")).alias("body"))
    b = b.withColumn("check", 98 - ids.mod97(F.concat("body", F.lit("00"))))
    code = lambda c: F.concat("body", F.lpad(c.cast("string"), 2, "0"))
    given = F.when(F.col("id") % 4 == 0, code((F.col("check") + 1) % 97)).otherwise(code(F.col("check")))
    return b.select("id", code(F.col("check")).alias("lei"), ids.lei_valid(given).alias("valid"))


KEY_SQL = """CASE WHEN right(trim(cusip), 1) = CAST(digit AS VARCHAR) THEN 'cusip:' || upper(trim(cusip))
    ELSE 'name:' || trim(regexp_replace(upper(p_name), '[^A-Z0-9_]+', ' ', 'g')) || '|' || trim(regexp_replace(upper(p_type), '[^A-Z0-9_]+', ' ', 'g')) END"""


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return codes(spark, sf_dir).withColumn("security_key", ids.security_key(F.col("cusip"), none, none, F.col("p_type"), F.col("p_name")))


@query("security_key", CODES_SQL + f" SELECT id, {KEY_SQL} AS security_key FROM codes")
def security_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("id", "security_key")


@query("identifier_report", CODES_SQL + f""", k AS (SELECT id, {KEY_SQL} AS key FROM codes), c AS (SELECT key, count(*) AS n FROM k GROUP BY 1)
    SELECT split_part(key, ':', 1) AS scheme, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_duplicated, CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM c GROUP BY 1""")
def identifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = keyed(spark, sf_dir).groupBy("security_key").agg(F.count("*").alias("n"))
    return c.groupBy(F.substring_index("security_key", ":", 1).alias("scheme")).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_duplicated"), F.sum(F.col("n") - 1).alias("n_surplus")
    )


@query("identifier_history", """
    SELECT l_partkey AS asset_id, min(CAST(l_shipdate AS DATE)) AS first_seen, max(CAST(l_shipdate AS DATE)) AS last_seen, count(DISTINCT l_suppkey) AS n_funds,
        string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def identifier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asset_id")).agg(
        F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.countDistinct("l_suppkey").alias("n_funds"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("flags")
    )


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _name_sql(column: str, stop: tuple[str, ...]) -> str:
    base = f"""regexp_replace(upper(trim({column})), '\\s*[/\\\\]\\s*[A-Z]{{2,3}}\\s*[/\\\\]?\\s*$', '')"""
    plain = f"trim(regexp_replace(regexp_replace(replace({base}, '&', ' AND '), '[.''’]', '', 'g'), '[^A-Z0-9_]+', ' ', 'g'))"
    return f"array_to_string(list_filter(string_split({plain}, ' '), lambda x: NOT list_contains([{_quoted(stop)}], x)), ' ')"


NAME_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'The ' || c_name || ' Holdings, Inc.' WHEN 1 THEN c_name || ' Corp /DE/' WHEN 2 THEN replace(c_name, '#', ' & ') || ' Group' ELSE c_name END"
FORMS_SQL = f"""
    WITH n AS (SELECT c_custkey AS id, {NAME_SQL} AS name FROM customer), f AS (SELECT id, {_name_sql('name', ids.SUFFIXES)} AS exact, {_name_sql('name', ids.LOOSE)} AS loose FROM n)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    made = F.when(k == 0, F.concat(F.lit("The "), name, F.lit(" Holdings, Inc."))).when(k == 1, F.concat(name, F.lit(" Corp /DE/"))).when(k == 2, F.concat(F.replace(name, F.lit("#"), F.lit(" & ")), F.lit(" Group"))).otherwise(name)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), made.alias("name"))


@query("company_name_forms", FORMS_SQL + " SELECT id, exact, loose, '~' || replace(loose, ' ', '') AS compact FROM f")
def company_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = ids.company_name(F.col("name"), True)
    return _names(spark, sf_dir).select("id", ids.company_name(F.col("name")).alias("exact"), loose.alias("loose"), F.concat(F.lit("~"), F.replace(loose, F.lit(" "), F.lit(""))).alias("compact"))


MATCH_SQL = FORMS_SQL + f""", forms AS (
        SELECT id, 0 AS tier, exact AS form FROM f WHERE exact <> '' UNION ALL SELECT id, 1, loose FROM f WHERE loose <> '' UNION ALL SELECT id, 2, '~' || replace(loose, ' ', '') FROM f WHERE loose <> ''
    ), reg AS (SELECT c_custkey // 2 AS cik, {_name_sql('c_name', ids.LOOSE)} AS loose, {_name_sql('c_name', ids.SUFFIXES)} AS exact FROM customer),
    rf AS (SELECT DISTINCT cik, form FROM (SELECT cik, exact AS form FROM reg UNION ALL SELECT cik, loose FROM reg UNION ALL SELECT cik, '~' || replace(loose, ' ', '') FROM reg)),
    pool AS (SELECT form, count(*) AS n, min(cik) AS cik FROM rf GROUP BY 1), s AS (SELECT * FROM forms LEFT JOIN pool USING (form)),
    b AS (SELECT id, min(CASE WHEN n = 1 THEN tier END) AS tier, arg_min(cik, tier) FILTER (n = 1) AS cik, max(coalesce(n, 0)) AS most FROM s GROUP BY 1)
    SELECT id, cik, tier, CASE WHEN tier IS NOT NULL THEN 'matched' WHEN most > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM b"""


@query("match_issuers_tiered", MATCH_SQL)
def match_issuers_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _names(spark, sf_dir).select("id", F.inline(F.filter(ids.name_forms(F.col("name")), lambda x: x["tier"] < 3)))
    right = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 2).alias("cik"), F.inline(F.filter(ids.name_forms(F.col("c_name")), lambda x: x["tier"] < 3)))
    return joins.tiered(left, right, "id", "cik")


@query("resolve_ambiguous", """
    WITH c AS (SELECT c_custkey // 9 AS name_no, c_custkey AS cik, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 2 END AS code FROM customer),
    g AS (SELECT name_no, list(CAST(cik AS VARCHAR) ORDER BY cik) AS ids, count(DISTINCT code) AS codes, min(code) AS code FROM c GROUP BY 1)
    SELECT name_no, CASE WHEN codes = 1 THEN code END AS code, array_to_string(ids[1:6], '|') AS candidates, len(ids) > 6 AS more FROM g""")
def resolve_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one name are accepted where those that have a code agree on it; six at most are shown."""
    c = read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 9).alias("name_no"), F.col("c_custkey").alias("cik"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") % 2).alias("code"))
    g = c.groupBy("name_no").agg(F.transform(F.array_sort(F.collect_list("cik")), lambda x: x.cast("string")).alias("ids"), F.count_distinct("code").alias("codes"), F.min("code").alias("code"))
    return g.select("name_no", F.when(F.col("codes") == 1, F.col("code")).alias("code"), F.array_join(F.slice("ids", 1, 6), "|").alias("candidates"), (F.size("ids") > 6).alias("more"))


@query("sic_range_exclusion", """
    WITH r(k, reason, lo, hi) AS (VALUES %s), c AS (SELECT p_partkey AS id, 1000 + p_partkey * 37 %% 3000 AS sic FROM part)
    SELECT id, sic, arg_min(reason, k) AS reason FROM c LEFT JOIN r ON sic BETWEEN lo AND hi GROUP BY 1, 2""" % ", ".join(f"({k}, '{n}', {a}, {b})" for k, (n, a, b) in enumerate(EXCLUDED_INDUSTRIES)))
def sic_range_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1000 + F.col("p_partkey") * 37 % 3000).alias("sic"))
    return joins.in_ranges(c, "sic", EXCLUDED_INDUSTRIES, "reason")
