"""Readers of universes, returns, fund reports and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a holding in a fund report, and where the XML has them.
HOLDING = {
    "issuer_name": ("name", "string"), "issuer_lei": ("lei", "string"), "title": ("title", "string"), "cusip": ("cusip", "string"), "balance": ("balance", "double"),
    "units": ("units", "string"), "currency": ("curCd", "string"), "value_usd": ("valUSD", "double"), "pct_net_assets": ("pctVal", "double"), "payoff_profile": ("payoffProfile", "string"),
    "asset_category": ("assetCat", "string"), "issuer_category": ("issuerCat", "string"), "country": ("invCountry", "string"), "is_restricted": ("isRestrictedSec", "string"), "fair_value_level": ("fairValLevel", "string"),
}


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN is no number: null in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def universe(spark: SparkSession, path: str) -> DataFrame:
    """A universe CSV: ticker, mu, sector, esg_score, carbon and maps of flag_*, attr_* and cat_* columns."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in ("ticker", "mu", "sector", "esg_score", "carbon") if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")

    def map_of(prefix: str, kind: str) -> Column:
        found = [c for c in raw.columns if c.startswith(prefix)]
        cells = [x for c in found for x in (F.lit(c.removeprefix(prefix)), F.col(c).cast(kind))]
        return (F.create_map(*cells) if cells else F.create_map()).cast(f"map<string,{kind}>")

    number = lambda c: F.col(c).cast("double").alias(c)
    sigma = number("sigma") if "sigma" in raw.columns else F.lit(None).cast("double").alias("sigma")
    flags = F.transform_values(map_of("flag_", "int"), lambda _, v: v == 1)
    return raw.select("ticker", number("mu"), "sector", number("esg_score"), number("carbon"), sigma, flags.alias("flags"), map_of("attr_", "double").alias("attributes"), map_of("cat_", "string").alias("categories"))


def wide_to_long(spark: SparkSession, path: str, row: str, column: str, value: str) -> DataFrame:
    """A wide CSV (index, then a column a name) as rows; an empty cell raises when it is read."""
    raw = spark.read.csv(path, header=True)
    index, names = raw.columns[0], raw.columns[1:]
    out = raw.unpivot([index], names, column, value).withColumnRenamed(index, row)
    cell = F.col(value).cast("double")
    return out.withColumn(value, F.when(cell.isNull() | F.isnan(cell), F.raise_error(F.concat(F.lit("empty cell: "), F.col(column))).cast("double")).otherwise(cell))


def covariance(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, cov) of a square covariance CSV."""
    return wide_to_long(spark, path, "i", "j", "cov")


def returns(spark: SparkSession, path: str) -> DataFrame:
    """(period, ticker, ret) of a wide returns CSV."""
    return wide_to_long(spark, path, "period", "ticker", "ret")


def fund_report_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of fund report XML files, with the file that each row is from.

    The schema is given, not inferred: a CUSIP of digits is no number.
    """
    names = {source: kind for source, kind in HOLDING.values()}
    schema = ", ".join(f"{n} {k}" for n, k in names.items()) + ", identifiers struct<isin: struct<_value: string>, ticker: struct<_value: string>>"
    raw = spark.read.format("xml").option("rowTag", "invstOrSec").schema(schema).load(path)
    columns = [F.col(source).alias(name) for name, (source, _) in HOLDING.items()]
    return null_if_nan(raw.select(F.input_file_name().alias("file"), *columns, F.col("identifiers.isin._value").alias("isin"), F.col("identifiers.ticker._value").alias("ticker")))


def submissions(rows: DataFrame, json: str = "json") -> DataFrame:
    """A row a filing from listings of parallel arrays; ragged arrays raise."""
    schema = "accessionNumber array<string>, filingDate array<string>, form array<string>"
    s = rows.withColumn("_s", F.from_json(json, schema))
    even = (F.size("_s.accessionNumber") == F.size("_s.filingDate")) & (F.size("_s.accessionNumber") == F.size("_s.form"))
    zipped = F.when(even, F.arrays_zip("_s.accessionNumber", "_s.filingDate", "_s.form")).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    keep = [c for c in rows.columns if c != json]
    out = s.select(*keep, F.explode(zipped).alias("f"))
    return out.select(*keep, F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").alias("filing_date"), F.col("f.form").alias("form"))


def positional_table(rows: DataFrame, columns: list[str], json: str = "json") -> DataFrame:
    """Rows of ``{"fields": [...], "data": [[...]]}``, columns found by their place in fields."""
    t = rows.select(F.from_json(json, "fields array<string>, data array<array<string>>").alias("t"))
    t = t.select(F.col("t.fields").alias("fields"), F.explode("t.data").alias("row"))
    return t.select(*(F.element_at("row", F.array_position("fields", c).cast("int")).alias(c) for c in columns))


def company_tickers(rows: DataFrame, json: str = "json") -> DataFrame:
    """(cik, ticker, title) of a map of objects, the first of each cik."""
    t = rows.select(F.explode(F.from_json(json, "map<string, struct<cik_str: long, ticker: string, title: string>>")).alias("k", "v"))
    return t.groupBy(F.col("v.cik_str").alias("cik")).agg(F.min_by(F.struct("v.ticker", "v.title"), F.col("k").cast("long")).alias("f")).select("cik", "f.ticker", "f.title")


def cik_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(name, cik) of ``NAME:CIK:`` lines; a name may hold colons."""
    lines = spark.read.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="").toDF("line")
    return lines.select(F.regexp_extract("line", r"^(.*):(\d+):$", 1).alias("name"), F.regexp_extract("line", r"^(.*):(\d+):$", 2).alias("cik")).where("cik <> ''").distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of an append-only index."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    text = spark.read.text(path).where("trim(value) <> ''")
    return raw.where("_corrupt IS NULL").drop("_corrupt"), text.where(F.from_json("value", schema).isNull() | F.expr("try_parse_json(value) IS NULL"))


def closes(rows: DataFrame, json: str = "json") -> DataFrame:
    """(day, close, adjusted) of a chart document's parallel arrays."""
    t = rows.withColumn("_c", F.from_json(json, "timestamp array<long>, close array<double>, adjclose array<double>"))
    t = t.select(*[c for c in rows.columns if c != json], F.explode(F.arrays_zip("_c.timestamp", "_c.close", "_c.adjclose")).alias("f"))
    return t.select(*[c for c in rows.columns if c != json], F.to_date(F.timestamp_seconds("f.timestamp")).alias("day"), F.col("f.close").alias("close"), F.col("f.adjclose").alias("adjusted"))


def paragraphs(rows: DataFrame, text: str = "text") -> DataFrame:
    """Blank-line separated paragraphs with their number and offsets (code points) in the text."""
    pattern = F.lit(r"\n[ \t\r\f\x0B]*\n\s*")
    cut = F.regexp_replace(F.col(text), pattern, F.lit("\x00"))
    gaps = F.regexp_extract_all(F.col(text), pattern, 0)
    parts = rows.withColumns({"_p": F.split(cut, "\x00"), "_g": gaps})
    starts = F.transform("_p", lambda p, i: F.struct(p.alias("t"), i.alias("i"), (F.aggregate(F.slice("_p", 1, i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("_g", 1, i), F.lit(0), lambda a, x: a + F.length(x))).alias("s")))
    keep = [c for c in rows.columns if c != text]
    out = parts.select(*keep, F.inline(starts)).where("trim(t) <> ''")
    return out.select(*keep, F.col("i").alias("idx"), F.col("s").alias("char_start"), (F.col("s") + F.length("t")).alias("char_end"), F.col("t").alias(text))


def period_returns(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """(security_key, total_return) of a user's returns CSV for exactly one period; a security given twice is an error."""
    rows = spark.read.csv(path, header=True)
    missing = {"security_key", "start", "end", "total_return"} - set(rows.columns)
    if missing:
        raise ValueError(f"the returns CSV lacks {sorted(missing)}")
    rows = rows.where((F.col("start") == start) & (F.col("end") == end))
    if rows.groupBy("security_key").count().where("count > 1").limit(1).count():
        raise ValueError(f"a security has several returns from {start} to {end}")
    value = F.expr("try_cast(total_return AS DOUBLE)")
    return rows.select("security_key", value.alias("total_return")).where(F.col("total_return").isNotNull() & ~F.isnan("total_return"))
