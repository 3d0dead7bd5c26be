"""Security identifiers as column expressions: cleaning, check digits, keys, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of identifiers by value, and texts that stand for none.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"
PLACEHOLDERS = ("", "N/A", "NA", "NONE", "NAN", "NULL")
# Company suffixes that names are compared without, and those of the loose form.
SUFFIXES = ("INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC", "LLC", "LP", "NV", "SA", "AG", "SE", "THE", "DE", "NEW", "CLASS", "COM", "OF")
LOOSE = (*SUFFIXES, "HOLDINGS", "HOLDING", "HLDGS", "GROUP", "GRP", "INTERNATIONAL", "INTL", "COS", "COMPANIES", "TRUST", "REIT", "AND", "A", "B", "C", "ORD", "SHS")


def clean(raw: Column) -> Column:
    """Trimmed upper case; placeholders and all zeros are null."""
    c = F.upper(F.trim(raw))
    return F.when(~c.isin(*PLACEHOLDERS) & ~c.rlike(r"^0+$"), c)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once however often f names it: an argument of a lambda is not copied into its body."""
    return F.transform(F.array(value), f)[0]


def _char_value(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c) - 1


def _value(text: Column, i: Column) -> Column:
    return _char_value(F.substring(text, i, F.lit(1)))


def _digit_sum(total: Column, v: Column) -> Column:
    return total + F.floor(v / 10).cast("int") + v % 10


def cusip_digit(body: Column) -> Column:
    """The check digit of eight characters: every second doubled, digits of the products added."""
    def digit(b: Column) -> Column:
        products = F.array(*(_value(b, F.lit(i)) * (2 if i % 2 == 0 else 1) for i in range(1, 9)))
        return (10 - F.aggregate(products, F.lit(0), _digit_sum) % 10) % 10

    return _once(body, digit)


def cusip_valid(raw: Column) -> Column:
    shape = r"^[0-9A-Z*@#]{8}[0-9]$"
    valid = lambda c: (F.length(c) == 9) & c.rlike(shape) & (cusip_digit(F.substring(c, 1, 8)) == F.substring(c, 9, 1).try_cast("int"))
    return F.coalesce(_once(clean(raw), valid), F.lit(False))


def isin_digit(body: Column) -> Column:
    """Luhn digit of eleven characters, letters counting as two digits."""
    # From the right: (sum of digits, whether the next digit is doubled). A letter's two digits leave that as it is.
    start = F.struct(F.lit(0).alias("total"), F.lit(True).alias("twice"))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def add(s: Column, v: Column) -> Column:
        tens, ones = F.floor(v / 10).cast("int"), v % 10
        more = F.when(v < 10, F.when(s["twice"], doubled(ones)).otherwise(ones)).otherwise(F.when(s["twice"], doubled(ones) + tens).otherwise(ones + doubled(tens)))
        return F.struct((s["total"] + more).alias("total"), (s["twice"] == (v > 9)).alias("twice"))

    values = F.transform(F.split(F.reverse(body), ""), _char_value)
    return F.aggregate(values, start, add, lambda s: (10 - s["total"] % 10) % 10)


def isin_valid(raw: Column) -> Column:
    valid = lambda c: c.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (isin_digit(F.substring(c, 1, 11)) == F.substring(c, 12, 1).try_cast("int"))
    return F.coalesce(_once(clean(raw), valid), F.lit(False))


def mod97(text: Column) -> Column:
    """The number that a text's characters spell (letters as two digits), modulo 97, digit by digit."""
    def add(rest: Column, v: Column) -> Column:
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return _once(text, lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda rest, i: add(rest, _value(t, i))))


def lei_valid(raw: Column) -> Column:
    return F.coalesce(_once(clean(raw), lambda c: F.when(c.rlike(r"^[0-9A-Z]{20}$"), mod97(c) == 1)), F.lit(False))


def normalise(raw: Column) -> Column:
    """Upper case without dots and apostrophes; other punctuation is a blank, blanks are one."""
    c = F.regexp_replace(F.upper(raw), r"[.'’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "), r" +", " "))


def security_key(cusip: Column, isin: Column, lei: Column, title: Column, name: Column) -> Column:
    """``scheme:value``: a valid CUSIP, else ISIN (US and CA by their CUSIP), else LEI with title, else the name."""
    i, inner = clean(isin), F.substring(clean(isin), 3, 9)
    t, n = normalise(title), normalise(name)
    by_isin = F.when(i.rlike("^(US|CA)") & cusip_valid(inner), F.concat(F.lit("cusip:"), inner)).otherwise(F.concat(F.lit("isin:"), i))
    return (
        F.when(cusip_valid(cusip), F.concat(F.lit("cusip:"), clean(cusip))).when(isin_valid(isin), by_isin)
        .when(lei_valid(lei) & (t != ""), F.concat(F.lit("lei:"), clean(lei), F.lit("|"), t))
        .when(n != "", F.concat(F.lit("name:"), n, F.lit("|"), F.coalesce(t, F.lit("")))).otherwise("unknown:")
    )


def company_name(raw: Column, loose: bool = False) -> Column:
    """A company's name without its state, suffixes and punctuation."""
    c = F.regexp_replace(F.upper(F.trim(raw)), r"\s*[/\\]\s*[A-Z]{2,3}\s*[/\\]?\s*$", "")
    c = normalise(F.regexp_replace(c, "&", " AND "))
    stop = F.array(*(F.lit(s) for s in (LOOSE if loose else SUFFIXES)))
    return F.array_join(F.filter(F.split(c, " "), lambda x: ~F.array_contains(stop, x)), " ")


def name_forms(raw: Column) -> Column:
    """Array of (tier, form): exact, loose, compact letters, sorted letters (eight or more)."""
    exact, loose = company_name(raw), company_name(raw, True)
    compact = F.replace(loose, F.lit(" "), F.lit(""))
    letters = F.array_join(F.array_sort(F.split(compact, "")), "")
    form = lambda k, c: F.struct(F.lit(k).alias("tier"), c.alias("form"))
    return F.filter(
        F.array(form(0, exact), form(1, loose), form(2, F.concat(F.lit("~"), compact)), form(3, F.when(F.length(compact) >= 8, F.concat(F.lit("#"), letters)))),
        lambda x: x["form"].isNotNull() & ~x["form"].isin("", "~"),
    )


def accession(raw: Column) -> Column:
    """A filing's number as 10-2-6 digits with dashes; null where it is none."""
    found = F.regexp_extract(raw, r"^(\d{10})-?(\d{2})-?(\d{6})$", 0)
    return F.when(found != "", F.regexp_replace(raw, r"^(\d{10})-?(\d{2})-?(\d{6})$", "$1-$2-$3"))


def cusip_to_isin(cusip: Column, country: Column) -> Column:
    """The ISIN of a valid CUSIP in a country."""
    body = F.concat(F.upper(country), clean(cusip))
    return F.when(cusip_valid(cusip), _once(body, lambda b: F.concat(b, isin_digit(b).cast("string"))))


def isin_to_cusip(isin: Column) -> Column:
    """The CUSIP inside a valid ISIN of the United States or Canada."""
    return _once(clean(isin), lambda c: F.when(F.substring(c, 1, 2).isin("US", "CA") & isin_valid(c), F.substring(c, 3, 9)))
