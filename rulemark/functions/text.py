"""Wording, numbers and quotes in policy texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording that commits, and wording that hedges, by name.
HARD = {
    "must": r"\bmust\b", "shall": r"\bshall\b", "may not": r"\bmay\s+not\b", "no ... may": r"\bno\b[^.;:]{0,80}?\bmay\b", "between ... and": r"\bbetween\b[^.;:]{0,40}?\band\b",
    "will not": r"\bwill\s+not\b", "does not invest": r"\bdo(?:es)?\s+not\s+invest\b", "cannot": r"\bcan\s*not\b", "prohibited": r"\bprohibit(?:s|ed)?\b", "excluded": r"\bexclud(?:e|es|ed|ing)\b",
    "at least": r"\bat\s+least\b", "no more than": r"\b(?:no|not)\s+more\s+than\b", "not exceed": r"\bnot\s+(?:to\s+)?exceed\b", "no less than": r"\b(?:no|not)\s+less\s+than\b", "only": r"\bonly\b",
}
SOFT = {
    "seeks to": r"\bseeks?\s+to\b", "aims": r"\baims?\b", "normally": r"\bnormally\b", "under normal circumstances": r"\bunder\s+normal\s+(?:circumstances|market\s+conditions|conditions)\b",
    "generally": r"\bgenerally\b", "typically": r"\btypically\b", "intends to": r"\bintends?\s+to\b", "expects to": r"\bexpect(?:s|ed)?\s+to\b",
    "where practicable": r"\b(?:where|when|if|to\s+the\s+extent)\s+practicable\b", "best efforts": r"\bbest\s+efforts\b", "considers": r"\bconsiders?\b", "approximately": r"\bapproximately\b",
    "may": r"\bmay\b", "target": r"\btargets?\b", "primarily": r"\bprimarily\b",
}
# Fund name words of the two groups of name rules.
NAME_STRICT = r"\b(esg|sri|sustainab\w*|environment\w*|green|climate|impact\w*|paris|net[- ]zero|responsible)\b"
NAME_LIGHT = r"\b(transition\w*|social\w*|governance|improv\w*|progress\w*|evolution|transformation)\b"
# Fixed value: a "may" that forbids.
_HIDDEN_MAY = r"\bmay\s+not\b|\bno\b[^.;:]{0,80}?\bmay\b"


def terms(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in a text, in their order. A "may" that forbids does not hedge."""
    low = F.lower(text)
    where = lambda name: F.regexp_replace(low, _HIDDEN_MAY, " ") if name == "may" else low
    return F.filter(F.array(*(F.when(where(n).rlike(p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())


def modality(hard: Column, soft: Column) -> Column:
    """hard only where committing wording stands alone."""
    return F.when((F.size(hard) > 0) & (F.size(soft) == 0), "hard").otherwise("soft")


def name_categories(name: Column) -> Column:
    """Groups of name rules that a fund's name falls in."""
    low = F.lower(name)
    strict, light = low.rlike(NAME_STRICT), low.rlike(NAME_LIGHT)
    return F.filter(F.array(F.when(strict | light, F.lit("name_any")), F.when(light, F.lit("name_ctb")), F.when(strict, F.lit("name_pab"))), lambda x: x.isNotNull())


def not_enforced(target: Column, status: Column, observability: Column, kind: Column, review: Column, promote_soft: bool = False, require_approved: bool = True, allow_proxy: bool = True) -> Column:
    """The first reason why a rule may not be enforced; null if it may."""
    return (
        F.when(target.isNull(), "no numeric form").when(status == "unknown", "value not established").when(observability == "unobservable", "not observable")
        .when((observability == "proxy") & F.lit(not allow_proxy), "proxy not allowed").when(review == "rejected", "rejected in review")
        .when((kind == "soft") & F.lit(not promote_soft), "soft wording").when((review != "approved") & F.lit(require_approved), "not approved")
    )


def confidence(found: Column, grounded: Column, mixed: Column, occurrences: Column, unmarked: Column) -> Column:
    """How far an extracted rule can be trusted: 0 without its quote, 0.3 with an ungrounded number."""
    # The weights of doubts.
    penalty = 0.15 * mixed.cast("int") + 0.10 * (occurrences > 1).cast("int") + 0.10 * unmarked.cast("int")
    return F.when(~found, 0.0).when(~grounded, 0.3).otherwise(F.round(0.95 - penalty, 2))


def digits(text: Column) -> Column:
    """Numbers written in digits, thousands commas dropped, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?|(?<![\w.,])\d+(?:\.\d+)?"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def approve(constraints: DataFrame, approved: Column, promoted: Column, kind: str = "kind", review: str = "review") -> DataFrame:
    """Rules after a review: those of ``approved`` that nobody has rejected are approved, those of ``promoted`` count as hard."""
    return constraints.withColumns({kind: F.when(promoted, "hard").otherwise(F.col(kind)), review: F.when(approved & (F.col(review) != "rejected"), "approved").otherwise(F.col(review))})
