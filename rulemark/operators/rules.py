"""Investment rules as aggregate predicates over samples of held assets.

A rule is an aggregate over the rows of one sample that is true where the sample
obeys; a set of rules is one grouped query with all of them side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


@dataclass(frozen=True)
class Rule:
    """A named rule: ``ok`` is an aggregate over a sample's rows."""

    name: str
    ok: Column


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def cardinality(k: int) -> Rule:
    return Rule("cardinality", F.count("*") == k)


def sector_cap(sector: str, most: int, column: str = "sector") -> Rule:
    return Rule("sector_cap", F.count_if(F.col(column) == sector) <= most)


def exclusion(banned: Column) -> Rule:
    return Rule("exclusion", F.count_if(banned) == 0)


def min_avg(column: str, least: float) -> Rule:
    return Rule("min_avg", _no(F.avg(column) >= least))


def max_avg(column: str, most: float) -> Rule:
    return Rule("max_avg", _no(F.avg(column) <= most))


def count_bound(member: Column, low: int | None, high: int | None) -> Rule:
    n = F.count_if(member)
    return Rule("count_bound", F.lit(True) & (n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True)))


def avg_bound(column: str, low: float | None, high: float | None) -> Rule:
    a = F.avg(column)
    return Rule("avg_bound", _no((a >= low if low is not None else F.lit(True)) & (a <= high if high is not None else F.lit(True)) & a.isNotNull()))


def linear_threshold(coefficient: Column, threshold: float, at_least: bool = True) -> Rule:
    total = F.coalesce(F.sum(coefficient), F.lit(0.0))
    return Rule("linear_threshold", total >= threshold if at_least else total < threshold)


def min_groups(column: str, least: int) -> Rule:
    return Rule("min_groups", F.countDistinct(column) >= least)


def volatility_cap(most: float, market_variance: float, beta: str = "beta", residual: str = "resid") -> Rule:
    """Equal weights under a single-index covariance: no pair of assets is formed."""
    n = F.count("*")
    variance = market_variance * F.pow(F.avg(beta), F.lit(2.0)) + F.sum(residual) / (n * n)
    return Rule("volatility_cap", _no(F.sqrt(variance) <= most))


def tracking_error_cap(most: float, market_variance: float, beta: str = "beta", residual: str = "resid", bench: str = "bench", bench_risk: tuple[float, float] = (1.0, 0.0)) -> Rule:
    """Equal weights against benchmark weights; bench_risk: the benchmark's beta and sum of squared weights times residuals."""
    n = F.count("*")
    active = F.avg(beta) - bench_risk[0]
    own = F.sum(residual) / (n * n) - 2 * F.sum(F.col(bench) * F.col(residual)) / n + bench_risk[1]
    return Rule("tracking_error_cap", _no(F.sqrt(F.greatest(market_variance * active * active + own, F.lit(0.0))) <= most))


def share_to_count(share: float, k: int, bound: str) -> int:
    """A bound on a share of k names as a count."""
    import math

    return math.floor(share * k + EPS) if bound == "max" else math.ceil(share * k - EPS)


def evaluate(held: DataFrame, rules: list[Rule], by: str = "sample_id") -> DataFrame:
    """One row a sample: whether it obeys each rule, and all of them (ok)."""
    out = held.groupBy(by).agg(*(r.ok.alias(r.name) for r in rules))
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.col(r.name)
    return out.withColumn("ok", ok)


def holdings_range(low: int, high: int, weight: str = "w") -> Rule:
    n = F.count_if(F.col(weight) > EPS)
    return Rule("holdings_range", (n >= low) & (n <= high))


def position_bound(low: float, high: float, weight: str = "w") -> Rule:
    held = F.when(F.col(weight) > EPS, F.col(weight))
    return Rule("position_bound", _no((F.min(held) >= low - EPS) & (F.max(held) <= high + EPS)))


def group_sum(member: Column, low: float, high: float, weight: str = "w") -> Rule:
    total = F.coalesce(F.sum(F.when(member, F.col(weight))), F.lit(0.0))
    return Rule("group_sum", (total >= low - EPS) & (total <= high + EPS))


def weighted_average(column: str, low: float | None, high: float | None, missing: str = "ineligible", weight: str = "w") -> Rule:
    """Bounds on a weighted mean. Missing values fail ("ineligible") or leave the mean ("renormalise")."""
    covered = F.sum(F.when(F.col(column).isNotNull(), F.col(weight)).otherwise(0.0))
    mean = F.try_divide(F.sum(F.col(weight) * F.col(column)), covered if missing == "renormalise" else F.lit(1.0))
    fine = covered > EPS if missing == "renormalise" else F.sum(weight) - covered <= EPS
    inside = (mean >= low - EPS if low is not None else F.lit(True)) & (mean <= high + EPS if high is not None else F.lit(True))
    return Rule(f"average_{missing}", _no(fine & inside & mean.isNotNull()))


def turnover(previous: str, most: float, weight: str = "w") -> Rule:
    return Rule("turnover", F.sum(F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - F.coalesce(F.col(previous), F.lit(0.0)))) / 2 <= most + EPS)
