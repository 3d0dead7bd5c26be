"""Exact binomial intervals and monotone fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for a, b >= 1, by Gauss-Legendre panels around the mode.

    The density is unimodal for a, b >= 1, so panels of a few standard deviations
    about the mean hold all but a negligible part of it.
    """
    mean, dev = a / (a + b), np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    from_ = np.maximum(0.0, mean - 40 * dev)
    to = np.clip(x, from_, np.minimum(1.0, mean + 40 * dev))
    nodes, weights = np.polynomial.legendre.leggauss(24)
    scale = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b, strict=True)])
    panels, total = 64, np.zeros(len(a))
    step = (to - from_) / panels
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(panels):
            t = from_[:, None] + step[:, None] * (k + (nodes + 1) / 2)
            log = scale[:, None] + (a - 1)[:, None] * np.log(t) + (b - 1)[:, None] * np.log1p(-t)
            total += (np.exp(np.where(step[:, None] > 0, log, -np.inf)) * weights).sum(1) * step / 2
    return np.clip(total, 0, 1)


def _quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (low + high) / 2
        below = _beta_share(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def clopper_pearson(hits: Column, n: Column, conf: float = 0.95) -> Column:
    """struct<low, high>: the interval of a share by the binomial law itself; null without trials or for hits outside 0 to n."""

    @F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
    def interval(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        h, m = hits.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan)
        good = (m > 0) & (h >= 0) & (h <= m)
        low, high = np.where(good, 0.0, np.nan), np.where(good, 1.0, np.nan)
        some, rest = good & (h > 0), good & (h < m)
        low[some] = _quantile(h[some], m[some] - h[some] + 1, (1 - conf) / 2)
        high[rest] = _quantile(h[rest] + 1, m[rest] - h[rest], (1 + conf) / 2)
        return pd.DataFrame({"low": low, "high": high}).astype(object).where(lambda d: d.notna(), None)

    return interval(hits.cast("double"), n.cast("double"))


def pooled_levels(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing levels nearest to y in weighted squares: the slopes of the greatest convex minorant.

    The minorant is of the running sums of w * y over those of w.
    """
    at = np.append(0.0, np.cumsum(w))
    height = np.append(0.0, np.cumsum(w * y))
    hull = [0]
    for k in range(1, len(at)):
        while len(hull) > 1 and (height[hull[-1]] - height[hull[-2]]) * (at[k] - at[hull[-1]]) >= (height[k] - height[hull[-1]]) * (at[hull[-1]] - at[hull[-2]]):
            hull.pop()
        hull.append(k)
    slopes = np.diff(height[hull]) / np.diff(at[hull])
    return np.repeat(slopes, np.diff(hull))


def isotonic(rows: DataFrame, by: list[str], x: str, y: str, weight: str, out: str = "fit") -> DataFrame:
    """(by, x, out): the monotone fit of y on x within each group.

    Rows of one x are pooled by an aggregation first, so a group holds one row for
    each distinct x. Rows with a null x or y or without a positive weight play no part.
    """
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(weight) > 0))
    w = F.col(weight).cast("double")
    pooled = used.groupBy(*by, x).agg((F.sum(F.col(y) * w) / F.sum(w)).alias("_y"), F.sum(w).alias("_w"))
    schema = T.StructType([*(pooled.schema[c] for c in (*by, x)), T.StructField(out, T.DoubleType())])

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(x, kind="stable")
        group[out] = pooled_levels(group["_y"].to_numpy(float), group["_w"].to_numpy(float))
        return group[[*by, x, out]]

    return pooled.groupBy(*by).applyInPandas(fitted, schema)
