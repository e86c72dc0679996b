"""Statistics of measurements: quantiles, deviation, bounds, bootstraps, regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Error of the sketch that brackets a quantile is 1 / ACCURACY; the bracket is SLACK wide on both sides.
ACCURACY = 10_000
SLACK = 5 / ACCURACY


def beside(rows: DataFrame, few: DataFrame, by: list[str], how: str = "inner", and_on: str | None = None) -> DataFrame:
    """``rows`` with the other columns of ``few``, which has one row a group; groups of nulls too. ``and_on`` is a further key, never null."""
    key = {c: f"_by_{c}" for c in [*by, *([and_on] if and_on else [])]}
    few = few.withColumnsRenamed(key)
    if not key:
        return rows.crossJoin(F.broadcast(few))
    same = [rows[c] == few[k] if c == and_on else rows[c].eqNullSafe(few[k]) for c, k in key.items()]
    return rows.join(F.broadcast(few), reduce(Column.__and__, same), how).drop(*key.values())


def quantiles(df: DataFrame, value: str, wanted: dict[str, tuple[str, float]], by: list[str] | None = None) -> DataFrame:
    """(…by, a double for each of ``wanted``), exact; null for a group without values.

    ``("rank", q)`` is the ceil(q n)-th value, the least for q = 0; ``("r7", q)`` interpolates at (n - 1) q.

    A sketch of each group brackets the quantiles, the values below, within and above each bracket are
    counted, and only the slices that the counts say hold a wanted rank are grouped by value and
    summed up in order. A bracket that misses costs time; the result is the same.
    """
    by = by or []
    rows = df.select(*by, F.col(value).alias("_v"))
    near = [min(1.0, max(0.0, q + d)) for _, q in wanted.values() for d in (-SLACK, SLACK)]
    groups = rows.groupBy(*by).agg(F.percentile_approx("_v", near, ACCURACY).alias("_f"), F.count("_v").alias("_n"))
    n, v = F.col("_n"), F.col("_v")
    ranks, results = [], []
    for name, (kind, q) in wanted.items():
        if kind == "rank":
            ranks.append(F.greatest(F.lit(1), F.ceil(n * F.lit(Decimal(str(q)))).cast("bigint")))
            results.append(F.col(f"_r{len(ranks) - 1}").cast("double").alias(name))
        else:
            at = (n - 1) * F.lit(float(q))
            ranks += [F.floor(at) + 1, F.ceil(at) + 1]
            low, high = (F.col(f"_r{len(ranks) - k}").cast("double") for k in (2, 1))
            mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
            results.append(F.when(low == high, low).otherwise(mixed).alias(name))
    # Grows with the value; a bracket has both its ends, so that a value that fills it is alone in it.
    place = sum(((v >= F.get("_f", F.lit(i))).cast("int") + (v > F.get("_f", F.lit(i + 1))).cast("int") for i in range(0, len(near), 2)), F.lit(0))
    sliced = beside(rows.filter(v.isNotNull()), groups, by).select(*by, "_n", "_v", place.alias("_s"))
    counts = sliced.groupBy(*by, "_n", "_s").agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*by).orderBy("_s"))  # a row for each bracket and what is between them
    counts = counts.select(*by, "_n", "_s", (run - F.col("_c")).alias("_below"), run.alias("_to"))
    holds = lambda r, low, to: (F.col(low) < r) & (r <= F.col(to))
    counts = counts.filter(reduce(Column.__or__, [holds(r, "_below", "_to") for r in ranks])).select(*by, "_s", "_below")
    values = beside(sliced, counts, by, and_on="_s").groupBy(*by, "_n", "_s", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = F.col("_below") + F.sum("_c").over(Window.partitionBy(*by, "_s").orderBy("_v"))
    values = values.withColumn("_to", run).withColumn("_from", F.col("_to") - F.col("_c"))
    found = values.groupBy(*by).agg(*[F.max(F.when(holds(r, "_from", "_to"), v)).alias(f"_r{i}") for i, r in enumerate(ranks)])
    return beside(groups.select(*by, "_n"), found, by, "left").select(*by, *results)


def mad(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(…by, median, mad): the median absolute deviation from the median, unscaled."""
    by = by or []
    rows = df.select(*by, F.col(value).alias("_x"))
    median = quantiles(rows, "_x", {"median": ("r7", 0.5)}, by)
    away = beside(rows, median, by).select(*by, F.abs(F.col("_x") - F.col("median")).alias("_x"))
    out = beside(median, quantiles(away, "_x", {"mad": ("r7", 0.5)}, by), by)
    return out if by else out.join(rows.limit(1).select(), how="cross")  # no rows, no row


def ols_simple(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, float]:
    """(coefficients with the intercept first, residual sum of squares): one pass for the cross products of centred columns."""
    n, *mean = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in [*xs, y]]).first()
    k = len(xs) + 1
    z = [F.col(c) - F.lit(m) for c, m in zip([*xs, y], mean, strict=True)]
    flat = df.agg(*[F.sum(z[i] * z[j]) for i in range(k) for j in range(i, k)]).first()
    s, at = np.zeros((k, k)), iter(flat)
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = next(at)
    beta = np.linalg.solve(s[:-1, :-1], s[:-1, -1])
    return np.concatenate([[mean[-1] - beta @ np.array(mean[:-1])], beta]), float(s[-1, -1] - beta @ s[:-1, -1])


def zero_failure_upper(n: Column | int, confidence: float = 0.95):
    """Clopper-Pearson upper bound of a failure rate after ``n`` trials without one."""
    alpha = 1 - confidence
    if isinstance(n, Column):
        return 1 - F.pow(F.lit(alpha), 1 / n)
    return 1 - alpha ** (1 / n) if n else 1.0


def wilson_upper(k: Column | int, n: Column | int, confidence: float = 0.95):
    """One-sided Wilson upper bound of a share of ``k`` in ``n``."""
    z = NormalDist().inv_cdf(confidence)
    col = isinstance(k, Column) or isinstance(n, Column)
    p = k / n
    root = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) if col else math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) + z * root) / (1 + z * z / n)


class Mulberry32:
    """Seeded 32-bit generator; ``random()`` is in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def random(self) -> float:
        m = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & m
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & m
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m
        return ((t ^ (t >> 14)) & m) / 2**32


def quantile7(values: Sequence[float], q: float) -> float:
    return float(np.quantile(np.asarray(values, float), q, method="linear"))


def bootstrap_interval(values: Sequence[float], statistic=np.median, confidence: float = 0.95, rounds: int = 1000, seed: int = 1) -> tuple[float, float]:
    """Percentile bootstrap with the seeded generator: draws are one sequence."""
    v, rng = np.asarray(values, float), Mulberry32(seed)
    stats = [float(statistic(v[[int(rng.random() * len(v)) for _ in range(len(v))]])) for _ in range(rounds)]
    a = (1 - confidence) / 2
    return quantile7(stats, a), quantile7(stats, 1 - a)


def paired_ratio_interval(a: Sequence[float], b: Sequence[float], **kw) -> tuple[float, float]:
    """Interval of the ratio of sums over resampled pairs."""
    pairs = np.column_stack([a, b]).astype(float)
    index = np.arange(len(pairs), dtype=float)
    return bootstrap_interval(index, lambda i: pairs[i.astype(int), 0].sum() / pairs[i.astype(int), 1].sum(), **kw)


def stratified_difference_interval(strata: Sequence[Sequence[tuple[float, float]]], confidence: float = 0.95, rounds: int = 1000, seed: int = 1) -> tuple[float, float]:
    """Interval of the mean over strata of mean paired differences; pairs are redrawn within strata."""
    rng, d = Mulberry32(seed), [np.array([x - y for x, y in s], float) for s in strata]
    stats = [float(np.mean([s[[int(rng.random() * len(s)) for _ in range(len(s))]].mean() for s in d])) for _ in range(rounds)]
    a = (1 - confidence) / 2
    return quantile7(stats, a), quantile7(stats, 1 - a)


def bootstrap_by(df: DataFrame, by: str, value: str, rounds: int = 200, seed: int = 1) -> DataFrame:
    """(by, low, high): a bootstrap of the median for each group; groups are whole in a task, as the draws are one sequence."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_interval(np.sort(f[value].to_numpy(float)), rounds=rounds, seed=seed)
        return pd.DataFrame({by: [f[by].iloc[0]], "low": [low], "high": [high]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, low double, high double")


def weighted_pick(weights: dict[str, float], u: float) -> str:
    """The first name at which the running sum of weights reaches ``u`` of their total."""
    at = u * sum(weights.values())
    for name, w in weights.items():
        at -= w
        if at <= 0:
            return name
    return name


def zipf_index(n: int, s: float, u: float) -> int:
    """An index of [0, n) that leans to the low ones: the continuous law with exponent ``s`` above 1, inverted and cut off."""
    power = float("inf") if s <= 1 else 1 / (s - 1)
    value = (1 - u) ** -power if u else 1.0
    return n - 1 if value == float("inf") else min(n - 1, max(0, math.floor(value) - 1))


def power_law(low: float, high: float, alpha: float, u: float) -> float:
    """A value of [low, high] with density in proportion to x^-alpha."""
    a = 1 - alpha
    x = (low**a + u * (high**a - low**a)) ** (1 / a) if a else low * (high / low) ** u
    return min(high, max(low, x))
