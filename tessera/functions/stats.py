"""Measures over columns and small tables."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share; (0, 0) for no trials."""
    p, m = hits / n, n.cast("double")
    centre, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def gini(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, gini of the values of each group; nulls are left out, empty and all-zero groups have 0.

    The rank comes from counts of distinct values, so that a group of any size is aggregated before it is sorted.
    """
    by_value = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__k"))
    below = Window.partitionBy(*groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_value.withColumn("__before", F.coalesce(F.sum("__k").over(below), F.lit(0)))
    # ranks before+1 .. before+k of equal values: their sum is k * before + k (k + 1) / 2
    weighted = F.col("__v") * (F.col("__k") * F.col("__before") + F.col("__k") * (F.col("__k") + 1) / 2)
    sums = ranked.groupBy(*groups).agg(F.sum("__k").alias("n"), F.sum(F.col("__v") * F.col("__k")).alias("__s"), F.sum(weighted).alias("__w"))
    return sums.select(*groups, "n", F.when(F.col("__s") == 0, 0.0).otherwise(2 * F.col("__w") / (F.col("n") * F.col("__s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def bootstrap_f1(true: list[bool], predicted: list[bool], draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of F1 over resamples of a small gold set, on the driver."""
    rng, n, found = random.Random(seed), len(true), []
    if not n:
        return 0.0, 0.0
    for _ in range(draws):
        at = [rng.randrange(n) for _ in range(n)]
        tp = sum(true[i] and predicted[i] for i in at)
        wrong = sum(true[i] != predicted[i] for i in at)
        found.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    found.sort()
    return found[int(0.025 * draws)], found[min(draws - 1, int(0.975 * draws))]


def negative_binomial(y: np.ndarray, x: np.ndarray, exposure: np.ndarray, steps: int = 200) -> dict[str, object]:
    """NB2 regression of counts on columns of x (an intercept is added) with log(exposure) as offset, by Newton steps.

    For aggregated rows on the driver. The dispersion is found by alternating with the coefficients. Returns
    coefficients, their exponentials (rate ratios), alpha, log-likelihood and McFadden's pseudo R squared.
    """
    from math import lgamma

    def fit(design: np.ndarray) -> tuple[np.ndarray, float, float]:
        beta, alpha, offset = np.zeros(design.shape[1]), 0.5, np.log(np.maximum(exposure, 1e-9))
        beta[0] = np.log(max(y.mean(), 1e-9)) - offset.mean()
        loglik = lambda a, mu: float(sum(lgamma(v + 1 / a) - lgamma(1 / a) - lgamma(v + 1) + (np.log(1 / (1 + a * m)) / a) + v * np.log(a * m / (1 + a * m)) for v, m in zip(y, mu)))
        for _ in range(steps):
            mu = np.exp(np.clip(design @ beta + offset, -30, 30))
            w = mu / (1 + alpha * mu)
            step = np.linalg.lstsq(design.T @ (design * w[:, None]) + 1e-9 * np.eye(design.shape[1]), design.T @ ((y - mu) / (1 + alpha * mu)), rcond=None)[0]
            beta = beta + np.clip(step, -2, 2)
            grid = alpha * np.exp(np.linspace(-0.4, 0.4, 9))
            mu = np.exp(np.clip(design @ beta + offset, -30, 30))
            new = float(max(grid, key=lambda a: loglik(max(a, 1e-6), mu)))
            done = np.abs(step).max() < 1e-8 and abs(new - alpha) < 1e-8
            alpha = max(new, 1e-6)
            if done:
                break
        return beta, alpha, loglik(alpha, np.exp(np.clip(design @ beta + offset, -30, 30)))

    ones = np.ones((len(y), 1))
    beta, alpha, full = fit(np.hstack([ones, x]))
    null = fit(ones)[2]
    return {"coefficients": beta, "rate_ratios": np.exp(beta), "alpha": alpha, "log_likelihood": full, "pseudo_r2": 1 - full / null if null else 0.0}
