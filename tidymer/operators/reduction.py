"""Reductions of profiles before comparison, and small fits whose data are a few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import gram


def pca(profile: DataFrame, share: float, centre: bool = True) -> DataFrame:
    """(entity, feature, value) with components as features: those whose cumulative singular values stay below ``share``, and one more. Entities or features must be of training size."""
    from .models import centred, feature_gram, few

    rows = centred(profile) if centre else profile
    by_features = not few(profile)
    names, g = feature_gram(rows) if by_features else gram(rows)
    values, u = np.linalg.eigh(g)
    order = np.argsort(-values)
    s = np.sqrt(np.maximum(values[order], 0))
    n = min(int((np.cumsum(s) / s.sum() < share).sum()) + 1, len(s))
    if by_features:
        table = [(f, k, float(u[i, order[k]])) for i, (_, f) in enumerate(names) for k in range(n)]
        axes = profile.sparkSession.createDataFrame(table, f"feature {profile.schema['feature'].dataType.simpleString()}, component int, v double")
        return rows.join(F.broadcast(axes), "feature").groupBy("entity", F.col("component").alias("feature")).agg(F.coalesce(F.sum(F.col("value") * F.col("v")), F.lit(0.0)).alias("value"))
    rows = [(names[i], k, float(u[i, order[k]] * s[k])) for i in range(len(names)) for k in range(n)]
    return profile.sparkSession.createDataFrame(rows, f"entity {profile.schema['entity'].dataType.simpleString()}, feature int, value double")


def nmf(profile: DataFrame, rank: int, rounds: int = 200, seed: int = 0, limit: int = 4_000_000) -> DataFrame:
    """Non-negative factors of entities by multiplicative updates on one task; tables of more than ``limit`` values are an error."""
    n = profile.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} values")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="entity", columns="feature", values="value").fillna(0).clip(lower=0)
        v = table.to_numpy(float)
        rng = np.random.default_rng(seed)
        w, h = rng.random((v.shape[0], rank)) + 0.1, rng.random((rank, v.shape[1])) + 0.1
        for _ in range(rounds):
            h *= (w.T @ v) / np.maximum(w.T @ w @ h, 1e-12)
            w *= (v @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        return pd.DataFrame([(e, k, float(x)) for e, row in zip(table.index, w, strict=True) for k, x in enumerate(row)], columns=["entity", "feature", "value"])

    return profile.groupBy().applyInPandas(solve, f"entity {profile.schema['entity'].dataType.simpleString()}, feature int, value double")


def mds(distances: DataFrame, dimensions: int = 2) -> DataFrame:
    """Classical scaling of a small distance table (a, b, distance): (entity, feature, value)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[pdf.a.to_numpy(), pdf.b.to_numpy()])
        d = np.zeros((len(names),) * 2)
        i, j = np.searchsorted(names, pdf.a), np.searchsorted(names, pdf.b)
        d[i, j] = d[j, i] = pdf.distance
        c = np.eye(len(names)) - 1 / len(names)
        values, u = np.linalg.eigh(-c @ (d**2) @ c / 2)
        order = np.argsort(-values)[:dimensions]
        at = u[:, order] * np.sqrt(np.maximum(values[order], 0))
        return pd.DataFrame([(n, k, float(x)) for n, row in zip(names, at, strict=True) for k, x in enumerate(row)], columns=["entity", "feature", "value"])

    return distances.groupBy().applyInPandas(solve, f"entity {distances.schema['a'].dataType.simpleString()}, feature int, value double")


def growth_fit(points: list[tuple[float, float]], bounds: tuple[float, float] = (1e-6, 10.0)) -> tuple[float, float]:
    """(m, a) of y = ln(m a x + 1) / a with the least squares: m by golden-section search inside a grid of a."""
    x, y = np.array(points, float).T
    best = (np.inf, 0.0, 0.0)
    for a in np.geomspace(*bounds, 400):
        target = np.expm1(np.minimum(a * y, 700)) / a
        low, high = np.min(target / x) + 1e-12, np.max(target / x) + 1e-12
        for _ in range(60):
            p, q = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
            error = [np.sum((np.log1p(m * a * x) / a - y) ** 2) for m in (p, q)]
            low, high = (low, q) if error[0] < error[1] else (p, high)
        m = (low + high) / 2
        best = min(best, (float(np.sum((np.log1p(m * a * x) / a - y) ** 2)), float(m), float(a)))
    return best[1], best[2]


def domain_compatible(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose domain lists (joined by -) differ by at most one in the count of every class."""
    x, y = F.split(a, "-"), F.split(b, "-")
    count = lambda of, c: F.size(F.filter(of, lambda d: d == c))
    return pairs.where(F.forall(F.array_union(x, y), lambda c: F.abs(count(x, c) - count(y, c)) <= 1))


def count_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger number of domains, to correct identities of proteins of different size."""
    return F.least(a, b) / F.greatest(a, b)


def alpha_ratio(text: Column) -> Column:
    """Share of letters in a text."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"\p{L}")), F.length(text)), F.lit(0.0))
