"""Arithmetic on array<double> columns, evaluated in the JVM in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y)))


def chi_square(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.when(x + y != 0, (x.cast("double") - y) * (x.cast("double") - y) / (x + y)).otherwise(0.0)))


def correlation_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    centred = [F.transform(v, lambda x, v=v: x.cast("double") - total(v) / F.size(v)) for v in (a, b)]
    return cosine_distance(*centred)


def rbf_of_cosine(a: Column | str, b: Column | str, sigma: float = 0.2) -> Column:
    d = cosine_distance(a, b)
    return F.exp(-d * d / (sigma * sigma))


def rbf(a: Column | str, b: Column | str, sigma: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / (sigma * sigma))


#: Kernels by name; sums and products of kernels are arithmetic on these columns.
KERNELS = {
    "linear": dot,
    "poly": lambda a, b, degree=2, offset=1.0: F.pow(dot(a, b) + offset, F.lit(float(degree))),
    "rbf": rbf,
    "laplacian": lambda a, b, gamma=1.0: F.exp(-gamma * manhattan(a, b)),
    "chi2": lambda a, b, gamma=1.0: F.exp(-gamma * chi_square(a, b)),
    "rbf_cosine": rbf_of_cosine,
}


def polynomial(x: Column | str, coefficients: list[float]) -> Column:
    """Value at x of a polynomial whose highest coefficient comes first (Horner)."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * _col(x) + F.lit(float(c))
    return out


def growth_curve(x: Column | str, m: float, a: float) -> Column:
    """ln(m a x + 1) / a: features covered by x samples; its samples overlap by 1 - exp(-a)."""
    return F.log(F.lit(m * a) * _col(x) + 1) / a


def information(p: Column | str, background: float = 0.25, floor: float = -2.0) -> Column:
    """p log2(p / background), at least ``floor``; the floor where p is 0."""
    p = _col(p)
    return F.when(p > 0, F.greatest(p * F.log2(p / background), F.lit(floor))).otherwise(F.lit(floor))


def normal_tail(z: Column | str) -> Column:
    """Upper tail of the standard normal distribution, by a continued fraction beyond 3 and a power series below (error under 1e-12)."""
    z = _col(z).cast("double")
    x = F.abs(z)
    density = F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    fraction = F.lit(0.0)
    for k in range(60, 0, -1):
        fraction = k / (x + fraction)
    far = density / (x + fraction)
    term = F.lit(1.0)
    for k in range(40, 0, -1):
        term = 1 + term * x * x / (2 * k + 1)
    near = 0.5 - density * x * term
    tail = F.when(x > 3, far).otherwise(near)
    return F.when(z >= 0, tail).otherwise(1 - tail)
