"""Similarity of entities of a long profile, over the union of their top-sets (or all features)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topset(profile: DataFrame, how: str, cut: float) -> DataFrame:
    """Adds ``top``: among the ``cut`` highest (``topnum``), the highest share (``topfraction``), at or above ``cut`` times the maximum (``topcut``) or above the quantile ``cut`` of all values (``significance``); an empty set takes the maximum."""
    w = Window.partitionBy("entity")
    place = F.row_number().over(w.orderBy(F.desc("value"), "feature"))
    if how == "significance":
        level = profile.agg(F.percentile("value", F.lit(float(cut))).alias("level"))
        inside = F.col("value") > F.col("level")
        profile = profile.join(level)
    else:
        inside = {"topnum": place <= cut, "topfraction": place <= F.ceil(F.count("*").over(w) * cut), "topcut": F.col("value") >= cut * F.max("value").over(w)}[how]
    marked = profile.withColumns({"inside": inside, "place": place})
    return marked.withColumn("top", F.col("inside") | (~F.max("inside").over(w) & (F.col("place") == 1))).select("entity", "feature", "value", "top")


def pairs(profile: DataFrame) -> DataFrame:
    """a < b, feature, x, y, tx, ty for all pairs on shared features. The equi-join on the feature is the whole cost: entities^2 per feature."""
    left = profile.select("feature", F.col("entity").alias("a"), F.col("value").alias("x"), F.col("top").alias("tx"))
    right = profile.select("feature", F.col("entity").alias("b"), F.col("value").alias("y"), F.col("top").alias("ty"))
    return left.join(right, "feature").where("a < b")


x, y, tx, ty = (lambda: F.col("x")), (lambda: F.col("y")), (lambda: F.col("tx")), (lambda: F.col("ty"))


def _s(c: Column) -> Column:
    return F.sum(c)


def _safe(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(0.0)


def _moment(k: int) -> Column:
    """Eigenvalues of the 2x2 matrix of second moments, the larger (k = 1) or the smaller."""
    xx, yy, xy = _s(x() * x()), _s(y() * y()), _s(x() * y())
    root = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    return (xx + yy + (root if k else -root)) / 2


def _eigenvector() -> Column:
    xx, yy, xy = _s(x() * x()), _s(y() * y()), _s(x() * y())
    angle = F.atan2(2 * xy, xx - yy) / 2
    return F.abs(F.cos(angle) + F.sin(angle)) / F.sqrt(F.lit(2.0))


def _weighted_pearson() -> Column:
    w = (tx().cast("double") + ty().cast("double")) / 2
    mx, my = F.avg(x()), F.avg(y())
    top = _s(w * x() * y()) - my * _s(w * x()) - mx * _s(w * y()) + mx * my * _s(w)
    return _safe(top, _s(w) * F.stddev_pop(x()) * F.stddev_pop(y()))


def _deviation(power: int) -> Column:
    d = F.abs(x() - y()) if power == 1 else (x() - y()) * (x() - y())
    on1, on2 = F.avg(F.when(tx(), d)), F.avg(F.when(ty(), d))
    spread = F.var_pop(x()) + F.var_pop(y()) if power == 2 else F.stddev_pop(x()) + F.stddev_pop(y())
    return 1 - _safe(on1 + on2, spread)


def _determination() -> Column:
    """R^2 of y as a prediction of x."""
    return 1 - _safe(_s((x() - y()) * (x() - y())), F.var_pop(x()) * F.count("*"))


METRICS: dict[str, Callable[[], Column]] = {
    "pearson": lambda: F.corr("x", "y"),
    "eigenvalue": lambda: _safe(_moment(1), _moment(0)),
    "eigenvector": _eigenvector,
    "pearsonweighted": _weighted_pearson,
    "normdot": lambda: _safe(_s(x() * y()) * _s(x() * y()), _s(x() * x()) * _s(y() * y())),
    "dotproduct": lambda: _s(x() * y()),
    "mdot": lambda: _safe(2 * _s(x() * y()), _s(x() * x()) + _s(y() * y())),
    "cosine": lambda: 1 - _safe(_s(x() * y()), F.sqrt(_s(x() * x()) * _s(y() * y()))),
    "coefofdet": _determination,
    "meansquaredeviation": lambda: _deviation(2),
    "meanabsdeviation": lambda: _deviation(1),
    "topset": lambda: _safe(_s((tx() & ty()).cast("double")), _s(tx().cast("double"))),
    "topsetweighted": lambda: _safe(_s(F.when(tx() & ty(), F.least(x(), y())).otherwise(0.0)), _s(F.when(tx() | ty(), F.greatest(x(), y())).otherwise(0.0))),
    "spearman": lambda: F.corr("x", "y"),
}


def similarity(profile: DataFrame, metric: str, masked: bool = True) -> DataFrame:
    """a < b, value. ``profile`` carries ``top`` (see topset); with ``masked`` only features in either top-set count. ``spearman`` ranks inside each pair's mask."""
    met = pairs(profile)
    if masked:
        met = met.where("tx OR ty")
    if metric == "spearman":
        w = Window.partitionBy("a", "b")
        mid = {c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("a", "b", c)) - 1) / 2.0 for c in "xy"}
        met = met.withColumns(mid)
    value = METRICS[metric]()
    return met.groupBy("a", "b").agg(value.alias("value")).withColumn("value", F.when(F.isnan("value") | F.col("value").isNull(), 0.0).otherwise(F.col("value")))


def mirrored(sim: DataFrame, names: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """The full square from its upper triangle."""
    same = names.select(F.col("entity").alias("a"), F.col("entity").alias("b"), F.lit(diagonal).alias("value"))
    return sim.select("a", "b", "value").union(sim.select(F.col("b"), F.col("a"), "value")).union(same)


def most_similar(sim: DataFrame, n: int) -> DataFrame:
    both = sim.select("a", "b", "value").union(sim.select(F.col("b"), F.col("a"), "value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "b"))).where(F.col("rank") <= n)


def domain_identity(edges: DataFrame, how: str = "highdom") -> DataFrame:
    """Protein identities from those of their domains (a, i, b, j, value; na and nb are the proteins' numbers of domains).

    ``highdom`` takes the best pair; ``order`` the best run of pairs (i + d, j + d) as long as the shorter protein, over its length;
    ``twohigh``, ``alldomain`` and ``shortprot`` the best assignment of 2, max and min of (na, nb) disjoint pairs over that number.
    Assignments are solved per pair of proteins, whose domains are few.
    """
    if how == "highdom":
        return edges.groupBy("a", "b").agg(F.max("value").alias("value"))
    if how == "order":
        diagonal = edges.withColumn("n", F.least("na", "nb")).withColumn("d", F.col("i") - F.col("j"))
        w = Window.partitionBy("a", "b", "d").orderBy("i")
        steps = diagonal.withColumn("from_", F.collect_list("value").over(w.rowsBetween(0, Window.unboundedFollowing)))
        run = F.aggregate(F.slice("from_", 1, F.col("n")), F.lit(0.0), lambda s, v: s + v)
        return steps.groupBy("a", "b").agg(F.max(run / F.col("n")).alias("value"))

    def assign(pdf):
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        n = {"twohigh": 2, "alldomain": max(first.na, first.nb), "shortprot": min(first.na, first.nb)}[how]
        table = np.zeros((int(first.na), int(first.nb)))
        table[pdf.i.to_numpy(int), pdf.j.to_numpy(int)] = pdf.value
        if table.shape[1] > table.shape[0]:
            table = table.T
        k = min(int(n), table.shape[1])
        best = {(0, 0): 0.0}  # (columns used as bits, pairs) -> sum, row by row
        for row in table:
            for (used, m), total in list(best.items()):
                for j, v in enumerate(row):
                    if m < k and not used >> j & 1:
                        key = (used | 1 << j, m + 1)
                        best[key] = max(best.get(key, -np.inf), total + v)
        value = max((t for (_, m), t in best.items() if m == k), default=0.0) / n
        return pd.DataFrame({"a": [first.a], "b": [first.b], "value": [value]})

    return edges.groupBy("a", "b").applyInPandas(assign, f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}, value double")
