"""Folds for training and testing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import best_matches, crossed
from .models import apply_linear, by_entities, feature_gram, few, gram, ridge_primal
from .stores import persisted

#: Entities of a block of ``joint``; matrices of features by features solved at a time.
BLOCK, SOLVED = 8192, 256


def make_folds(names: DataFrame, n: int | None, *, seed: int = 1, similar: DataFrame | None = None, reached: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """fold, role, entity: a seeded permutation dealt to n folds (None: one entity each); from a fold's training part go those that ``similar`` (a, b) links to its test part.

    ``reached`` gives what is near a fold's test part (fold, entity) from the test parts (entity, fold), where all links would be too many.
    """
    order = Window.orderBy(F.xxhash64("entity", F.lit(seed)), "entity")
    place = F.row_number().over(order) - 1
    test = names.select("entity").distinct().withColumn("fold", (place % n if n else place).cast("int"))
    folds = test.select("fold").distinct()
    train = folds.crossJoin(test.withColumnRenamed("fold", "own")).where("fold <> own").select("fold", "entity")
    if similar is not None:
        both = similar.select("a", "b").union(similar.select("b", "a"))
        near = test.join(both.withColumnRenamed("a", "entity"), "entity").select("fold", F.col("b").alias("entity"))
        train = train.join(near, ["fold", "entity"], "left_anti")
    if reached is not None:
        train = train.join(reached(test), ["fold", "entity"], "left_anti")
    return test.select("fold", F.lit("test").alias("role"), "entity").union(train.select("fold", F.lit("train").alias("role"), "entity"))


def tail_split(names: DataFrame, share: float, order: str) -> DataFrame:
    """Adds ``role``: the last share by ``order`` is the test part."""
    place = F.percent_rank().over(Window.orderBy(order))
    return names.withColumn("role", F.when(place > 1 - share, "test").otherwise("train"))


def dedupe_between(folds: DataFrame, similar: DataFrame) -> DataFrame:
    """Training entities linked to a test entity of their fold through one other entity go too."""
    both = similar.select("a", "b").union(similar.select("b", "a")).distinct()
    test = folds.where("role = 'test'").select("fold", F.col("entity").alias("a"))
    two = test.join(both, "a").select("fold", F.col("b").alias("a")).join(both, "a").select("fold", F.col("b").alias("entity"), F.lit("train").alias("role"))
    return folds.join(two, ["fold", "role", "entity"], "left_anti")


def merge_folds(outputs: DataFrame, expected: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All folds' rows, and the expected folds that are missing; fewer than ``least`` folds are an error."""
    n = outputs.agg(F.count_distinct("fold")).first()[0]
    if n < least:
        raise ValueError(f"{n} folds, {least} are needed")
    return outputs, expected.join(outputs, "fold", "left_anti")


def leave_one_out(sequence: DataFrame, response: DataFrame, how: str, *, alpha: float = 1.0, components: int = 10, sigma: float = 0.2, least: float = 0.01) -> DataFrame:
    """(entity, feature, value): every entity's response as predicted by a model of all others.

    ``nearest`` takes the response of the entity with the largest cosine of sequence features, ``ridge`` a ridge regression without intercept, ``joint`` the
    factorisation of both sides, from whose first ``components`` the entity's latent row is found by its sequence and decoded by the latent rows near it.
    Every model's prediction is a weighted sum of the others' responses. The weights come from Gram matrices of at most MAX_TRAINING entities, each fold's in a task of its own.
    Of more entities, or for ``joint`` of more than features and MANY, the features are solved instead, which gives the same.
    """
    trained = sequence.join(response.select("entity").distinct(), "entity", "left_semi")
    if how == "nearest" and not few(trained):
        nearest = best_matches(trained, 1, "whole_cosine", 9).select("entity", F.col("match").alias("other"))
        return nearest.join(response.withColumnRenamed("entity", "other"), "other").select("entity", "feature", F.col("value").cast("double").alias("value"))
    if how == "ridge" and alpha > 0 and not few(trained):
        return _ridge_out(trained, response, alpha)
    if how == "joint":
        answered = response.join(sequence.select("entity").distinct(), "entity", "left_semi")
        if not by_entities(trained, answered):
            return _joint_out(trained, answered, components, sigma, least)
    names, gx = gram(trained)
    gy = None
    if how == "joint":
        same, gy = gram(answered)
        if same != names:
            raise ValueError("sequence and response must hold the same entities")
    inverse = np.linalg.pinv(gx + alpha * np.eye(len(names))) if how == "ridge" else None
    spark, kind = sequence.sparkSession, sequence.schema["entity"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((names, gx, gy, inverse))

    def weights(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, gx, gy, inverse = shared.value
        for part in parts:
            for i in part.id.tolist():
                rest = np.delete(np.arange(len(names)), i)
                if not len(rest):
                    continue
                if how == "ridge":
                    w = -inverse[i, rest] / inverse[i, i]
                elif how == "nearest":
                    w = np.zeros(len(rest))
                    w[np.round(_cosines(gx[i, i], gx[i, rest], np.diag(gx)[rest]), 9).argmax()] = 1.0
                else:
                    w = _local(gx, gy, i, rest, components, sigma, least)
                at = np.flatnonzero(w)
                yield pd.DataFrame({"entity": [names[i]] * len(at), "other": [names[rest[k]] for k in at], "w": w[at]})

    table = spark.range(0, len(names), numPartitions=min(len(names), 64) or 1).mapInPandas(weights, f"entity {kind}, other {kind}, w double")
    met = table.join(response.withColumnRenamed("entity", "other"), "other")
    return met.groupBy("entity", "feature").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _ridge_out(sequence: DataFrame, response: DataFrame, alpha: float) -> DataFrame:
    """Leave-one-out predictions of a ridge regression from one fit: y - (y - fitted) / (1 - h), where h = x'(X'X + alpha)^-1 x is an entity's leverage."""
    codes, g = feature_gram(sequence)
    inverse = np.linalg.inv(g + alpha * np.eye(len(codes)))
    table = [(f, o, float(inverse[i, j])) for i, (_, f) in enumerate(codes) for j, (_, o) in enumerate(codes)]
    kind = sequence.schema["feature"].dataType.simpleString()
    q = sequence.sparkSession.createDataFrame(table, f"feature {kind}, other {kind}, q double")
    turned = sequence.join(F.broadcast(q), "feature").groupBy("entity", F.col("other").alias("feature")).agg(F.sum(F.col("value") * F.col("q")).alias("t"))
    leverage = turned.join(sequence, ["entity", "feature"]).groupBy("entity").agg(F.sum(F.col("t") * F.col("value")).alias("h"))
    given = response.join(sequence.select("entity").distinct(), "entity", "left_semi")
    fitted = apply_linear(sequence, ridge_primal(sequence, given, alpha)).withColumnRenamed("value", "fitted")
    known = given.groupBy("feature").agg(F.count("*").alias("n"))
    met = fitted.join(given.withColumnRenamed("value", "y"), ["entity", "feature"], "left").join(known, "feature").join(leverage, "entity").where("y IS NULL OR n > 1")
    y = F.coalesce("y", F.lit(0.0))
    return met.select("entity", "feature", (y - (y - F.col("fitted")) / (1 - F.col("h"))).alias("value"))


def _joint_out(sequence: DataFrame, response: DataFrame, components: int, sigma: float, least: float) -> DataFrame:
    """Leave-one-out predictions of ``joint`` from the Gram matrix of all features, from which an entity's own products are taken off for its fold.

    An entity carries its fold's axes and its latent row there to every block of the others; weighted sums of responses leave a task, pairs do not.
    """
    names, g = feature_gram(sequence, response)
    n, first = len(names), sum(side == 0 for side, _ in names)
    answers, spark, kind = [f for side, f in names if side == 1], sequence.sparkSession, sequence.schema["entity"].dataType.simpleString()
    parts = []
    for k, p in enumerate((sequence, response)):
        codes = spark.createDataFrame([(f, i) for i, (side, f) in enumerate(names) if side == k], f"feature {p.schema['feature'].dataType.simpleString()}, code int")
        parts.append(p.join(F.broadcast(codes), "feature").select(F.col("entity").alias("id"), "code", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value")))
    rows = persisted(parts[0].union(parts[1]).groupBy("id").agg(F.collect_list("code").alias("codes"), F.collect_list("value").alias("values")), "rows")
    shared = spark.sparkContext.broadcast(g)

    def solved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for part in parts:
            for low in range(0, len(part), SOLVED):
                some = part.iloc[low : low + SOLVED]
                z = _dense(some, n)[0]
                axes, latent = [], []
                for row, values, v in zip(z, *np.linalg.eigh(g - z[:, :, None] * z[:, None, :]), strict=True):
                    order = np.argsort(-values, kind="stable")[:components]
                    v = v[:, order[values[order] > max(values.max(), 0) * 1e-12]]
                    axes.append(v.ravel())
                    latent.append(np.linalg.pinv(v[:first].T @ v[:first]) @ (v[:first].T @ row[:first]) if v.size else np.zeros(0))
                yield pd.DataFrame({"id": some.id, "turn": axes, "latent": latent})

    tests = persisted(rows.repartition(64, "id").mapInPandas(solved, f"id {kind}, turn array<double>, latent array<double>"), "axes")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not a.empty and not b.empty:
            b = b.sort_values("id").reset_index(drop=True)
            z, known, there = _dense(b, n)
            table = np.hstack([z[:, first:], known[:, first:], there[:, first:]])
            ids = b.id.to_numpy()
            for own, axes, row in zip(a.id, a.turn, a.latent, strict=True):
                v = np.asarray(axes, float).reshape(n, -1)
                latent = z @ v
                d = 1 - _cosines(float(np.dot(row, row)), latent @ np.asarray(row, float), (latent * latent).sum(axis=1))
                d[ids == own] = np.inf
                w = np.exp(-(d**2) / sigma**2)
                w[w < least] = 0
                k = int(d.argmin())
                if np.isfinite(d[k]):
                    sums = np.vstack([w @ table, table[k]])
                    sums[0, len(answers) :] = (w > 0) @ table[:, len(answers) :]
                    out.append((own, w.sum(), sums[0], d[k], ids[k], sums[1]))
        return pd.DataFrame(out, columns=["entity", "weight", "sums", "distance", "match", "own"])

    part = crossed(tests, rows, meet, f"entity {kind}, weight double, sums array<double>, distance double, match {kind}, own array<double>", BLOCK)
    total = F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(3 * len(answers))))
    met = part.groupBy("entity").agg(F.sum("weight").alias("weight"), total.alias("sums"), F.min_by("own", F.struct("distance", "match")).alias("own"))
    chosen = met.select("entity", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"), F.when(F.col("weight") > 0, F.col("sums")).otherwise(F.col("own")).alias("sums"))
    zipped = F.arrays_zip(F.array(*map(F.lit, answers)).alias("feature"), *(F.slice("sums", 1 + i * len(answers), len(answers)).alias(c) for i, c in enumerate(("sum", "known", "there"))))
    long = chosen.select("entity", "weight", F.explode(zipped).alias("z")).where("z.there > 0")
    return long.select("entity", F.col("z.feature").alias("feature"), F.when(F.col("z.known") > 0, F.col("z.sum") / F.col("weight")).alias("value"))


def _dense(rows: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of an entity's values by code, how many of them are known and how many there are."""
    z, known, there = np.zeros((3, len(rows), n))
    for i, (codes, values) in enumerate(zip(rows.codes, rows["values"], strict=True)):
        values = np.asarray(values, float)
        np.add.at(z[i], codes, np.nan_to_num(values, nan=0.0))
        np.add.at(known[i], codes, ~np.isnan(values))
        np.add.at(there[i], codes, 1.0)
    return z, known, there


def _cosines(own: float, products: np.ndarray, others: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.maximum(own * others, 0))
    return np.where(length > 0, products / np.where(length > 0, length, 1), 0.0)


def _local(gx: np.ndarray, gy: np.ndarray, i: int, rest: np.ndarray, components: int, sigma: float, least: float) -> np.ndarray:
    """Weights of the training entities near the latent row that the sequence of entity i gives, in a factorisation of the others."""
    inner = gx[np.ix_(rest, rest)]
    values, u = np.linalg.eigh(inner + gy[np.ix_(rest, rest)])
    order = np.argsort(-values)[:components]
    order = order[values[order] > max(values.max(), 0) * 1e-12]
    s, u = np.sqrt(values[order]), u[:, order]
    half = u / s
    row = np.linalg.pinv(half.T @ inner @ half) @ (half.T @ gx[rest, i])
    latent = u * s
    distance = 1 - _cosines(row @ row, latent @ row, (latent * latent).sum(axis=1))
    near = np.exp(-(distance**2) / sigma**2)
    near[near < least] = 0
    if not near.any():
        near[distance.argmin()] = 1.0
    return near / near.sum()


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """entity, n, pearson: how well each entity's predicted values follow its true ones."""
    met = predicted.join(truth.withColumnRenamed("value", "true"), ["entity", "feature"])
    return met.groupBy("entity").agg(F.count("*").alias("n"), F.corr("value", "true").alias("pearson"))
