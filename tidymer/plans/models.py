"""Queries on models and motifs. Factorisations and motif building have no SQL form; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, motifs, ordered
from ..operators import models as m
from ..operators import profiles as p
from ..operators import sequences as s
from .registry import Tables, query


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Brand counts of suppliers as the sequence side, their revenue by brand as the response."""
    sequence = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity"), F.col("p_type").alias("feature")).agg(F.count("*").cast("double").alias("value"))
    return sequence, t.profile.withColumn("value", F.col("value") / 1e5)


@query("joint_svd_round_trip")
def joint_svd_round_trip(t: Tables) -> DataFrame:
    sequence, response = halves(t)
    _, vx, _ = m.joint_svd(sequence, response, amount=5)
    return m.round_trip_distance(sequence, vx)


@query("joint_svd_local")
def joint_svd_local(t: Tables) -> DataFrame:
    sequence, response = halves(t)
    _, vx, _ = m.joint_svd(sequence, response, amount=5)
    lat = m.latent(sequence, vx)
    return m.decode_near(lat, lat, response)


@query("ridge_dual")
def ridge_dual(t: Tables) -> DataFrame:
    sequence, response = halves(t)
    return m.apply_linear(sequence, m.ridge(sequence, response, 1.0))


@query(
    "knn_predict",
    "WITH c AS (SELECT a.entity AS a, b.entity AS b, round(sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))), 9) AS value FROM profile a JOIN profile b ON a.feature = b.feature AND a.entity <> b.entity GROUP BY ALL), k AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY value DESC, b) <= 3) SELECT k.a AS entity, feature, round(avg(value), 5) AS value FROM k JOIN profile p ON p.entity = k.b GROUP BY ALL",
    ("profile",),
)
def knn_predict(t: Tables) -> DataFrame:
    similar = blocks.best_matches(t.profile, 3, "cosine", 9)
    return m.knn_predict(similar, t.profile, 3).withColumn("value", F.round("value", 5))


@query("pwm_from_kmers")
def pwm_from_kmers(t: Tables) -> DataFrame:
    rna = t.part.select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("part"), F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz #0123456789", "ACGUACGUACGUACGUACGUACGUACGUACGUACGUACG").alias("seq"))
    return motifs.build_pwms(ordered.topk(s.kmers(rna, 5), "top", 10))


@query("pwm_scan")
def pwm_scan(t: Tables) -> DataFrame:
    rna = t.part.select(F.col("p_partkey").alias("entity"), F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz #0123456789", "ACGUACGUACGUACGUACGUACGUACGUACGUACGUACG").alias("seq"))
    pwm = t.spark.createDataFrame([(k, i, b, 0.7 if b == c else 0.1) for k in ("GUACG", "UUA") for i, c in enumerate(k) for b in "ACGU"], "motif string, pos int, base string, p double")
    return motifs.scan(rna, pwm, "sum", 0.001)


@query("fold_change_response", "WITH low AS (SELECT entity, feature, value - 50000 AS value FROM profile), raised AS (SELECT entity, feature, CASE WHEN value > 0 THEN value ELSE (SELECT min(value) FROM low WHERE value > 0) END AS value FROM low) SELECT entity, feature, round(log2(value / avg(value) OVER (PARTITION BY feature)), 6) AS value FROM raised", ("profile",))
def fold_change_response(t: Tables) -> DataFrame:
    low = t.profile.withColumn("value", F.col("value") - 50000)
    return p.log2_fold_of_mean(p.clean(low)).select("entity", "feature", F.round("value", 6).alias("value"))
