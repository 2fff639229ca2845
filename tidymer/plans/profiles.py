"""Queries on profiles: normalisation, filters, top-sets and pairwise similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, ordered, pairwise
from ..operators import profiles as p
from .registry import Tables, query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("entity", "feature", F.round("value", digits).alias("value"))


def _simple(name: str, build, value: str, digits: int = 6, tail: str = "") -> None:
    query(name, f"SELECT entity, feature, round({value}, {digits}) AS value FROM profile {tail}", ("profile",))(lambda t: rounded(build(t.profile), digits))


E, Q = "(PARTITION BY entity)", "(PARTITION BY feature)"
_simple("l2_normalize", p.l2_normalize, f"value / sqrt(sum(value * value) OVER {E})")
_simple("l1_normalize", p.l1_normalize, f"value / sum(abs(value)) OVER {E}")
_simple("minmax_scale", p.minmax_scale, f"coalesce((value - min(value) OVER {Q}) / nullif(max(value) OVER {Q} - min(value) OVER {Q}, 0), 0)")
_simple("standard_scale", p.standard_scale, f"coalesce((value - avg(value) OVER {Q}) / nullif(stddev_pop(value) OVER {Q}, 0), 0)")
_simple("log2_fold_of_mean", p.log2_fold_of_mean, f"log2(value / avg(value) OVER {Q})")
_simple("binarize", p.binarize, "(value > 0)::INT::DOUBLE")
_simple("negate", p.negate, "-value", 4)
_simple("binarize_top", lambda d: p.binarize_top(d, 10), "(row_number() OVER (PARTITION BY feature ORDER BY value DESC, entity) <= 10)::INT::DOUBLE")
_simple("binarize_significant", lambda d: p.binarize_significant(d, 0.1), "(value >= (SELECT quantile_cont(value, 1 - 0.1) FROM profile))::INT::DOUBLE")
_simple("weights_significant_top_each", lambda d: p.cut_weights(d, "significant-top-each", 1.0), f"CASE WHEN value >= avg(value) OVER {E} + stddev_pop(value) OVER {E} THEN value ELSE 0 END", 4)
_simple("weights_mean", lambda d: p.cut_weights(d, "mean", 1.2), "CASE WHEN value >= 1.2 * (SELECT avg(value) FROM profile) THEN value ELSE 0 END", 4)
_simple("weights_centre_each", lambda d: p.cut_weights(d, "centre-each", 1.0), f"CASE WHEN abs(value - avg(value) OVER {E}) >= stddev_pop(value) OVER {E} THEN value ELSE 0 END", 4)
_simple("group_zscore", lambda d: p.group_zscore(d, F.length("feature")), "(value - avg(value) OVER (PARTITION BY length(feature))) / stddev_pop(value) OVER (PARTITION BY length(feature))")
_simple("min_feature_support", lambda d: p.min_feature_support(d, 1e5), "value", 4, "WHERE feature IN (SELECT feature FROM profile GROUP BY feature HAVING sum(value) >= 1e5)")


@query("mad_zscore", f"WITH o AS (SELECT entity, feature, value - avg(value) OVER {E} AS x FROM profile) SELECT entity, feature, round(x / coalesce(nullif(1.4826 * avg(abs(x)) OVER {E}, 0), 1), 6) AS value FROM o", ("profile",))
def mad_zscore(t: Tables) -> DataFrame:
    return rounded(p.mad_zscore(t.profile))


@query("quantile_normalize", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value, feature) AS rank FROM profile), m AS (SELECT rank, avg(value) AS mean FROM r GROUP BY rank) SELECT entity, feature, round(mean, 4) AS value FROM r JOIN m USING (rank)", ("profile",))
def quantile_normalize(t: Tables) -> DataFrame:
    return rounded(p.quantile_normalize(t.profile), 4)


@query("align_features", "SELECT e.entity, f.feature, coalesce(value, 0) AS value FROM (SELECT DISTINCT entity FROM profile) e CROSS JOIN (SELECT DISTINCT p_brand AS feature FROM part) f LEFT JOIN profile USING (entity, feature)", ("profile",))
def align_features(t: Tables) -> DataFrame:
    return p.align_features(t.profile, t.part.select(F.col("p_brand").alias("feature")))


@query("subset_entities", "SELECT s_suppkey AS entity, EXISTS (SELECT 1 FROM profile WHERE entity = s_suppkey) AS found FROM supplier", ("profile",))
def subset_entities(t: Tables) -> DataFrame:
    names = t.supplier.select(F.col("s_suppkey").alias("entity"))
    rows, missing = p.subset_entities(t.profile, names)
    return rows.select("entity").distinct().withColumn("found", F.lit(True)).union(missing.select("entity", F.lit(False)))


@query("profile_topk", "SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY value DESC, feature) AS rank, feature, value FROM profile QUALIFY rank <= 5", ("profile",))
def profile_topk(t: Tables) -> DataFrame:
    return ordered.topk(t.profile, "top", 5).withColumn("rank", F.col("rank").cast("long"))


@query("profile_toprelative", "SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY value DESC, feature) AS rank, feature, value FROM profile QUALIFY value >= 0.8 * max(value) OVER (PARTITION BY entity)", ("profile",))
def profile_toprelative(t: Tables) -> DataFrame:
    return ordered.topk(t.profile, "relative", 0.8).withColumn("rank", F.col("rank").cast("long"))


@query("topset_fraction", "SELECT entity, feature, value, row_number() OVER (PARTITION BY entity ORDER BY value DESC, feature) <= ceil(count(*) OVER (PARTITION BY entity) * 0.2) AS top FROM profile", ("profile",))
def topset_fraction(t: Tables) -> DataFrame:
    return pairwise.topset(t.profile, "topfraction", 0.2)


@query(
    "tfilter_features",
    "WITH r AS (SELECT l_suppkey AS entity, l_returnflag AS response, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), c AS (SELECT DISTINCT l_suppkey AS entity, l_partkey % 499 AS feature FROM lineitem), f AS (SELECT DISTINCT feature FROM c), s AS (SELECT feature, response, avg(value) FILTER (has) AS m1, avg(value) FILTER (NOT has) AS m2, var_pop(value) FILTER (has) AS v1, var_pop(value) FILTER (NOT has) AS v2, count(*) FILTER (has) AS n1, count(*) FILTER (NOT has) AS n2 FROM (SELECT f.feature, response, value, c.entity IS NOT NULL AS has FROM f CROSS JOIN r LEFT JOIN c ON c.feature = f.feature AND c.entity = r.entity) x GROUP BY ALL), t AS (SELECT feature, max((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) AS t FROM s WHERE n1 > 0 AND n2 > 0 AND v1 / n1 + v2 / n2 > 0 GROUP BY feature) SELECT feature, round(t, 6) AS t FROM t WHERE t >= (SELECT quantile_cont(t, 0.7) FROM t)",
)
def tfilter_features(t: Tables) -> DataFrame:
    responses = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("response")).agg(F.avg("l_quantity").alias("value"))
    carried = t.lineitem.select(F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 499).alias("feature"), F.lit(1.0).alias("value")).distinct()
    return p.tfilter_features(carried, responses, 0.7).withColumn("t", F.round("t", 6))


SQL_METRICS = {
    "pearson": "corr(x, y)",
    "eigenvalue": "coalesce(((sum(x*x) + sum(y*y)) + sqrt(power(sum(x*x) - sum(y*y), 2) + 4 * power(sum(x*y), 2))) / nullif((sum(x*x) + sum(y*y)) - sqrt(power(sum(x*x) - sum(y*y), 2) + 4 * power(sum(x*y), 2)), 0), 0)",
    "eigenvector": "abs(cos(atan2(2 * sum(x*y), sum(x*x) - sum(y*y)) / 2) + sin(atan2(2 * sum(x*y), sum(x*x) - sum(y*y)) / 2)) / sqrt(2)",
    "pearsonweighted": "coalesce((sum(w*x*y) - avg(y) * sum(w*x) - avg(x) * sum(w*y) + avg(x) * avg(y) * sum(w)) / nullif(sum(w) * stddev_pop(x) * stddev_pop(y), 0), 0)",
    "normdot": "coalesce(sum(x*y) * sum(x*y) / nullif(sum(x*x) * sum(y*y), 0), 0)",
    "dotproduct": "sum(x*y)",
    "mdot": "coalesce(2 * sum(x*y) / nullif(sum(x*x) + sum(y*y), 0), 0)",
    "cosine": "1 - coalesce(sum(x*y) / nullif(sqrt(sum(x*x) * sum(y*y)), 0), 0)",
    "coefofdet": "1 - coalesce(sum((x-y)*(x-y)) / nullif(var_pop(x) * count(*), 0), 0)",
    "meansquaredeviation": "1 - coalesce((avg((x-y)*(x-y)) FILTER (tx) + avg((x-y)*(x-y)) FILTER (ty)) / nullif(var_pop(x) + var_pop(y), 0), 0)",
    "meanabsdeviation": "1 - coalesce((avg(abs(x-y)) FILTER (tx) + avg(abs(x-y)) FILTER (ty)) / nullif(stddev_pop(x) + stddev_pop(y), 0), 0)",
    "topset": "coalesce(sum((tx AND ty)::INT) / nullif(sum(tx::INT), 0), 0)",
    "topsetweighted": "coalesce(sum(CASE WHEN tx AND ty THEN least(x, y) ELSE 0 END) / nullif(sum(greatest(x, y)), 0), 0)",
    "spearman": "corr(rx, ry)",
}
PAIRS = (
    "WITH marked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, feature) <= 16 AS top FROM centroids), "
    "pairs AS (SELECT a.entity AS a, b.entity AS b, a.value AS x, b.value AS y, a.top AS tx, b.top AS ty, (a.top::INT + b.top::INT) / 2.0::DOUBLE AS w FROM marked a JOIN marked b ON a.feature = b.feature AND a.entity < b.entity WHERE a.top OR b.top), "
    "mid AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM pairs) "
)
for _metric, _sql in SQL_METRICS.items():
    query(f"pairwise_{_metric}", f"{PAIRS} SELECT a, b, round({_sql}, 6) AS value FROM mid GROUP BY a, b", ("centroids",))(
        lambda t, metric=_metric: pairwise.similarity(pairwise.topset(t.centroids, "topnum", 16), metric).withColumn("value", F.round("value", 6))
    )


@query("supplier_pearson_top3", "WITH c AS (SELECT a.entity AS a, b.entity AS b, round(corr(a.value, b.value), 6) AS value FROM profile a JOIN profile b ON a.feature = b.feature AND a.entity <> b.entity GROUP BY ALL), f AS (SELECT a, b, CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE value END AS value FROM c) SELECT a, b, value, row_number() OVER (PARTITION BY a ORDER BY value DESC, b) AS rank FROM f QUALIFY rank <= 3", ("profile",))
def supplier_pearson_top3(t: Tables) -> DataFrame:
    best = blocks.best_matches(t.profile, 3, "pearson", 6)
    return best.select(F.col("entity").alias("a"), F.col("match").alias("b"), "value", F.col("rank").cast("long").alias("rank"))
