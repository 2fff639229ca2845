"""Group summaries: means, coverage, overlaps, selectivity, expression and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_mean(df: DataFrame, by: list[str], totals: list[str], parts: list[str]) -> DataFrame:
    """Means of the counts and of each part's share in the first total; an undefined share is 0."""
    share = [F.avg(F.coalesce(F.try_divide(F.col(p), F.col(totals[0])), F.lit(0.0))).alias(f"{p}_share") for p in parts]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_mean") for c in [*totals, *parts]), *share)


def tissue_mean(expression: DataFrame, samples: DataFrame) -> DataFrame:
    """gene, tissue, value: mean over the tissue's samples."""
    return expression.join(samples, "sample").groupBy("gene", "tissue").agg(F.avg("value").alias("value"))


def tissue_correlation(means: DataFrame) -> DataFrame:
    """a < b, r over genes."""
    x, y = means.select("gene", F.col("tissue").alias("a"), F.col("value").alias("x")), means.select("gene", F.col("tissue").alias("b"), F.col("value").alias("y"))
    return x.join(y, "gene").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


def replicate_cosine(expression: DataFrame, replicates: DataFrame, cut: float) -> DataFrame:
    """Genes whose two replicates (sample -> tissue, replicate 1 or 2) have a cosine above the cut."""
    wide = expression.join(replicates, "sample").groupBy("gene", "tissue").agg(F.avg(F.when(F.col("replicate") == 1, F.col("value"))).alias("x"), F.avg(F.when(F.col("replicate") == 2, F.col("value"))).alias("y"))
    c = F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    return wide.groupBy("gene").agg(c.alias("cosine")).where(F.col("cosine") > cut)


def species_coverage(entities: DataFrame, id_cut: float, distance_cut: float, classes: list[str]) -> DataFrame:
    """Counts for each species (entity, species, class, measured, identity, distance, match, cluster): measured, reached by identity, by distance, by either, by both, for all and each class, with distinct matches and clusters."""
    by_id, by_distance = F.coalesce(F.col("identity") >= id_cut, F.lit(False)), F.coalesce(F.col("distance") <= distance_cut, F.lit(False))
    flags = {"measured": F.col("measured"), "by_identity": by_id, "by_distance": by_distance, "either": by_id | by_distance, "both": by_id & by_distance}
    groups = {"all": F.lit(True)} | {c: F.col("class") == c for c in classes}
    counts = [F.sum((g & f).cast("int")).alias(f"{k}_{n}") for n, g in groups.items() for k, f in {"total": F.lit(True), **flags}.items()]
    distinct = [F.count_distinct(F.when(f, F.col("match"))).alias(f"matches_{k}") for k, f in (("by_identity", by_id), ("by_distance", by_distance))]
    return entities.groupBy("species").agg(*counts, *distinct, F.count_distinct("cluster").alias("clusters"))


def counts_by(df: DataFrame, by: str, *kinds: str) -> DataFrame:
    """Counts at every grouping of the given columns within ``by``; a null kind is a total."""
    sets = [F.col(k) for k in kinds]
    return df.cube(by, *sets).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).where(F.col(by).isNotNull())


def mode(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Commonest value of each group; ties take the first in order."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), column)
    return counts.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def cluster_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    """For each cluster: size, first three names by species rank, modal class, mean identity within (members: cluster, id, species_rank, class)."""
    names = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("species_rank", "id"))), lambda s: s["id"]), 1, 3)
    base = members.groupBy("cluster").agg(F.count("*").alias("size"), names.alias("names"))
    own, other = members.select(F.col("id").alias("a"), "cluster"), members.select(F.col("id").alias("b"), F.col("cluster").alias("to"))
    within = edges.join(own, "a").join(other, "b").where("cluster = to").groupBy("cluster").agg(F.avg("value").alias("mean_identity"))
    return base.join(mode(members, ["cluster"], "class").select("cluster", F.col("class").alias("modal_class")), "cluster").join(within, "cluster", "left")


def distinct_bound(significant: DataFrame, cuts: list[float], space: int) -> DataFrame:
    """cut, n, percent: features with an adjusted p below the cut in one entity at least, of all ``space`` features."""
    least = significant.groupBy("feature").agg(F.min("p_adjusted").alias("p"))
    at = least.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.col("p") < F.col("cut"))
    return at.groupBy("cut").agg(F.count("*").alias("n"), (100.0 * F.count("*") / space).alias("percent"))


def cluster_features(members: DataFrame, features: DataFrame) -> DataFrame:
    """cluster, feature present in any member."""
    return members.join(features, F.col("id") == F.col("entity")).select("cluster", "feature").distinct()


def feature_overlap(features: DataFrame) -> DataFrame:
    """Regions of a Venn diagram: classes (sorted, joined by +), n features found in exactly these classes."""
    classes = features.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("class")), "+").alias("classes"))
    return classes.groupBy("classes").agg(F.count("*").alias("n"))


def target_overlap(sets: DataFrame) -> DataFrame:
    """a < b, common, share of the smaller, Jaccard of sets (set, gene)."""
    s = sets.distinct()
    size = s.groupBy("set").agg(F.count("*").alias("n"))
    met = s.select(F.col("set").alias("a"), "gene").join(s.select(F.col("set").alias("b"), "gene"), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    both = met.join(size.select(F.col("set").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "common", (F.col("common") / F.least("na", "nb")).alias("share"), (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def selectivity(df: DataFrame, by: str, value: str) -> DataFrame:
    """(max - mean) / deviation, skewness and (p95 - p50) / (p50 - p5) of each group's values."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    stats = df.groupBy(by).agg(F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.skewness(value).alias("skewness"), p.alias("p"))
    return stats.select(by, F.when(F.col("sd") > 0, (F.col("most") - F.col("mean")) / F.col("sd")).alias("height"), "skewness", F.try_divide(F.col("p")[2] - F.col("p")[1], F.col("p")[1] - F.col("p")[0]).alias("tail"))


def percentiles(df: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.median(value).alias("median"), F.percentile(value, F.array(*map(F.lit, at))).alias("percentiles"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
