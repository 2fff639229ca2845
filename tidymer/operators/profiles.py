"""Alignment, filters and normalisation of long profiles (entity, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(profile: DataFrame) -> DataFrame:
    """NaN, infinite and null values become 0."""
    v = F.col("value").cast("double")
    return profile.withColumn("value", F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def from_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("entity"), F.posexplode(vector_col).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def to_vectors(profile: DataFrame) -> DataFrame:
    """entity, vec: values in order of feature."""
    return profile.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("vec"))


def align_entities(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both profiles reduced to the entities that they share."""
    return a.join(b.select("entity").distinct(), "entity", "left_semi"), b.join(a.select("entity").distinct(), "entity", "left_semi")


def align_features(profile: DataFrame, features: DataFrame) -> DataFrame:
    """Every entity on exactly the given features; what it lacks is 0."""
    grid = profile.select("entity").distinct().crossJoin(features.select("feature").distinct())
    return grid.join(profile, ["entity", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def common_names(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("entity").distinct()
    for f in frames[1:]:
        out = out.join(f.select("entity"), "entity", "left_semi")
    return out


def subset_entities(profile: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed entities' rows, and the listed names that have none."""
    return profile.join(names, "entity", "left_semi"), names.join(profile, "entity", "left_anti")


def filter_confident(rows: DataFrame, distances: DataFrame, cut: float) -> DataFrame:
    return rows.join(distances.where(F.col("distance") <= cut), "entity", "left_semi")


def filter_max_experiment(rows: DataFrame, id_col: str, most: int, digits: int = 4) -> DataFrame:
    """Rows whose id ends in a number of at most ``most``."""
    return rows.where(F.substring(id_col, -digits, digits).cast("int") <= most)


def drop_zero_features(profile: DataFrame) -> DataFrame:
    return profile.join(profile.groupBy("feature").agg(F.sum("value").alias("s")).where("s > 0"), "feature", "left_semi")


def drop_zero_entities(profile: DataFrame) -> DataFrame:
    return profile.join(profile.groupBy("entity").agg(F.sum("value").alias("s")).where("s > 0"), "entity", "left_semi")


def min_feature_support(profile: DataFrame, least: float) -> DataFrame:
    return profile.join(profile.groupBy("feature").agg(F.sum("value").alias("s")).where(F.col("s") >= least), "feature", "left_semi")


def filter_features(profile: DataFrame, listed: DataFrame) -> DataFrame:
    return profile.join(listed, "feature", "left_semi")


def tfilter_features(profile: DataFrame, response: DataFrame, percentile: float) -> DataFrame:
    """Features whose largest two-sample t (carriers against the others, over all responses) reaches the percentile of all features.

    ``response`` is (entity, response, value). Sums over carriers come from a join on the entity; the others' sums are totals less these.
    """
    totals = response.groupBy("response").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    carried = profile.where("value > 0").select("entity", "feature").join(response, "entity")
    inside = carried.groupBy("feature", "response").agg(F.count("*").alias("n1"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1")).join(totals, "response")
    n2, s2, q2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1"), F.col("q") - F.col("q1")
    m1, m2 = F.col("s1") / F.col("n1"), s2 / n2
    spread = F.greatest((F.col("q1") / F.col("n1") - m1 * m1) / F.col("n1") + (q2 / n2 - m2 * m2) / n2, F.lit(0.0))
    t = inside.where(n2 > 0).select("feature", F.when(spread > 0, (m1 - m2) / F.sqrt(spread)).alias("t"))
    best = t.groupBy("feature").agg(F.max("t").alias("t"))
    cut = best.agg(F.percentile("t", F.lit(percentile)).alias("cut"))
    return best.join(cut, F.col("t") >= F.col("cut")).select("feature", "t")


def binarize(profile: DataFrame) -> DataFrame:
    return profile.withColumn("value", (F.col("value") > 0).cast("double"))


def _top(by: str, n: int) -> Column:
    other = "feature" if by == "entity" else "entity"
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc("value"), other)) <= n


def binarize_top(profile: DataFrame, n: int) -> DataFrame:
    """1 for the n highest entities of each feature, else 0."""
    return profile.withColumn("value", _top("feature", n).cast("double"))


def binarize_significant(profile: DataFrame, share: float) -> DataFrame:
    """1 at or above the quantile of all values that leaves ``share`` of them, else 0."""
    cut = profile.agg(F.percentile("value", F.lit(1 - share)).alias("cut"))
    return profile.join(cut).withColumn("value", (F.col("value") >= F.col("cut")).cast("double")).drop("cut")


def negate(profile: DataFrame) -> DataFrame:
    return profile.withColumn("value", -F.col("value"))


def _over(value: Column, divisor: Column) -> Column:
    return F.when(divisor != 0, value / divisor).otherwise(F.lit(0.0))


def l2_normalize(profile: DataFrame) -> DataFrame:
    return profile.withColumn("value", _over(F.col("value"), F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("entity")))))


def l1_normalize(profile: DataFrame) -> DataFrame:
    return profile.withColumn("value", _over(F.col("value"), F.sum(F.abs("value")).over(Window.partitionBy("entity"))))


def quantile_normalize(profile: DataFrame) -> DataFrame:
    """Each value becomes the mean, over entities, of the values of its rank."""
    ranked = profile.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("value", "feature")))
    means = ranked.groupBy("rank").agg(F.avg("value").alias("mean"))
    return ranked.join(means, "rank").select("entity", "feature", F.col("mean").alias("value"))


def mad_zscore(profile: DataFrame, by: str = "entity") -> DataFrame:
    """(x - mean) / (1.4826 mean|x - mean|); a zero divisor counts as 1."""
    w = Window.partitionBy(by)
    off = profile.withColumn("off", F.col("value") - F.avg("value").over(w))
    spread = 1.4826 * F.avg(F.abs("off")).over(w)
    return off.withColumn("value", F.col("off") / F.when(spread == 0, 1.0).otherwise(spread)).drop("off")


def group_zscore(profile: DataFrame, group: Column) -> DataFrame:
    """(x - mean) / population deviation over all rows of a group, such as k-mers of one length."""
    w = Window.partitionBy("group")
    return profile.withColumn("group", group).withColumn("value", _over(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w))).drop("group")


def log2_fold_of_mean(profile: DataFrame) -> DataFrame:
    """log2(x / mean) by feature, values of 0 or less raised to the least positive one of all."""
    floor = profile.where("value > 0").agg(F.min("value").alias("floor"))
    raised = profile.join(floor).withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(F.col("floor")))
    return raised.withColumn("value", F.log2(F.col("value") / F.avg("value").over(Window.partitionBy("feature")))).drop("floor")


def minmax_scale(profile: DataFrame, by: str = "feature") -> DataFrame:
    w = Window.partitionBy(by)
    low, high = F.min("value").over(w), F.max("value").over(w)
    return profile.withColumn("value", _over(F.col("value") - low, high - low))


def standard_scale(profile: DataFrame, by: str = "feature") -> DataFrame:
    w = Window.partitionBy(by)
    return profile.withColumn("value", _over(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)))


def cut_weights(profile: DataFrame, how: str, cut: float) -> DataFrame:
    """Weights that don't pass become 0.

    ``weight``: value >= cut; ``mean``: value >= cut times the mean; ``top``: among the share ``cut`` of highest values;
    ``centre``: beyond cut deviations from the mean either way; ``significant-top``: at least mean + cut deviations;
    ``significant-centre``: |value| of at least mean + cut deviations of |values|. With ``-each`` these statistics are
    taken within each entity, else over all rows.
    """
    kind, each = how.removesuffix("-each"), how.endswith("-each")
    v, size = F.col("value"), F.abs("value")
    stats = {"m": F.avg("value"), "d": F.stddev_pop("value"), "am": F.avg(size), "ad": F.stddev_pop(size), "q": F.percentile("value", F.lit(1 - cut if kind == "top" else 0.5))}
    table = profile.groupBy("entity").agg(*(e.alias(k) for k, e in stats.items())) if each else profile.agg(*(e.alias(k) for k, e in stats.items()))
    joined = profile.join(table, "entity") if each else profile.join(table)
    passes = {
        "weight": v >= cut,
        "mean": v >= cut * F.col("m"),
        "top": v >= F.col("q"),
        "centre": F.abs(v - F.col("m")) >= cut * F.col("d"),
        "significant-top": v >= F.col("m") + cut * F.col("d"),
        "significant-centre": size >= F.col("am") + cut * F.col("ad"),
    }[kind]
    return joined.select("entity", "feature", F.when(passes, v).otherwise(0.0).alias("value"))


def mask_by_presence(weights: DataFrame, present: DataFrame) -> DataFrame:
    return weights.join(present, ["entity", "feature"], "left_semi")


def clamp_ratio(rows: DataFrame, value: str, ceiling: str) -> DataFrame:
    return rows.withColumn("ratio", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value) / F.col(ceiling))))


def split_by_delim(joined: DataFrame, parts: DataFrame) -> DataFrame:
    """Scores of '*'-joined sequences back to their parts: part k begins after the lengths of the parts before it."""
    at = F.aggregate(F.slice("pieces", 1, F.col("part")), F.lit(0), lambda s, p: s + F.length(p))
    placed = joined.withColumn("pieces", F.split("seq", r"\*")).select("entity", "scores", F.posexplode("pieces").alias("part", "piece"), "pieces")
    cut = placed.select("entity", "part", F.col("piece").alias("seq"), F.slice("scores", at + 1, F.length("piece")).alias("scores"))
    return cut.join(parts, ["entity", "seq"], "left_semi")


def slice_by_substring(parents: DataFrame, parts: DataFrame) -> DataFrame:
    """Aligned arrays of the parent sequence cut to where each part stands in it."""
    met = parents.join(parts.withColumnRenamed("seq", "part_seq"), "entity").withColumn("at", F.expr("instr(seq, part_seq)")).where("at > 0")
    return met.select("entity", F.col("part_seq").alias("seq"), F.col("at").alias("start"), F.slice("scores", F.col("at"), F.length("part_seq")).alias("scores"))
