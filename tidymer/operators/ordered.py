"""Ranks, top-k, curves over score order and other window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """0-based rank in ascending order, ties by ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) - 1)


def midrank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Ranks from 1 whose ties share their mean."""
    mid = F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0
    return df.withColumn("midrank", mid)


def weighted_midrank(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Cumulative weight before the ties plus half of the ties' weight and a half."""
    upto = F.sum(weight).over(Window.partitionBy(*by).orderBy(value))
    tied = F.sum(weight).over(Window.partitionBy(*by, value))
    return df.withColumn("midrank", upto - tied + (tied + 1) / 2.0)


def topk(profile: DataFrame, how: str, cut: float) -> DataFrame:
    """Rows of each entity with their rank: the ``cut`` highest (``top``), the highest percent (``toppercent``), values of at least ``cut`` (``threshold``) or of ``cut`` times the maximum (``relative``)."""
    w = Window.partitionBy("entity")
    ranked = profile.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("value"), "feature")), "n": F.count("*").over(w), "most": F.max("value").over(w)})
    keep = {"top": F.col("rank") <= cut, "toppercent": F.col("rank") <= F.ceil(F.col("n") * cut / 100), "threshold": F.col("value") >= cut, "relative": F.col("value") >= cut * F.col("most")}[how]
    return ranked.where(keep).select("entity", "rank", "feature", "value")


def _score_order(by: list[str], score: str, tie: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc(score), tie)


def precision_curve(df: DataFrame, by: list[str], score: str, tie: str, realised: str) -> DataFrame:
    """Running mean of what was realised in order of falling score, its standard-error band, and recall by the total and by n + 1."""
    w = _score_order(by, score, tie)
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    n = F.row_number().over(w)
    band = F.when(n > 1, F.stddev_pop(realised).over(upto) / F.sqrt((n - 1).cast("double")))
    return df.withColumns({
        "rank": n, "precision": F.avg(realised).over(upto), "sem": band,
        "recall": F.sum(realised).over(upto) / F.nullif(F.sum(realised).over(whole), F.lit(0)), "recall_n": F.sum(realised).over(upto) / (F.count("*").over(whole) + 1),
    })


def trailing_mean(df: DataFrame, by: list[str], score: str, tie: str, realised: str, width: int = 25, least: int = 5) -> DataFrame:
    """Mean over the row and the ``width`` before it in score order, from the ``least``-th row on; earlier rows take the mean of the first ``least``."""
    w = _score_order(by, score, tie)
    n = F.row_number().over(w)
    head = F.avg(F.when(F.col("rank") <= least, F.col(realised))).over(Window.partitionBy(*by))
    return df.withColumn("rank", n).withColumn("trailing", F.when(F.col("rank") < least, head).otherwise(F.avg(realised).over(w.rowsBetween(-width, 0))))


def smoothed_precision(df: DataFrame, by: list[str], score: str, tie: str, realised: str, width: int = 300, stride: int = 20) -> DataFrame:
    """Centred moving mean in score order, one row every ``stride`` rows."""
    w = _score_order(by, score, tie)
    return df.withColumns({"rank": F.row_number().over(w), "smoothed": F.avg(realised).over(w.rowsBetween(-width // 2, width // 2 - 1))}).where((F.col("rank") - 1) % stride == 0)


def score_at_cut(curve: DataFrame, by: list[str], score: str, cut: float) -> DataFrame:
    """Score and rank of the last row whose precision reaches the cut."""
    return curve.where(F.col("precision") >= cut).groupBy(*by).agg(F.max_by(score, "rank").alias("score"), F.max("rank").alias("rank"))


def neighbour_score(df: DataFrame, by: list[str], order: str, value: str, reach: int, share: float) -> DataFrame:
    """(1 - share) times the mean of the neighbours that are not negative plus share times the value; the ends stay."""
    w = Window.partitionBy(*by).orderBy(order)
    around = w.rowsBetween(-reach, reach)
    n, s = F.sum(F.when(F.col(value) >= 0, 1).otherwise(0)).over(around), F.sum(F.when(F.col(value) >= 0, F.col(value)).otherwise(0.0)).over(around)
    own = F.when(F.col(value) >= 0, F.col(value)).otherwise(0.0)
    m = n - F.when(F.col(value) >= 0, 1).otherwise(0)
    inner = (F.row_number().over(w) > reach) & (F.row_number().over(w) <= F.count("*").over(Window.partitionBy(*by)) - reach)
    return df.withColumn("smoothed", F.when(inner & (F.col(value) >= 0) & (m > 0), (1 - share) * (s - own) / m + share * F.col(value)).otherwise(F.col(value)))


def overlapping_quantiles(df: DataFrame, by: list[str], value: str, tie: str, parts: int = 16, width: int = 2) -> DataFrame:
    """Rows dealt to windows of ``width`` neighbouring quantile parts, window b holding parts b..b+width-1."""
    part = F.ntile(parts).over(Window.partitionBy(*by).orderBy(value, tie))
    bins = F.sequence(F.greatest(F.col("part") - width + 1, F.lit(1)), F.least(F.col("part"), F.lit(parts - width + 1)))
    return df.withColumn("part", part).withColumn("bin", F.explode(bins))


def cdf_gap(df: DataFrame, by: list[str], score: str, marked: str) -> DataFrame:
    """Score at which the cumulative shares of marked and other rows differ most (the least of equals), and the difference."""
    at = df.groupBy(*by, score).agg(F.sum(F.col(marked).cast("int")).alias("m"), F.count("*").alias("n"))
    w, whole = Window.partitionBy(*by).orderBy(score), Window.partitionBy(*by)
    inside, outside = F.sum("m").over(w) / F.nullif(F.sum("m").over(whole), F.lit(0)), F.sum(F.col("n") - F.col("m")).over(w) / F.nullif(F.sum(F.col("n") - F.col("m")).over(whole), F.lit(0))
    gaps = at.withColumn("gap", F.abs(inside - outside))
    best = gaps.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gap"), score)))
    return best.where("place = 1").select(*by, score, "gap")


def share_within(df: DataFrame, by: list[str], value: str, cut: float) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(value) <= cut).cast("double")).alias("share"))


def growth_of_cover(df: DataFrame, orders: list[str], order: str, feature: str) -> DataFrame:
    """Distinct features covered after each step of each order (species accumulation): a feature counts where it is first seen."""
    first = df.groupBy(*orders, feature).agg(F.min(order).alias(order))
    new = first.groupBy(*orders, order).agg(F.count("*").alias("new"))
    steps = df.select(*orders, order).distinct().join(new, [*orders, order], "left")
    return steps.withColumn("covered", F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(*orders).orderBy(order))).select(*orders, order, "covered")


def bucket(value: Column | str, low: float, high: float, parts: int) -> Column:
    """Number from 1 of the bin [lo, hi) that holds a value; 0 and parts + 1 lie outside."""
    v = F.col(value) if isinstance(value, str) else value
    return F.least(F.greatest(F.floor((v - low) / (high - low) * parts) + 1, F.lit(0)), F.lit(parts + 1)).cast("int")
