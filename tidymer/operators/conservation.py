"""Column conservation of multiple alignments (seq_id, pos, aa), with sequence weights, gap penalty and neighbour smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMINO = "ARNDCQEGHILKMFPSTWYV"

#: Background frequencies of BLOSUM62, in the order of AMINO.
BACKGROUND = [0.078, 0.051, 0.041, 0.052, 0.024, 0.034, 0.059, 0.083, 0.025, 0.062, 0.092, 0.056, 0.024, 0.044, 0.043, 0.059, 0.055, 0.014, 0.034, 0.072]

#: Groups of amino acids by property.
PROPERTIES = ["VLIM", "FWY", "ST", "NQ", "HKR", "DE", "AG", "P", "C"]

PSEUDO = 1e-7


def henikoff_weights(msa: DataFrame) -> DataFrame:
    """seq_id, weight: the mean over columns of 1 / (distinct letters x sequences with the letter); gaps count as a letter."""
    letters = msa.groupBy("pos").agg(F.count_distinct("aa").alias("k"))
    same = msa.groupBy("pos", "aa").agg(F.count("*").alias("n"))
    return msa.join(letters, "pos").join(same, ["pos", "aa"]).groupBy("seq_id").agg(F.avg(1.0 / (F.col("k") * F.col("n"))).alias("weight"))


def column_frequencies(msa: DataFrame, weights: DataFrame) -> DataFrame:
    """pos, aa, f (weighted share among letters, every amino acid with a pseudocount) and gap (weighted share of gaps)."""
    met = msa.join(weights, "seq_id")
    totals = met.groupBy("pos").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("aa") == "-", F.col("weight")).otherwise(0.0)).alias("g"))
    seen = met.where("aa <> '-'").groupBy("pos", "aa").agg(F.sum("weight").alias("s"))
    grid = totals.withColumn("aa", F.explode(F.array(*map(F.lit, AMINO))))
    counted = grid.join(seen, ["pos", "aa"], "left").withColumn("c", F.coalesce("s", F.lit(0.0)) + PSEUDO)
    return counted.select("pos", "aa", (F.col("c") / F.sum("c").over(Window.partitionBy("pos"))).alias("f"), (F.col("g") / F.col("w")).alias("gap"))


def _background(spark) -> DataFrame:
    return spark.createDataFrame([(a, b / sum(BACKGROUND)) for a, b in zip(AMINO, BACKGROUND, strict=True)], "aa string, q double")


def _entropy(f: Column) -> Column:
    return -F.sum(F.when(f > 0, f * F.log(f)).otherwise(0.0))


def conservation(msa: DataFrame, how: str = "js_divergence", *, gap_penalty: bool = True, gap_cut: float = 0.3) -> DataFrame:
    """pos, score (higher: more conserved): shannon, property_entropy, property_relative, relative_entropy, js_divergence, von_neumann or sum_of_pairs.

    Columns with more gaps than ``gap_cut`` score -1000; the penalty multiplies by the share without gaps.
    """
    spark = msa.sparkSession
    weights = henikoff_weights(msa)
    freq = column_frequencies(msa, weights)
    f, q = F.col("f"), F.col("q")
    groups = F.broadcast(spark.createDataFrame([(a, i) for i, g in enumerate(PROPERTIES) for a in g], "aa string, property int"))
    back = F.broadcast(_background(spark))
    if how in ("property_entropy", "property_relative"):
        part = freq.join(groups, "aa").join(back, "aa").groupBy("pos", "property").agg(F.sum("f").alias("f"), F.sum("q").alias("q"), F.max("gap").alias("gap"))
        score = 1 - _entropy(f) / float(np.log(len(PROPERTIES))) if how == "property_entropy" else F.sum(F.when(f > 0, f * F.log(f / q)).otherwise(0.0))
    elif how in ("von_neumann", "sum_of_pairs"):
        from .alignment import substitution_scores

        table = substitution_scores()
        sim = np.array([[table[a, b] for b in AMINO] for a in AMINO], float)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            p = pdf.set_index("aa").f.reindex(list(AMINO)).to_numpy()
            if how == "sum_of_pairs":
                value = float(p @ sim @ p)
            else:
                density = np.diag(p) @ sim / np.trace(np.diag(p) @ sim)
                values = np.abs(np.linalg.eigvals(density))
                value = 1 + float(sum(v * np.log(v) for v in values if v > 0)) / np.log(len(AMINO))
            return pd.DataFrame({"pos": [pdf.pos.iloc[0]], "score": [value], "gap": [pdf.gap.iloc[0]]})

        out = freq.groupBy("pos").applyInPandas(solve, f"pos {msa.schema['pos'].dataType.simpleString()}, score double, gap double")
        return _gapped(out, gap_penalty, gap_cut)
    else:
        part = freq.join(back, "aa")
        m = (f + q) / 2
        score = {
            "shannon": 1 - _entropy(f) / float(np.log(len(AMINO))),
            "relative_entropy": F.sum(F.when(f > 0, f * F.log(f / q)).otherwise(0.0)),
            "js_divergence": F.sum(F.when(f > 0, f * F.log2(f / m)).otherwise(0.0) + q * F.log2(q / m)) / 2,
        }[how]
    return _gapped(part.groupBy("pos").agg(score.alias("score"), F.max("gap").alias("gap")), gap_penalty, gap_cut)


def _gapped(scores: DataFrame, penalty: bool, cut: float) -> DataFrame:
    value = F.col("score") * (1 - F.col("gap")) if penalty else F.col("score")
    return scores.select("pos", F.when(F.col("gap") > cut, -1000.0).otherwise(value).alias("score"))


def score_z(scores: DataFrame) -> DataFrame:
    """Scores in deviations from the mean of those above -999."""
    fit = F.when(F.col("score") > -999, F.col("score"))
    stats = scores.agg(F.avg(fit).alias("m"), F.stddev_pop(fit).alias("d"))
    return scores.join(stats).select("pos", F.when((F.col("score") > -999) & (F.col("d") > 0), (F.col("score") - F.col("m")) / F.col("d")).otherwise(F.lit(-1000.0)).alias("score"))


def pssm(homologs: DataFrame, identities: DataFrame, cut: float = 0.8) -> DataFrame:
    """pos, aa, p: column frequencies weighted by 1 / (2 + other homologs at least ``cut`` identical), with a prior of the sum of all weights over the number of letters.

    The weighted counts of a column are divided by the sum of all weights before the prior is added, and columns are normalised. Gaps count in no letter."""
    both = identities.select("a", "b", "value").union(identities.select("b", "a", "value"))
    close = both.where(F.col("value") >= cut).groupBy(F.col("a").alias("seq_id")).agg(F.count("*").alias("n"))
    weight = homologs.select("seq_id").distinct().join(close, "seq_id", "left").select("seq_id", (1.0 / (2 + F.coalesce("n", F.lit(0)))).alias("weight"))
    all_weights = weight.agg(F.sum("weight").alias("m"))
    seen = homologs.where("aa <> '-'").join(weight, "seq_id").groupBy("pos", "aa").agg(F.sum("weight").alias("s"))
    grid = homologs.select("pos").distinct().withColumn("aa", F.explode(F.array(*map(F.lit, AMINO)))).crossJoin(F.broadcast(all_weights))  # one row
    counted = grid.join(seen, ["pos", "aa"], "left").withColumn("c", F.coalesce("s", F.lit(0.0)) / F.col("m") + F.col("m") / len(AMINO))
    return counted.select("pos", "aa", (F.col("c") / F.sum("c").over(Window.partitionBy("pos"))).alias("p"))


def pssm_sigmoid(p: DataFrame) -> DataFrame:
    return p.withColumn("p", 1 / (1 + F.exp(-F.col("p"))))


def pssm_information(p: DataFrame) -> DataFrame:
    """p ln(p x number of letters), at least 0."""
    return p.withColumn("p", F.greatest(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") * len(AMINO))).otherwise(0.0), F.lit(0.0)))
