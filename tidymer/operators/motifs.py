"""Motifs: from k-mers to position weight matrices, their comparison, merging, IUPAC codes and scans of sequences.

A matrix is long: (motif, pos, base, p), pos from 0, one row for each of the four bases.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGU"

#: IUPAC codes of sets of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "AC": "M", "AG": "R", "AU": "W", "CG": "S", "CU": "Y", "GU": "K", "ACG": "V", "ACU": "H", "AGU": "D", "CGU": "B", "ACGU": "N"}
SETS = {code: bases for bases, code in IUPAC.items()}


def align_kmer(kmer: str, seed: str, least: int) -> tuple[int, int]:
    """(identical letters, shift) of the best placing of a k-mer along a seed with at least ``least`` letters in common range; ties take the smaller shift."""
    options = []
    for shift in range(least - len(kmer), len(seed) - least + 1):
        same = sum(kmer[i - shift] == seed[i] for i in range(max(0, shift), min(len(seed), shift + len(kmer))))
        options.append((-same, abs(shift), shift))
    same, _, shift = min(options, default=(0, 0, 0))
    return -same, shift


def build_pwms(top: DataFrame, *, least_kmers: int = 3, least_overlap: int = 4, most_mismatches: int = 1, pseudo: float = 0.0) -> DataFrame:
    """Matrices of each entity's top k-mers (entity, rank, feature, value): the best unused k-mer is a seed; those that align to it with at most
    ``most_mismatches`` in the overlap join it, weighted by value; left-over k-mers begin the next matrix until fewer than ``least_kmers`` remain.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "feature"], ascending=[False, True])
        left, rows, number = list(zip(pdf.feature, pdf.value, strict=True)), [], 0
        while len(left) >= least_kmers or (left and not number):
            seed, placed, rest = left[0][0], [], []
            for kmer, value in left:
                same, shift = align_kmer(kmer, seed, least_overlap)
                common = min(len(seed), shift + len(kmer)) - max(0, shift)
                (placed if common - same <= most_mismatches else rest).append((kmer, value, shift))
            low, high = min(s for *_, s in placed), max(s + len(k) for k, _, s in placed)
            table = np.full((high - low, 4), pseudo)
            for kmer, value, shift in placed:
                for i, c in enumerate(kmer):
                    if c in BASES:
                        table[i + shift - low, BASES.index(c)] += max(value, 0.0)
            total = table.sum(axis=1, keepdims=True)
            table = np.where(total > 0, table / np.where(total > 0, total, 1), 0.25)
            name = f"{pdf.entity.iloc[0]}_{number}"
            rows += [(name, i, b, p, len(placed), float(sum(v for _, v, _ in placed))) for i, line in enumerate(table) for b, p in zip(BASES, line, strict=True)]
            left, number = [(k, v) for k, v, _ in rest], number + 1
        return pd.DataFrame(rows, columns=["motif", "pos", "base", "p", "n_kmers", "score"])

    return top.groupBy("entity").applyInPandas(solve, "motif string, pos int, base string, p double, n_kmers int, score double")


def consensus(pwm: DataFrame, cut: float = 0.5) -> DataFrame:
    """motif, logo: at each position the base above the cut, else N."""
    best = pwm.groupBy("motif", "pos").agg(F.max("p").alias("p"), F.max_by("base", "p").alias("base"))
    letter = F.when(F.col("p") > cut, F.col("base")).otherwise("N")
    return best.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))), lambda s: s["c"]), "").alias("logo"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^N+|N+$", "")


def iupac(pwm: DataFrame, single: float = 0.47, each: float = 0.3, both: float = 0.8) -> DataFrame:
    """motif, iupac: the top base if it reaches ``single`` and the second doesn't reach ``each``; the top two if both reach ``each`` or sum to ``both``; else N. Ends of N are trimmed."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("minus"), "base")))
    ranked = pwm.groupBy("motif", "pos").agg(ordered.alias("o"))
    p = [-F.col("o")[i]["minus"] for i in range(2)]
    two = F.array_join(F.array_sort(F.array(F.col("o")[0]["base"], F.col("o")[1]["base"])), "")
    codes = F.create_map(*(F.lit(x) for kv in IUPAC.items() for x in kv))
    letter = F.when((p[0] >= single) & (p[1] < each), F.col("o")[0]["base"]).when(((p[0] >= each) & (p[1] >= each)) | (p[0] + p[1] >= both), F.element_at(codes, two)).otherwise("N")
    return ranked.groupBy("motif").agg(trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))), lambda s: s["c"]), "")).alias("iupac"))


def iupac_similarity(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``similarity`` of the codes x and y: over all shifts with at least ``least`` letters in common, the largest sum of shared bases over the larger set's size."""
    sets = F.create_map(*(F.lit(x) for kv in SETS.items() for x in kv))

    def one(a: Column, b: Column) -> Column:
        s, t = F.split(F.element_at(sets, a), ""), F.split(F.element_at(sets, b), "")
        return F.size(F.array_intersect(s, t)) / F.greatest(F.size(s), F.size(t))

    n, m = F.length("x"), F.length("y")
    shifts = F.sequence(F.lit(least) - m, n - least)
    start, stop = (lambda k: F.greatest(k, F.lit(0))), (lambda k: F.least(n, k + m))
    score = F.transform(shifts, lambda k: F.aggregate(F.sequence(start(k), stop(k) - 1), F.lit(0.0), lambda acc, i: acc + one(F.substring("x", i + 1, F.lit(1)), F.substring("y", i - k + 1, F.lit(1)))))
    return pairs.withColumn("similarity", F.when(F.least(n, m) >= least, F.array_max(score)).otherwise(0.0))


def symmetric_kl(pwm: DataFrame, floor: float = 1e-3) -> DataFrame:
    """a < b, value: least mean over shifts (half of the shorter at least in common) of the symmetric Kullback-Leibler divergence of aligned positions."""
    smooth = pwm.withColumn("p", (F.col("p") + floor) / (1 + 4 * floor))
    size = smooth.groupBy("motif").agg((F.max("pos") + 1).alias("n"))
    x = smooth.join(size, "motif").select(F.col("motif").alias("a"), F.col("pos").alias("i"), "base", F.col("p").alias("p"), F.col("n").alias("na"))
    y = smooth.join(size, "motif").select(F.col("motif").alias("b"), F.col("pos").alias("j"), "base", F.col("p").alias("q"), F.col("n").alias("nb"))
    met = x.join(y, "base").where("a < b").withColumn("shift", F.col("i") - F.col("j"))
    d = (F.col("p") - F.col("q")) * F.log2(F.col("p") / F.col("q"))
    at = met.groupBy("a", "b", "shift").agg((F.sum(d) / (F.count("*") / 4)).alias("d"), (F.count("*") / 4).alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return at.where(F.col("common") * 2 >= F.least("na", "nb")).groupBy("a", "b").agg(F.min("d").alias("value"), F.min_by("shift", "d").alias("shift"))


def merge_pwms(pwm: DataFrame, members: DataFrame, shifts: DataFrame) -> DataFrame:
    """One matrix for each cluster: its members' mean after moving each by its shift along the cluster's centre."""
    placed = pwm.join(members, "motif").join(shifts, "motif", "left").withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0)))
    low = F.min("pos").over(Window.partitionBy("cluster"))
    mean = placed.withColumn("pos", F.col("pos") - low).groupBy("cluster", "pos", "base").agg(F.avg("p").alias("p"))
    return mean.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("cluster", "pos"))).withColumnRenamed("cluster", "motif")


def scan(seqs: DataFrame, pwm: DataFrame, mode: str = "sum", cut: float = 0.0) -> DataFrame:
    """entity, motif, score: over all windows the product of p / (row's maximum); ``sum`` of those of at least ``cut``, or ``max``; 0 for sequences shorter than the matrix.

    Matrices are rows of a few hundred numbers; each sequence meets each matrix once and its windows stay inside the row.
    """
    scaled = pwm.withColumn("s", F.col("p") / F.max("p").over(Window.partitionBy("motif", "pos")))
    lines = scaled.groupBy("motif", "pos").agg(F.map_from_entries(F.collect_list(F.struct("base", "s"))).alias("line"))
    tables = lines.groupBy("motif").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.map_entries("line").alias("line")))), lambda r: F.map_from_entries(r["line"])).alias("rows"))
    met = seqs.select("entity", F.split("seq", "").alias("letters")).crossJoin(F.broadcast(tables))  # one row for each matrix
    width = F.size("rows")
    last = F.size("letters") - width

    def product(start: Column) -> Column:
        factor = F.zip_with(F.slice("letters", start + 1, width), F.col("rows"), lambda c, line: F.coalesce(F.try_element_at(line, c), F.lit(0.0)))
        return F.aggregate(factor, F.lit(1.0), lambda a, f: a * f)

    scores = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), product)).otherwise(F.array().cast("array<double>"))
    value = F.coalesce(F.array_max("scores"), F.lit(0.0)) if mode == "max" else F.aggregate(F.filter("scores", lambda s: s >= cut), F.lit(0.0), lambda a, s: a + s)
    return met.withColumn("scores", scores).select("entity", "motif", value.alias("score"))


def shuffle_sequence(seqs: DataFrame, seed: int) -> DataFrame:
    """Each sequence's letters in an order fixed by the seed."""
    letters = F.transform(F.split("seq", ""), lambda c, i: F.struct(F.xxhash64("entity", i, F.lit(seed)).alias("k"), c.alias("c")))
    return seqs.withColumn("seq", F.array_join(F.transform(F.array_sort(letters), lambda s: s["c"]), ""))


def interface_templates(pairs: DataFrame, least_identity: float, least_motif: float, combine: float = 70.0) -> DataFrame:
    """For each query its best template by identity then motif similarity, and the others that pass both cuts and are at least ``combine`` % identical."""
    fit = pairs.where((F.col("identity") >= least_identity) & (F.col("motif_similarity") >= least_motif))
    w = Window.partitionBy("query").orderBy(F.desc("identity"), F.desc("motif_similarity"), "template")
    return fit.withColumn("rank", F.row_number().over(w)).where((F.col("rank") == 1) | (F.col("identity") >= combine))
