"""K-mer features, compositions, identities and annotations of sequences (entity, part, seq)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_of(seq: Column | str, k: Column | int) -> Column:
    """All substrings of length k in order, as an array."""
    s, k = (F.col(seq) if isinstance(seq, str) else seq), (F.lit(k) if isinstance(k, int) else k)
    last = F.length(s) - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))


#: Letters of a sequence that are cut into windows together, and of the longer pieces that sequences are cut into first.
CHUNK, PIECE = 256, 1 << 16


def chunks(seqs: DataFrame, k: int) -> DataFrame:
    """Sequences as pieces of ``CHUNK`` letters, each with the k - 1 letters after it: every window of k letters begins in exactly one of them.

    Letters are addressed from the beginning of a string, so that windows of whole long texts would take quadratic time."""

    def cut(df: DataFrame, size: int) -> DataFrame:
        last = F.floor(F.greatest(F.length("seq") - k, F.lit(0)) / size).cast("int")
        return df.withColumn("seq", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("seq", i * size + 1, F.lit(size + k - 1)))))

    return cut(cut(seqs, PIECE), CHUNK)


def _windows(seqs: DataFrame, k: int) -> DataFrame:
    return chunks(seqs, k).select("entity", F.explode(windows_of("seq", k)).alias("feature"))


def _counted(rows: DataFrame, pieces: Column) -> DataFrame:
    return rows.select("entity", F.explode(pieces).alias("feature")).groupBy("entity", "feature").agg(F.count("*").alias("value"))


def kmers(seqs: DataFrame, k: int, start: int | None = None) -> DataFrame:
    """Counts of all k-mers (of lengths ``start``..k) over all parts of an entity; no k-mer bridges two parts."""
    lengths = range(k if start is None else start, k + 1)
    return reduce(DataFrame.unionByName, (_windows(seqs, n) for n in lengths)).groupBy("entity", "feature").agg(F.count("*").alias("value"))


#: Letters made into windows at a time, entities of a task whose ASCII 3-mers are held at once, and 3-mers handed on at a time.
LETTERS, HELD, ROWS = 1 << 20, 64, 1 << 16


def distinct_3mers(seqs: DataFrame) -> DataFrame:
    """entity, feature: all distinct 3-mers of an entity (null is one too). A task passes on each that it meets once, but for those that it can't hold, not every window."""
    kind = seqs.schema["entity"].dataType.simpleString()
    narrow, wide = (np.int64(1) << 14, np.int64(1) << 7), (np.int64(1) << 42, np.int64(1) << 21)  # 7 and 21 bits a letter

    def spelt(entity, keys: np.ndarray, bits: int, type_: pa.DataType) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(keys), ROWS):
            part, mask = keys[low : low + ROWS], (1 << bits) - 1
            letters = np.stack([part >> 2 * bits, part >> bits & mask, part & mask], axis=1).astype("<u4")
            text = letters.tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_pydict({"entity": pa.array([entity] * len(part), type_), "feature": [text[i : i + 3] for i in range(0, len(text), 3)]})

    def windows(texts: list[str]) -> Iterator[np.ndarray]:
        """Starts and letters of windows inside a text, of some texts or pieces of a long one at a time."""
        held, size = [], 0
        for text in texts:
            for low in range(0, max(len(text) - 2, 0), LETTERS):
                held.append(text[low : low + LETTERS + 2])
                size += len(held[-1])
                if size >= LETTERS:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rare, type_ = {}, {}, None
        for x in batches:
            type_, by = x.column(0).type, {}
            for entity, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                by.setdefault(entity, []).append(text or "")
            for entity, texts in by.items():
                if entity not in seen and len(seen) >= HELD:
                    for e in seen:
                        yield from spelt(e, np.flatnonzero(seen[e]), 7, type_)
                        yield from spelt(e, rare[e], 21, type_)
                    seen, rare = {}, {}
                marks = seen.setdefault(entity, np.zeros(1 << 21, bool))
                others = [rare.get(entity, np.empty(0, np.int64))]
                for letters, inside in windows(texts):
                    a, b, c = letters[:-2], letters[1:-1], letters[2:]
                    ascii_ = (a | b | c) < 128
                    fit = inside & ascii_
                    marks[a[fit] * narrow[0] + b[fit] * narrow[1] + c[fit]] = True
                    fit = inside & ~ascii_
                    others.append(np.unique(a[fit] * wide[0] + b[fit] * wide[1] + c[fit]))
                rare[entity] = np.unique(np.concatenate(others))
                if len(rare[entity]) > LETTERS:
                    yield from spelt(entity, rare[entity], 21, type_)
                    rare[entity] = rare[entity][:0]
        for e in seen:
            yield from spelt(e, np.flatnonzero(seen[e]), 7, type_)
            yield from spelt(e, rare[e], 21, type_)

    return seqs.select("entity", "seq").mapInArrow(found, f"entity {kind}, feature string").distinct()


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts as numbers one after the other, and whether the window of three that begins at each (but the last two) lies inside a text."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    inside = np.ones(len(letters), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return letters, inside[:-2]


def _masked(seqs: DataFrame, k: int, masks: list[tuple[int, ...]], fill: str) -> DataFrame:
    """Windows of k letters in which each mask's positions become ``fill``."""

    def apply(w: Column, mask: tuple[int, ...]) -> Column:
        cuts = [(a, b) for a, b in itertools.pairwise([-1, *mask, k]) if b - a > 1 or fill]
        pieces = [F.substring(w, a + 2, b - a - 1) for a, b in cuts]
        return F.array_join(F.array(*pieces), fill)

    pieces = F.flatten(F.transform(windows_of("seq", k), lambda w: F.array(*(apply(w, m) for m in masks))))
    return _counted(chunks(seqs, k), pieces)


def gapped_kmers(seqs: DataFrame, k: int, gap: int, centre: int | None = None) -> DataFrame:
    """Windows of k letters without a block of ``gap`` letters, after position 1..k-gap-1 or after ``centre`` only."""
    places = range(1, k - gap) if centre is None else [centre]
    return _masked(seqs, k, [tuple(range(p, p + gap)) for p in places], "")


def mismatch_kmers(seqs: DataFrame, k: int, gaps: int) -> DataFrame:
    """Windows of k letters without any ``gaps`` positions; dropping the last ones is the same as a shorter window, so masks keep the last letter."""
    return _masked(seqs, k, list(itertools.combinations(range(k - 1), gaps)), "")


def posmismatch_kmers(seqs: DataFrame, k: int, gaps: int) -> DataFrame:
    """Windows of k letters with ``gaps`` interior positions as X; the first and last letter stay."""
    return _masked(seqs, k, list(itertools.combinations(range(1, k - 1), gaps)), "X")


def smoothed_kmers(counts: DataFrame, similar: DataFrame, max_differences: int, how: str = "none") -> DataFrame:
    """Weights of k-mers shared with all k-mers that differ in at most ``max_differences`` letters.

    ``similar`` is (a, b, score) for letters. A pair's weight is the mean of its letter scores relative to the k-mer's own
    (``linear``), its square (``quadratic``), exp(-(1-s)^2) (``gauss``), log2(1+s) (``log``) or s as it is (``none``). Candidates
    share one of ``max_differences`` + 1 disjoint pieces at its place, so only k-mers that can qualify meet.
    """
    pieces = max_differences + 1
    n = F.length("feature")

    def blocks(name: str) -> Column:
        cut = [F.floor(n * i / pieces).cast("int") for i in range(pieces + 1)]
        return F.array(*(F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring("feature", cut[i] + 1, cut[i + 1] - cut[i]).alias("s")) for i in range(pieces))).alias(name)

    names = counts.select("feature").distinct()
    left = names.select(F.col("feature").alias("x"), F.explode(blocks("b")).alias("b"))
    right = left.select(F.col("x").alias("y"), "b")
    pairs = left.join(right, "b").select("x", "y").distinct()
    letters = pairs.select("x", "y", F.posexplode(F.split("x", "")).alias("i", "a")).withColumn("b", F.substring(F.col("y"), F.col("i") + 1, F.lit(1)))
    scored = letters.join(similar, ["a", "b"]).join(similar.where("a = b").select("a", F.col("score").alias("own")), "a")
    score = scored.groupBy("x", "y").agg((F.sum("score") / F.sum("own")).alias("s"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("d")).where(F.col("d") <= max_differences)
    s = F.greatest(F.col("s"), F.lit(0.0))
    weight = {"none": F.col("s"), "linear": s, "quadratic": s * s, "gauss": F.exp(-(1 - F.col("s")) * (1 - F.col("s"))), "log": F.log2(1 + s)}[how]
    return counts.join(score.select(F.col("x").alias("feature"), "y", weight.alias("w")), "feature").groupBy("entity", F.col("y").alias("feature")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def composition(seqs: DataFrame, k: int) -> DataFrame:
    """Counts of the sorted distinct letters of every window."""
    return _counted(seqs, F.transform(windows_of("seq", k), lambda w: F.array_join(F.array_sort(F.array_distinct(F.split(w, ""))), "")))


def reduced_alphabet(seqs: DataFrame, letters: str, onto: str) -> DataFrame:
    return seqs.withColumn("seq", F.translate("seq", letters, onto))


def ortholog_kmers(homologs: DataFrame, k: int, weight: str = "distinct") -> DataFrame:
    """K-mers over aligned homologs (entity, part, member, seq): each place shares a weight of 1 among its distinct k-mers, or gives 1 each, or shares by count."""
    placed = homologs.select("entity", "part", F.posexplode(windows_of("seq", k)).alias("pos", "feature")).where(~F.col("feature").contains("-"))
    at = placed.groupBy("entity", "part", "pos", "feature").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity", "part", "pos")
    share = {"distinct": 1 / F.count("*").over(w), "one": F.lit(1.0), "count": F.col("n") / F.sum("n").over(w)}[weight]
    return at.withColumn("w", share).groupBy("entity", "feature").agg(F.sum("w").alias("value"))


def score_weighted_kmers(scored: DataFrame, k: int, how: str = "max") -> DataFrame:
    """K-mers of (entity, part, seq, scores) summed over the maximum, mean or sum of the scores that each covers."""
    at = scored.select("entity", "scores", F.posexplode(windows_of("seq", k)).alias("pos", "feature"))
    cut = F.slice("scores", F.col("pos") + 1, k)
    added = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x)
    value = {"max": F.array_max(cut), "mean": added / k, "sum": added}[how]
    return at.select("entity", "feature", value.alias("v")).groupBy("entity", "feature").agg(F.sum("v").alias("value"))


def drop_gap_kmers(profile: DataFrame, gaps: str = "-.") -> DataFrame:
    return profile.where(reduce(lambda a, g: a & ~F.col("feature").contains(g), gaps, F.lit(True)))


def subkmer_design(names: DataFrame, longest: int) -> DataFrame:
    """For each k-mer (feature) its distinct substrings of 1..longest letters, scaled so that each substring's column has length 1."""
    subs = names.select("feature", F.explode(F.array_distinct(F.flatten(F.array(*(windows_of("feature", n) for n in range(1, longest + 1)))))).alias("sub"))
    return subs.withColumn("value", 1 / F.sqrt(F.count("*").over(Window.partitionBy("sub"))))


def kmer_to_sequence(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    """(entity, part, pos, aa, value): each residue sums the weights (feature, value) of the k-mers over it; an X in a k-mer matches any residue but is not given weight."""
    shapes = weights.select(F.length("feature").alias("k"), F.array_join(F.transform(F.split("feature", ""), lambda c: F.when(c == "X", "X").otherwise("o")), "").alias("shape")).distinct()
    met = seqs.join(F.broadcast(shapes))  # a few shapes for each k-mer length
    placed = met.select("entity", "part", "shape", F.posexplode(windows_of("seq", F.col("k"))).alias("start", "w"))
    masked = F.array_join(F.zip_with(F.split("w", ""), F.split("shape", ""), lambda a, s: F.when(s == "X", "X").otherwise(a)), "")
    hit = placed.withColumn("feature", masked).join(weights, "feature")
    spread = hit.select("entity", "part", "start", "value", F.posexplode(F.split("feature", "")).alias("i", "c")).where("c <> 'X'")
    sums = spread.groupBy("entity", "part", (F.col("start") + F.col("i")).alias("pos")).agg(F.sum("value").alias("value"))
    letters = seqs.select("entity", "part", F.posexplode(F.split("seq", "")).alias("pos", "aa")).where("aa <> ''")
    return letters.join(sums, ["entity", "part", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def equal_positions(a: Column | str, b: Column | str, gaps: str = "") -> Column:
    """Positions with equal letters (gap letters never count)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) & (x != "") & ~F.lit(gaps).contains(x) if gaps else (x == y) & (x != ""), 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def hamming_identity(a: Column | str, b: Column | str, gaps: str = "") -> Column:
    """Share of equal positions; with ``gaps``, of positions where neither has a gap."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if gaps:
        both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x != "") & ~F.lit(gaps).contains(x) & ~F.lit(gaps).contains(y), 1).otherwise(0))
        size = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    else:
        size = F.greatest(F.length(a), F.length(b))
    return F.when(size > 0, equal_positions(a, b, gaps) / size).otherwise(0.0)


def fuse_intervals(rows: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Intervals (start, end) of a group that overlap or lie within ``gap`` become one (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


#: Shares of an entity's sequences that are compared with all of them by themselves.
SHARES = 16


def identity_of_pairs(seqs: DataFrame) -> DataFrame:
    """a < b, identity of all pairs of parts of an entity (entity, part, seq). Equal sequences are compared once, in one order; their parts meet where that is done, so no pair is shuffled."""
    own = seqs.where("seq IS NOT NULL").groupBy("entity", "seq").agg(F.collect_list("part").alias("parts"))
    first = own.select("entity", F.col("seq").alias("x"), F.col("parts").alias("a"), F.pmod(F.xxhash64("seq"), F.lit(SHARES)).cast("int").alias("share"))
    other = own.select("entity", F.col("seq").alias("y"), F.col("parts").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    first, other = (side.repartition(SHARES * SHARES, "entity", "share") for side in (first, other))
    met = first.join(other.hint("merge"), ["entity", "share"]).where("x <= y")  # the parts stay in their task, and so does what becomes of them
    compared = met.select("a", "b", hamming_identity("x", "y").alias("identity"), (F.col("x") == F.col("y")).alias("same"))
    pairs = compared.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).where("a < b OR (a > b AND NOT same)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "identity")


def extend_intervals(rows: DataFrame, by: list[str], flank: int, length: str, tie: str | None = None) -> DataFrame:
    """Intervals with ``flank`` more positions on either side, stopped by their neighbours and the sequence's ends. ``tie`` orders equal intervals; those without a place come last."""
    w = Window.partitionBy(*by).orderBy(*(F.asc_nulls_last(c) for c in ("start", "end", *([tie] if tie else []))))
    low = F.greatest(F.col("start") - flank, F.coalesce(F.lag("end").over(w) + 1, F.lit(1)))
    high = F.least(F.col("end") + flank, F.coalesce(F.lead("start").over(w) - 1, F.col(length)))
    return rows.withColumns({"start": low, "end": high})


def runs(rows: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Maximal runs of one state in order: group, state, first, last, n."""
    w = Window.partitionBy(*by).orderBy(order)
    inside = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, state).orderBy(order))
    return rows.withColumn("run", inside).groupBy(*by, state, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def combine_parts(parts: DataFrame) -> DataFrame:
    """Parts of an entity joined in order of their index."""
    return parts.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq"))), lambda s: s["seq"]), "").alias("seq"))


def one_hot(seqs: DataFrame) -> DataFrame:
    """(entity, part, pos, aa, value = 1): the sparse form of a 0/1 column per letter."""
    return seqs.select("entity", "part", F.posexplode(F.split("seq", "")).alias("pos", "aa")).where("aa <> ''").withColumn("value", F.lit(1))


#: Hydrophobicity, hydrophilicity, hydrogen bonds, side-chain volume, polarity, polarizability, solvent-accessible surface, net charge index, mass.
PHYSCHEM = """
A 0.62 -0.5 2 27.5 8.1 0.046 1.181 0.007187 71.0788
C 0.29 -1 2 44.6 5.5 0.128 1.461 -0.03661 103.1388
D -0.9 3 4 40 13 0.105 1.587 -0.02382 115.0886
E -0.74 3 4 62 12.3 0.151 1.862 0.006802 129.1155
F 1.19 -2.5 2 115.5 5.2 0.29 2.228 0.037552 147.1766
G 0.48 0 2 0 9 0 0.881 0.179052 57.0519
H -0.4 -0.5 4 79 10.4 0.23 2.025 -0.01069 137.1411
I 1.38 -1.8 2 93.5 5.2 0.186 1.81 0.021631 113.1594
K -1.5 3 2 100 11.3 0.219 2.258 0.017708 128.1741
L 1.06 -1.8 2 93.5 4.9 0.186 1.931 0.051672 113.1594
M 0.64 -1.3 2 94.1 5.7 0.221 2.034 0.002683 131.1986
N -0.78 2 4 58.7 11.6 0.134 1.655 0.005392 114.1039
P 0.12 0 2 41.9 8 0.131 1.468 0.239531 97.1167
Q -0.85 0.2 4 80.7 10.5 0.18 1.932 0.049211 128.1307
R -2.53 3 4 105 10.5 0.18 1.932 0.049211 156.1875
S -0.18 0.3 4 29.3 9.2 0.062 1.298 0.004627 87.0782
T -0.05 -0.4 4 51.3 8.6 0.108 1.525 0.003352 101.1051
V 1.08 -1.5 2 71.5 5.9 0.14 1.645 0.057004 99.1326
W 0.81 -3.4 3 145.5 5.4 0.409 2.663 0.037977 186.2132
Y 0.26 -2.3 3 117.3 6.2 0.298 2.368 0.023599 163.1760
"""


def physchem(residues: DataFrame) -> DataFrame:
    """Residues with their nine properties as an array; letters without a row get zeros."""
    rows = [(f[0], [float(x) for x in f[1:]]) for f in map(str.split, PHYSCHEM.strip().splitlines())]
    known = residues.join(F.broadcast(residues.sparkSession.createDataFrame(rows, "aa string, properties array<double>")), "aa", "left")  # 20 rows
    return known.withColumn("properties", F.coalesce("properties", F.array_repeat(F.lit(0.0), 9)))


def sliding_sum(residues: DataFrame, reach: int) -> DataFrame:
    """Each residue's value becomes the sum over ``reach`` residues to either side."""
    w = Window.partitionBy("entity", "part").orderBy("pos").rowsBetween(-reach, reach)
    return residues.withColumn("value", F.sum("value").over(w))


def sliding_concat(residues: DataFrame, reach: int, pad: float = 0.0) -> DataFrame:
    """Each residue gets the values of ``reach`` residues to either side as an array, padded at the ends."""
    w = Window.partitionBy("entity", "part").orderBy("pos")
    near = [F.coalesce(F.lag("value", -d).over(w), F.lit(pad)) for d in range(-reach, reach + 1)]
    return residues.withColumn("window", F.array(*near))


def parse_ids(df: DataFrame, column: str) -> DataFrame:
    """Fields of ids like protein||experiment__domains_index."""
    head, tail = F.substring_index(column, "__", 1), F.when(F.col(column).contains("__"), F.substring_index(column, "__", -1))
    index = F.regexp_extract(tail, r"_([0-9]+)$", 1)
    return df.withColumns({
        "protein": F.substring_index(head, "||", 1), "experiment": F.when(head.contains("||"), F.substring_index(head, "||", -1)),
        "domains": F.regexp_replace(tail, r"_[0-9]+$", ""), "domain_index": F.when(index != "", index.cast("int")),
    })


def species_initials(name: Column | str) -> Column:
    """First letter of the genus and of the species, as Homo_sapiens -> Hs."""
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(F.substring_index(name, "_", -1), 1, 1)))
