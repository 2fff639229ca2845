"""Embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is turned by a fixed random rotation and keeps one sign bit per dimension: its code, the nearest
corner o of a hypercube. With it is stored the correction factor c = <x, o>, the cosine between vector and code.
For another vector q, <o, q> / c estimates <x, q> without bias. q is rounded to ``PLANES`` bits a dimension, so <o, q> is a sum of popcounts
of the code with q's bit planes; what rounding may change is known for each q. A pair is left out if its estimate and the bound of its error stay
below the threshold. The default bound has full confidence: x lies arccos(c) from its code, so a q within the threshold's angle of x has
<o, q> >= cos(arccos(c) + arccos(threshold)), and an estimate less than that below the threshold. ``epsilon`` gives the narrower bound of
so many deviations, which may miss pairs. What is left is recomputed in double precision.

Vectors fall into cells around pivots (a bounded sample, which decides only speed). Two cells are compared unless
their pivots lie further apart than both radii and the threshold's angle allow. Large cells are cut into parts of about
``CELL`` vectors, so that every comparison is a task of bounded size; the work is that of all pairs of cells that cannot be excluded, which
on isotropic vectors is all pairs. A task passes on sums of links and a spanning forest, no pairs.

Vectors that are null, empty or zero, hold null or non-finite components, or have no id link with nothing and are their own
component; vectors of different lengths never link. Equal vectors, and rows that repeat an id, are one node and count each other as links. Only id
and vector are read. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .components import connected_components, merge_labels
from .shared import written

#: Vectors in a part of a cell; pivots at most; rows, columns and candidate pairs held at a time; bits of a rounded dimension.
CELL, PIVOTS, ROWS, COLUMNS, PAIRS, PLANES = 6144, 256, 64, 2048, 1 << 15, 4
SEED, SLACK = 20, 1e-5


def rotation(dim: int) -> np.ndarray:
    """The same random rotation on every machine."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors after rotation, their packed sign bits, and <x, code>."""
    dim = vectors.shape[1]
    turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rotation(dim)
    return turned, _packed(turned >= 0), np.abs(turned).sum(axis=1) / math.sqrt(dim)


class Rounded:
    """Turned unit vectors as bit planes: coordinate = least + step * number, and what rounding changes of a product with a code at most."""

    def __init__(self, turned: np.ndarray):
        self.dim = turned.shape[1]
        self.least = turned.min(axis=1)
        span = turned.max(axis=1) - self.least
        self.step = np.where(span > 0, span, 1.0) / (2**PLANES - 1)
        number = np.rint((turned - self.least[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = number.sum(axis=1, dtype=np.int64)
        self.planes = [_packed(number >> p & 1) for p in range(PLANES)]
        self.error = np.abs(turned - self.least[:, None] - self.step[:, None] * number).sum(axis=1) / math.sqrt(self.dim)

    def products(self, rows: slice, codes: np.ndarray) -> np.ndarray:
        """<code, rounded vector> for the vectors of ``rows`` and all codes."""
        sums = np.zeros((len(self.total[rows]), len(codes)), np.uint16 if self.dim << PLANES < 1 << 16 else np.uint32)
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                sums += np.bitwise_count(plane[rows, w, None] & codes[None, :, w]).astype(sums.dtype) << p
        ones = (2 * np.bitwise_count(codes).sum(axis=1, dtype=np.int64) - self.dim).astype(np.float32)
        scale = (self.step[rows, None] / math.sqrt(self.dim)).astype(np.float32)
        return sums * (2 * scale) + (self.least[rows, None] / math.sqrt(self.dim)).astype(np.float32) * ones - scale * self.total[rows, None].astype(np.float32)


def margin(c: np.ndarray, threshold: float, dim: int, epsilon: float | None) -> np.ndarray:
    """How far the estimate of a pair that reaches the threshold may lie below it, for correction factors c."""
    widest = threshold - np.cos(np.minimum(np.arccos(np.clip(c, -1, 1)) + math.acos(threshold), math.pi)) / c
    if epsilon is None:
        return widest
    return np.minimum(widest, np.sqrt(np.maximum(0, 1 - c * c)) / c * epsilon / math.sqrt(max(1, dim - 1)))


def matches(a: np.ndarray, b: np.ndarray, codes: np.ndarray, c: np.ndarray, threshold: float, epsilon: float | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) with cosine >= threshold; codes and c belong to b."""
    dim = a.shape[1]
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    rounded = Rounded(unit_a @ rotation(dim))
    least = (threshold - margin(c, threshold, dim, epsilon) - SLACK).astype(np.float32)
    factor, error = c.astype(np.float32), rounded.error.astype(np.float32) + np.float32(SLACK)
    for k, m in itertools.product(range(0, len(a), ROWS), range(0, len(b), COLUMNS)):
        rows, some = slice(k, k + ROWS), slice(m, m + COLUMNS)
        at, to = np.nonzero(rounded.products(rows, codes[some]) >= least[some] * factor[some] - error[rows, None])  # estimate * c, to spare a division for each pair
        for j in range(0, len(at), PAIRS):
            x, y = at[j : j + PAIRS] + k, to[j : j + PAIRS] + m
            near = np.einsum("ij,ij->i", unit_a[x], unit_b[y]) >= threshold
            yield x[near], y[near]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _coded(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """node, copies, vector -> with code, c, dim, the nearest pivot and the angle to it."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS for a length

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column("vector"), dim)
                _, codes, c = encode(x)
                cosines = x / np.linalg.norm(x, axis=1, keepdims=True) @ shared.value[int(dim)].T
                best = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(x)), best], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("node", "copies", "vector")), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(c), pa.array(np.full(len(x), dim, np.int32)), pa.array(best.astype(np.int32)), pa.array(angle)],
                    names=["node", "copies", "vector", "code", "c", "dim", "pivot", "angle"],
                )

    return nodes.mapInArrow(blocks, f"node long, copies long, vector {nodes.schema['vector'].dataType.simpleString()}, code binary, c double, dim int, pivot int, angle double")


def _pivots(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each length the unit vectors of a few nodes in hashed order, more of them for more nodes."""
    counts = nodes.groupBy(F.size("vector").alias("dim")).count().collect()  # a row for each length
    out = {}
    for dim, n in counts:
        few = nodes.where(F.size("vector") == dim).orderBy(F.xxhash64("vector"), "node").limit(min(PIVOTS, -(-n // CELL))).select("vector").collect()
        x = np.array([r[0] for r in few], np.float64)
        out[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def links(nodes: DataFrame, threshold: float, epsilon: float | None = None) -> DataFrame:
    """(node, others, parent): parts of the number of linked other vectors, and a spanning forest of the links."""
    spark = nodes.sparkSession
    ship(spark)
    pivots = _pivots(nodes)
    coded = written(_coded(nodes, pivots), "codes")
    cells = {(r.dim, r.pivot): (-(-r.n // CELL), r.radius) for r in coded.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # at most PIVOTS for a length
    reach, rows = math.acos(threshold) + 1e-6, []
    for (d, i), (parts, radius) in cells.items():
        near = [j for (e, j), (_, other) in cells.items() if e == d and (i == j or math.acos(float(np.clip(pivots[d][i] @ pivots[d][j], -1, 1))) <= radius + other + reach)]
        rows.append((d, i, parts, [(j, cells[d, j][0]) for j in near]))
    plan = spark.createDataFrame(rows, "dim int, pivot int, parts int, near array<struct<pivot: int, parts: int>>")
    own = F.struct("pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    others = F.flatten(F.transform("near", lambda n: F.transform(F.sequence(F.lit(0), n["parts"] - 1), lambda k: F.struct(n["pivot"].alias("pivot"), k.alias("part")))))
    met = coded.join(F.broadcast(plan), ["dim", "pivot"]).withColumn("own", own).withColumn("other", F.explode(others))
    pairs = met.select(F.xxhash64("dim", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), (F.col("own") <= F.col("other")).alias("low"), (F.col("own") >= F.col("other")).alias("high"), "dim", "node", "copies", "vector", "code", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                key = batch.column("pair").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for a, b in itertools.pairwise(cuts):
                    if held and held[0].column("pair")[0].as_py() != int(key[a]):
                        yield from _compared(held, threshold, epsilon)
                        held = []
                    held.append(batch.slice(a, b - a))
            elif batch is None and held:
                yield from _compared(held, threshold, epsilon)

    return pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "node long, others long, parent long")


def _compared(held: list[pa.RecordBatch], threshold: float, epsilon: float | None) -> Iterator[pa.RecordBatch]:
    """What the vectors of one pair of cells (or of one cell with itself) have in common."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    dim = rows.column("dim")[0].as_py()
    node, copies = (rows.column(n).to_numpy() for n in ("node", "copies"))
    low, high = (np.flatnonzero(rows.column(n).to_numpy(zero_copy_only=False)) for n in ("low", "high"))
    if not len(low) or not len(high):
        return
    x = _matrix(rows.column("vector"), dim)
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(len(x), -1)
    c = rows.column("c").to_numpy()
    others, label = np.zeros(len(x), np.int64), np.arange(len(x))
    alone = np.array_equal(low, high)
    for i, j in matches(x[low], x[high], codes[high], c[high], threshold, epsilon):
        i, j = low[i], high[j]
        if alone:
            i, j = i[i < j], j[i < j]
        np.add.at(others, i, copies[j])
        np.add.at(others, j, copies[i])
        merge_labels(i, j, label)
    found = np.flatnonzero(others)
    yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(others[found]), pa.array(node[label[found]])], names=["node", "others", "parent"])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, epsilon: float | None = None) -> DataFrame:
    """id, n_links, component_id (least id reachable), kept (it is the own id) of every row."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # as stored; arithmetic is in double precision
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    fit = F.coalesce(usable, F.lit(False))
    nodes = written(slim.where(fit).groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = written(links(nodes.select("node", "copies", "vector"), threshold, epsilon), "links")
    roots = connected_components(found.where("node <> parent").select("node", "parent"))
    counts = found.groupBy("node").agg(F.sum("others").alias("others"))
    rooted = nodes.join(counts, "node", "left").join(roots, "node", "left").select("vector", "least", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("vector").alias("same"), "links", "component")
    joined = slim.withColumn("match", F.when(fit, F.col("vector"))).join(named, F.col("match") == F.col("same"), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE fit AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach(vec_id, got) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.got = l.a),
least AS (SELECT vec_id, min(got) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least l ON e.vec_id = l.vec_id
"""
