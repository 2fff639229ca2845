"""Nearest-neighbour and threshold joins of vectors by cosine, exact, in bounded blocks.

Both sides are hashed to blocks of about ``blocks.VECTORS`` vectors, written once; a task reads some blocks of both sides
and passes on the k best of each query, or the pairs within the cut. Work is the product of both sides, as exactness asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import CELLS, DIGITS, Vectors, blockwise, compared, crossed, packed, product
from .stores import persisted

#: Pairs handed on at a time.
ROWS = 1 << 16

#: Lists of neighbours in a block, neighbours as bits at a time, and edges compared at a time.
LISTS, COLUMNS, PAIRS = 16_384, 4096, 16_384


def _prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")


def nearest(queries: DataFrame, base: DataFrame, k: int = 1, *, id_col: str, vector_col: str, exclude_self: bool = True) -> DataFrame:
    """id, match, cosine, rank of the k nearest base vectors of every query; ties go to the lower id. Cosines are rounded to 9 decimals.

    A task passes on the k best of each query among all base vectors that it reads. Pairs that products in single precision can't exclude are computed in double precision.
    """
    kind = _prepared(queries, id_col, vector_col).schema["id"].dataType.simpleString()
    q = packed(_prepared(queries, id_col, vector_col))
    b = q if base is queries else packed(_prepared(base, id_col, vector_col))

    def meet(pairs: Iterator[tuple[Vectors, Vectors]]) -> Iterator[pa.RecordBatch]:
        best = None
        for a, other in pairs:
            if best is None or best.a is not a:
                if best is not None:
                    yield best.batch()
                best = _Best(a, k)
            best.add(other, exclude_self)
        if best is not None:
            yield best.batch()

    best = compared(q, b, meet, f"id {kind}, match {kind}, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "match")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best of each row of a block so far."""

    def __init__(self, a: Vectors, k: int):
        self.a, self.k, self.kind = a, k, a.kind
        self.row, self.cos, self.match = np.empty(0, np.int64), np.empty(0), a.ids[:0]
        self.least = np.full(len(a.ids), -np.inf)  # of those that have k

    def add(self, b: Vectors, exclude_self: bool) -> None:
        found = [(self.row, self.cos, self.match)]
        own, same = _equal(self.a.ids, b.ids) if exclude_self else (np.empty(0, np.int64),) * 2
        for low, near in self.a.slabs(b):
            part = (own >= low) & (own < low + len(near))
            near[own[part] - low, same[part]] = -9.0
            least = self.least[low : low + len(near)] - self.a.margin
            new = np.flatnonzero(np.isinf(least))
            if len(new):
                at = max(0, len(b.ids) - self.k)
                least[new] = np.maximum(np.partition(near[new], at, axis=1)[:, at] - 2 * self.a.margin, -8.0) if at else -8.0
            flat = np.flatnonzero(near >= least.astype(np.float32)[:, None])
            for i in range(0, len(flat), CELLS // 4):
                r, c = np.divmod(flat[i : i + CELLS // 4], len(b.ids))
                r += low
                cos = self.a.cosines(b, r, c)
                fit = cos >= self.least[r]
                found.append(self._cut(r[fit], cos[fit], b.ids[c[fit]]))
        self.row, self.cos, self.match = self._cut(*(np.concatenate(x) for x in zip(*found, strict=True)))
        n = np.bincount(self.row, minlength=len(self.least))
        full, last = n == self.k, np.cumsum(n) - 1
        self.least[full] = self.cos[last[full]]

    def _cut(self, row: np.ndarray, cos: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((np.unique(match, return_inverse=True)[1], -cos, row))
        row, cos, match = row[order], cos[order], match[order]
        fit = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[fit], cos[fit], match[fit]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": pa.array(self.a.ids[self.row], self.kind), "match": pa.array(self.match, self.kind), "cosine": self.cos})


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal elements in both."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    n = high - low
    r = np.repeat(np.arange(len(a)), n)
    return r, order[np.repeat(low, n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]


def within(queries: DataFrame, base: DataFrame, distance: float, *, id_col: str, vector_col: str, half: bool = False) -> DataFrame:
    """id, match, cosine of all pairs of different ids with cosine distance of at most ``distance``; with ``half`` only id < match. Of one frame with itself, each pair is computed once."""
    kind = _prepared(queries, id_col, vector_col).schema["id"].dataType.simpleString()
    one = base is queries
    q = packed(_prepared(queries, id_col, vector_col))
    b = q if one else packed(_prepared(base, id_col, vector_col))

    def meet(pairs: Iterator[tuple[Vectors, Vectors]]) -> Iterator[pa.RecordBatch]:
        for x, y in pairs:
            for r, c, cos in x.reaching(y, 1 - distance):
                i, j = x.ids[r], y.ids[c]
                if one and x.number != y.number:
                    i, j = np.where(i < j, i, j), np.where(i < j, j, i)
                fit = np.flatnonzero((i < j) if half or one else (i != j))
                for low in range(0, len(fit), ROWS):
                    part = fit[low : low + ROWS]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(i[part], x.kind), "match": pa.array(j[part], x.kind), "cosine": cos[part]})

    found = compared(q, b, meet, f"id {kind}, match {kind}, cosine double", half=one)
    return found.union(found.select("match", "id", "cosine")) if one and not half else found


def joining_edges(vectors: DataFrame, distance: float) -> DataFrame:
    """Edges (a, b) that join the vectors (id, vec) which the pairs within ``distance`` join, for components: a task passes on at most one edge for each vector that it reads, not the pairs."""
    rows = packed(_prepared(vectors, "id", "vec"))
    kind = vectors.schema["id"].dataType.simpleString()

    def meet(pairs: Iterator[tuple[Vectors, Vectors]]) -> Iterator[pa.RecordBatch]:
        start, ids, label, type_ = {}, [], np.empty(0, np.int64), None
        for a, b in pairs:
            type_ = a.kind
            for x in (a, b):
                if x.number not in start:
                    start[x.number] = len(label)
                    ids.append(x.ids)
                    label = np.append(label, np.arange(len(label), len(label) + len(x.ids)))
            i, j = start[a.number], start[b.number]
            for r, c, _ in a.reaching(b, 1 - distance, lambda r, c, i=i, j=j: label[i + r] != label[j + c]):
                _join(label, i + r, j + c)
        if len(label):
            names = np.concatenate(ids)
            joined = np.flatnonzero(label != np.arange(len(label)))
            for low in range(0, len(joined), ROWS):
                part = joined[low : low + ROWS]
                yield pa.RecordBatch.from_pydict({"a": pa.array(names[part], type_), "b": pa.array(names[label[part]], type_)})

    return compared(rows, rows, meet, f"a {kind}, b {kind}", half=True)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs join the least label among them; ``label`` holds the place of each one's root, before and after."""
    while len(a):
        x, y = label[a], label[b]
        fit = x != y
        a, b, x, y = a[fit], b[fit], x[fit], y[fit]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while len(a):
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


#: Groups whose bits one number holds.
WORD = 62


def groups_within(vectors: DataFrame, distance: float, groups: int) -> DataFrame:
    """id, group of every vector (id, vec, group from 0 to ``groups`` - 1) and every group that holds another vector within ``distance``. A task passes on bits of each vector that it reads, not the pairs."""
    rows = packed(vectors.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec", "group"))
    kind = vectors.schema["id"].dataType.simpleString()

    def meet(pairs: Iterator[tuple[Vectors, Vectors]]) -> Iterator[pa.RecordBatch]:
        start, ids, near, type_ = {}, [], np.zeros((0, groups), bool), None
        for a, b in pairs:
            type_ = a.kind
            for x in (a, b):
                if x.number not in start:
                    start[x.number] = len(near)
                    ids.append(x.ids)
                    near = np.concatenate([near, np.zeros((len(x.ids), groups), bool)])
            i, j = start[a.number], start[b.number]
            new = lambda r, c, a=a, b=b, i=i, j=j: (a.ids[r] != b.ids[c]) & ~(near[i + r, b.groups[c]] & near[j + c, a.groups[r]])
            for r, c, _ in a.reaching(b, 1 - distance, new):
                near[i + r, b.groups[c]] = near[j + c, a.groups[r]] = True
        names = np.concatenate(ids) if ids else []
        for word in range(-(-groups // WORD) if ids else 0):
            bits = near[:, word * WORD : (word + 1) * WORD]
            mask = bits @ (1 << np.arange(bits.shape[1], dtype=np.int64))
            held = np.flatnonzero(mask)
            for low in range(0, len(held), ROWS):
                part = held[low : low + ROWS]
                yield pa.RecordBatch.from_pydict({"id": pa.array(names[part], type_), "word": pa.array(np.full(len(part), word, np.int32)), "mask": mask[part]})

    found = compared(rows, rows, meet, f"id {kind}, word int, mask long", half=True).groupBy("id", "word").agg(F.bit_or("mask").alias("mask"))
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("mask", k) == 1)
    return found.select("id", F.explode(F.transform(places, lambda k: k + F.col("word") * WORD)).alias("group"))


def reciprocal_best(edges: DataFrame) -> DataFrame:
    """a < b that are each other's most similar entity in the other's group; ``edges`` (a, group_a, b, group_b, value) holds both directions."""
    w = Window.partitionBy("a", "group_b").orderBy(F.desc("value"), "b")
    best = edges.where("group_a <> group_b").withColumn("place", F.row_number().over(w)).where("place = 1").select("a", "b", "value")
    back = best.select(F.col("a").alias("b"), F.col("b").alias("a"))
    return best.join(back, ["a", "b"]).where("a < b")


def reciprocal_best_vectors(vectors: DataFrame) -> DataFrame:
    """``reciprocal_best`` of vectors (id, label, vec) by cosine: a block passes on the best of each vector and other label only, not its pairs."""
    rows = persisted(vectors.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").select("id", "label", "vec"), "vectors")
    kind, group = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "group_a": [], "b": [], "group_b": [], "value": []})]
        if not a.empty and not b.empty:
            b = b.sort_values(["label", "id"])
            x, y = (np.array(f.vec.tolist(), np.float64) for f in (a, b))
            with np.errstate(all="ignore"):
                cos = np.round(np.nan_to_num(x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))), DIGITS)
            labels, ids, own = b.label.to_numpy(), b.id.to_numpy(), a.label.to_numpy()
            for g in np.unique(labels):
                low, high = np.searchsorted(labels, g), np.searchsorted(labels, g, side="right")
                first = cos[:, low:high].argmax(axis=1)
                fit = own != g
                out.append(pd.DataFrame({"a": a.id.to_numpy(), "group_a": own, "b": ids[low + first], "group_b": g, "value": cos[np.arange(len(a)), low + first]})[fit])
        return pd.concat(out[1:] or out)

    return reciprocal_best(persisted(crossed(rows, rows, meet, f"a {kind}, group_a {group}, b {kind}, group_b {group}, value double"), "best"))


#: Neighbours in a block of lists at least and at most; cells of a block's neighbours as a table, and paths of two edges formed, at a time.
NEAR, TABLE, PATHS = (1 << 14, 1 << 21), 1 << 26, 1 << 21


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with all three edges (a, b; a < b; each once).

    Blocks of lists of higher neighbours are written once and read by the tasks; paths of two edges are looked up where they are formed, and triangles only leave a task.
    """
    edges = persisted(edges.where("a < b").select("a", "b"), "edges")
    kind, most = edges.schema["a"].dataType.simpleString(), min(max(edges.count() // 24, NEAR[0]), NEAR[1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in batches:
            for k in range(x.num_rows):
                held.append((x.column(0)[k].as_py(), x.column(1)[k].values))
                size += len(held[-1][1])
                if size >= most:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    def made(held: list) -> pa.RecordBatch:
        type_ = held[0][1].type
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        sizes = pa.array([len(near) for _, near in held], pa.int32())
        return pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int32()), "ids": one(pa.array([i for i, _ in held], type_)), "sizes": one(sizes), "near": one(pa.concat_arrays([near for _, near in held]))})

    lists = edges.groupBy("a").agg(F.collect_list("b").alias("near")).mapInArrow(pack, f"block int, ids array<{kind}>, sizes array<int>, near array<{kind}>")
    lists = blockwise(lists, "near")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(x.num_rows):
                type_ = x.column(1)[k].values.type
                a, b = ([x.column(at + i)[k].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3)] for at in (0, 4))
                for r, y, c in _closed(a, b):
                    for low in range(0, len(r), ROWS):
                        yield pa.RecordBatch.from_pydict({n: pa.array(v[low : low + ROWS], type_) for n, v in (("a", r), ("b", y), ("c", c))})

    return product(lists, lists).mapInArrow(meet, f"a {kind}, b {kind}, c {kind}")


def _closed(a: tuple, b: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triangles whose least corner has its list in ``a`` and whose next one in ``b`` (ids, sizes of lists, lists)."""
    (ai, an, near), (bi, bn, further) = a, b
    order = np.argsort(bi, kind="stable")
    at = np.minimum(np.searchsorted(bi[order], near), len(bi) - 1)
    edge = np.flatnonzero(bi[order][at] == near)
    row, to = np.repeat(np.arange(len(ai)), an), order[at[edge]]
    names, column = np.unique(near, return_inverse=True)
    place = np.minimum(np.searchsorted(names, further), len(names) - 1)
    known = names[place] == further
    ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(bn)])]
    start, n, place = ends[:-1][to], np.diff(ends)[to], place[known]
    first, rows = row[edge], max(1, TABLE // len(names))
    for low in range(0, len(ai), rows):
        i, j = np.searchsorted(row, [low, low + rows])
        e, f = np.searchsorted(first, [low, low + rows])
        if e == f:
            continue
        table = np.zeros((min(rows, len(ai) - low), len(names)), bool)
        table[row[i:j] - low, column[i:j]] = True
        total = np.cumsum(n[e:f])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(PATHS, total[-1], PATHS)), [f - e]]))
        for g, h in zip(cuts[:-1] + e, cuts[1:] + e, strict=True):
            m = n[g:h]
            path = np.repeat(np.arange(g, h), m)
            c = place[np.repeat(start[g:h] - np.cumsum(m) + m, m) + np.arange(len(path))]
            hit = np.flatnonzero(table[first[path] - low, c])
            yield ai[first[path[hit]]], bi[to[path[hit]]], names[c[hit]]


def closed_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b; a < b) that are part of a triangle: both ends have a neighbour in common.

    Lists of neighbours meet in blocks and are compared as bits, so no path of two edges is formed: a list is carried once for every block of the other ends.
    """
    edges = persisted(edges, "edges")
    both = edges.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.where("a <> b").select("b", "a"))
    rows = persisted(both.groupBy("id").agg(F.collect_set("near").alias("near")), "near")
    kind = rows.schema["id"].dataType.simpleString()

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["a", "b"])
        b = b.sort_values("id")
        sides = [(np.repeat(np.arange(len(f)), f.near.map(len)), np.concatenate(f.near.tolist())) for f in (a, b)]
        ai, bi, (x, y) = a.id.to_numpy(), b.id.to_numpy(), sides[0]
        at = np.minimum(np.searchsorted(bi, y), len(bi) - 1)
        fit = np.flatnonzero((bi[at] == y) & (ai[x] < y))
        x, y = x[fit], at[fit]
        closed, ids = np.zeros(len(x), bool), np.intersect1d(sides[0][1], sides[1][1])
        for low in range(0, len(ids) if len(x) else 0, COLUMNS):
            some, bits = ids[low : low + COLUMNS], []
            for f, (row, near) in zip((a, b), sides, strict=True):
                place = np.minimum(np.searchsorted(some, near), len(some) - 1)
                there = some[place] == near
                dense = np.zeros((len(f), -(-len(some) // 64) * 64), bool)
                dense[row[there], place[there]] = True
                bits.append(np.packbits(dense, axis=1).view(np.uint64))
            rest = np.flatnonzero(~closed)
            for k in range(0, len(rest), PAIRS):
                part = rest[k : k + PAIRS]
                closed[part] = (bits[0][x[part]] & bits[1][y[part]]).any(axis=1)
        return pd.DataFrame({"a": ai[x[closed]], "b": bi[y[closed]]})

    found = crossed(rows, rows, meet, f"a {kind}, b {kind}", LISTS)
    return edges.join(found, ["a", "b"], "left_semi")


def candidate_pairs(by_a: DataFrame, by_b: DataFrame, cut_a: float, cut_b: float) -> DataFrame:
    """Pairs (id, match) that are best by either similarity or reach its cut."""

    def chosen(sim: DataFrame, cut: float) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.desc("value"), "match")
        return sim.withColumn("place", F.row_number().over(w)).where((F.col("place") == 1) | (F.col("value") >= cut)).select("id", "match")

    return chosen(by_a, cut_a).union(chosen(by_b, cut_b)).distinct()


def contacts(atoms: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Least distance of each residue's atoms to ``others`` of the same structure within the radius.

    Atoms meet in cubes of one radius' width and their 26 neighbours, an equi-join; no pair beyond these is formed.
    """
    cube = [F.floor(F.col(c) / radius).cast("long") for c in "xyz"]
    near = F.explode(F.flatten(F.flatten(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda j: F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda k: F.struct((cube[0] + i).alias("x"), (cube[1] + j).alias("y"), (cube[2] + k).alias("z"))))))))
    left = atoms.withColumn("cube", F.struct(*(c.alias(n) for c, n in zip(cube, "xyz", strict=True))))
    right = others.withColumn("cube", near).select("pdb", "cube", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    d2 = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"), F.lit(0.0))
    met = left.join(right, ["pdb", "cube"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return met.groupBy("pdb", "chain", "res_no").agg(F.sqrt(F.min("d2")).alias("distance"))
