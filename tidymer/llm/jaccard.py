"""Near-duplicates by the exact Jaccard similarity of word shingles.

A text's set holds the 64-bit XXH64 values of its distinct shingles; texts of one set are one node. Two sets of n and m shingles with
a similarity of at least t share a shingle among the first n - ceil(t n) + 1 and m - ceil(t m) + 1 of any common order, so
nodes that meet under none of these cannot be links. Shingles are ordered by how many stand in their cell of a table of ``CELLS`` counts over
all texts, rare ones first; the table's size is fixed and it decides on the work only.

Pairs are verified in three rounds: first the links of SimHash fingerprints, and each node with one other under each of its shingles (at most ``FEW``);
then, with the components of these known, a few pairs of each node that meet across components; then all that are left. So a group of near copies
costs about its size, not its square, and components are exactly those of all pairs that reach the similarity. Verification drops pairs by sketches
first, then compares whole sets: a sketch holds the parity of a set's shingles in at least two cells a shingle, so sets differ in as many shingles as
their sketches in bits, or more.

No task holds a bucket: shingles with crowded cells are salted for the first pass, which needs each row's neighbour only, and buckets of more than
``CELL`` nodes are cut into cells of two parts each for the second.

Null and empty texts have the empty set and are one node; texts of fewer words than a shingle are one shingle. Rows with a null id are
linked like any other, but name no component unless it has no other id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from .components import component_ids, connected_components
from .shared import drop_written, trimmed, written
from .shingles import fingerprint, hashes

#: Cells of the table of counts and blocks in which they travel; a cell so many times the mean is crowded, and its shingles are salted.
CELLS, BLOCK, CROWDED, HOT, SALTS = 1 << 20, 1 << 14, 8, 4096, 64
#: Nodes of a bucket that are compared in one place; other nodes that a node is held against first; rows, words of sketches, and sets, that a task holds at a time; bits of a sketch at most.
CELL, FEW, ROWS, WORDS, SETS, SKETCH = 4096, 8, 1 << 15, 1 << 19, 256, 1 << 15
SLACK = 1e-9


def node(found: np.ndarray) -> int:
    """A digest of the set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def cell_of(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(CELLS - 1)).astype(np.int64)


def _counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts, repeats in a text left out, fall into each cell: partial tables are summed block by block over the cluster."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        table = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(table, cell_of(np.unique(hashes(text.as_py(), words))), 1)
        if table.any():
            yield from packed(enumerate(table.reshape(-1, BLOCK)))

    def packed(blocks) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for number, block in blocks:
            yield _batch(block=np.array([number], np.int32), counts=pa.array([press.compress(block.tobytes())], pa.binary()))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[number] = sums.get(number, 0) + unpacked(counts.as_py())
        yield from packed(sums.items())

    def unpacked(block: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.int64)

    schema = "block int, counts binary"
    table = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for row in texts.select("text").mapInArrow(partial, schema).repartition("block").mapInArrow(total, schema).collect():  # a row for each block
        table[row.block] += unpacked(bytes(row.counts))
    return table.reshape(-1)


def prefix(found: np.ndarray, counts: np.ndarray, similarity: float, hot: float) -> tuple[np.ndarray, int]:
    """The shingles, rare ones first, one of which every set of that similarity has among its own such; and how many of them have no crowded cell."""
    most = len(found) - math.ceil(similarity * len(found) - SLACK) + 1 if len(found) else 0
    number = counts[cell_of(found)]
    order = np.lexsort((found, number))[:most]
    return found[order], int((number[order] <= hot).sum())


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the set's members in each of a power of two of cells."""
    bits = min(SKETCH, max(64, 1 << (2 * len(found)).bit_length()))
    odd = np.bincount((found >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _may_share(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Sizes n, m fit, and a shingle at places i, j leaves enough others before and after it to share (length and positional filters)."""
    most = np.minimum(i, j) + 1 + np.minimum(n - 1 - i, m - 1 - j)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK) & (most >= similarity / (1 + similarity) * (n + m) - SLACK)


def _meet(similarity: float) -> Callable:
    """Rows (token, salt, mix, n, place, fp, crowded), sorted -> those whose shingle another node has too, with the row before it where that may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        last = None  # the last row so far, not yet passed on, and the token before it
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if last is not None:
                rows = [np.r_[a, b] for a, b in zip(last, rows, strict=True)]
            rows = _without_repeats(rows)
            yield from settled(rows, False)
            last = [c[-2:] for c in rows]  # the row before the last decides whether the last one is met
        if last is not None:
            yield from settled(last, True)

    def settled(rows: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
        """All rows but the last (and the first of two, which the call before has passed on)."""
        token, salt, _, n, place, fp, crowded, begun = rows
        same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
        met = (np.r_[False, same] | np.r_[same, False] | crowded) & ~begun
        near = np.r_[False, same & _may_share(n[1:], place[1:], n[:-1], place[:-1], similarity)]
        stop = len(token) if final else len(token) - 1
        take = np.flatnonzero(met[:stop])
        rows[-1][:stop] = True
        yield _batch(token=token[take], n=n[take], place=place[take], fp=fp[take], other=pa.array(fp[take - 1], mask=~near[take]))

    return run


def _without_repeats(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of one shingle and node once; equal ones are neighbours."""
    new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[5][1:] != rows[5][:-1])]
    return [c[new] for c in rows]


def _folded(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


class _Sketches:
    """The sketches of a cell's rows by size, and bounds of the differences to one of them."""

    def __init__(self, values: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.size, self.place, self.of = size, np.zeros(len(size), np.int64), {}
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            self.place[at] = np.arange(len(at))
            self.of[k] = values[start[at][:, None] + np.arange(k)]
        self.halves = {k // 2: _folded(m) for k, m in self.of.items() if k > 1}

    def differing(self, x: int, others: np.ndarray) -> np.ndarray:
        """Least number of shingles in which row x and each of the others, of half to twice its size of sketch, differ."""
        k, out = self.size[x], np.zeros(len(others), np.int64)
        own = self.of[k][self.place[x]]
        for size in np.unique(self.size[others]):
            at = np.flatnonzero(self.size[others] == size)
            place = self.place[others[at]]
            if size == k:
                both = self.of[k][place] ^ own
            elif size == 2 * k:
                both = self.halves[k][place] ^ own
            else:
                both = self.of[size][place] ^ self.halves[size][self.place[x]]
            out[at] = np.bitwise_count(both).sum(axis=1)
        return out


def _across(similarity: float, few: int | None) -> Callable:
    """Rows (cell, part, n, place, fp, root, sketch), whole cells together -> the pairs (at most ``few`` for a node in a cell) that lie in two components,
    and in two parts where the cell has two, and may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        held: list[np.ndarray] = []
        values = np.zeros(0, np.uint64)
        for batch in batches:
            *columns, lists = batch.columns
            new = [c.to_numpy() for c in columns] + [np.diff(lists.offsets.to_numpy()).astype(np.int64)]
            held = [np.r_[a, b] for a, b in zip(held, new, strict=True)] if held else new
            values = np.r_[values, lists.flatten().to_numpy().view(np.uint64)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) >= ROWS or len(values) >= WORDS else 0  # the last cell may go on
            if whole:
                yield from solve(*(c[:whole] for c in held), values)
                values, held = values[held[-1][:whole].sum() :], [c[whole:] for c in held]
        if held and len(held[0]):
            yield from solve(*held, values)

    def solve(cell, part, n, place, fp, root, words, values) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum(words) - words
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        a, b, count = [], [], 0
        for start, stop in zip(first.tolist(), np.r_[first[1:], len(cell)].tolist(), strict=True):
            own, side, size, at, name = root[start:stop], part[start:stop], n[start:stop], place[start:stop], fp[start:stop]
            if (own == own[0]).all():
                continue
            one = (side == side[0]).all()
            sketches = _Sketches(values, starts[start:stop], words[start:stop])
            kinds, counts = np.unique(own, return_counts=True)
            largest, later = kinds[counts.argmax()], np.arange(stop - start)
            for x in np.flatnonzero(own != largest):
                fit = np.flatnonzero((own != own[x]) & ((own == largest) | (later > x)) & (one | (side != side[x])) & _may_share(size, at, size[x], at[x], similarity))
                fit = fit[sketches.differing(x, fit) <= (1 - similarity) / (1 + similarity) * (size[x] + size[fit]) + SLACK][:few]
                a.append(np.full(len(fit), name[x]))
                b.append(name[fit])
                count += len(fit)
                if count > ROWS:
                    yield pairs(a, b)
                    a, b, count = [], [], 0
        if count:
            yield pairs(a, b)

    def pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return _batch(a=found[:, 0], b=found[:, 1])

    return run


def _differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ, the larger one folded to the size of the smaller."""

    def folded(s: Column, to: Column) -> Column:
        half = F.zip_with(F.slice(s, 1, to), F.slice(s, to + 1, to), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(s) == 2 * to, half).otherwise(s)

    size = F.least(F.size(x), F.size(y))
    both = F.zip_with(folded(x, size), folded(y, size), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * size, F.aggregate(both, F.lit(0), lambda s, v: s + v)).otherwise(F.lit(0))


class _Verifier:
    """Decides pairs of nodes by sketches, then by whole sets, which are read from the texts again."""

    def __init__(self, texts: DataFrame, prints: DataFrame, words: int, similarity: float):
        self.texts, self.prints, self.words, self.similarity = texts, prints, words, similarity
        self.marks = written(prints.where("tokens IS NOT NULL").dropDuplicates(["fp"]).select("fp", "n", "sketch"), "marks")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity."""
        side = lambda name: self.marks.select(F.col("fp").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
        allowed = (1 - self.similarity) / (1 + self.similarity) * (F.col("n_a") + F.col("n_b")) + SLACK
        likely = written(pairs.join(side("a"), "a").join(side("b"), "b").where(_differing(F.col("s_a"), F.col("s_b")) <= allowed).select("a", "b"), "likely")
        sets = written(self._sets(likely.select(F.col("a").alias("fp")).union(likely.select("b")).distinct()), "sets")
        whole = likely.join(sets.select(F.col("fp").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("found").alias("y")), "b")
        sized = whole.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("shared"))
        out = written(sized.where(F.col("shared") >= self.similarity * (F.col("both") - F.col("shared")) - SLACK).select("a", "b"), "links")
        drop_written(likely)
        drop_written(sets)
        return out

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """fp and the set (found) of each node: one text of each is read again."""
        words, (id_col, *_) = self.words, self.texts.columns
        names = self.prints.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min(id_col).alias("of")).select("of").distinct()

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trimmed()
            for batch in batches:
                for k in range(0, batch.num_rows, SETS):
                    found = [np.unique(hashes(text.as_py(), words)) for text in batch.column(0)[k : k + SETS]]
                    yield _batch(fp=pa.array([node(x) for x in found], pa.int64()), found=pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())))

        again = self.texts.join(names, F.col(id_col).eqNullSafe(F.col("of")), "left_semi").select("text").mapInArrow(whole, "fp long, found array<long>")
        return again.join(nodes, "fp", "left_semi").dropDuplicates(["fp"])


def _prints(texts: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """id, fp (digest of the set) of every row; n, simhash, sketch, tokens (the prefix) and calm (how many of these have no crowded cell) of a node's first row in a task."""
    id_col, kind = texts.columns[0], texts.schema[texts.columns[0]].dataType.simpleString()
    shared, hot = texts.sparkSession.sparkContext.broadcast(counts), max(HOT, CROWDED * counts.sum() / CELLS)  # CELLS longs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, SETS):
                rows = []
                for text in batch.column(1)[k : k + SETS]:
                    found = np.unique(hashes(text.as_py(), words))
                    name = node(found)
                    if name in seen:
                        rows.append((name, None, None, None, None, None))
                        continue
                    seen.add(name)
                    tokens, calm = prefix(found, shared.value, similarity, hot)
                    rows.append((name, len(found), int(fingerprint(found).view(np.int64)), sketch(found), tokens.view(np.int64), calm))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, SETS), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "fp", "n", "simhash", "sketch", "tokens", "calm"])

    return texts.mapInArrow(read, f"{id_col} {kind}, fp long, n int, simhash long, sketch array<long>, tokens array<long>, calm int")


def _apart(met: DataFrame, roots: DataFrame, marks: DataFrame, tried: DataFrame, similarity: float, few: int | None) -> DataFrame:
    """Untried pairs (a, b) of nodes in different components that meet under a shingle and that no filter excludes; at most ``few`` for a node and cell."""
    rooted = met.select("token", "n", "place", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    mixed = written(rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count")).where("low < high").select("token", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "mixed")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("token", F.least(other, F.col("part")), F.greatest(other, F.col("part"))))
    placed = rooted.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    apart = placed.join(marks.select("fp", "sketch"), "fp").select(F.explode(cells).alias("cell"), "part", "n", "place", "fp", "root", "sketch")
    pairs = apart.repartition("cell").sortWithinPartitions("cell").mapInArrow(_across(similarity, few), "a long, b long").distinct()
    rest = written(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    drop_written(rooted)
    drop_written(mixed)
    return rest


def components(docs: DataFrame, linked: Callable[[DataFrame], DataFrame], *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """id and fp (a digest of the row's set) of every row; fp and component_id (the component's least id) of every set. ``linked`` gives edges (a, b) between near fingerprints (fp)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    prints = written(_prints(texts, _counts(texts, words), words, similarity), "prints")
    firsts, verifier = prints.where("tokens IS NOT NULL"), _Verifier(texts, prints, words, similarity)

    salt = F.when(F.col("place") >= F.col("calm"), F.pmod("fp", F.lit(SALTS)).cast("int")).otherwise(0)
    placed = firsts.select("n", "fp", "calm", F.posexplode("tokens").alias("place", "token"))
    dealt = placed.select("token", salt.alias("salt"), F.xxhash64("token", "fp").alias("mix"), "n", "place", "fp", (F.col("place") >= F.col("calm")).alias("crowded"), F.lit(False).alias("begun"))
    met = written(dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "mix", "fp").mapInArrow(_meet(similarity), "token long, n int, place int, fp long, other long"), "met")

    few = met.where("other IS NOT NULL").groupBy(F.col("fp").alias("a")).agg(F.slice(F.array_sort(F.collect_set("other")), 1, FEW).alias("others"))
    leads = written(firsts.groupBy("simhash").agg(F.min("fp").alias("lead")), "leads")
    alike = firsts.select("simhash", F.col("fp").alias("b")).join(leads.withColumnRenamed("lead", "a"), "simhash").select("a", "b")
    near = linked(leads.select(F.col("simhash").alias("fp"))).join(leads.select(F.col("simhash").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("simhash").alias("b"), F.col("lead").alias("y")), "b")
    tried = few.select("a", F.explode("others").alias("b")).union(alike).union(near.select("x", "y"))
    tried = written(tried.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    links = verifier.links(tried)

    for few in (FEW, None):  # first some, which merge most components, then all that are left
        rest = _apart(met, connected_components(links), verifier.marks, tried, similarity, few)
        links, tried = links.union(verifier.links(rest)), tried.union(rest)

    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    named = component_ids(nodes, connected_components(links))
    for done in (met, leads, tried, links, verifier.marks):
        drop_written(done)
    return prints.select(id_col, "fp"), named
