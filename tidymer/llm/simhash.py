"""SimHash near-duplicates by bit-sliced comparison.

Each document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one node. Two nodes within
``radius`` bits agree in at least two of ``radius`` + 2 bit blocks, so every pair of blocks gives a table of
buckets, and only nodes of one bucket are compared. Inside a bucket the nodes lie vertically: plane p of a
slice of 64 nodes holds their bits p. A node meets a slice by 64 exclusive-ors whose ones run through carry-save
counters, all 64 distances at once; slices in which every distance exceeds the radius are abandoned early.
Buckets above ``CELL`` nodes are cut into cells of two parts each, so that every pair still meets in one bounded
cell. A task passes on a spanning forest of the links that it finds, never all pairs; components follow from these.

At a Jaccard similarity of 0.8 fingerprints differ in about 10 of 64 bits, give or take 3, and so do some of less similar texts. So where
a similarity is asked for, links of fingerprints are candidates only: ``jaccard`` verifies them by whole shingle sets and adds the candidates that they miss.

Null and empty texts have fingerprint zero and are linked like any other; repeated rows share a node; other columns
are not read; an empty table gives an empty table. Rows with a null id are linked, but name no component unless
the component has no other id, where component_id is null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ship
from . import jaccard
from .components import component_ids, connected_components, merge_labels
from .shared import trimmed, written
from .shingles import BITS, fingerprint, hashes

CELL = 1024
#: (node, slice) comparisons, and rows, that a task holds at a time.
SLAB, ROWS = 1 << 14, 1 << 17


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id and fp (signed long) of every row, over shingles of ``words`` words."""

    ship(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(blocks, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def _keys(radius: int) -> Column:
    """One bucket key for each pair of bit blocks; the pair's number is part of it."""
    n = radius + 2
    edges = [BITS * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(n)]
    width = max(edges[i + 1] - edges[i] for i in range(n))
    pairs = itertools.combinations(range(n), 2)
    return F.array(*(F.xxhash64(F.lit(t), F.shiftleft(part[i], width).bitwiseOR(part[j])) for t, (i, j) in enumerate(pairs)))


def _within(fp: np.ndarray, node: np.ndarray, part: np.ndarray, valid: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, slot) pairs within the radius: comparison k holds node[k] against slice part[k], in the slots of valid[k]."""
    width = (radius + 1).bit_length()
    mine, count, over = fp[node], [np.zeros(len(node), np.uint64) for _ in range(width)], np.zeros(len(node), np.uint64)
    zero, one = np.uint64(0), np.uint64(1)
    for p in range(0, BITS, 2):
        x = planes[part, p] ^ (zero - (mine >> np.uint64(p) & one))
        y = planes[part, p + 1] ^ (zero - (mine >> np.uint64(p + 1) & one))
        half = count[0] ^ x
        carry = count[0] & x | half & y
        count[0] = half ^ y
        for k in range(1, width):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        over |= carry
        if p % 8 == 6:
            beyond, same = over, ~zero
            for k in reversed(range(width)):  # count > radius, from the highest bit
                if radius >> k & 1:
                    same = same & count[k]
                else:
                    beyond, same = beyond | same & count[k], same & ~count[k]
            over = beyond  # sticky
            stay = (valid & ~over) != 0
            if not stay.all():
                node, part, valid, mine, over, count = node[stay], part[stay], valid[stay], mine[stay], over[stay], [c[stay] for c in count]
                if not len(node):
                    break
    hits = valid & ~over
    at, slot = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(hits) else (np.zeros(0, int),) * 2
    return node[at], part[at] * BITS + slot


def _links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the cells; rows of a cell are consecutive."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    many = np.repeat(size > 1, size)
    fp, size = fp[many], size[size > 1]
    n = len(fp)
    if not n:
        return fp, fp
    end = np.repeat(np.cumsum(size), size)
    bits = np.unpackbits(np.pad(fp, (0, -n % BITS)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, BITS, BITS)
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]
    nodes = np.flatnonzero(np.arange(1, n + 1) < end)
    low, high = (nodes + 1) // BITS, (end[nodes] - 1) // BITS
    number = high - low + 1
    stops = np.cumsum(number)
    label, full = np.arange(n), ~np.uint64(0)
    for k in range(0, len(nodes), SLAB // 4):
        take = slice(k, k + SLAB // 4)
        node = np.repeat(nodes[take], number[take])
        part = np.arange(len(node)) - np.repeat(stops[take] - number[take] - (stops[k] - number[k]), number[take]) + np.repeat(low[take], number[take])
        from_, to = np.maximum(node + 1 - part * BITS, 0).astype(np.uint64), np.minimum(end[node] - part * BITS, BITS).astype(np.uint64)
        valid = full << from_ & full >> (np.uint64(BITS) - to)
        for j in range(0, len(node), SLAB):
            merge_labels(*_within(fp, node[j : j + SLAB], part[j : j + SLAB], valid[j : j + SLAB], planes, radius), label)
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, each once) that chains of links of at most ``radius`` differing bits connect."""
    ship(nodes.sparkSession)
    buckets = nodes.select("fp", F.explode(_keys(radius)).alias("key"))
    large = written(buckets.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).cast("int").alias("parts")), "buckets")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit("part")), F.col("parts")).cast("int")
    cells = F.when(F.col("parts").isNull(), F.array("key")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.xxhash64("key", F.least(other, own), F.greatest(other, own)))
    )
    dealt = buckets.join(large, "key", "left").select("fp", F.explode(cells).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cell = np.r_[cell, batch.column("cell").to_numpy()]
                fp = np.r_[fp, batch.column("fp").to_numpy().view(np.uint64)]
                if len(cell) < ROWS:
                    continue
            whole = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole:
                a, b = _links(cell[:whole], fp[:whole], radius)
                cell, fp = cell[whole:], fp[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """id and fp of every row; fp and component_id (the component's least id) of every fp, which is the fingerprint, or with ``similarity`` a digest of the shingle set."""
    if similarity is not None:
        return jaccard.components(docs, lambda nodes: links(nodes, radius), id_col=id_col, text_col=text_col, words=words, similarity=similarity)
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    return prints, component_ids(nodes, connected_components(links(nodes.select("fp"), radius)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """id, fp and component_id (the component's least id) of every row; with ``similarity``, links are exactly the pairs that reach that Jaccard similarity of shingle sets."""
    prints, named = components(docs, id_col=id_col, **how)
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group of near-duplicates.

    Ids name documents; of rows that share an id, or have none and are alone in their component, all stay.
    """
    kept = components(docs, id_col=id_col, **how)[1].select(F.col("component_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
