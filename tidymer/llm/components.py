"""Connected components of a large edge list by alternating star steps.

Each round hooks the larger neighbours of every node, then its smaller ones, to the least node it sees. Rounds
grow with the logarithm of a component's diameter; each is written to the shared folder, so lineage stays short and
no edge ever reaches the driver. A node's edges are never gathered: its least neighbour is a partial aggregate,
written and joined back to the edges, so that adaptive execution can split the join where one node has many.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def _least(edges: DataFrame, temporary: list[DataFrame]) -> DataFrame:
    """Least neighbour (or itself) of every node, as a table of its own: a join with it can be split where a node has many edges."""
    temporary.append(written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least"))
    return temporary[-1]


def _round(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, after one large-star and one small-star step."""
    temporary: list[DataFrame] = []
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = written(both.where("b > a").join(_least(both, temporary), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
    least = _least(large, temporary)
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    for table in (*temporary, large):
        drop_written(table)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node of ``edges`` (a, b) that is no root itself.

    Directions, repeated edges, loops and edges with a null do not matter. No edges give an empty table.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    state = None
    while True:
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()
        if after == state or not after[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, before = after, now
        now = _round(now)
        drop_written(before)


def component_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, component_id (the least id of its component) from nodes (fp, least) and roots (node, root)."""
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")  # a table of its own: the join can be split where a root has many nodes
    return rooted.join(ids, "root").select("fp", "component_id")


def merge_labels(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the components of ``label`` (each node's least known fellow) along the links a-b."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
