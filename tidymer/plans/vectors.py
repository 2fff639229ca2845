"""Queries on embeddings: neighbours, thresholds, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds, graph, neighbours
from ..operators.stores import persisted
from .registry import Tables, query

COS = "round(coalesce(list_dot_product(a.vec, b.vec) / nullif(sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)), 0), 0), 9)"
RANKED = f"ranked AS (SELECT a.id, b.id AS match, b.label, {COS} AS cosine, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS rank FROM vectors a JOIN vectors b ON a.id <> b.id)"


def near(t: Tables, k: int, **how) -> DataFrame:
    vectors = t.vectors
    return neighbours.nearest(vectors, vectors, k, id_col="id", vector_col="vec", **how)


def graph_of(t: Tables, distance: float) -> DataFrame:
    vectors = t.vectors
    pairs = neighbours.within(vectors, vectors, distance, id_col="id", vector_col="vec", half=True)
    return pairs.select(F.col("id").alias("a"), F.col("match").alias("b"), "cosine")


@query("cosine_top1", f"WITH {RANKED} SELECT id, match, round(cosine, 6) AS cosine, CASE WHEN 1 - cosine <= 0.127 THEN 'high' WHEN 1 - cosine <= 0.2 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank = 1", ("vectors",))
def cosine_top1(t: Tables) -> DataFrame:
    d = 1 - F.col("cosine")
    return near(t, 1).select("id", "match", F.round("cosine", 6).alias("cosine"), F.when(d <= 0.127, "high").when(d <= 0.2, "medium").otherwise("low").alias("confidence"))


@query("cosine_topn", f"WITH {RANKED} SELECT id, match, rank, round(cosine, 6) AS cosine FROM ranked WHERE rank <= 5", ("vectors",))
def cosine_topn(t: Tables) -> DataFrame:
    return near(t, 5).select("id", "match", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


@query("cosine_threshold_pairs", f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS cosine FROM vectors a JOIN vectors b ON a.id < b.id WHERE {COS} >= 1 - 0.7", ("vectors",))
def cosine_threshold_pairs(t: Tables) -> DataFrame:
    return graph_of(t, 0.7).withColumn("cosine", F.round("cosine", 6))


@query("latent_stats", f"SELECT a.id, round(min(1 - {COS}), 6) AS min_distance FROM vectors a JOIN vectors b ON a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY a.id", ("vectors",))
def latent_stats(t: Tables) -> DataFrame:
    best = neighbours.nearest(t.vectors.where("id % 2 = 1"), t.vectors.where("id % 2 = 0"), 1, id_col="id", vector_col="vec")
    return best.select("id", F.round(1 - F.col("cosine"), 6).alias("min_distance"))


@query("knn_vote", f"WITH {RANKED}, votes AS (SELECT id, label, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY ALL) SELECT id, label AS predicted, n AS votes FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1", ("vectors",))
def knn_vote(t: Tables) -> DataFrame:
    votes = near(t, 5).join(t.vectors.select(F.col("id").alias("match"), "label"), "match").groupBy("id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "label")
    return votes.withColumn("place", F.row_number().over(w)).where("place = 1").select("id", F.col("label").alias("predicted"), F.col("n").alias("votes"))


@query("rbf_weighted_vote", f"WITH {RANKED}, votes AS (SELECT id, label, round(sum(exp(-(1 - cosine) * (1 - cosine) / 0.25)), 6) AS w FROM ranked WHERE rank <= 5 GROUP BY ALL) SELECT id, label AS predicted, w AS weight FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1", ("vectors",))
def rbf_weighted_vote(t: Tables) -> DataFrame:
    d = 1 - F.col("cosine")
    votes = near(t, 5).join(t.vectors.select(F.col("id").alias("match"), "label"), "match").groupBy("id", "label").agg(F.round(F.sum(F.exp(-d * d / 0.25)), 6).alias("w"))
    w = Window.partitionBy("id").orderBy(F.desc("w"), "label")
    return votes.withColumn("place", F.row_number().over(w)).where("place = 1").select("id", F.col("label").alias("predicted"), F.col("w").alias("weight"))


@query(
    "reciprocal_best",
    f"WITH near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.label, {COS} AS value FROM vectors a JOIN vectors b ON a.label <> b.label), best AS MATERIALIZED (SELECT a, b, value FROM near QUALIFY row_number() OVER (PARTITION BY a, label ORDER BY value DESC, b) = 1) SELECT x.a, x.b, round(x.value, 6) AS value FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    ("vectors",),
)
def reciprocal_best(t: Tables) -> DataFrame:
    return neighbours.reciprocal_best_vectors(t.vectors).withColumn("value", F.round("value", 6))


EDGES = f"edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.id < b.id WHERE {COS} >= 1 - 0.65)"


@query("triangles", f"WITH {EDGES} SELECT x.a, x.b, y.b AS c FROM edges x JOIN edges y ON x.b = y.a JOIN edges z ON z.a = x.a AND z.b = y.b", ("vectors",))
def triangles(t: Tables) -> DataFrame:
    return neighbours.triangles(graph_of(t, 0.65))


@query("closed_edges", f"WITH {EDGES} SELECT x.a, x.b FROM edges x WHERE EXISTS (SELECT 1 FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) y JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) z ON y.b = z.a WHERE y.a = x.a AND z.b = x.b)", ("vectors",))
def closed_edges(t: Tables) -> DataFrame:
    return neighbours.closed_edges(graph_of(t, 0.65)).select("a", "b")


@query(
    "components",
    f"WITH RECURSIVE edges AS (SELECT a.id AS a, b.id AS b FROM (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings) a JOIN (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings) b ON a.id <> b.id WHERE {COS} >= 1 - 0.55), reach(id, got) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.got = e.a) SELECT id, min(got) AS component FROM reach GROUP BY id",
)
def components(t: Tables) -> DataFrame:
    return graph.connected_components(t.vectors.select("id"), neighbours.joining_edges(t.vectors, 0.55))


@query("greedy_cover")
def greedy_cover(t: Tables) -> DataFrame:
    return graph.greedy_cover(graph_of(t, 0.55), t.vectors.select("id"))


@query("seeded_cover")
def seeded_cover(t: Tables) -> DataFrame:
    return graph.seeded_cover(graph_of(t, 0.55), t.vectors.select("id"), t.vectors.where("id % 5 = 0").select("id"))


@query("agglomerative_average")
def agglomerative_average(t: Tables) -> DataFrame:
    return average_linkage(t.vectors, graph_of(t, 0.6), 0.6)


def average_linkage(vectors: DataFrame, edges: DataFrame, cut: float) -> DataFrame:
    """component, id, cluster, centre of every vector: average linkage on all distances inside the components of the pairs within the cut."""
    usable = vectors.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    edges = persisted(edges.select("a", "b"), "edges")
    placed = usable.join(graph.connected_components(usable.select("id"), edges), "id")
    alone = placed.join(placed.groupBy("component").count().where("count = 1"), "component", "left_semi")
    many = placed.join(alone.select("id"), "id", "left_anti")
    inner = edges.join(placed.select(F.col("id").alias("a"), "component"), "a")
    return graph.average_of_vectors(many, inner, "component", cut).union(alone.select("component", "id", F.lit(0), F.lit(True)))


@query("cluster_summary", "WITH n AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label) SELECT size, count(*) AS n_clusters FROM n GROUP BY size")
def cluster_summary(t: Tables) -> DataFrame:
    return graph.cluster_sizes(t.vectors.select("id", F.col("label").alias("cluster")))


@query(
    "cluster_medoid",
    f"WITH sums AS (SELECT a.label AS cluster, a.id, round(sum(1 - {COS}), 6) AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.id <> b.id GROUP BY ALL) SELECT cluster, id AS medoid FROM sums QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d, id) = 1",
    ("vectors",),
)
def cluster_medoid(t: Tables) -> DataFrame:
    return graph.medoid_of_vectors(t.vectors.withColumnRenamed("label", "cluster"))


@query("folds_leave_similar_out")
def folds_leave_similar_out(t: Tables) -> DataFrame:
    def reached(test: DataFrame) -> DataFrame:
        placed = t.vectors.join(test.select(F.col("entity").alias("id"), F.col("fold").alias("group")), "id")
        return neighbours.groups_within(placed, 0.6, 10).select(F.col("group").alias("fold"), F.col("id").alias("entity"))

    return folds.make_folds(t.vectors.select(F.col("id").alias("entity")), 10, reached=reached)


@query("tail_split", "SELECT id, CASE WHEN percent_rank() OVER (ORDER BY id) > 1 - 0.2 THEN 'test' ELSE 'train' END AS role FROM vectors", ("vectors",))
def tail_split(t: Tables) -> DataFrame:
    return folds.tail_split(t.vectors.select("id"), 0.2, "id")
