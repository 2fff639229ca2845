"""All queries by name and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables under one folder, read where they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def profile(self) -> DataFrame:
        """Revenue of suppliers (entity) by brand (feature)."""
        joined = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return joined.groupBy(F.col("l_suppkey").alias("entity"), F.col("p_brand").alias("feature")).agg(F.round(F.sum(amount), 4).alias("value"))

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))

    @property
    def centroids(self) -> DataFrame:
        """Mean embedding of each label (entity) as a long profile, 6 decimals."""
        long = self.embeddings.select(F.col("label").alias("entity"), F.posexplode("embedding").alias("feature", "x"))
        return long.groupBy("entity", "feature").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))

    @property
    def scored(self) -> DataFrame:
        """Documents with labels: score is the length, quality the label."""
        return self.documents.join(self.labels, "doc_id").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"), "quality", "toxic")


#: The same frames for DuckDB, to stand after WITH.
CTE = {
    "profile": "profile AS (SELECT l_suppkey AS entity, p_brand AS feature, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "vectors": "vectors AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)",
    "centroids": "centroids AS (SELECT label AS entity, i - 1 AS feature, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL)",
    "scored": "scored AS (SELECT doc_id, source, lang, n_chars::DOUBLE AS score, quality, toxic FROM documents JOIN labels USING (doc_id))",
}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function of Tables; ``sql`` may begin with the frames named in ``uses``."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            body = sql.strip()
            heads = ", ".join(CTE[u] for u in uses)
            if heads:
                body = f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
            ORACLES[name] = body
        return f

    return register


for _module in ("vectors", "profiles", "sequences", "statistics", "models", "more", "annotations", "files"):
    importlib.import_module(f"tidymer.plans.{_module}")
