"""Mixing sources to target weights by weighted fair queueing.

Each source's documents come in a fixed shuffled order, twice over; a document's virtual finish time is its source's
cumulative words divided by the source's target. All times are range-sorted over the cluster and cut where the words
taken reach the total budget, so every source stops within a document of its target.

A source's running sum does not pass through one task: its documents fall into about sqrt(n) buckets of the shuffle
key, sums of earlier buckets are added to the sum inside a bucket. The cut is found from the sums of the sorted
partitions and then inside the one partition in which it lies. Only the table of sources (a row each) is sorted whole.

Nulls: a null text has size 0, a null source is a source of its own and sorts last, a null id shuffles like an empty
one. Documents of size 0 are never taken. Rows that share id, source and size are peers and get equal results. Only the
columns id, text and source are read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, drop_written, written


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """source, source_size, n_docs -> with rank and target: ``share`` of all words by weight, none above ``epochs`` times its size.

    A common level times the weights, cut at the caps, spends the budget: with sources in order of cap per weight, the
    level before each source is what the capped ones leave, over the weights that remain; the first source whose cap lies above it sets it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy("need", "rank")
    cap = epochs * F.col("source_size").cast("double")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    level = (F.lit(share) * F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("need", cap / F.col("weight")).withColumn("level", level)
    common = F.min(F.when(F.col("need") > F.col("level"), F.struct("need", "rank", "level"))).over(Window.partitionBy())["level"]
    return leveled.select("source", "source_size", "n_docs", "rank", F.least(cap, F.coalesce(F.col("weight") * common, cap)).alias("target"))


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """id, source, size, source_size, target, taken (words that the mix takes, repeats counted) of every row."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slim = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), key.alias("key")), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = written(targets(sizes, weights, share, epochs), "targets")

    joined = slim.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    bits = F.floor(F.log2("n_docs") / 2).cast("int") + 1
    dealt = joined.withColumn("bucket", F.floor(spread / F.pow(F.lit(2.0), 32 - bits)))
    sums = dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    earlier = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("key", "size"))  # by range: peers share the sum
    done = dealt.withColumn("inside", inside).join(earlier, ["rank", "bucket"]).withColumn("done", F.col("earlier") + F.col("inside"))
    finish = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: (e * F.col("source_size") + F.col("done")) / F.col("target")))
    timed = written(done.select("id", "source", "size", "source_size", "target", finish.alias("finish")), "times")

    cut = _cut(timed.select("size", F.explode("finish").alias("at")), timed.sparkSession, sources.agg(F.sum("source_size")).first()[0], share)
    drop_written(slim)
    drop_written(sources)
    taken = F.coalesce(F.size(F.filter("finish", lambda t: t <= F.lit(cut))), F.lit(0)) if cut is not None else F.lit(0)
    rows = timed.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * taken).otherwise(F.lit(0)).cast("long"))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def _cut(events: DataFrame, spark, total: int | None, share: float) -> float | None:
    """The last finish time up to which the words of all events stay within the budget."""
    ordered = written(events.repartitionByRange("at").sortWithinPartitions("at").withColumn("part", F.spark_partition_id()), "order")
    last = _crossing(ordered, share * (total or 0))
    drop_written(ordered)
    return last


def _crossing(ordered: DataFrame, budget: float) -> float | None:
    sums = ordered.groupBy("part").agg(F.sum("size").alias("words"), F.max("at").alias("last"))
    parts = sums.withColumn("upto", F.sum("words").over(Window.orderBy("part"))).where(F.col("upto") > budget).orderBy("part").limit(1)
    crossed = parts.select("part", (F.col("upto") - F.col("words")).alias("before")).first()
    if crossed is None:
        return ordered.agg(F.max("at")).first()[0]
    inside = ordered.where(F.col("part") == crossed["part"]).select("at", (F.sum("size").over(Window.orderBy("at")) + crossed["before"]).alias("upto"))
    last = inside.where(F.col("upto") <= budget).agg(F.max("at")).first()[0]
    return last if last is not None else ordered.where(F.col("part") < crossed["part"]).agg(F.max("at")).first()[0]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (not at all, once, ... up to ``epochs`` times)."""
    planned = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("taken > 0")
    copies = planned.select(F.col(id_col).alias("mix_id"), F.col(source_col).alias("mix_source"), (F.col("taken") / F.col("size")).cast("int").alias("mix_copies"), F.col("size").alias("mix_size")).distinct()
    same = docs[id_col].eqNullSafe(copies["mix_id"]) & docs[source_col].eqNullSafe(copies["mix_source"]) & (size_of(text_col) == copies["mix_size"])
    repeated = docs.join(copies, same).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return repeated.select(*(docs[c] for c in docs.columns))


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM sums),
needed AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS need FROM weighed),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY need, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY need, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM needed),
common AS (SELECT arg_min(level, need) AS level FROM leveled WHERE need > level),
targets AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM common), cap)) AS target FROM leveled),
done AS (SELECT s.*, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size) AS done FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
events AS (SELECT size, (done + e * source_size)::DOUBLE / target AS finish FROM done, (VALUES (0), (1)) v(e) WHERE size > 0),
running AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS upto FROM events),
cut AS (SELECT max(finish) AS finish FROM running WHERE upto <= 1.5 * (SELECT sum(size) FROM sized))
SELECT doc_id, size::BIGINT AS size, source_size, target,
    CASE WHEN size > 0 THEN size * ((coalesce(done::DOUBLE / target <= (SELECT finish FROM cut), false))::INT + (coalesce((done + source_size)::DOUBLE / target <= (SELECT finish FROM cut), false))::INT) ELSE 0 END::BIGINT AS taken
FROM done
"""
