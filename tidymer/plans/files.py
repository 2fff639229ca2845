"""Queries that write the driver's tables in the text formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import BLOSUM62, substitution_scores
from ..operators.stores import scratch
from ..sources import readers, writers
from .registry import CTE, Tables, query


def text_file(t: Tables, lines: DataFrame, order: list[str], name: str, head: str = "") -> str:
    """The path of one text of the lines (column line) in order, as formats whose records span lines are read whole."""
    path = scratch(t.spark, name)
    listed = F.array_sort(F.collect_list(F.struct(*order, "line")))
    lines.agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda r: r["line"]), "\n")).alias("value")).write.text(path)
    return path


def joined(order: str, value: Column, separator: str = " ") -> Column:
    """Values of a group in an order, as text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda r: r["v"].cast("string")), separator)


def sequences(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("seq"))


@query("read_fasta", "SELECT p_partkey::VARCHAR AS entity, 0 AS part, upper(replace(p_name, ' ', '')) AS seq FROM part")
def read_fasta(t: Tables) -> DataFrame:
    path = scratch(t.spark, "fasta")
    writers.write_fasta(sequences(t), path)
    return readers.read_fasta(t.spark, path)


@query("read_fasta_parts", "SELECT p_brand AS entity, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS part, upper(replace(p_name, ' ', '')) AS seq FROM part")
def read_fasta_parts(t: Tables) -> DataFrame:
    path = scratch(t.spark, "fasta")
    own = t.part.groupBy(F.replace("p_brand", F.lit(" "), F.lit("_")).alias("entity")).agg(joined("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), "*").alias("seq"))
    writers.write_fasta(own, path)
    return readers.read_fasta(t.spark, path).withColumn("part", F.col("part").cast("long"))


@query("read_scored_fasta", "SELECT p_partkey::VARCHAR AS entity, upper(replace(p_name, ' ', '')) AS seq, i::BIGINT AS pos, CASE WHEN ascii(substring(upper(replace(p_name, ' ', '')), i, 1)) = 69 THEN NULL ELSE ascii(substring(upper(replace(p_name, ' ', '')), i, 1))::DOUBLE END AS score FROM part, range(1, 100) r(i) WHERE i <= length(replace(p_name, ' ', ''))")
def read_scored_fasta(t: Tables) -> DataFrame:
    path = scratch(t.spark, "scored")
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    scores = F.transform(letters, lambda x: F.when(x != "E", F.ascii(x).cast("double")))
    writers.write_scored_fasta(sequences(t).withColumn("rows", F.array(scores)), path)
    return readers.read_scored_fasta(t.spark, path).select("entity", "seq", F.posexplode(F.get("rows", F.lit(0))).alias("i", "score")).select("entity", "seq", (F.col("i") + 1).cast("long").alias("pos"), "score")


@query("read_profile_txt", f"WITH {CTE['profile']} SELECT entity::VARCHAR AS entity, replace(feature, ' ', '_') AS feature, value FROM profile")
def read_profile_txt(t: Tables) -> DataFrame:
    p = t.profile.withColumn("feature", F.replace("feature", F.lit(" "), F.lit("_")))
    names = p.select("entity").distinct().agg(F.concat(F.lit("feature "), F.array_join(F.array_sort(F.collect_list("entity")), " ")).alias("line")).withColumn("feature", F.lit(""))
    grid = p.select("entity").distinct().join(p.select("feature").distinct()).join(p, ["entity", "feature"], "left")
    body = grid.groupBy("feature").agg(F.concat_ws(" ", "feature", joined("entity", F.coalesce("value", F.lit(0.0)))).alias("line"))
    found = readers.read_profile_txt(t.spark, text_file(t, names.select("feature", "line").union(body.select("feature", "line")), ["feature"], "profile"))
    return found.where("value <> 0")


def steps(t: Tables) -> DataFrame:
    a, b = (t.nation.select(F.replace("n_name", F.lit(" "), F.lit("_")).alias(x), F.col("n_nationkey").alias(f"{x}_key")) for x in "ab")
    return a.join(b).withColumn("value", F.abs(F.col("a_key") - F.col("b_key")) / 4.0)


STEPS = "SELECT replace(x.n_name, ' ', '_') AS a, replace(y.n_name, ' ', '_') AS b, abs(x.n_nationkey - y.n_nationkey) / 4.0::DOUBLE AS value FROM nation x, nation y"


@query("read_matrix_txt", STEPS)
def read_matrix_txt(t: Tables) -> DataFrame:
    names = t.nation.agg(F.concat(F.lit("# "), joined("n_nationkey", F.concat(F.lit("n||"), F.replace("n_name", F.lit(" "), F.lit("_"))))).alias("line")).withColumn("a_key", F.lit(-1))
    body = steps(t).groupBy("a_key").agg(joined("b_key", F.col("value")).alias("line"))
    return readers.read_matrix_txt(t.spark, text_file(t, names.select("a_key", "line").union(body), ["a_key"], "matrix"))


@query("read_blocks_sim", STEPS + " WHERE x.n_nationkey <> y.n_nationkey")
def read_blocks_sim(t: Tables) -> DataFrame:
    s = steps(t).withColumn("block", F.floor(F.col("b_key") / 10))
    heads = t.nation.groupBy(F.floor(F.col("n_nationkey") / 10).alias("block")).agg(F.concat(F.lit("#"), joined("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")))).alias("line")).withColumn("a_key", F.lit(-1))
    body = s.groupBy("block", "a_key", "a").agg(F.concat_ws(" ", "a", joined("b_key", F.col("value"))).alias("line"))
    lines = heads.select("block", "a_key", "line").union(body.select("block", "a_key", "line"))
    return readers.read_blocks_sim(t.spark, text_file(t, lines, ["block", "a_key"], "blocks"))


@query("read_folds", "SELECT f.fold::BIGINT AS fold, CASE WHEN s_suppkey % 4 = f.fold THEN 'test' ELSE 'train' END AS role, s_suppkey::VARCHAR AS entity FROM supplier, range(0, 4) f(fold)")
def read_folds(t: Tables) -> DataFrame:
    dealt = t.supplier.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("test", (F.col("s_suppkey") % 4 == F.col("fold")).cast("int"))
    body = dealt.groupBy("fold", "test").agg(F.concat_ws("\n", F.when(F.col("test") == 1, "##Test:").otherwise("##Train:"), joined("s_suppkey", F.col("s_suppkey"), "\n")).alias("line"))
    heads = t.spark.range(4).select(F.col("id").cast("int").alias("fold"), F.lit(-1).alias("test"), F.concat(F.lit("###Set "), F.col("id")).alias("line"))
    return readers.read_folds(t.spark, text_file(t, heads.union(body), ["fold", "test"], "folds")).select(F.col("fold").cast("long").alias("fold"), "role", "entity")


@query("read_pwm", "SELECT replace(p_brand, ' ', '_') AS motif, (k - 1)::BIGINT AS pos, b AS base, round(count(*) FILTER (substring('ACGU', 1 + ascii(substring(p_name, k, 1)) % 4, 1) = b) / count(*)::DOUBLE, 4) AS p FROM part, range(1, 6) r(k), (VALUES ('A'), ('C'), ('G'), ('U')) v(b) GROUP BY ALL")
def read_pwm(t: Tables) -> DataFrame:
    path = scratch(t.spark, "pwm")
    letter = F.substring(F.lit("ACGU"), 1 + F.ascii(F.substring("p_name", F.col("pos") + 1, F.lit(1))) % 4, F.lit(1))
    rows = t.part.select(F.replace("p_brand", F.lit(" "), F.lit("_")).alias("motif"), "p_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    spread = rows.withColumn("own", letter).withColumn("base", F.explode(F.array(*map(F.lit, "ACGU"))))
    writers.write_pwm(spread.groupBy("motif", "pos", "base").agg(F.avg((F.col("own") == F.col("base")).cast("double")).alias("p")), path)
    return readers.read_pwm(t.spark, path).select("motif", F.col("pos").cast("long").alias("pos"), "base", F.round("p", 4).alias("p"))


@query("read_msa", "SELECT p_partkey::VARCHAR AS seq_id, (i - 1)::BIGINT AS pos, translate(upper(substring(p_name, i, 1)), 'BZX ', 'DQ--') AS aa FROM part, range(1, 9) r(i) WHERE i <= length(p_name)")
def read_msa(t: Tables) -> DataFrame:
    path = scratch(t.spark, "msa")
    writers.write_fasta(t.part.select(F.col("p_partkey").alias("entity"), F.translate(F.substring("p_name", 1, 8), " ", ".").alias("seq")), path)
    return readers.read_msa(t.spark, path).select("seq_id", F.col("pos").cast("long").alias("pos"), "aa")


@query("read_scoring_matrix", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {v}.0::DOUBLE)" for (a, b), v in sorted(substitution_scores().items())) + ") v(a, b, score)")
def read_scoring_matrix(t: Tables) -> DataFrame:
    path = scratch(t.spark, "scores")
    t.spark.createDataFrame([(BLOSUM62.strip("\n"),)], "value string").write.text(path)
    return readers.read_scoring_matrix(t.spark, path)


@query("read_master_tsv", "SELECT s_suppkey::VARCHAR AS id, k::VARCHAR AS place, (s_nationkey * k)::VARCHAR AS product FROM supplier, range(1, 4) r(k)")
def read_master_tsv(t: Tables) -> DataFrame:
    path = scratch(t.spark, "master")
    rows = t.supplier.select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.lit("1,2,3"), F.array_join(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: (k * F.col("s_nationkey")).cast("string")), ", ")).alias("value"))
    t.spark.createDataFrame([("id\tplace\tproduct",)], "value string").union(rows).coalesce(1).write.text(path)
    return readers.read_master_tsv(t.spark, path, ["place", "product"])


@query("read_score_col", "SELECT s_suppkey::VARCHAR AS entity, -s_acctbal AS score FROM supplier")
def read_score_col(t: Tables) -> DataFrame:
    lines = t.supplier.select("s_suppkey", F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string")).alias("line"))
    return readers.read_score_col(t.spark, text_file(t, lines, ["s_suppkey"], "scores", "# id nation balance\n"), "-2")


@query("read_infofile", "SELECT 'p' || s_suppkey AS name, 2 AS n, 'D' || s_nationkey || ',E' AS domains, '1-9,10-19' AS locations, 'ACD,EFG' AS seqs FROM supplier")
def read_infofile(t: Tables) -> DataFrame:
    lines = t.supplier.select("s_suppkey", F.concat(F.lit("p"), "s_suppkey", F.lit(" 2 D"), "s_nationkey", F.lit(" E 1-9 10-19 ACD EFG")).alias("line"))
    return readers.read_infofile(t.spark, text_file(t, lines, ["s_suppkey"], "info")).select("name", "n", *(F.array_join(c, ",").alias(c) for c in ("domains", "locations", "seqs")))


@query("read_affprofiles", f"WITH {CTE['profile']}, p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY entity) - 1 AS k FROM profile) SELECT replace(feature, ' ', '_') AS feature, k AS \"column\", value FROM p")
def read_affprofiles(t: Tables) -> DataFrame:
    p = t.profile.withColumn("feature", F.replace("feature", F.lit(" "), F.lit("_")))
    lines = p.groupBy("feature").agg(F.concat_ws(" ", F.lit("0"), "feature", joined("entity", F.col("value"))).alias("line"))
    return readers.read_affprofiles(t.spark, text_file(t, lines, ["feature"], "affinities", "skipped\n")).withColumn("column", F.col("column").cast("long"))


@query("write_csv_quoted", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")
def write_csv_quoted(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    writers.write_csv_quoted(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path)
    return t.spark.read.csv(path, header=True)


@query("write_matrix", STEPS.replace("abs(x.n_nationkey - y.n_nationkey) / 4.0::DOUBLE", "round(abs(x.n_nationkey - y.n_nationkey) / 7.0::DOUBLE, 4)"))
def write_matrix(t: Tables) -> DataFrame:
    path = scratch(t.spark, "matrix")
    writers.write_matrix(steps(t).select("a", "b", (F.abs(F.col("a_key") - F.col("b_key")) / 7.0).alias("value")), path)
    return t.spark.read.parquet(path)


@query("write_sparse", "SELECT l_orderkey, l_linenumber, l_discount AS value FROM lineitem WHERE l_discount <> 0")
def write_sparse(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sparse")
    writers.write_sparse(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value")), path)
    return t.spark.read.parquet(path)


@query("write_folds", "SELECT s_suppkey % 5 AS fold, 'test' AS role, s_suppkey AS entity FROM supplier")
def write_folds(t: Tables) -> DataFrame:
    path = scratch(t.spark, "folds")
    writers.write_folds(t.supplier.select((F.col("s_suppkey") % 5).alias("fold"), F.lit("test").alias("role"), F.col("s_suppkey").alias("entity")), path)
    return t.spark.read.parquet(path).select(F.col("fold").cast("long").alias("fold"), "role", "entity")


@query("write_cluster_sheet", "SELECT s_nationkey::VARCHAR AS cluster, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 0) AS even, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 1) AS odd FROM supplier GROUP BY s_nationkey")
def write_cluster_sheet(t: Tables) -> DataFrame:
    path = scratch(t.spark, "sheet")
    members = t.supplier.select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("species"))
    writers.write_cluster_sheet(members, path)
    return t.spark.read.csv(path, sep="\t", header=True).select("cluster", "even", "odd")
