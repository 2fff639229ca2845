"""Writers of long tables: Parquet and CSV directly, text formats as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(sim: DataFrame, path: str, digits: int = 4) -> None:
    sim.withColumn("value", F.round("value", digits)).write.mode("overwrite").parquet(path)


def write_sparse(profile: DataFrame, path: str) -> None:
    """Long tables are sparse already: only values other than 0 are kept."""
    profile.where("value <> 0").write.mode("overwrite").parquet(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True)


def write_folds(folds: DataFrame, path: str) -> None:
    folds.write.mode("overwrite").partitionBy("fold").parquet(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("entity").cast("string")), "seq")).write.mode("overwrite").text(path)


def write_scored_fasta(scored: DataFrame, path: str) -> None:
    """entity, seq, rows (arrays of numbers); null stands as X."""
    rows = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), ",", "X"))
    scored.select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("entity").cast("string")), "seq", F.array_join(rows, "\n"))).write.mode("overwrite").text(path)


def write_pwm(pwm: DataFrame, path: str, digits: int = 6) -> None:
    """A block for each motif: its name, a line of bases, numbered rows."""
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "p"))), lambda s: F.format_number(s["p"], digits)), "\t")
    rows = pwm.groupBy("motif", "pos").agg(F.concat_ws("\t", F.col("pos").cast("string"), cells).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda s: s["row"]), "\n")
    rows.groupBy("motif").agg(F.concat_ws("\n", F.concat(F.lit("Motif "), F.col("motif")), F.lit("Pos\tA\tC\tG\tU"), body, F.lit("")).alias("value")).select("value").write.mode("overwrite").text(path)


def write_cluster_sheet(members: DataFrame, path: str, column: str = "species") -> None:
    """A row for each cluster, a column for each species with its members."""
    members.groupBy("cluster").pivot(column).agg(F.array_join(F.array_sort(F.collect_list("id")), ",")).write.mode("overwrite").csv(path, header=True, sep="\t")
