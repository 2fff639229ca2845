"""Readers of the text formats of sequence, profile, motif and structure data.

Files come in whole (one row a file, by Spark's reader, so any store works) where records span lines, and line by line
otherwise; splitting is done by JVM expressions, and by Arrow-fed parsers only for report formats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """file, line number from 0 and line of every file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    return text.select("file", F.posexplode(lines).alias("n", "line"))


def _number(c: Column) -> Column:
    """Double; what is no number or NaN is 0."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)


def _groups(lines: DataFrame, starts: Column) -> DataFrame:
    """Lines with the number of record heads up to them in their file (0: before the first)."""
    return lines.withColumn("record", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("n")))


def read_profile_txt(spark: SparkSession, path: str) -> DataFrame:
    """entity, feature, value of a white-space table: names in its header, features in the first column."""
    lines = _whole(spark, path).where("trim(line) <> ''").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    head = lines.where("n = 0").select("file", F.col("cells").alias("names"))
    body = lines.where("n > 0").join(head, "file")
    shift = F.size("names") - F.size("cells") + 1  # the header may or may not name the first column
    return body.select(F.element_at("cells", 1).alias("feature"), F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("i", "v"), "names", shift.alias("shift")).select(F.get("names", F.col("i") + F.col("shift")).alias("entity"), "feature", _number(F.col("v")).alias("value"))


def read_affprofiles(spark: SparkSession, path: str) -> DataFrame:
    """One line skipped; feature in the second column, values from the third: feature, column, value."""
    cells = _whole(spark, path).where("n > 0 AND trim(line) <> ''").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    return cells.select(F.element_at("cells", 2).alias("feature"), F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("column", "v")).select("feature", "column", _number(F.col("v")).alias("value"))


def read_glob_lastcol(spark: SparkSession, glob: str, part: int = 0, separator: str = "_") -> DataFrame:
    """entity (a part of the file's name), feature (first column), value (last column) of many files."""
    cells = _whole(spark, glob).where("trim(line) <> ''").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    return cells.select(F.get(F.split("file", separator), F.lit(part)).alias("entity"), F.element_at("cells", 1).alias("feature"), _number(F.element_at("cells", -1)).alias("value"))


def read_npz(spark: SparkSession, path: str, matrix: str, rows: str, columns: str) -> DataFrame:
    """feature, entity, value of an archive's matrix (rows x columns), read as binary files on the executors; pickled members are refused."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    m, r, c = z[matrix], z[rows].astype(str), z[columns].astype(str)
                i, j = np.nonzero(m)
                yield pd.DataFrame({"feature": r[i], "entity": c[j], "value": np.nan_to_num(m[i, j].astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "feature string, entity string, value double")


def read_matrix_txt(spark: SparkSession, path: str) -> DataFrame:
    """a, b, value of a square table whose header (after #) names its columns and, in order, its rows; of a||b names the part after || stays."""
    lines = _whole(spark, path).where("trim(line) <> ''")
    head = lines.where("line LIKE '#%'").select("file", F.transform(F.split(F.trim(F.regexp_replace("line", "^#+", "")), r"\s+"), lambda x: F.substring_index(x, "||", -1)).alias("names"))
    body = lines.where("line NOT LIKE '#%'").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1).join(head, "file")
    return body.select(F.get("names", F.col("i")).alias("a"), "names", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("j", "v")).select("a", F.get("names", F.col("j")).alias("b"), _number(F.col("v")).alias("value"))


def read_blocks_sim(spark: SparkSession, path: str) -> DataFrame:
    """a, b, value of repeated blocks: a line # names, then lines of a name and its values; pairs with itself are left out."""
    lines = _groups(_whole(spark, path).where("trim(line) <> ''"), F.col("line").startswith("#"))
    head = lines.where("line LIKE '#%'").select("file", "record", F.split(F.trim(F.regexp_replace("line", "^#+", "")), r"\s+").alias("names"))
    body = lines.where("line NOT LIKE '#%'").withColumn("cells", F.split(F.trim("line"), r"\s+")).join(head, ["file", "record"])
    return body.select(F.element_at("cells", 1).alias("a"), "names", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("j", "v")).select("a", F.get("names", F.col("j")).alias("b"), _number(F.col("v")).alias("value")).where("a <> b")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """entity (head up to a blank), part, seq; lines of a record are joined, '*' parts a sequence."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^>")).alias("r")).where("trim(r) <> ''")
    cut = records.select(F.regexp_extract("r", r"^(\S*)", 1).alias("entity"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("s"))
    return cut.select("entity", F.posexplode(F.split("s", r"\*")).alias("part", "seq"))


def read_infofile(spark: SparkSession, path: str) -> DataFrame:
    """name, n, domains, locations, seqs of lines 'name n dom... loc... seq...' with n of each."""
    cells = _whole(spark, path).where("trim(line) <> ''").withColumn("c", F.split(F.trim("line"), r"\s+")).withColumn("k", F.element_at("c", 2).cast("int"))
    return cells.select(F.element_at("c", 1).alias("name"), F.col("k").alias("n"), F.slice("c", 3, F.col("k")).alias("domains"), F.slice("c", F.col("k") + 3, F.col("k")).alias("locations"), F.slice("c", -F.greatest(F.col("k"), F.lit(1)), F.col("k")).alias("seqs"))


def read_scored_fasta(spark: SparkSession, path: str) -> DataFrame:
    """entity, seq, rows: each row of comma-separated numbers as an array; X stays null (masked), ? becomes 0."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^>")).alias("r")).where("trim(r) <> ''").withColumn("l", F.filter(F.split("r", r"\r?\n"), lambda x: F.trim(x) != ""))
    numbers = F.transform(F.slice("l", 3, F.size("l")), lambda row: F.transform(F.split(F.trim(row), ","), lambda v: F.when(v == "X", F.lit(None).cast("double")).when(v == "?", 0.0).otherwise(v.try_cast("double"))))
    return records.select(F.regexp_extract(F.element_at("l", 1), r"^(\S*)", 1).alias("entity"), F.trim(F.element_at("l", 2)).alias("seq"), numbers.alias("rows"))


def read_pwm(spark: SparkSession, path: str) -> DataFrame:
    """motif, pos, base, p of blocks: a line 'Motif name', a comment, a line 'Pos A C G U', rows of numbers."""
    lines = _groups(_whole(spark, path).where("trim(line) <> ''"), F.col("line").rlike(r"^Motif\s")).withColumn("cells", F.split(F.trim("line"), r"\s+"))
    heads = lines.where(F.col("line").rlike(r"^Motif\s")).select("file", "record", F.element_at("cells", 2).alias("motif"))
    bases = lines.where(F.col("line").rlike(r"^Pos\s")).select("file", "record", F.slice("cells", 2, F.size("cells")).alias("bases"))
    rows = lines.where(F.col("line").rlike(r"^\d+\s")).join(heads, ["file", "record"]).join(bases, ["file", "record"])
    return rows.select("motif", (F.element_at("cells", 1).cast("int")).alias("row"), "bases", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("i", "v")).select("motif", "row", F.get("bases", F.col("i")).alias("base"), F.col("v").cast("double").alias("p")).withColumn("pos", F.col("row") - F.min("row").over(_by("motif"))).select("motif", "pos", "base", "p")


def read_pwm_logos(spark: SparkSession, path: str) -> DataFrame:
    """motif, logo, n_kmers, score of the comment line of each block."""
    lines = _groups(_whole(spark, path).where("trim(line) <> ''"), F.col("line").rlike(r"^Motif\s")).withColumn("cells", F.split(F.trim("line"), r"\s+"))
    heads = lines.where(F.col("line").rlike(r"^Motif\s")).select("file", "record", F.element_at("cells", 2).alias("motif"))
    notes = lines.where(F.col("line").startswith("#")).select("file", "record", F.filter(F.split(F.regexp_replace("line", "^#+", ""), r"\s+"), lambda x: x != "").alias("c"))
    return heads.join(notes, ["file", "record"]).select("motif", F.get("c", F.lit(0)).alias("logo"), F.get("c", F.lit(1)).try_cast("int").alias("n_kmers"), F.get("c", F.lit(2)).try_cast("double").alias("score"))


def _by(column: str) -> WindowSpec:
    return Window.partitionBy(column)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """fold, role, entity of blocks ###Set i / ##Train: / names / ##Test: / names."""
    lines = _groups(_whole(spark, path).where("trim(line) <> ''"), F.col("line").startswith("###"))
    w = _ordered("file", "record", order="n")
    role = F.last(F.when(F.col("line").rlike("^##[^#]"), F.lower(F.regexp_extract("line", r"^##\s*(\w+)", 1))), ignorenulls=True).over(w)
    marked = lines.withColumn("role", role).where("line NOT LIKE '##%'")
    return marked.select((F.col("record") - 1).cast("int").alias("fold"), "role", F.explode(F.split(F.trim("line"), r"\s+")).alias("entity"))


def _ordered(*by: str, order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def read_hmmer(spark: SparkSession, path: str) -> DataFrame:
    """query, target, dom, evalue, bits, from, to of the domain tables in text reports."""
    kind = "query string, target string, dom int, evalue double, bits double, start int, stop int"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, query, target = [], None, None
            for text in pdf.value:
                for line in text.splitlines():
                    cells = line.split()
                    if line.startswith("Query:"):
                        query = cells[1]
                    elif line.startswith(">>"):
                        target = cells[1]
                    elif len(cells) >= 16 and cells[0].isdigit() and cells[1] in "!?":
                        rows.append((query, target, int(cells[0]), float(cells[5]), float(cells[2]), int(cells[9]), int(cells[10])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, kind)


def read_dssp(spark: SparkSession, path: str) -> DataFrame:
    """pdb, chain, seq, secstr of records '>pdb:chain:sequence' and '>pdb:chain:secstr'; a blank state becomes C."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^>")).alias("r")).where("trim(r) <> ''")
    cut = records.select(F.split(F.regexp_extract("r", r"^([^\n]*)", 1), ":").alias("h"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n", ""), r"[\r\n]", "").alias("s"))
    named = cut.select(F.lower(F.get("h", F.lit(0))).alias("pdb"), F.get("h", F.lit(1)).alias("chain"), F.trim(F.get("h", F.lit(2))).alias("kind"), "s")
    return named.groupBy("pdb", "chain").agg(F.max(F.when(F.col("kind") == "sequence", F.col("s"))).alias("seq"), F.max(F.when(F.col("kind") == "secstr", F.translate("s", " ", "C"))).alias("secstr"))


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """pdb, record, chain, res_no, res, atom, x, y, z of the fixed-width ATOM and HETATM lines."""
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.\w+$", "").alias("pdb"), "value").where(F.col("value").rlike("^(ATOM|HETATM)"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return lines.select("pdb", cut(1, 6).alias("record"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("res_no"), cut(18, 3).alias("res"), cut(13, 4).alias("atom"), *(cut(a, 8).cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))))


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """a, b, dist: half the path length between each two leaves of a tree (a < b)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf.value:
                yield pd.DataFrame(leaf_distances(text), columns=["a", "b", "dist"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "a string, b string, dist double")


def leaf_distances(newick: str) -> list[tuple[str, str, float]]:
    """Half of every leaf pair's path length, from the lengths down to each leaf of the two sides of their last common node."""
    import re

    stack: list[list[dict[str, float]]] = [[]]
    out: list[tuple[str, str, float]] = []
    done: dict[str, float] | None = None
    for token in re.findall(r"[(),;]|:[^(),;]+|[^(),:;]+", newick.strip()):
        if token == "(":
            stack.append([])
        elif token in ",)":
            if done is not None:
                stack[-1].append(done)
                done = None
            if token == ")":
                done, sides = {}, stack.pop()
                for side in sides:
                    out += [(min(x, y), max(x, y), (dx + dy) / 2) for x, dx in done.items() for y, dy in side.items()]
                    done |= side
        elif token.startswith(":"):
            done = {k: v + float(token[1:]) for k, v in (done or {}).items()}
        elif token != ";" and done is None and token.strip():
            done = {token.strip(): 0.0}
    return out


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, pos, aa of an aligned FASTA or CLUSTAL file; B, Z become D, Q and X, '.' gaps."""
    text = spark.read.text(path, wholetext=True)
    fasta = text.where(F.ltrim("value").startswith(">")).select(F.explode(F.split("value", "(?m)^>")).alias("r")).where("trim(r) <> ''").select(F.regexp_extract("r", r"^(\S*)", 1).alias("seq_id"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"))
    rows = text.where(~F.ltrim("value").startswith(">")).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.col("line").rlike(r"^\S+\s+\S+")).where("line NOT LIKE 'CLUSTAL%'")
    blocks = rows.select(F.regexp_extract("line", r"^(\S+)", 1).alias("seq_id"), "n", F.regexp_extract("line", r"^\S+\s+(\S+)", 1).alias("piece"))
    clustal = blocks.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]), "").alias("seq"))
    return fasta.union(clustal).select("seq_id", F.posexplode(F.split(F.translate(F.upper("seq"), "BZX.", "DQ--"), "")).alias("pos", "aa")).where("aa <> ''")


def read_scoring_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a letter table; a lower triangle is mirrored."""
    lines = _whole(spark, path).where("trim(line) <> '' AND line NOT LIKE '#%'").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    head = lines.withColumn("first", F.min("n").over(_by("file"))).where("n = first").select("file", F.col("cells").alias("letters"), "first")
    body = lines.join(head, "file").where("n > first").select(F.element_at("cells", 1).alias("a"), "letters", F.posexplode(F.slice("cells", 2, F.size("cells"))).alias("j", "v"))
    half = body.select("a", F.get("letters", F.col("j")).alias("b"), F.col("v").cast("double").alias("score"))
    return half.union(half.select("b", "a", "score")).distinct()


def read_master_tsv(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """Rows of a table whose comma-separated cells in ``lists`` are taken apart together, one row for each position."""
    table = spark.read.csv(path, sep="\t", header=True)
    zipped = F.explode(F.arrays_zip(*(F.split(c, ",").alias(c) for c in lists)))
    return table.withColumn("_item", zipped).select(*(c for c in table.columns if c not in lists), *(F.trim(F.col("_item")[c]).alias(c) for c in lists))


def read_score_col(spark: SparkSession, path: str, column: str) -> DataFrame:
    """entity (first column) and score: the column at a position, which a leading '-' negates."""
    sign, place = (-1.0, int(column[1:])) if column.startswith("-") else (1.0, int(column))
    cells = _whole(spark, path).where("trim(line) <> '' AND line NOT LIKE '#%'").withColumn("cells", F.split(F.trim("line"), r"\s+"))
    return cells.select(F.element_at("cells", 1).alias("entity"), (sign * F.get("cells", F.lit(place)).try_cast("double")).alias("score"))
