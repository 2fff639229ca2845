"""Readers and writers on small files."""

from __future__ import annotations

import pytest

from tidymer.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    return write


def test_profile(spark, put):
    got = readers.read_profile_txt(spark, put("p.txt", "kmer a b\nAAA 1 nan\nAAC 2.5 3\n")).collect()
    assert {(r.entity, r.feature): r.value for r in got} == {("a", "AAA"): 1, ("b", "AAA"): 0, ("a", "AAC"): 2.5, ("b", "AAC"): 3}


def test_matrix_and_blocks(spark, put):
    got = readers.read_matrix_txt(spark, put("m.txt", "# x||a y||b\n1 0.5\n0.5 1\n")).collect()
    assert {(r.a, r.b): r.value for r in got}[("a", "b")] == 0.5
    got = readers.read_blocks_sim(spark, put("b.txt", "#a b\na 1 .5\nc .2 .3\n#d\na .9\n")).collect()
    assert {(r.a, r.b): r.value for r in got} == {("a", "b"): 0.5, ("c", "a"): 0.2, ("c", "b"): 0.3, ("a", "d"): 0.9}


def test_fasta(spark, put):
    got = readers.read_fasta(spark, put("s.fa", ">p||e__D_0 note\nACD\nEF*GH\n>q\nA\n")).collect()
    assert {(r.entity, r.part): r.seq for r in got} == {("p||e__D_0", 0): "ACDEF", ("p||e__D_0", 1): "GH", ("q", 0): "A"}


def test_scored_fasta_masks(spark, put):
    row = readers.read_scored_fasta(spark, put("sc.fa", ">n\nACD\n1,X,?\n0,1,2\n")).first()
    assert row.seq == "ACD" and row.rows == [[1.0, None, 0.0], [0.0, 1.0, 2.0]]


def test_pwm_round_trip(spark, put, tmp_path):
    path = put("m.hmot", "Motif\tM1\n# NGN 5 1.5\nPos\tA\tC\tG\tU\n1\t0.1\t0.2\t0.6\t0.1\n2\t0.25\t0.25\t0.25\t0.25\n")
    pwm = readers.read_pwm(spark, path)
    assert {(r.pos, r.base): r.p for r in pwm.collect()}[(0, "G")] == 0.6
    assert readers.read_pwm_logos(spark, path).first().asDict() == {"motif": "M1", "logo": "NGN", "n_kmers": 5, "score": 1.5}
    writers.write_pwm(pwm, f"file://{tmp_path}/out")
    assert {tuple(r) for r in readers.read_pwm(spark, f"file://{tmp_path}/out/*.txt").collect()} == {tuple(r) for r in pwm.collect()}


def test_folds(spark, put):
    got = readers.read_folds(spark, put("f.txt", "###Set 0\n##Train:\na b\nc d\n##Test:\ne\n###Set 1\n##Train:\na\n##Test:\nb\n")).collect()
    assert {(r.fold, r.role, r.entity) for r in got} == {(0, "train", "a"), (0, "train", "b"), (0, "train", "c"), (0, "train", "d"), (0, "test", "e"), (1, "train", "a"), (1, "test", "b")}


def test_newick():
    got = {(a, b): d for a, b, d in readers.leaf_distances("((a:1,b:2):3,c:4,(d:1):1);")}
    assert got == {("a", "b"): 1.5, ("a", "c"): 4.0, ("b", "c"): 4.5, ("a", "d"): 3.0, ("b", "d"): 3.5, ("c", "d"): 3.0}


def test_pdb_msa_tsv_scores(spark, put):
    line = "ATOM      1  CA  ALA A  12      11.104   6.134  -6.504  1.00  0.00           C"
    atom = readers.read_pdb_atoms(spark, put("1abc.pdb", line + "\nTER\n")).first()
    assert (atom.pdb, atom.chain, atom.res_no, atom.res, atom.atom, atom.x, atom.z) == ("1abc", "A", 12, "ALA", "CA", 11.104, -6.504)
    msa = readers.read_msa(spark, put("a.aln", "CLUSTAL W\n\ns1 AB-\ns2 ZXC\n\ns1 DE\ns2 D.\n")).collect()
    assert "".join(r.aa for r in sorted((r for r in msa if r.seq_id == "s2"), key=lambda r: r.pos)) == "Q-CD-"
    got = readers.read_master_tsv(spark, put("t.tsv", "id\texp\tval\np\ta,b\t1,2\n"), ["exp", "val"]).collect()
    assert {(r.id, r.exp, r.val) for r in got} == {("p", "a", "1"), ("p", "b", "2")}
    assert [tuple(r) for r in readers.read_score_col(spark, put("s.dat", "x 1 2.5\n"), "-2").collect()] == [("x", -2.5)]


def test_writers(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACD"), ("b", "EF")], "entity string, seq string")
    writers.write_fasta(seqs, f"file://{tmp_path}/fa")
    assert {(r.entity, r.seq) for r in readers.read_fasta(spark, f"file://{tmp_path}/fa/*.txt").collect()} == {("a", "ACD"), ("b", "EF")}
