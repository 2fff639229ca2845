"""Operators without an SQL form, against numpy or values worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidymer.functions import vector
from tidymer.operators import alignment, blocks, conservation, folds, graph, models, motifs, neighbours, pairwise, statistics
from tidymer.operators import profiles as p
from tidymer.operators import sequences as s


def long(spark, matrix, names=None):
    return spark.createDataFrame([(i if names is None else names[i], j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "entity int, feature int, value double")


def values(df):
    return {(r.entity, r.feature): r.value for r in df.collect()}


def test_normal_tail(spark):
    zs = [-4.0, -1.0, 0.0, 0.5, 1.96, 2.99, 3.01, 6.0, 12.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(vector.normal_tail("z")).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) / 2 for z in zs], rel=1e-9)


def test_clean_turns_nan_into_zero(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 2, None), (1, 3, 2.0), (1, 4, float("inf"))], "entity int, feature int, value double")
    assert values(p.clean(df)) == {(1, 1): 0, (1, 2): 0, (1, 3): 2, (1, 4): 0}


def test_kmers_never_bridge_parts(spark):
    seqs = spark.createDataFrame([("e", 0, "ABCD"), ("e", 1, "CDA"), ("f", 0, "A")], "entity string, part int, seq string")
    assert {(r.entity, r.feature): r.value for r in s.kmers(seqs, 2).collect()} == {("e", "AB"): 1, ("e", "BC"): 1, ("e", "CD"): 2, ("e", "DA"): 1}
    assert {r.feature for r in s.posmismatch_kmers(seqs, 4, 1).collect()} == {"AXCD", "ABXD"}
    assert {r.feature for r in s.gapped_kmers(seqs, 4, 2).collect()} == {"AD"}
    assert {r.feature for r in s.mismatch_kmers(seqs, 3, 1).collect()} == {"BC", "AC", "CD", "BD", "DA", "CA"}


def test_smoothed_kmers_meet_only_near_ones(spark):
    counts = spark.createDataFrame([("e", "AAAA", 2.0), ("e", "AAAB", 1.0), ("e", "BBBB", 1.0)], "entity string, feature string, value double")
    similar = spark.createDataFrame([(a, b, 1.0 if a == b else 0.5) for a in "AB" for b in "AB"], "a string, b string, score double")
    got = {r.feature: r.value for r in s.smoothed_kmers(counts, similar, 1).collect()}
    assert got == pytest.approx({"AAAA": 2 + 0.875, "AAAB": 1 + 2 * 0.875, "BBBB": 1})


def test_alignment_and_identity(spark):
    assert alignment.align("ACGT", "AGT", lambda a, b: 2.0 if a == b else -1.0, 1, 1, False)[:2] == ("ACGT", "A-GT")
    assert alignment.align("TTACGTT", "GGACGGG", lambda a, b: 2.0 if a == b else -3.0, 3, 1, True)[:2] == ("ACG", "ACG")
    pairs = spark.createDataFrame([("HEAGAWGHEE", "PAWHEAE"), ("AW", "AW")], "x string, y string")
    rows = {r.x: r for r in alignment.identity(alignment.pairwise(pairs), "min").collect()}
    assert rows["AW"].identity == 100 and rows["AW"].score == 15
    assert rows["HEAGAWGHEE"].aligned_y.replace("-", "") == "PAWHEAE"
    done = spark.createDataFrame([("AC-GT", "ACTG-", "hhee")], "aligned_x string, aligned_y string, note string")
    assert alignment.transfer(done, "note", "?").first().transferred == "hh?e"


def test_domain_identity(spark):
    edges = spark.createDataFrame([("p", 0, "q", 0, 90.0), ("p", 0, "q", 1, 80.0), ("p", 1, "q", 0, 85.0), ("p", 1, "q", 1, 10.0)], "a string, i int, b string, j int, value double").withColumns({"na": F.lit(2), "nb": F.lit(2)})
    assert pairwise.domain_identity(edges, "highdom").first().value == 90
    assert pairwise.domain_identity(edges, "shortprot").first().value == 82.5
    assert pairwise.domain_identity(edges, "order").first().value == 50


def test_components_and_cover(spark):
    nodes = spark.range(8).select(F.col("id"))
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (5, 6)], "a long, b long")
    got = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    cover = {r.id: r.centre for r in graph.greedy_cover(edges, nodes).collect()}
    assert cover[0] == cover[1] == cover[2] == 1 and cover[3] == 3 and cover[5] == cover[6]


@pytest.mark.parametrize("method,expected", [("single", {0: 0, 1: 0, 2: 0}), ("complete", {0: 0, 1: 0, 2: 1}), ("average", {0: 0, 1: 0, 2: 1})])
def test_agglomerative(spark, method, expected):
    edges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.5), (0, 0, 2, 3.0)], "block int, a int, b int, distance double")
    assert {r.id: r.cluster for r in graph.agglomerative(edges, "block", method, 2.0).collect()} == expected


def test_average_linkage_takes_all_distances_of_a_component(spark):
    from tidymer.plans.vectors import average_linkage

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 6))
    x[40:50] = x[:10] + 0.4 * rng.standard_normal((10, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - np.round(unit @ unit.T, 9)
    for cut in (0.1, 0.3, 0.6):
        want = graph._merge_steps(d, "average", cut)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
        edges = spark.createDataFrame([(i, j) for i in range(60) for j in range(i) if d[i, j] <= cut], "a int, b int")
        got = {r.id: (r.component, r.cluster) for r in average_linkage(frame, edges, cut).collect()}
        assert len(got) == 60
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(60) for j in range(i))


def test_neighbour_joining_gives_back_a_tree(spark):
    d = {("a", "b"): 5, ("a", "c"): 9, ("a", "d"): 9, ("b", "c"): 10, ("b", "d"): 10, ("c", "d"): 8}
    tree = graph.neighbour_joining(spark.createDataFrame([(*k, float(v)) for k, v in d.items()], "a string, b string, dist double")).collect()
    lengths = {r.child: r.length for r in tree}
    assert lengths["a"] == pytest.approx(2) and lengths["b"] == pytest.approx(3)


def test_nearest_takes_lower_id_on_ties(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 0.0])], "id int, vec array<double>")
    got = {r.id: r.match for r in neighbours.nearest(df, df, 1, id_col="id", vector_col="vec").collect()}
    assert got[3] == 1 and got[1] == 2 and got[2] == 1 and got[4] == 1


def test_contacts_find_all_near_atoms(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 20, (60, 3)), rng.uniform(0, 20, (60, 3))
    atoms = spark.createDataFrame([("p", "A", i, *map(float, v)) for i, v in enumerate(a)], "pdb string, chain string, res_no int, x double, y double, z double")
    others = spark.createDataFrame([("p", *map(float, v)) for v in b], "pdb string, x double, y double, z double")
    got = {r.res_no: r.distance for r in neighbours.contacts(atoms, others, 4.0).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert got == pytest.approx({i: v for i, v in enumerate(d) if v <= 4})


def test_joint_svd_and_latent(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((6, 8)), rng.standard_normal((6, 5))
    u, vx, vy = models.joint_svd(long(spark, x), long(spark, y), how="significant", amount=6)
    back = values(models.decode_global(models.latent(long(spark, x), vx), vx))
    assert np.allclose([[back[i, j] for j in range(8)] for i in range(6)], x)
    assert np.allclose((u.to_numpy() ** 2).sum(), (x**2).sum() + (y**2).sum())


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((7, 4)), rng.standard_normal((7, 3))
    got = {(r.feature, r.response): r.value for r in models.ridge(long(spark, x), long(spark, y), 0.5).collect()}
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(4), x.T @ y)
    assert np.allclose([[got[i, j] for j in range(3)] for i in range(4)], want)


def test_nonnegative_and_shrunk():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((20, 5)), rng.standard_normal(20)
    g, r = a.T @ a, a.T @ b
    w = models.nonnegative(g, r)
    slope = r - g @ w
    assert (w >= 0).all() and (slope[w > 0] == pytest.approx(0, abs=1e-8)) and (slope[w == 0] <= 1e-8).all()
    w = models.shrunk(g, r, 1.0)
    slope = r - g @ w
    assert np.allclose(slope[w != 0], np.sign(w[w != 0]), atol=1e-6) and (np.abs(slope[w == 0]) <= 1 + 1e-6).all()


def test_affinity_regression_recovers_products(spark):
    rng = np.random.default_rng(4)
    x, y, d = rng.standard_normal((5, 6)), rng.standard_normal((5, 9)), rng.standard_normal((9, 4))
    design = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(9) for j in range(4)], "feature int, sub int, value double")
    w = models.affinity_regression(long(spark, x), long(spark, y), design, 1e-9, 1.01, 1.01)
    table = np.zeros((4, 6))
    for r in w.collect():
        table[r["sub"], r.feature] = r.value
    left, gram = y @ d, y @ y.T
    assert np.allclose(left @ table @ x.T, left @ np.linalg.pinv(left) @ gram, atol=1e-4)


def test_pwm_scan_and_consensus(spark):
    rows = [("m", i, b, 0.7 if b == c else 0.1) for i, c in enumerate("AUG") for b in "ACGU"]
    pwm = spark.createDataFrame(rows, "motif string, pos int, base string, p double")
    seqs = spark.createDataFrame([("x", "CAUGC"), ("y", "AU")], "entity string, seq string")
    got = {r.entity: r.score for r in motifs.scan(seqs, pwm, "max").collect()}
    assert got == pytest.approx({"x": 1.0, "y": 0.0})
    total = motifs.scan(seqs, pwm, "sum").where("entity = 'x'").first().score
    assert total == pytest.approx(1 + 1 / 343 * 1 + 1 / 343 * 1, rel=1)
    assert motifs.consensus(pwm).first().logo == "AUG" and motifs.iupac(pwm).first().iupac == "AUG"


def test_build_pwms_groups_alignable_kmers(spark):
    top = spark.createDataFrame([("e", i, k, 4.0 - i) for i, k in enumerate(["UGCAUG", "GCAUGU", "UGCAUA", "CCCCCC"])], "entity string, rank int, feature string, value double")
    got = motifs.build_pwms(top, least_kmers=3).collect()
    assert {r.motif for r in got} == {"e_0"} and all(sum(r.p for r in got if r.pos == k) == pytest.approx(1) for k in {r.pos for r in got})


def test_conservation(spark):
    msa = spark.createDataFrame([(i, j, c) for i, q in enumerate(["AWC-", "AWD-", "AWEK"]) for j, c in enumerate(q)], "seq_id int, pos int, aa string")
    for how in ("shannon", "js_divergence", "relative_entropy", "property_entropy", "property_relative", "von_neumann", "sum_of_pairs"):
        got = {r.pos: r.score for r in conservation.conservation(msa, how).collect()}
        assert got[3] == -1000 and got[1] > got[2]
    w = {r.seq_id: r.weight for r in conservation.henikoff_weights(msa).collect()}
    assert w[2] > w[0] == pytest.approx(w[1])


def test_delong_and_fisher(spark):
    rows = [(1, 0.9, 0.2, 1), (2, 0.8, 0.9, 1), (3, 0.7, 0.4, 0), (4, 0.2, 0.5, 0), (5, 0.6, 0.7, 1), (6, 0.1, 0.1, 0)]
    got = statistics.delong(spark.createDataFrame(rows, "id int, a double, b double, y int").withColumn("g", F.lit(1)), ["g"], "a", "b", "y").first()
    assert got.auc_a == pytest.approx(8 / 9) and got.auc_b == pytest.approx(7 / 9)
    table = spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long")
    assert table.select(statistics.fisher_greater("a", "b", "c", "d")).first()[0] == pytest.approx(17 / 70)


def test_folds_exclude_similar(spark):
    names = spark.range(6).select(F.col("id").alias("entity"))
    similar = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    rows = folds.make_folds(names, None, similar=similar).collect()
    test = {r.fold: r.entity for r in rows if r.role == "test"}
    train = {k: {r.entity for r in rows if r.role == "train" and r.fold == k} for k in test}
    assert sorted(test.values()) == list(range(6))
    assert all(train[k] == set(range(6)) - {e} - {0: {1}, 1: {0}, 2: {3}, 3: {2}}.get(e, set()) for k, e in test.items())


def test_leave_one_out_equals_models_fitted_without_the_entity(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((12, 6)), rng.standard_normal((12, 9))
    sequence, response = (spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(m.shape[1])], "entity long, feature long, value double") for m in (x, y))

    def predicted(how, **options):
        out = np.zeros_like(y)
        for r in folds.leave_one_out(sequence, response, how, **options).collect():
            out[r.entity, r.feature] = r.value
        return out

    ridge, joint, nearest = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    for i in range(12):
        rest = np.delete(np.arange(12), i)
        ridge[i] = x[i] @ np.linalg.solve(x[rest].T @ x[rest] + 0.5 * np.eye(6), x[rest].T @ y[rest])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        nearest[i] = y[rest[(unit[rest] @ unit[i]).argmax()]]
        u, s, v = np.linalg.svd(np.c_[x[rest], y[rest]], full_matrices=False)
        vx, lat = v[:4, :6], u[:, :4] * s[:4]
        row = np.linalg.lstsq(vx.T, x[i], rcond=None)[0]
        d = 1 - lat @ row / (np.linalg.norm(lat, axis=1) * np.linalg.norm(row))
        w = np.where(np.exp(-(d**2) / 0.04) >= 0.01, np.exp(-(d**2) / 0.04), 0)
        w = w if w.any() else (d == d.min()).astype(float)
        joint[i] = w @ y[rest] / w.sum()
    assert np.allclose(predicted("ridge", alpha=0.5), ridge) and np.allclose(predicted("nearest"), nearest) and np.allclose(predicted("joint", components=4), joint)
    scores = {r.entity: r.pearson for r in folds.evaluate(folds.leave_one_out(sequence, response, "ridge", alpha=0.5), response).collect()}
    assert scores[3] == pytest.approx(np.corrcoef(ridge[3], y[3])[0, 1])


def test_primal_and_dual_ridge_agree_and_components_give_the_sequence_back(spark):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((10, 4)), rng.standard_normal((10, 5))
    sequence, response = (spark.createDataFrame([(i, j, float(m[i, j])) for i in range(10) for j in range(m.shape[1])], "entity long, feature long, value double") for m in (x, y))
    both = [{(r.feature, r.response): r.value for r in f(sequence, response, 0.3).collect()} for f in (models.ridge, models.ridge_primal)]
    assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k]) for k in both[0])
    back = {(r.entity, r.feature): r.value for r in models.reconstruct(sequence, response, "sequence", amount=9).collect()}
    assert all(back[i, j] == pytest.approx(x[i, j], abs=1e-6) for i in range(10) for j in range(4))
    few, every = (models.reconstruct(sequence, response, "response", amount=5, reach=r).collect() for r in (0.2, None))
    assert len(few) == len(every) == 40 and {(r.entity, r.feature): round(r.value, 6) for r in few} != {(r.entity, r.feature): round(r.value, 6) for r in every}


def test_conserved_groups_merge_along_the_tree(spark):
    tree = spark.createDataFrame([("x", "y", 1.0), ("x", "z", 5.0), ("y", "z", 5.0)], "a string, b string, dist double")
    members = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "x"), (5, "z")], "id long, species string")
    pairs = [(1, 2, 0.9, 0.1), (2, 3, 0.9, 0.3), (1, 3, 0.2, 0.9), (3, 4, 0.9, 0.2), (1, 4, 0.9, 0.8), (2, 4, 0.9, 0.9)]
    homologs = spark.createDataFrame(pairs, "a long, b long, value double, distance double")
    got = {r.id: r.cluster for r in graph.conserved_groups(homologs, members, tree, 0.5, 0.4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}  # 1, 2 merge first; then 3 and 4, as 3 lies 0.6 from both others on average


def test_subclusters_and_cuts(spark):
    members = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 1)], "id long, cluster long")
    edges = spark.createDataFrame([(0, 1, 0.1), (2, 3, 0.2), (0, 2, 0.9), (0, 3, 0.9), (1, 2, 0.9), (1, 3, 0.9)], "a long, b long, distance double")
    got = {r.id: (r.cluster, r["sub"]) for r in graph.subcluster(members, edges, "average", 0.5).collect()}
    assert got[0] == got[1] != got[2] == got[3] and got[9] == (1, 0) and len({got[i] for i in range(5)}) == 3
    cut = {(r.cut, r.id): r.cluster for r in graph.split_linkage(edges.withColumn("block", F.lit(0)), "block", "average", [0.15, 0.5, 1.0]).collect()}
    assert [len({cut[c, i] for i in range(4)}) for c in (0.15, 0.5, 1.0)] == [3, 2, 1] and cut[0.15, 0] == cut[0.15, 1] == 0


def test_losses_leave_out_other_lineages(spark):
    distances = spark.createDataFrame([(a, b, d) for x, y, d in (("p", "q", 1.0), ("p", "r", 9.0), ("q", "r", 9.0)) for a, b in ((x, y), (y, x))] + [(s, s, 0.0) for s in "pqr"], "a string, b string, dist double")
    members = spark.createDataFrame([(1, "p"), (1, "r"), (2, "p"), (2, "q"), (3, "r"), (4, "q"), (4, "r"), (5, "r")], "cluster long, species string")
    ages = spark.createDataFrame([(1, 9.0), (4, 9.0), (2, 1.0), (3, 0.5), (5, 0.5)], "cluster long, age double")
    got = {(r.age, r.gained_age): (r.gained, r.lost, r.newly_lost) for r in graph.gains_losses(members, ages, distances).collect()}
    assert got == {(9.0, 9.0): (2, 0, 0), (1.0, 1.0): (1, 0, 0), (1.0, 9.0): (2, 0, 0), (0.5, 0.5): (2, 0, 0), (0.5, 9.0): (2, 0, 0)}


def test_hamming_identity_of_all_pairs_of_a_brand(spark):
    from tidymer.plans import sequences as plan

    parts = [(k, "ab"[k % 2], name) for k, name in ((1, "red ring"), (3, "red rung"), (1001, "blue"), (2, "red ring"), (4, "red ring"))]
    frame = spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string")
    got = {(r.a, r.b): r.identity for r in plan.hamming_identity(type("T", (), {"part": frame})).collect()}
    want = {(a, b): round(sum(x == y for x, y in zip(s, t, strict=False)) / max(len(s), len(t)), 6) for a, p, s in parts for b, q, t in parts if p == q and a < b}
    assert got == want


def test_mann_whitney_of_millions_of_rows(spark):
    rows = spark.range(3_400_000).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("value"), (F.col("id") % 2 == 0).alias("m"))
    got = statistics.condition_change(rows, ["g"], "value", "m").first()
    n = 1_700_000.0
    assert got.z == round(-(n / 2) / math.sqrt(n * n * (2 * n + 1) / 12), 3) and not got.changed


def test_fisher_scan_takes_the_least_cut_of_equal_rounded_p(spark):
    rows = spark.createDataFrame([("g", float(x), x > 50) for x in range(100)], "g string, x double, m boolean")
    got = statistics.fisher_scan(rows, ["g"], "x", "m", [30.0, 50.0]).first()
    assert (got.cut, got.sign, got.p) == (30.0, 1, 0.0)  # at 50 p is smaller, but both are 0 to nine decimals


def test_extend_intervals_orders_equal_intervals_by_a_tie(spark):
    for ids in ([1, 2], [2, 1]):
        rows = spark.createDataFrame([("u", i, 1000, 1060, 5000) for i in ids], "u string, id int, start long, end long, length long").coalesce(1)
        assert {r.id: (r.start, r.end) for r in s.extend_intervals(rows, ["u"], 100, "length", "id").collect()} == {1: (900, 999), 2: (1061, 1160)}


def by_features_too(monkeypatch, run):
    """Results with a Gram matrix of the entities and, where only three of these may be, of the features."""
    first = run()
    monkeypatch.setattr(models, "MAX_TRAINING", 3)
    return first, run()


def five_by_two(spark):
    rng = np.random.default_rng(3)
    return long(spark, rng.normal(size=(5, 2))), long(spark, rng.normal(size=(5, 3)))


def test_joint_svd_round_trip_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    x, y = five_by_two(spark)
    run = lambda: {r.entity: (r.cosine, r.euclidean) for r in models.round_trip_distance(x, models.joint_svd(x, y, amount=1)[1]).collect()}
    a, b = by_features_too(monkeypatch, run)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_decode_near_is_decode_local(spark, monkeypatch):
    x, y = five_by_two(spark)

    def run(decode=models.decode_near, **how):
        lat = models.latent(x, models.joint_svd(x, y, amount=2)[1])
        return values(decode(lat, lat, y.where("entity + feature <> 3"), **how))

    plain = lambda test, train, response, **how: models.decode_local(models.latent_distances(test, train), response, **how)
    a, b = by_features_too(monkeypatch, run)
    assert a == pytest.approx(b) and run(plain) == pytest.approx(b)
    assert run(sigma=0.001) == pytest.approx(run(plain, sigma=0.001))  # the nearest one's


def test_reconstruction_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    x, y = five_by_two(spark)
    a, b = by_features_too(monkeypatch, lambda: values(models.reconstruct(x, y, source="sequence", amount=2)))
    assert a == pytest.approx(b)


def test_ridge_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    x, y = five_by_two(spark)
    a, b = by_features_too(monkeypatch, lambda: {(r.feature, r.response): r.value for r in models.ridge(x, y.where("entity < 4"), 0.5).collect()})
    assert a == pytest.approx(b)


def test_pca_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    from tidymer.operators import reduction

    x, _ = five_by_two(spark)
    a, b = by_features_too(monkeypatch, lambda: {k: abs(v) for k, v in values(reduction.pca(x, 0.9)).items()})
    assert a == pytest.approx(b)


@pytest.mark.parametrize("metric", ["cosine", "pearson", "near"])
def test_best_matches_pass_on_k_rows_an_entity(spark, monkeypatch, metric):
    from tidymer.operators import blocks

    monkeypatch.setattr(blocks, "FEATURES", 2)
    table = np.random.default_rng(4).integers(0, 4, size=(12, 5)).astype(float)
    there = np.random.default_rng(5).random(table.shape) < 0.8
    rows = [(i, j, table[i, j]) for i, j in zip(*np.nonzero(there), strict=True)]
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in rows], "entity int, feature int, value double")
    got = {(r.entity, r["rank"]): (r.match, r.value) for r in blocks.best_matches(df, 3, metric, 6).collect()}
    for a in range(12):
        found = []
        for b in range(12):
            m = there[a] & there[b]
            if a != b and m.any():
                x, y = table[a, m], table[b, m]
                with np.errstate(all="ignore"):
                    v = {"cosine": lambda: x @ y / np.sqrt(x @ x * (y @ y)), "pearson": lambda: np.corrcoef(x, y)[0, 1] if np.ptp(x) and np.ptp(y) else 0.0, "near": lambda: -np.abs(x - y).mean()}[metric]()
                found.append((-round(v, 6) if np.isfinite(v) else np.inf, b))
        for k, (v, b) in enumerate(sorted(found)[:3]):
            assert got[a, k + 1][0] == b and (np.isinf(v) or got[a, k + 1][1] == pytest.approx(-v))


def test_rank_on_line_is_sequence_rank(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(rng.integers(2)), float(rng.integers(-5, 6)), float(rng.integers(-5, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double")
    own, candidates = df.select("g", F.col("id").alias("entity"), "x"), df.select("g", F.col("id").alias("match"), "y")
    pairs = own.join(candidates, "g").select("entity", "match", F.round(F.abs(F.col("x") - F.col("y")), 4).alias("distance"))
    assert sorted(models.rank_on_line(own, candidates, "g", 4).collect()) == sorted(models.sequence_rank(pairs).collect())


def test_leave_one_out_nearest_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    x, y = five_by_two(spark)
    a, b = by_features_too(monkeypatch, lambda: values(folds.leave_one_out(x, y, "nearest")))
    assert a == pytest.approx(b)


def test_leave_one_out_ridge_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch):
    x, y = five_by_two(spark)
    a, b = by_features_too(monkeypatch, lambda: values(folds.leave_one_out(x, y.where("feature < 2 OR entity = 1"), "ridge", alpha=0.5)))
    assert a == pytest.approx(b)


def test_greedy_cover_in_one_task_is_that_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = spark.createDataFrame(sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 12, size=(14, 2)) if p[0] != p[1]}), "a long, b long")
    one = sorted(graph.greedy_cover(edges, spark.range(14)).collect())
    monkeypatch.setattr(graph, "COVER_EDGES", 8)
    assert sorted(graph.greedy_cover(edges, spark.range(14)).collect()) == one


def test_identity_of_pairs_compares_equal_sequences_once(spark):
    rows = [("e", i, q) for i, q in enumerate(["abc", "abc", "abd", "", "abcd"])] + [("f", 9, "abc")]
    got = {(r.a, r.b): r.identity for r in s.identity_of_pairs(spark.createDataFrame(rows, "entity string, part long, seq string")).collect()}
    assert got == pytest.approx({(0, 1): 1, (0, 2): 2 / 3, (1, 2): 2 / 3, (0, 3): 0, (1, 3): 0, (2, 3): 0, (0, 4): 0.75, (1, 4): 0.75, (2, 4): 0.5, (3, 4): 0})


def test_reciprocal_best_vectors_passes_on_the_best_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, int(rng.integers(3)), rng.normal(size=3).tolist()) for i in range(40)], "id long, label int, vec array<double>")
    pairs, names = neighbours.within(df, df, 2.0, id_col="id", vector_col="vec"), df.select("id", "label")
    edges = pairs.join(names.withColumnRenamed("label", "group_a"), "id").join(names.select(F.col("id").alias("match"), F.col("label").alias("group_b")), "match")
    plain = neighbours.reciprocal_best(edges.select(F.col("id").alias("a"), "group_a", F.col("match").alias("b"), "group_b", F.col("cosine").alias("value")))
    assert sorted(neighbours.reciprocal_best_vectors(df).collect()) == sorted(plain.collect())


def test_the_smaller_side_is_solved_where_entities_are_many(spark, monkeypatch):
    x, y = five_by_two(spark)
    y, sizes, plain = y.where("feature < 2"), [], models.gram

    def watched(profile, *limit):
        names, g = plain(profile, *limit)
        sizes.append(len(names))
        return names, g

    run = lambda: ({(r.feature, r.response): r.value for r in models.ridge(x, y, 0.5).collect()}, values(models.reconstruct(x, y, source="sequence", amount=2)))
    before = run()
    monkeypatch.setattr(models, "gram", watched)
    monkeypatch.setattr(models, "MANY", 3)
    after = run()
    assert sizes and max(sizes) <= 4 and all(a == pytest.approx(b) for a, b in zip(before, after, strict=True))


@pytest.mark.parametrize("sigma", [0.2, 0.001])
def test_leave_one_out_joint_of_more_entities_than_a_gram_matrix_holds(spark, monkeypatch, sigma):
    rng = np.random.default_rng(8)
    x, y = long(spark, rng.normal(size=(12, 3))), long(spark, rng.normal(size=(12, 4)) + 1)
    y = y.where("entity + feature <> 5")
    run = lambda: values(folds.leave_one_out(x, y, "joint", components=2, sigma=sigma))
    before = run()
    monkeypatch.setattr(models, "MAX_TRAINING", 8)
    monkeypatch.setattr(folds, "BLOCK", 5)
    assert run() == pytest.approx(before)


def test_average_linkage_takes_memory_for_pairs_and_not_for_the_square_of_entities(spark):
    k = F.col("id")
    edges = spark.range(100_000).select(F.lit("x").alias("block"), (2 * k).alias("a"), (2 * k + 1).alias("b"), F.when(k < 500, 0.1).otherwise(0.9).alias("distance"))
    found = graph.split_linkage(edges, "block", "average", [0.05, 0.5])
    counts = {r.cut: (r.n, r.rows) for r in found.groupBy("cut").agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("rows")).collect()}
    assert counts == {0.05: (200_000, 200_000), 0.5: (199_500, 200_000)}


def test_subcluster_of_many_entities(spark):
    k = F.col("id")
    edges = spark.range(100_000).select((2 * k).alias("a"), (2 * k + 1).alias("b"), F.when(k < 500, 0.1).otherwise(0.9).alias("distance"))
    members = spark.range(200_000).select("id", F.lit(7).alias("cluster"))
    found = graph.subcluster(members, edges, "average", 0.5)
    assert found.count() == 200_000 and found.select("sub").distinct().count() == 199_500


@pytest.mark.parametrize("method", ["average", "complete"])
def test_linkage_of_pairs_is_that_of_the_whole_matrix(method):
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 20))
        i, j = (rng.integers(0, n, 3 * n) for _ in range(2))
        d, whole = rng.integers(1, 8, 3 * n) / 8, np.full((n, n), np.inf)  # many ties
        for x, y, v in zip(i, j, d, strict=True):
            whole[x, y] = whole[y, x] = v
        pairs = graph._Pairs(n, i, j, d, method)
        for _ in pairs.merge(0.6):
            pass
        assert (np.unique(pairs.label, return_inverse=True)[1] == graph._merge_steps(whole, method, 0.6)).all()


def test_conserved_groups_of_a_component_of_thousands(spark):
    tree = spark.createDataFrame([("x", "y", 1.0)], "a string, b string, dist double")
    members = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("species"))
    homologs = spark.range(2999).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.9).alias("value"), F.lit(0.1).alias("distance"))
    got = {r.id: r.cluster for r in graph.conserved_groups(homologs, members, tree, 0.5, 0.4).collect()}
    assert got == {k: k - k % 2 for k in range(3000)}


def test_average_linkage_of_vectors_forms_no_pair_beyond_the_cut(spark):
    from tidymer.plans.vectors import average_linkage

    n = 30_000  # on a circle, each within the cut of the next; all distances would be 450 million
    frame = spark.range(n).select("id", F.array(F.cos(F.col("id") * (math.tau / n)), F.sin(F.col("id") * (math.tau / n))).alias("vec"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = average_linkage(frame, edges, 3e-8).groupBy("component", "cluster").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.col("centre").cast("int")).alias("centres")).collect()
    assert {(r.first, r.last, r.centres) for r in got} == {(k, k + 1, 1) for k in range(0, n, 2)}


def test_seeded_cover_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(x.num_rows)
            yield x

    edges = spark.createDataFrame([(0, 5), (0, 1), (1, 2), (3, 4)], "a long, b long").mapInArrow(counted, "a long, b long")
    got = {r.id: r.centre for r in graph.seeded_cover(edges, spark.range(6), spark.range(0, 6, 5)).collect()}
    assert got == {0: 0, 5: 0, 1: 0, 2: 2, 3: 3, 4: 3} and read.value == 4


def test_closed_edges_form_no_path_of_two_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 40, (90, 2)) if p[0] != p[1]})
    edges = spark.createDataFrame(pairs, "a long, b long")
    near = {k: {y for p in pairs if k in p for y in p} - {k} for k in range(40)}
    monkeypatch.setattr(neighbours, "LISTS", 7)
    monkeypatch.setattr(neighbours, "COLUMNS", 10)
    monkeypatch.setattr(neighbours, "triangles", None)
    got = sorted((r.a, r.b) for r in neighbours.closed_edges(edges).collect())
    assert got == [p for p in pairs if near[p[0]] & near[p[1]]] and 0 < len(got) < len(pairs)


def test_extend_intervals_puts_those_without_a_place_last(spark):
    rows = spark.createDataFrame([("u", 1, 1000, 1060, 5000), ("u", 2, None, None, 5000), ("u", 3, 2000, 2060, 5000)], "u string, id int, start long, end long, length long")
    assert {r.id: (r.start, r.end) for r in s.extend_intervals(rows, ["u"], 100, "length", "id").collect()} == {1: (900, 1160), 2: (2061, 5000), 3: (1900, 2160)}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_nearest_sends_no_vector_to_every_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTORS", 16)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(90, 3)))  # with equal and opposite directions, and zeros
    x[7], x[40:50] = 0, x[3]
    df = spark.createDataFrame([(100 - i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    with np.errstate(all="ignore"):
        cos = np.round(np.nan_to_num(x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)), 9)
    want = {(100 - i, r + 1): 100 - j for i in range(90) for r, j in enumerate(sorted(set(range(90)) - {i}, key=lambda j: (-cos[i, j], 100 - j))[:4])}
    found = neighbours.nearest(df, df, 4, id_col="id", vector_col="vec")
    assert "CartesianProduct" in plan_of(found) and "CoGroup" not in plan_of(found)
    assert {(r.id, r.rank): r.match for r in found.collect()} == want


def test_within_computes_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTORS", 8)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([(f"v{i:02}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    other = df.where("id > 'v20'")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"v{i:02}", f"v{j:02}") for i in range(50) for j in range(50) if i != j and unit[i] @ unit[j] >= 0.4}
    half = neighbours.within(df, df, 0.6, id_col="id", vector_col="vec", half=True)
    assert "CoGroup" not in plan_of(half) and sorted((r.id, r.match) for r in half.collect()) == sorted(p for p in want if p[0] < p[1])
    assert sorted((r.id, r.match) for r in neighbours.within(df, df, 0.6, id_col="id", vector_col="vec").collect()) == sorted(want)
    assert sorted((r.id, r.match) for r in neighbours.within(df, other, 0.6, id_col="id", vector_col="vec").collect()) == sorted(p for p in want if p[1] > "v20")


def test_joining_edges_are_fewer_than_pairs_and_join_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTORS", 9)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(6, 5))
    df = spark.createDataFrame([(i, (centres[i % 6] + 0.4 * rng.normal(size=5)).tolist()) for i in range(80)] + [(99, [0.0] * 5)], "id long, vec array<double>")
    pairs = neighbours.within(df, df, 0.1, id_col="id", vector_col="vec", half=True).selectExpr("id AS a", "match AS b")
    edges = neighbours.joining_edges(df, 0.1)
    want = {r.id: r.component for r in graph.connected_components(df.select("id"), pairs).collect()}
    assert {r.id: r.component for r in graph.connected_components(df.select("id"), edges).collect()} == want and 1 < len(set(want.values())) < 80
    monkeypatch.setattr(blocks, "VECTORS", 4096)
    assert neighbours.joining_edges(df, 0.1).count() == 81 - len(set(want.values())) < pairs.count()


def test_groups_within_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "VECTORS", 9)
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, int(rng.integers(70)), rng.normal(size=3).tolist()) for i in range(60)], "id long, group int, vec array<double>")
    pairs = neighbours.within(df, df, 0.2, id_col="id", vector_col="vec")
    want = {(r.id, r.group) for r in pairs.join(df.selectExpr("id AS match", "group"), "match").collect()}
    assert {(r.id, r.group) for r in neighbours.groups_within(df, 0.2, 70).collect()} == want


def test_medoid_of_vectors_equals_all_pairs(spark):
    rng = np.random.default_rng(15)
    rows = [(i, int(rng.integers(3)), rng.normal(size=4).tolist()) for i in range(60)]
    east, north = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows += [(70, 5, east), (71, 5, None), (72, 5, east), (73, 6, east), (74, None, east), (75, 7, east), (75, 7, [1.0, 1.0, 0.0, 0.0]), (76, 7, north)]
    got = {r.cluster: r.medoid for r in graph.medoid_of_vectors(spark.createDataFrame(rows, "id int, cluster int, vec array<double>")).collect()}

    def cos(x, y):
        x, y = (np.zeros(4) if v is None else np.array(v) for v in (x, y))
        return round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 9) if x.any() and y.any() else 0.0

    sums: dict = {}
    for i, g, x in rows:
        for j, h, y in rows:
            if g is not None and g == h and i != j:
                sums[g, i] = sums.get((g, i), 0) + 1 - cos(x, y)
    want = {g: min((round(d, 6), i) for (h, i), d in sums.items() if h == g)[1] for g, _ in sums}
    assert got == want and 6 not in got


def test_distinct_3mers_are_those_that_kmers_count(spark, monkeypatch):
    texts = ["abcabcd", "a\u00e9\U0001f600bc\u00e9\U0001f600b", "", "ab", "x", "\u4e2d\u6587\u5b57\u4e2d\u6587\u5b57", None, "abcdefghij" * 5]
    rows = [(e, i, t) for i, t in enumerate(texts) for e in ("en", "fr", None)]
    seqs = spark.createDataFrame(rows, "entity string, part int, seq string").coalesce(1)
    want = sorted(map(str, s.kmers(seqs, 3).select("entity", "feature").collect()))
    found = s.distinct_3mers(seqs)
    assert sorted(map(str, found.collect())) == want and len(want) > 20
    assert "Generate" not in plan_of(found)  # no row for each window


def test_3mers_of_pieces(monkeypatch):
    letters, inside = s._joined(["abcd", "ef", "ghi"])
    assert bytes(letters.astype(np.uint8)).decode() == "abcdefghi" and np.flatnonzero(inside).tolist() == [0, 1, 6]


def test_identity_of_pairs_shuffles_no_pair(spark):
    rng = np.random.default_rng(16)
    rows = [(f"e{i % 2}", i, "".join(rng.choice(list("ab"), rng.integers(1, 4)))) for i in range(60)]
    found = s.identity_of_pairs(spark.createDataFrame(rows, "entity string, part long, seq string"))
    share = lambda x, y: sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y))
    want = {(i, j): share(x, y) for e, i, x in rows for f, j, y in rows if e == f and i < j}
    got = [((r.a, r.b), r.identity) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)
    assert plan_of(found).split("Initial Plan")[-1].count("Join") == 1  # parts join sequences in no second one


def test_triangles_shuffle_no_path_of_two_edges(spark, monkeypatch):
    for name, value in (("NEAR", (5, 7)), ("TABLE", 60), ("PATHS", 11)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(17)
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 30, (150, 2)) if p[0] != p[1]})
    found = neighbours.triangles(spark.createDataFrame(pairs, "a long, b long"))
    edges = set(pairs)
    want = sorted((a, b, c) for a, b in pairs for c in range(b + 1, 30) if (b, c) in edges and (a, c) in edges)
    assert sorted((r.a, r.b, r.c) for r in found.collect()) == want and len(want) > 20
    assert "CartesianProduct" in plan_of(found) and "Exchange" not in plan_of(found)
    monkeypatch.setattr(neighbours, "TABLE", 60)
    a = (np.array([1, 2]), np.array([2, 1]), np.array([2, 3, 3]))
    assert [tuple(map(int, t)) for part in neighbours._closed(a, a) for t in zip(*part, strict=True)] == [(1, 2, 3)]


@pytest.mark.parametrize("name", ["knn_vote", "rbf_weighted_vote"])
def test_votes_send_no_vector_to_every_block(spark, name):
    from tidymer.plans import registry

    plan = plan_of(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" in plan and "CoGroup" not in plan
