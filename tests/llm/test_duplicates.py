"""SimHash and embedding near-duplicates, and components, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tidymer.llm import components, embedding_dedup, jaccard, simhash


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edges):
    got = simhash.fingerprints(edges, words=4).collect()
    want = sorted((plain_fingerprint(r.text, 4), -1 if r.doc_id is None else r.doc_id) for r in edges.collect())
    assert sorted((r.fp % 2**64, -1 if r.doc_id is None else r.doc_id) for r in got) == want


@pytest.mark.parametrize("cell,radius", [(1024, 4), (40, 4), (40, 7)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, cell, radius):
    monkeypatch.setattr(simhash, "CELL", cell)
    rnd = random.Random(cell + radius)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10] + [base[0]] * 30:
        x = b
        for _ in range(8):
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    found = simhash.links(nodes, radius).collect()
    at = {x: i for i, x in enumerate(fps)}
    mine = roots_of(len(fps), [(at[r.a % 2**64], at[r.b % 2**64]) for r in found])
    want = roots_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius])
    assert mine == want


def test_near_duplicates_and_keep_one(spark, edges, empty):
    got = simhash.near_duplicates(edges, words=4).collect()
    assert len(got) == edges.count()
    groups = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[4] == groups[5] == 4 and groups[9] == groups[10] == 9
    kept = [r.doc_id for r in simhash.keep_one(edges, words=4).collect()]
    assert set(kept) >= {1, 4, 9} and not {2, 3, 5, 10} & set(kept)
    assert simhash.near_duplicates(empty).count() == 0


def test_similarity_joins_near_copies_only(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    docs = []
    for g in range(30):
        base = [word() for _ in range(300)]
        docs.append((10 * g, " ".join(base)))
        near = list(base)
        near[150] = word()
        docs.append((10 * g + 1, " ".join(near)))  # 5 of 296 shingles change: 0.97
        docs.append((10 * g + 2, " ".join(base[:150] + [word() for _ in range(150)])))  # about a third
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, words=5, radius=12, similarity=0.8).collect()}
    assert got == {i: i if i % 10 != 1 else i - 1 for i, _ in docs}


def jaccard_groups(docs, words=5, least=0.8):
    """Component of each (id, text) by brute force over all pairs."""
    sets = []
    for _, text in docs:
        parts = (text or "").lower().split()
        sets.append({tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))})
    close = [(i, j) for i in range(len(docs)) for j in range(i) if (sets[i] & sets[j] or not (sets[i] or sets[j])) and 10 * len(sets[i] & sets[j]) >= 10 * least * len(sets[i] | sets[j])]
    return {docs[i][0]: docs[r][0] for i, r in enumerate(roots_of(len(docs), close))}


def test_a_repeated_line_joins_nothing(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(10)]
    docs = [(i, " ".join([word() for _ in range(700)] + line * 30)) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert simhash.keep_one(frame, words=5, radius=12, similarity=0.8).count() == 12


@pytest.mark.parametrize("crowded", [False, True])
def test_similarity_is_exact(spark, monkeypatch, crowded):
    """All groups of brute force, with every shingle salted and buckets cut into cells too, over small batches."""
    if crowded:
        monkeypatch.setattr(jaccard, "CELL", 3)
        monkeypatch.setattr(jaccard, "HOT", 0)
        monkeypatch.setattr(jaccard, "CROWDED", 0)
        monkeypatch.setattr(jaccard, "FEW", 1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    line, docs = [word() for _ in range(10)], [(0, None), (1, " "), (2, "one two"), (3, "One  two")]
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(30, 200))] + line
        for copy in range(6):
            text = list(base)
            for k in rnd.sample(range(len(text)), round(len(text) * 0.01 * copy)):
                text[k] = word()
            docs.append((len(docs), " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, words=5, radius=12, similarity=0.8).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == jaccard_groups(docs)


def test_sketches_and_prefixes_lose_no_pair():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, jaccard.CELLS)
    for n in (1, 4, 30, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for share in (0.89, 0.95):
            b = np.unique(np.r_[rng.choice(a, round(share * len(a)), replace=False), rng.integers(0, 2**63, round((1 - share) * len(a))).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a) + len(b) - 2 * both
            if both >= 0.8 * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard.prefix(a, counts, 0.8, 25)[0], jaccard.prefix(b, counts, 0.8, 25)[0]).size


def test_same_groups_as_brute_force_on_the_documents(spark):
    """All documents of the small table: no pair of a similarity of 0.8 or more is lost, none below it is a link."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect()}
    assert got == {k: v for k, v in jaccard_groups(sorted(map(tuple, docs.collect()))).items()}


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)] + [(5, None), (7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots_of(361, [x for x in links if x[1] is not None])
    assert got == {i: r for i, r in enumerate(want) if i != r}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("cell", [6144, 30])
def test_embeddings(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(cell)
    x = rng.standard_normal((150, 32)).astype(np.float32)
    near = (x[:25, None] + rng.standard_normal((25, 4, 32)) * rng.uniform(0.05, 0.4, (25, 4, 1))).reshape(-1, 32).astype(np.float32)
    rows = np.r_[x, near, x[:5], x[:1]]
    data = [(i, v.tolist()) for i, v in enumerate(rows)]
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None] * 32), (1004, [float("inf")] + [1.0] * 31), (1005, []), (1006, x[0][:16].tolist())]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    root = roots_of(len(rows), zip(*np.nonzero(np.triu(close, 1)), strict=True))
    assert {i: got[i] for i in range(len(rows))} == {i: (int(close[i].sum()) - 1, root[i], root[i] == i) for i in range(len(rows))}
    assert all(got[i] == (0, i, True) for i, _ in odd)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(9)
    for dim in (64, 100):
        x, q = rng.standard_normal((400, dim)), rng.standard_normal((1, dim))
        turned, codes, c = embedding_dedup.encode(x)
        tq = embedding_dedup.encode(q)[0]
        rounded = embedding_dedup.Rounded(tq)
        product = rounded.products(slice(None), codes)[0]
        assert np.abs(product - np.where(turned >= 0, 1, -1) @ tq[0] / np.sqrt(dim)).max() <= rounded.error[0] + 1e-6
        assert abs((product / c - turned @ tq[0]).mean()) < 0.02
        near = rng.uniform(0, 1, (400, 1)) * turned + tq
        near /= np.linalg.norm(near, axis=1, keepdims=True)
        c = np.abs(near).sum(axis=1) / np.sqrt(dim)
        estimate = rounded.products(slice(None), embedding_dedup._packed(near >= 0))[0] / c
        linked = near @ tq[0] >= 0.95
        assert linked.any() and (estimate + rounded.error[0] / c + embedding_dedup.margin(c, 0.95, dim, None) >= 0.95 - 1e-5)[linked].all()


def test_estimates_decide_what_is_recomputed(monkeypatch):
    """All links are found; hardly any other pair is recomputed, and fewer with a narrower bound, which loses few."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal((300, 64))
    x = np.r_[base, base + 0.15 * rng.standard_normal((300, 64)), rng.standard_normal((900, 64))]
    _, codes, c = embedding_dedup.encode(x)
    seen, whole = [], np.einsum
    monkeypatch.setattr(embedding_dedup.np, "einsum", lambda how, a, b: seen.append(len(a)) or whole(how, a, b))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.95), strict=True)}
    found = lambda epsilon: {p for i, j in embedding_dedup.matches(x, x, codes, c, 0.95, epsilon) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert found(None) == want
    wide, seen[:] = sum(seen), []
    narrow = found(1.0)
    assert len(want) <= wide < 0.02 * len(x) ** 2 and sum(seen) < wide
    assert narrow <= want and len(narrow) >= 0.95 * len(want)


def test_embedding_edges(spark):
    """Null and repeated ids, and columns whose names clash with those used inside."""
    rows = [(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, vector int, root int, component string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame.repartition(2)).where("vec_id IS NOT NULL").collect())
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (5, 0, 5, True)]
    assert [tuple(r) for r in embedding_dedup.near_duplicates(frame).where("vec_id IS NULL").collect()] == [(None, 0, None, True)] * 2
    assert embedding_dedup.near_duplicates(frame, epsilon=4.0).count() == len(rows)


def test_empty_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
