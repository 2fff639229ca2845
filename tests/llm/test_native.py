"""Mixing, chat formatting, license scans and quality rules against SQL and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidymer.llm import chat_format, license_scan, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    answer = duck.sql(queries.oracle_sql()[name])
    pick = [answer.columns.index(c) for c in frame.columns]
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(str(tuple(r[i] for i in pick)) for r in answer.fetchall())


def test_mix_of_edge_cases(edges, empty):
    rows = mixing.schedule(edges).collect()
    assert len(rows) == edges.count()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for part in by_source.values():
        assert {r.source_size for r in part} == {sum(r.size for r in part)}
        assert part[0].target <= 2 * part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= 2 * max(r.size for r in part)
    assert sum(v[0].target for v in by_source.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert Counter(map(tuple, mixing.schedule(edges).collect())) == Counter(map(tuple, rows))
    assert mixing.schedule(empty).count() == 0
    copies = Counter(r.doc_id for r in mixing.mix(edges.dropDuplicates(["doc_id"])).collect())
    single = mixing.schedule(edges.dropDuplicates(["doc_id"])).collect()
    assert copies == Counter({r.doc_id: r.taken // r.size for r in single if r.taken})


def test_targets_fill_up_to_the_caps(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 100, 1), ("c", 1000, 1), (None, 50, 1)], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    assert got == pytest.approx({"a": 20, "b": 200, "c": 1740 - 220 - 100, None: 100})


def rendered(turns):
    people = sorted({s for _, s, _ in turns} - {"system"})
    for me in people:
        text, spans = "", []
        for _, speaker, said in turns:
            text += "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == me else f"<|user name={speaker}|>\n"
            begin = len(text)
            text += said + "<|end|>\n"
            if speaker == me:
                spans.append((begin, len(text)))
        yield me, text, spans


def test_rotation(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CROWD", 8)
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "😀 ok"), (2, None, None, "?"), (2, 5, "ann", "x"), (2, 5, "ann", "x"), (3, 0, "system", "alone"), (None, 1, "bob", "lost")]
    turns += [(4, 7, "p", f"t{i}") for i in range(50)] + [(5, t, "ab"[t % 2], f"n{t}") for t in range(600)]
    turns += [(6, 0, "system", "rules")] + [(6, t, "ab"[t % 2], f"n{t}") for t in range(1, 700, 61)]
    frame = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, part int")
    got = defaultdict(list)
    for r in chat_format.rotate(frame).collect():
        got[r.conv_id, r.perspective].append(r)
    assert chat_format.rotate(frame.where("false")).count() == 0
    for r in got.pop((6, "a")) + got.pop((6, "b")):
        low = 256 * int(r.part.split(".")[0])
        own = [(t, s, x) for _, t, s, x in turns if _ == 6 and low <= t < low + 256]
        want = next((text, spans) for me, text, spans in rendered(([(0, "system", "rules")] if low else []) + own) if me == r.perspective)
        assert (r.text, [tuple(s) for s in r.spans], r.n_turns) == (*want, len(own))
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (2, "ann"), (None, "bob"), (4, "p"), (5, "a"), (5, "b")}
    for me, text, spans in rendered([(1, "system", "be kind"), (2, "ann", "hi < |end|>"), (3, "bob", ""), (4, "ann", "😀 ok")]):
        r = got[1, me][0]
        assert (r.text, [tuple(s) for s in r.spans]) == (text, spans) and all(r.text[a:b].endswith("<|end|>\n") for a, b in r.spans)
    assert sum(r.n_turns for r in got[2, "ann"]) == 2
    assert sum(r.n_turns for r in got[4, "p"]) == 50 and max(r.n_turns for r in got[4, "p"]) < 20
    assert sorted(x for r in got[4, "p"] for x in r.text.replace("<|assistant|>\n", "").split("<|end|>\n") if x) == sorted(f"t{i}" for i in range(50))
    parts = sorted(got[5, "a"], key=lambda r: [int(x) for x in r.part.split(".")])
    assert "".join(r.text for r in parts) == next(rendered([(t, "ab"[t % 2], f"n{t}") for t in range(600)]))[1]


def license_row(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, found = 0.0, set(labels)
    for label, template in license_scan.TEMPLATES:
        t = set(template.split())
        step = license_scan.step_of(template)
        for b in range(0, max(len(words) - step - 1, 0) // step + 1):
            share = len(t & set(words[b * step : b * step + 2 * step])) / len(t)
            if share >= 0.8:
                found.add(label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), 1.0 if places else best


def test_license_scan(spark, edges, empty):
    rows = [(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)] + [(1050, "x " * 40 + "Permission to use, copy, modify and/or distribute this software for any purpose with or without fee is granted" + " y" * 90), (1051, "the MIT-License, Apache\nlicense; GENERAL public license mit license")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edges, allowMissingColumns=True)
    got = license_scan.scan(frame)
    want = Counter((r.doc_id, *license_row(r.text)) for r in frame.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got.collect()) == want
    assert {r.labels for r in got.where("doc_id = 1050").collect()} == {"isc"}
    assert license_scan.scan(empty).count() == 0


def test_filters_of_the_license_join(spark):
    """Every template that a block matches is a candidate; the positional filter leaves out candidates that the prefixes and sizes allow."""
    templates = license_scan.TEMPLATES
    order = sorted({w for _, t in templates for w in t.split()})
    entries = spark.createDataFrame(license_scan.prefixes(order, templates, 0.8), "step int, template int, label string, words array<string>, needed int, word string, place int")
    rnd, rows = random.Random(8), []
    for k in range(300):
        own = set(rnd.choice(templates)[1].split())
        has = set(rnd.sample(sorted(own), rnd.randint(len(own) // 2, len(own)))) | set(rnd.sample(order, 8))
        rows.append((k, 32, 0, sorted(has), 4))
    blocks = spark.createDataFrame(rows, "row long, step int, block int, has array<string>, least int")
    found, loose = ({(r.row, r.template) for r in license_scan.candidates(blocks, entries, p).collect()} for p in (True, False))
    want = {(k, i) for k, _, _, has, _ in rows for i, (_, t) in enumerate(templates) if license_scan.step_of(t) == 32 and len(set(has) & set(t.split())) >= license_scan.needed(len(set(t.split())), 0.8)}
    assert want <= found < loose


def quality_row(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_base(edges, empty):
    got = quality.judge(edges).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *quality_row(r.text)) for r in edges.collect())
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(empty).count() == 0


def test_divergence(spark):
    import math

    rows = spark.createDataFrame([([4, 0, 4], [1, 1, 0]), ([1, 1], [2, 2]), ([1, 0], [0, 5]), ([0, 0], [1, 1])], "a array<long>, b array<long>")
    got = [r[0] for r in rows.select(quality.distance(rows.a, rows.b)).collect()]
    p, q = (0.5, 0, 0.5), (0.5, 0.5, 0)
    kl = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y, strict=True) if a)
    assert got[:3] == pytest.approx([math.sqrt((kl(p, q) + kl(q, p)) / 2), 0, 1]) and got[3] is None


def test_quality_keeps_good_documents_and_rejects_odd_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in quality.judge(docs).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(k for q, k in judged if q) >= 0.99 * sum(1 for q, _ in judged if q)
    assert sum(not k for q, k in judged if not q) >= 0.5 * sum(1 for q, _ in judged if not q)
