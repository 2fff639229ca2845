"""Learnt operators: held-out accuracy, edge cases, and the pipeline stage by stage."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import Row

import corpus_pipeline
from tidymer.llm import lang_id, mixing, queries, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op10_language_id"](spark, SF).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(langs) and sum(held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edges, empty):
    model = lang_id.fit(edges)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(edges, model).collect()}
    assert got[1] == got[2] == got[3] == got[11] == ("und", 0.0)
    assert got[4][0] in model.languages and len(lang_id.predict(edges, model).collect()) == edges.count()
    assert {r.lang_pred for r in lang_id.predict(edges, lang_id.fit(empty)).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0
    kept = lang_id.predict(edges, model, keep=True)
    assert kept.columns == edges.columns and {1, 2, 3, 11}.isdisjoint(r.doc_id for r in kept.collect())


def test_backoff_takes_ever_shorter_pieces(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(1, 60) for t, lang in (("schule lehrer fenster", "de"), ("school teacher window", "en"))], "doc_id long, text string, lang string")
    predictor = lang_id.Predictor(lang_id.fit(docs))
    assert predictor.predict("fensterchen")[0] == "de" and predictor.predict("windowless")[0] == "en"
    assert predictor.predict("漢字") == (predictor.model.languages[int(predictor.model.shares.argmax())], pytest.approx(predictor.model.shares.max()))


def test_predictions_are_those_of_plain_counting(spark):
    """Counts, back-off and scores again by loops, on all documents of the small table; rare words of a language with few texts are learnt too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 3 = 0")
    docs = docs.union(spark.createDataFrame([(10**6 + i, f"selten{chr(97 + i)} wort", "xx") for i in range(9)], docs.schema))
    model = lang_id.fit(docs)
    rows = docs.collect()
    words, counts = re.compile(r"[^\W\d_]+"), defaultdict(Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            for w in words.findall((r.text or "").lower()):
                counts[r.lang, 0][w] += 1
                for k in range(1, 6):
                    counts[r.lang, k].update(f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k))
    languages = sorted({lang for lang, _ in counts})
    total = {key: sum(c.values()) for key, c in counts.items()}
    share = max(1, len(languages) / 4)
    known = {key: {p: n for p, n in c.items() if n >= total[key] * share * (1e-5 if key[1] else 2e-5)} for key, c in counts.items()}
    log = lambda lang, k, piece: math.log((known[lang, k].get(piece, 0) + 0.5) / (total[lang, k] + 500))

    def value(w, lang):
        if any(w in known[x, 0] for x in languages):
            return log(lang, 0, w)
        for k in range(5, 0, -1):
            if pieces := [p for p in (f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)) if any(p in known[x, k] for x in languages)]:
                return sum(log(lang, k, p) for p in pieces) / len(pieces)
        return 0.0

    got = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert "xx" in languages and got[10**6].lang_pred == "xx"
    for r in rows[::7]:
        found = words.findall((r.text or "").lower())
        if not found:
            assert got[r.doc_id].lang_pred == "und"
            continue
        mean = {x: sum(value(w, x) for w in found) / len(found) * min(len(found), 12) for x in languages}
        best = max(mean.values())
        assert mean[got[r.doc_id].lang_pred] == pytest.approx(best, abs=1e-3)
        assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - best) for v in mean.values()), abs=1e-3)


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in queries.queries()["op3_toxicity"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    toxic, plain = ([r for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in plain) <= 0.05 * len(plain)
    auc = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in plain) / (len(toxic) * len(plain))
    assert auc >= 0.9


def test_scores_are_those_of_plain_compression(spark):
    """Every feature and score again, window by window, by a loop that compresses each under freshly loaded dictionaries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    params = toxicity.compression()

    def length(window, content):
        how = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
        return len(how.compress(window))

    few = docs.where("doc_id % 40 = 0 AND length(text) < 3000").collect() + [Row(doc_id=-1, text=""), Row(doc_id=-2, text=None)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(r.doc_id, r.text) for r in few], "doc_id long, text string"), model).collect()}
    for r in few:
        text, saved, at = (r.text or "").encode().lower(), [], 0
        while at == 0 or at + toxicity.OVERLAP < len(text):
            window = text[at : at + toxicity.WINDOW]
            saved.append(length(window, model.plain) - length(window, model.toxic + model.plain))
            at += toxicity.WINDOW - toxicity.OVERLAP
        top = sorted([*saved, 0, 0, 0], reverse=True)[:3]
        shares = [sum(s >= m for s in saved) / len(saved) for m in toxicity.MARKS]
        x = [*top, sum(saved) / len(saved), math.log(len(saved)), *shares, sum(s >= toxicity.MARKS[-1] for s in saved) ** 0.5]
        z = sum((v - m) / d * w for v, m, d, w in zip(x, model.mean, model.scale, model.weights[:-1], strict=True)) + model.weights[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_edges(spark, edges, empty):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(20, 60)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    got = toxicity.score(edges, model).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(edges, labels.where("false"))
    assert {r.score for r in toxicity.score(edges, none).collect()} == {0.0}
    kept = toxicity.score(edges, model, keep=True)
    assert kept.columns == edges.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if not r.predicted)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF).cache()
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and len({i for i, t in labels.items() if not t} - ids) <= 0.05 * len(labels)
    known = stage["language"](spark, clean, SF).cache()
    assert known.count() == clean.count()
    single = stage["near_duplicates"](spark, known, SF).cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(known, words=5, radius=12, similarity=0.8).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    mixed = stage["mixing"](spark, single, SF).cache()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.taken // r.size for r in mixing.schedule(single).collect() if r.taken})
    encoded = stage["byte_bpe"](spark, mixed, SF)
    assert encoded.count() == mixed.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_edges(spark, edges, empty):
    """Every stage on nulls, empty and long texts, repeated rows and clashing columns, and on an empty table."""
    docs, none = edges, empty
    for name, stage in corpus_pipeline.STAGES:
        out, blank = stage(spark, docs, SF), stage(spark, none, SF)
        assert blank.count() == 0
        if name == "byte_bpe":
            assert out.count() == docs.count() and {"doc_id", "ids_sha256"} <= set(out.columns)
            continue
        assert out.columns == docs.columns and blank.columns == none.columns
        if name == "near_duplicates":
            ids = Counter(r.doc_id for r in out.collect())
            assert ids[4] == 1 and 5 not in ids and ids[9] == 1 and 10 not in ids and ids[7] == 3
        docs, none = out.cache(), blank
