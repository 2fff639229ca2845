"""License scans: phrases in whole texts, and an exact set-similarity join of text blocks with license templates.

A text's words are cut into blocks of 2 s words, one beginning every s words, so that any run of up to s words lies whole in a block;
s is ``STEP`` for templates of up to so many words and the next power of two for longer ones. A block matches a template if it holds at least
``threshold`` of the template's distinct words. Words of templates are ordered by how many documents hold them, rarest first; others can't match
and are left out. A template that needs a of its n words shares one of its first n - a + 1 with every block that matches, and the block, of m such
words, one of its first m - a + 1 (prefix filter). Blocks are indexed by the prefix for the least a of all templates; a template that needs more
than m words (length filter), or more than those from the shared word on (positional filter), is left out. What passes is verified exactly.

Texts are read once: blocks with as many template words as some template needs, and the template words of each document, are written.
Nulls and empty texts have no words. Repeated rows get their own equal results. Of the documents only id and text are read;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

STEP, THRESHOLD = 32, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening words of public license notices, then two whole licenses, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text_col: str) -> Column:
    """Words of a text with A-Z in lower case."""
    bare = F.regexp_replace(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), f"^{SEPARATORS}|{SEPARATORS}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATORS))


def _starts(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        found = F.get(words, i) == phrase[0]
        for k in range(1, len(phrase)):
            found &= F.get(words, i + k) == phrase[k]
        return found

    present = (last >= 0) & F.array_contains(words, phrase[0]) & F.array_contains(words, phrase[-1])
    return F.when(present, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def step_of(text: str) -> int:
    """Words between the beginnings of the blocks that a template is held against."""
    return max(STEP, 1 << (len(text.split()) - 1).bit_length())


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def prefixes(order: list[str], templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, int, str, list[str], int, str, int]]:
    """(step, template, label, its words in the order, words needed, prefix word, its place) for every prefix word."""
    rows, rank = [], {w: i for i, w in enumerate(order)}
    for number, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        least = needed(len(words), threshold)
        rows += [(step_of(text), number, label, words, least, w, i) for i, w in enumerate(words[: len(words) - least + 1])]
    return rows


def candidates(blocks: DataFrame, entries: DataFrame, positional: bool = True) -> DataFrame:
    """Rows (row, step, block, has, least) with the words of ``has`` in the order -> each with the templates of ``entries`` that prefix, length and positional filters leave."""
    indexed = blocks.select("row", "step", "block", "has", F.posexplode(F.slice("has", 1, F.size("has") - F.col("least") + 1)).alias("at", "word"))
    met = indexed.join(F.broadcast(entries), ["step", "word"]).where(F.size("has") >= F.col("needed"))  # entries: the prefix words of the templates given
    if positional:
        met = met.where((F.size("has") - F.col("at") >= F.col("needed")) & (F.size("words") - F.col("place") >= F.col("needed")))
    return met.dropDuplicates(["row", "step", "block", "template"])


def _blocks(words: Column, step: int, universe: list[str], least: int) -> Column:
    """The template words of every block that holds at least ``least`` of them, with the block's number."""
    literal = F.array(*map(F.lit, universe))
    last = F.floor(F.greatest(F.size(words) - step - 1, F.lit(0)) / step).cast("int")
    every = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), F.array_intersect(F.slice(words, b * step + 1, 2 * step), literal).alias("has"), F.lit(least).alias("least")))
    return F.filter(every, lambda b: F.size(b["has"]) >= least)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 where a phrase stands) of every row."""
    spark, words = docs.sparkSession, F.col("words")
    universe, steps = {w for _, text in templates for w in text.split()}, {}
    for _, text in templates:
        own, least = steps.get(step_of(text), (set(), len(universe)))
        steps[step_of(text)] = own | set(text.split()), min(least, needed(len(set(text.split())), threshold))
    worded = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    starts = [_starts(words, p.split()) for p in phrases]
    held = F.array_intersect("words", F.array(*map(F.lit, sorted(universe))))
    blocks = F.when(F.size("held") >= min(least for _, least in steps.values()), F.concat(*(_blocks(words, step, sorted(own), least) for step, (own, least) in steps.items())))
    located = worded.withColumn("held", held).select("id", F.size(words).cast("long").alias("n_words"), "held", *(s.alias(f"at_{i}") for i, s in enumerate(starts)), blocks.alias("blocks"))
    places = F.flatten(F.array(*(f"at_{i}" for i in range(len(phrases)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    slim = written(located.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base.alias("base"), "held", "blocks",
    ), "blocks")

    counts = {r[0]: r[1] for r in slim.select(F.explode("held").alias("word")).groupBy("word").count().collect()}  # a row for each template word
    order = sorted(universe, key=lambda w: (counts.get(w, 0), w))
    entries = spark.createDataFrame(prefixes(order, templates, threshold), "step int, template int, label string, words array<string>, needed int, word string, place int")
    ordered = F.array_intersect(F.array(*map(F.lit, order)), F.col("b.has"))
    near = candidates(slim.select("row", F.explode("blocks").alias("b")).select("row", "b.step", "b.block", ordered.alias("has"), "b.least"), entries)
    shared = F.size(F.array_intersect("has", "words"))
    verified = near.where(shared >= F.col("needed")).select("row", "label", (shared / F.size("words")).alias("containment"))
    found = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))

    none = F.array().cast("array<string>")
    return slim.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """SQL for DuckDB with the same phrases, templates and threshold."""
    phrases = ", ".join(f"({p.split()!r}, '{l}')" for p, l in PHRASES.items())
    templates = ", ".join(f"('{l}', {sorted(set(t.split()))!r}, {step_of(t)})" for l, t in TEMPLATES)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases(phrase, label) AS (VALUES {phrases}),
templates(label, has, step) AS (VALUES {templates}),
places AS (SELECT row, label, i - 1 AS place FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM w) x JOIN phrases ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY row),
blocks AS (SELECT row, step, words[b * step + 1:b * step + 2 * step] AS block FROM (SELECT row, words, step, unnest(range(0, greatest(len(words) - step - 1, 0) // step + 1)) AS b FROM w, (SELECT DISTINCT step FROM templates) s) x),
matches AS (SELECT row, label, len(list_intersect(has, block)) AS shared, len(has) AS n FROM blocks b JOIN templates t ON b.step = t.step WHERE len(list_intersect(has, block)) >= ceil({THRESHOLD} * len(has) - 1e-9)),
labelled AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM matches UNION SELECT row, label FROM places) GROUP BY row),
best AS (SELECT row, max(shared / n) AS containment FROM matches GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0) END AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN labelled USING (row) LEFT JOIN best USING (row)
"""
