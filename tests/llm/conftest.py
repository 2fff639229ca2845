"""Documents with everything an operator must survive."""

from __future__ import annotations

import random

import pytest

WORDS = "the and of mit license apache general public idiot foo bar baz été straße niño A B7 x-y 漢字 😀 end.".split()
CLASHING = "n_tokens int, score double, fp long, component_id long, row int, words string, size int, held_out boolean, id int, kept boolean"


def edge_texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rnd = random.Random(5)
    some = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    long = some(30_000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, "b"), (4, long, "en", "a"), (5, long, "en", None), (6, "x" * 5000, "de", "b"), (None, some(30), "fr", "b")]
    rows += [(7, some(60), "es", "b")] * 3 + [(8, "one", "en", "a"), (9, "one two three four", "en", "a"), (10, "one two three four", "en", "a"), (11, "12 34 !!", "de", "c")]
    rows += [(20 + i, some(rnd.randint(1, 120)) + rnd.choice(["", "\nline\nline\nline", " \x1c\x85　"]), rnd.choice(["en", "de", "fr", "es"]), rnd.choice("abc")) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, 7, 0.5, 3, 9, 1, "w", 2, True, 0, False) for r in edge_texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
