"""Language identification by words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word falls back to the longest n for which any of
its character n-grams (with marks for its start and end) is known, and scores by the mean of their log frequencies.
A text's score is the share of the best language in the normalised likelihood of a text of ``EVIDENCE`` such words.

The fit uses about ``MAX_DOCS`` documents of each language, chosen by a hash of their ids, and keeps words and n-grams above a least relative
frequency, which is raised in proportion to the number of languages above ``LANGUAGES``; a language of few words keeps all of them. So all languages
together have at most LANGUAGES / MIN_WORD words and LANGUAGES / MIN_GRAM n-grams of a length, which bounds the broadcast model: it holds one number for each
piece and language that has it. Every text is read whole.

A text that is null or has no letter is ``und`` with score 0; so is every text where no language could be learnt. A text
without any known word or n-gram gets the commonest language and its share. Repeated rows get equal results. Only id, text and
(to learn) the language are read; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .shared import drop_written, held_out, trimmed, written

MAX_DOCS, MIN_WORD, MIN_GRAM, LANGUAGES, LONGEST = 4000, 2e-5, 1e-5, 4, 5
#: Words that a text is worth at most; added to counts; words taken together; numbers kept for unseen words; words counted before they are passed on.
EVIDENCE, SMOOTH, CHUNK, KEPT, HELD = 12.0, 0.5, 50_000, 1_000_000, 100_000
WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class Model:
    """``index`` gives the row of each word, and of each n-gram as n:gram. Row r adds more[k] to the log frequency ``least`` of its kind in language
    number[k], for k from start[r] to start[r + 1]; ``least`` holds the log frequency of unseen words (0) and n-grams by language."""

    languages: list[str]
    shares: np.ndarray
    index: dict[str, int]
    start: np.ndarray
    number: np.ndarray
    more: np.ndarray
    least: np.ndarray


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, int] = {}
        self.grams: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for key, row in model.index.items():
            size, _, piece = key.rpartition(":")
            (self.grams[int(size)] if size else self.words)[piece] = row
        self.unseen: dict[str, int] = {}
        self.kept = max(CHUNK, KEPT // max(1, len(model.languages)))
        self.backed = np.zeros((self.kept, len(model.languages)), np.float32)

    def _known(self, word: str) -> tuple[int, list[int]]:
        """The largest n for which n-grams of a word are known, and their rows."""
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            get = self.grams[n].get
            if known := [row for i in range(len(marked) - n + 1) if (row := get(marked[i : i + n])) is not None]:
                return n, known
        return 0, []

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the rows, and which of the rows each belongs to."""
        start = self.model.start[rows]
        sizes = self.model.start[rows + 1] - start
        of = np.repeat(np.arange(len(rows)), sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[of], of

    def _back_off(self, words: list[str]) -> None:
        """Means of the log frequencies of unseen words' n-grams, in rows of ``backed``; zero for a word without any."""
        at = np.arange(len(self.unseen), len(self.unseen) + len(words))
        self.unseen.update(zip(words, at.tolist(), strict=True))
        self.backed[at] = 0
        found = [(i, n, rows) for i, (n, rows) in zip(at.tolist(), map(self._known, words), strict=True) if rows]
        if found:
            place, size, rows = zip(*found, strict=True)
            place, sizes = np.array(place), np.array([len(r) for r in rows])
            entries, of = self._entries(np.fromiter(itertools.chain.from_iterable(rows), np.int64))
            word = np.repeat(np.arange(len(sizes)), sizes)[of]
            languages = len(self.model.languages)
            sums = np.bincount(word * languages + self.model.number[entries], self.model.more[entries], len(sizes) * languages).reshape(-1, languages)
            self.backed[place] = self.model.least[list(size)] + sums / sizes[:, None]

    def _sum(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        rows = list(map(self.words.get, words))
        new = [w for w, r in zip(words, rows, strict=True) if r is None]
        if len(self.unseen) + len(new) > self.kept:
            self.unseen = {}
        self._back_off([w for w in new if w not in self.unseen])
        at = np.array([-1 - self.unseen[w] if r is None else r for w, r in zip(words, rows, strict=True)])
        seen = at >= 0
        entries, of = self._entries(at[seen])
        known = np.bincount(self.model.number[entries], self.model.more[entries] * counts[seen][of], len(self.model.languages)) + counts[seen].sum() * self.model.least[0]
        return known + counts[~seen] @ self.backed[-1 - at[~seen]]

    def predict(self, text: str | None) -> tuple[str, float]:
        languages = self.model.languages
        counted = Counter(WORDS.findall(text.lower())) if text and languages else {}
        if not counted or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(languages)), 0
        items = iter(counted.items())
        while part := list(itertools.islice(items, CHUNK)):
            words, counts = zip(*part, strict=True)
            total += self._sum(list(words), np.array(counts, np.float64))
            n += sum(counts)
        if not total.any():
            best = int(self.model.shares.argmax())
            return languages[best], float(self.model.shares[best])
        mean = total / n * min(n, EVIDENCE)
        best = int(mean.argmax())
        return languages[best], float(1 / np.exp(mean - mean[best]).sum())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """A model from the text and language of documents whose crc32(id) mod 5 is not 0."""
    ship(docs.sparkSession)
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return Model([], np.zeros(0), {}, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((LONGEST + 1, 0)))
    languages = sorted(counts)
    least = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, max_docs / n))) for k, n in counts.items())), F.col(lang_col))
    sample = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < least * 1_000_000).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        found: dict[str, Counter] = {}
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found.setdefault(lang, Counter()).update(WORDS.findall((text.as_py() or "").lower()))
            if batch is None or sum(map(len, found.values())) > HELD:
                for lang, c in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "piece", "n"])
                found = {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            found: dict[tuple, int] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size in range(1, min(LONGEST, len(word) + 2) + 1):
                    for g in grams(word, size):
                        found[lang, size, g] = found.get((lang, size, g), 0) + n
            if found:
                lang, size, piece = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(size, pa.int32()), pa.array(piece), pa.array(found.values(), pa.int64())], names=["lang", "size", "piece", "n"])

    counted = sample.mapInArrow(words, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    pieces = counted.mapInArrow(cut, "lang string, size int, piece string, n long").groupBy("lang", "size", "piece").agg(F.sum("n").alias("n"))
    everything = written(counted.select("lang", F.lit(0).alias("size"), "piece", "n").union(pieces), "pieces")
    totals = {(r[0], r[1]): r[2] for r in everything.groupBy("lang", "size").agg(F.sum("n")).collect()}
    share = max(1.0, len(languages) / LANGUAGES)
    floor = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(f"{k[1]}:{k[0]}"), F.lit(n * share * (MIN_GRAM if k[1] else MIN_WORD))) for k, n in totals.items())), F.concat_ws(":", "size", "lang")) if totals else F.lit(0.0)
    kept = everything.where(F.col("n") >= floor).orderBy("size", "piece", "lang").toArrow()  # as many rows as the docstring states
    drop_written(everything)
    size, piece, lang, n = (kept.column(c).to_pylist() for c in ("size", "piece", "lang", "n"))
    number = np.array([languages.index(x) for x in lang], np.int64)
    new = np.array([i == 0 or (size[i], piece[i]) != (size[i - 1], piece[i - 1]) for i in range(len(size))], bool)
    index = {f"{size[i]}:{piece[i]}" if size[i] else piece[i]: row for row, i in enumerate(np.flatnonzero(new).tolist())}
    sums = np.array([[totals.get((lang, size), 0) for lang in languages] for size in range(LONGEST + 1)], float)
    least = np.log(SMOOTH / (sums + SMOOTH * 1000))
    shares = np.array([counts[lang] for lang in languages], float)
    more = np.log((np.array(n, float) + SMOOTH) / SMOOTH).astype(np.float32)
    return Model(languages, shares / math.fsum(shares), index, np.r_[np.flatnonzero(new), len(size)].astype(np.int64), number, more, least)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, keep: bool = False) -> DataFrame:
    """id, held_out, lang_pred, score of every row; with ``keep`` instead the rows of ``docs`` in a learnt language with a score of at least ``least``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [predictor.predict(t.as_py()) for t in batch.column(text_col)]
            if keep:
                yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    if keep:
        return docs.mapInArrow(blocks, docs.schema)
    out = docs.select(id_col, text_col).mapInArrow(blocks, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
