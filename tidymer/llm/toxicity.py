"""Toxicity by compression distance under zstandard dictionaries.

Two dictionaries are trained from labelled documents: one on ordinary text, one on toxic text. Toxic text for training
is what sets toxic documents apart: their words that ordinary documents lack or rarely hold, in order; dictionaries of whole
toxic texts hold mostly what both classes share and tell them apart badly (figures in the README). A text is cut into
windows; each is compressed with the ordinary dictionary alone and with the toxic one before it, as otherwise the differences of
ordinary passages hide those of toxic ones; the bytes saved are its distance. A logistic calibration of a text's distances (the largest
three, their mean, the shares and the number above two thresholds, and the number of windows) gives the score; its threshold is 0.5.
Calibration uses other documents than the dictionaries. Dictionaries are given to the compressor as plain content: their
entropy tables fit passages of a kilobyte, not windows, and cannot be joined.

The fit uses at most ``MAX_DOCS`` labelled documents of each class, of at most ``MAX_TEXT`` bytes each and ``MAX_BYTES`` bytes together,
chosen by a hash of their ids; so its size, and that of the broadcast dictionaries, is bounded. Every text is scored whole.

Nulls and empty texts are one empty window. Labels with a null id or value, documents labelled both ways, and texts longer than ``MAX_TEXT``, are not
learnt from. Without labels of both classes every score is the share of toxic ones (0 without any). Repeated rows get equal results;
of the documents only id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .shared import held_out, trimmed

MAX_DOCS, MAX_BYTES, MAX_TEXT = 2000, 12_000_000, 200_000
WINDOW, OVERLAP, TOXIC_BYTES, PLAIN_BYTES, PASSAGE = 96, 12, 8192, 110_000, 2048
#: Bytes saved from which a window counts, and the weight of the ordinary class in calibration.
MARKS, PLAIN_WEIGHT = (2, 4), 3.0
WORDS = re.compile(rb"[^\x00-\x60\x7b-\x7f]{4,}")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; the end of the samples where they are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compression() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(9, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = compression()
    known = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def distilled(toxic: list[bytes], plain: list[bytes]) -> list[bytes]:
    """The words of each toxic text that are at least six times as common among toxic texts as among ordinary ones."""
    inside, outside = (Counter(w for t in texts for w in set(WORDS.findall(t))) for texts in (toxic, plain))
    least = max(3, 0.003 * len(toxic))
    marks = {w for w, n in inside.items() if n >= least and n / len(toxic) >= 6 * (outside[w] + 0.5) / len(plain)}
    passages = (b" ".join(w for w in WORDS.findall(t) if w in marks) for t in toxic)
    return [b" " + p for p in passages if p]


@dataclass(frozen=True)
class Model:
    """Dictionary contents and calibration; ``weights`` is None where only ``prior`` is known."""

    toxic: bytes
    plain: bytes
    mean: np.ndarray | None
    scale: np.ndarray | None
    weights: np.ndarray | None
    prior: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.with_toxic, self.without = _compressor(model.toxic + model.plain), _compressor(model.plain)

    def features(self, text: bytes) -> list[float]:
        step, less, more = WINDOW - OVERLAP, self.with_toxic.compress, self.without.compress
        saved = np.array([len(more(w)) - len(less(w)) for w in (text[i : i + WINDOW] for i in range(0, max(1, len(text) - OVERLAP), step))], float)
        top = -np.partition(-np.r_[saved, 0, 0, 0], (0, 1, 2))[:3]
        top.sort()
        shares = [(saved >= m).mean() for m in MARKS]
        return [*top[::-1], saved.mean(), np.log(len(saved)), *shares, (saved >= MARKS[-1]).sum() ** 0.5]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if m.weights is None:
            return np.full(len(texts), m.prior)
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ m.weights, -500, 500)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and logistic weights (by Newton steps with a small ridge)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), PLAIN_WEIGHT * 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        w += np.linalg.solve((a * (each * (p * (1 - p) + 1e-9))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (each * (y - p)) - 0.1 * w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """A model from labelled documents whose crc32(id) mod 5 is not 0: one half of them, by a hash of the id, trains the dictionaries, the other calibrates."""
    usable = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("label_id"))
    marked = usable.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).where("label = other").select("label_id", "label")
    few = [marked.where(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(max_docs) for k in (0, 1)]
    chosen = few[0].union(few[1])  # at most 2 * max_docs ids: small enough to broadcast
    trains = F.pmod(F.xxhash64("label_id", F.lit("part")), F.lit(2)) == 0
    rows = docs.where(F.octet_length(text_col) <= MAX_TEXT).join(F.broadcast(chosen), F.col(id_col) == F.col("label_id")).select("label_id", "label", trains.alias("trains"), F.col(text_col).alias("text")).orderBy(F.xxhash64("label_id"), "label_id", "text")
    texts, held = {(k, t): {} for k in (0, 1) for t in (True, False)}, [0, 0]
    for r in rows.toLocalIterator():
        text = _bytes(r.text)
        if held[r.label] + len(text) <= MAX_BYTES and text not in texts[r.label, r.trains]:
            held[r.label] += len(text)
            texts[r.label, r.trains][text] = None
    return trained(*(list(texts[k, t]) for t in (True, False) for k in (1, 0)))


def trained(toxic: list[bytes], plain: list[bytes], more_toxic: list[bytes], more_plain: list[bytes]) -> Model:
    """Dictionaries from the first two lists, calibrated on the other two; a list that is empty is replaced by its fellow."""
    toxic, more_toxic, plain, more_plain = toxic or more_toxic, more_toxic or toxic, plain or more_plain, more_plain or plain
    if not plain or not toxic:
        return Model(b"", b"", None, None, None, 1.0 if toxic else 0.0)
    model = Model(_dictionary(TOXIC_BYTES, distilled(toxic, plain)), _dictionary(PLAIN_BYTES, [t[i : i + PASSAGE] for t in plain for i in range(0, len(t), PASSAGE)]), None, None, None)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for t in more_toxic + more_plain])
    return Model(model.toxic, model.plain, *_calibrated(x, np.r_[np.ones(len(more_toxic)), np.zeros(len(more_plain))]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: bool = False) -> DataFrame:
    """id, held_out, score, predicted of every row; with ``keep`` instead the rows of ``docs`` that are not predicted toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        scorer = Scorer(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = scorer.scores([_bytes(t.as_py()) for t in batch.column(text_col)])
            if keep:
                yield batch.filter(pa.array(values < threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(values)], names=[id_col, "score"])

    if keep:
        return docs.mapInArrow(blocks, docs.schema)
    scored = docs.select(id_col, text_col).mapInArrow(blocks, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
