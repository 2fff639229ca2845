"""Token counts of whole texts under a SentencePiece model, without materialising ids.

A BPE merge never crosses two adjacent characters that no vocabulary piece holds side by side, so a text falls
into pre-tokens (blanks with the word after them, blanks, or one character that no longer piece contains) whose
counts add up to the text's. Each block of documents takes its distinct pre-tokens, counts the pieces of each
once, and joins these counts to the per-document frequencies.

Nulls and empty texts count 0 tokens and 0 bytes; repeated rows each get their own result row; columns of the
input besides id and text are not read, so clashing names do no harm; an empty table gives an empty table.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .shared import TwoGenerationCache, kept, slices

#: Characters in a slice whose frequencies are held at a time, and pre-tokens kept between slices.
SLICE, KEPT = 2_000_000, 250_000
BLANK = "▁"


class PieceCounter:
    """Counts the pieces of pre-tokens of one model; lives as long as the Python worker has tasks of it only."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        joined = {c for p in pieces if len(p) > 1 for c in p} - {BLANK, " "}
        if "\n" in joined or any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("this model has pieces that cross pre-tokens")
        chars = "".join(re.escape(c) for c in sorted(joined))
        blank = f"[ {BLANK}]"
        self.split = re.compile(f"{blank}*[{chars}]+|{blank}+|[^{chars}]").findall
        #: A line end stands alone, so what follows it is cut as inside a text: no blank is put before it.
        self.lead = len(self.sp.encode("\n"))
        self.cache = TwoGenerationCache(KEPT)

    def counts(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(self.split(f" {t}")) if t else {} for t in texts]
        new = list(self.cache.missing(set().union(*frequencies)))
        encoded = self.sp.encode([f"\n{p}" for p in new], num_threads=1)
        known = self.cache.new
        known.update((p, len(ids) - self.lead) for p, ids in zip(new, encoded, strict=True))
        return [sum(map(operator.mul, f.values(), map(known.__getitem__, f))) for f in frequencies]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row; the model file (read here) travels as a broadcast of its fixed size."""
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("pieces", hash(model.value)), lambda: PieceCounter(model.value))
        for batch in batches:
            n: list[int] = []
            for part in slices((x.as_py() or "" for x in batch.column(2)), SLICE):
                n += counter.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(blocks, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
