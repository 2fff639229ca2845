"""What several of the training-data operators need: written tables, document columns, bounded slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import drop_persisted as drop_written
from ..operators.stores import persisted as written

__all__ = ["WORD", "TwoGenerationCache", "drop_written", "held_out", "kept", "slices", "table", "trimmed", "written"]

#: Bytes between words in the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 = 0: rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def slices(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Consecutive lists of texts of about ``limit`` characters; a longer text stands alone, whole."""
    part: list[str] = []
    held = 0
    for t in texts:
        if part and held + len(t) > limit:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


#: What a Python worker keeps for its next task: one object at most.
_kept: dict = {}


def kept(key: tuple, make: Callable):
    """The object of ``key``, made once for all tasks of this Python worker that follow each other; it goes when a task asks for another or calls ``trimmed``."""
    if key not in _kept:
        trimmed()
        _kept[key] = make()
    return _kept[key]


def trimmed() -> None:
    """Return to the system what earlier tasks left in this Python worker: kept objects and the allocators' free memory. Workers outlive tasks, so memory of one stage would add to the next one's."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


class TwoGenerationCache:
    """A dict of at most 2 * ``limit`` entries that keeps what was used lately; only speed depends on it."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those of ``keys`` without a value; all others are then in ``new``."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        rest = keys - self.new.keys()
        back = rest & self.old.keys()
        self.new.update((k, self.old[k]) for k in back)
        return rest - back
