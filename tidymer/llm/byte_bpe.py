"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

A text is cut by the vocabulary's pattern; the distinct pieces of a block become token-position rows that join
the merge table, and each step of a recursive query contracts every piece's leftmost pair of least rank, until
no piece has a pair left; a piece that is a token itself needs no contraction. Decoding joins the ids of each whole text to their
bytes and concatenates them by an ordered aggregation.

Nulls and empty texts have no ids; rows are encoded one by one, so ties and repeated rows get equal results;
only id and text are read, so clashing columns do no harm; an empty table gives an empty table. Texts are encoded
whole: pieces of more than ``LONG`` bytes, for which one contraction a step would take too many steps (the rows of all steps
grow with the square of a piece's length), go through a heap that contracts in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ship
from .shared import TwoGenerationCache, kept, slices

#: Characters whose pieces are held at a time; rows of all steps of a query, and ids in one query, at most; pieces kept between blocks; bytes of a long piece.
SLICE, STEPS, IDS, KEPT, LONG = 3_000_000, 1 << 24, 400_000, 200_000, 4000

#: Unicode White_Space in the Basic Multilingual Plane, as text for a character class.
SPACES = "\t-\r \x85\xa0  -     　"

ENCODE = """
WITH RECURSIVE step(round, piece, pos, id) AS (
    SELECT 0, piece, pos, id FROM start
    UNION ALL
    SELECT round + 1, s.piece, s.pos, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.id END
    FROM (SELECT round, piece, pos, id FROM step) s
    JOIN (
        SELECT piece, (min(merged * 65536 + pos) % 65536)::INT AS pos, (min(merged * 65536 + pos) // 65536)::INT AS merged, arg_min(next_pos, merged * 65536 + pos) AS gone
        FROM (
            SELECT p.piece, p.pos, p.next_pos, m.merged::BIGINT AS merged
            FROM (SELECT piece, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos FROM step WINDOW w AS (PARTITION BY piece ORDER BY pos)) p
            JOIN merges m ON m.l = p.id AND m.r = p.next_id)
        GROUP BY piece) b ON s.piece = b.piece
    WHERE s.pos <> b.gone
), fixpoint AS (SELECT piece, max(round) AS round FROM step GROUP BY piece)
SELECT piece, list(id ORDER BY pos) AS ids FROM step JOIN fixpoint USING (piece, round) GROUP BY piece ORDER BY piece
"""

DECODE = """
SELECT i.piece, string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids i JOIN vocabulary v USING (id) GROUP BY i.piece ORDER BY i.piece
"""


def _classes() -> tuple[str, str]:
    """Letters and numbers of the Basic Multilingual Plane as ranges for a character class."""
    import regex

    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return tuple("".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for gap in regex.findall(p, plane) for run in _runs(gap)) for p in (r"\p{L}+", r"\p{N}+"))


def _runs(chars: str) -> list[str]:
    codes = np.array([ord(c) for c in chars])
    return ["".join(map(chr, r)) for r in np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)]


class Codec:
    """Merge table, vocabulary and DuckDB connection of one rank file; lives as long as the Python worker has tasks of it only."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        letters, numbers = _classes()
        for name, chars in ((r"[^\s\p{L}\p{N}]", f"[^{SPACES}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{SPACES}]"), (r"\s", f"[{SPACES}]")):
            pattern = pattern.replace(name, chars)
        self.plain, self.astral = re.compile(pattern), re.compile("[\U00010000-\U0010ffff]")
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "350MB"})
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True)) if merges else (pa.array([], pa.int32()),) * 3
        self._load("merges", pa.table({"l": left, "r": right, "merged": merged}))
        self._load("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True
        self.cache = TwoGenerationCache(KEPT)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for k, v in tables.items():
            self.con.register(k, v)
        out = self.con.sql(sql).to_arrow_table()
        for k in tables:
            self.con.unregister(k)
        return out

    def split(self, text: str) -> list[str]:
        """Matches of the pattern. Texts without supplementary characters use the same pattern with its classes spelt out, which is faster."""
        return self.pattern.findall(text) if self.astral.search(text) else self.plain.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [r.to_bytes(4, "little") if (r := self.ranks.get(p)) is not None else self._by_heap(p) if len(p) > LONG else None for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        steps = np.cumsum([len(pieces[i]) ** 2 for i in rest])  # at most so many rows in all steps
        while rest:
            n = max(1, int(np.searchsorted(steps, STEPS, side="right")))
            part, rest, steps = rest[:n], rest[n:], steps[n:] - steps[n - 1]
            sizes = np.array([len(pieces[i]) for i in part])
            ends = np.cumsum(sizes)
            start = pa.table({
                "piece": np.repeat(np.arange(len(part), dtype=np.int32), sizes),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
                "id": self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)],
            })
            ids = self._query(ENCODE, start=start).column("ids").combine_chunks()
            values, offsets = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            for i, a, b in zip(part, offsets, offsets[1:], strict=False):
                out[i] = values[a:b]
        return out

    def _by_heap(self, piece: bytes) -> bytes:
        """The same contractions in the same order, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)

        def pair(i: int) -> tuple[int, int, int] | None:
            j = end[i]
            return (r, i, end[j]) if j < n and (r := ranks.get(piece[i : end[j]])) is not None else None

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != to:
                continue
            alive[j], end[i] = 0, to
            if to < n:
                before[to] = i
            for k in (i, before[i]):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return np.array(out, "<u4").tobytes()

    def decode_lists(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids; ids that the vocabulary lacks raise an error. Lists of more than ``IDS`` ids are decoded in runs."""
        out: list[list[bytes]] = [[] for _ in lists]
        runs = [(i, ids[k : k + IDS]) for i, ids in enumerate(lists) for k in range(0, len(ids), IDS)]
        while runs:
            sizes = np.array([len(x) for _, x in runs])
            n = max(1, int(np.searchsorted(np.cumsum(sizes), IDS, side="right")))
            part, runs, sizes = runs[:n], runs[n:], sizes[:n]
            ends, flat = np.cumsum(sizes), np.concatenate([x for _, x in part])
            if flat.min() < 0 or flat.max() >= len(self.known) or not self.known[flat].all():
                raise ValueError("an id is not in the vocabulary")
            rows = self._query(DECODE, ids=pa.table({"piece": np.repeat(np.arange(n, dtype=np.int32), sizes), "pos": np.arange(ends[-1]) - np.repeat(ends - sizes, sizes), "id": flat}))
            for k, h in zip(rows.column("piece").to_pylist(), rows.column("hex").to_pylist(), strict=True):
                out[part[k][0]].append(bytes.fromhex(h))
        return [b"".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        new = list(self.cache.missing(set().union(*cut)))
        known = self.cache.new
        known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4").astype(np.int32) for pieces in cut]


def _codec(rank_file: bytes, pattern: str) -> Codec:
    return kept(("codec", hash((rank_file, pattern))), lambda: Codec(rank_file, pattern))


def _map(docs: DataFrame, rank_path: str, pattern: str, columns: list, schema: str, block) -> DataFrame:
    ship(docs.sparkSession)
    with open(rank_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            yield from block(codec, batch)

    return docs.select(*columns).mapInArrow(blocks, schema)


def encode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>, unless ``with_ids`` is false), ids_sha256 and decoded_sha256 (of the bytes the ids decode to) of every row."""

    def block(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in slices((x.as_py() or "" for x in batch.column(1)), SLICE):
            ids = codec.encode(part)
            columns = [batch.column(0).slice(at, len(part)), pa.array([len(i) for i in ids], pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in ([i.astype("<u4").tobytes() for i in ids], codec.decode_lists(ids))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at += len(part)

    ids = ", ids array<int>" if with_ids else ""
    names = [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    return _map(docs, rank_path, pattern, [F.col(id_col), F.col(text_col).alias("text")], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long{ids}, ids_sha256 string, decoded_sha256 string", block)


def decode(encoded: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every list of ids; null and empty lists give empty text, bytes that are no UTF-8 become U+FFFD."""

    def block(codec: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = codec.decode_lists([np.array(x.as_py() or [], np.int64) for x in part.column(1)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(errors="replace") for t in texts], pa.string())], names=[id_col, "text"])

    return _map(encoded, rank_path, pattern, [F.col(id_col), F.col(ids_col).alias("ids")], f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string", block)
