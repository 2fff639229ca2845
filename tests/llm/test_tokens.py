"""Token counts and byte-level BPE against their libraries."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from tidymer.llm import byte_bpe, token_counts

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_sentencepiece(edges):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text or "" for r in edges.collect()]
    want = Counter((len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for t in texts)
    got = token_counts.count_tokens(edges, MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter((r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


@pytest.mark.parametrize("text", ["<s> </s> <unk>", "▁▁ a▁b", "a\x00b", "  lead", "tail  ", "\n\n\n", "1234567", "<0x0A>", "é" * 300, "a" * 3000])
def test_counts_of_odd_texts(text):
    with open(MODEL, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert token_counts.PieceCounter(model).counts([text, text]) == [len(sp.encode(text))] * 2


def test_bpe_equals_tiktoken(edges, library):
    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = byte_bpe.encode(edges, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in got) == Counter(row(r.doc_id, r.text) for r in edges.collect())


def test_bpe_round_trip(edges):
    back = byte_bpe.decode(byte_bpe.encode(edges, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in edges.collect())


def test_long_pieces_contract_in_the_same_order(library):
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), P.PATTERN)
    rnd = np.random.default_rng(0)
    for n in (401, 2000, 9000):
        text = "".join(rnd.choice(list("etaoinshrdlu"), n))
        assert codec.encode([text, "a"])[0].tolist() == library.encode_ordinary(text)


def test_unknown_id_is_an_error():
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), P.PATTERN)
    with pytest.raises(ValueError):
        codec.decode_lists([np.array([10**6])])


def test_decoding_whole_lists_in_runs(library, monkeypatch):
    """Decoded bytes come from the document's own list of ids, in runs where it is long."""
    monkeypatch.setattr(byte_bpe, "IDS", 7)
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), P.PATTERN)
    texts = ["", "one", "the quick brown fox jumps over the lazy dog " * 3, "é😀" * 9]
    lists = [np.array(library.encode_ordinary(t), np.int32) for t in texts]
    assert codec.decode_lists(lists) == [t.encode() for t in texts]
    assert codec.decode_lists([lists[2][::-1]])[0] != texts[2].encode()


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, MODEL).count() == 0
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0
