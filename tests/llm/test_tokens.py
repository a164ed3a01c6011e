"""Token files, token counts and the unigram encoder."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphlake.llm import token_count, token_store, unigram

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


AWKWARD = ["it's we're  he'll ''s I'D\n\n 's'sword 're\t\tx   ", "a<|endoftext|>b", " ", "\n", "   x", "x   ", "é ²³ ½ 中文 🙂🙂 a​b", "'s", "' s", "don't've", "\r\n\r\nfoo bar　baz", "x\u001cy", "a\U0010ffffb", ""]


def test_encoder_equals_the_library(library):
    random.seed(1)
    texts = AWKWARD + ["".join(random.choice("a b'srtdlve\n\t 1²é.,中") for _ in range(random.randint(1, 30))) for _ in range(4000)]
    ids, counts = token_store.byte_level_encoder(BPE)(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


@given(st.lists(st.integers(0, 10**12), max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values):
    values = sorted(values)
    ef = token_store.EliasFano.build(np.array(values, np.int64))
    assert ef.select_range(0, ef.n).tolist() == values and [ef.select(i) for i in range(len(values))] == values
    assert token_store.EliasFano.load(ef.n, ef.low_bits, *ef.parts()).select_range(0, ef.n).tolist() == values
    for a, b in [(0, 0), (ef.n // 3, ef.n // 2), (ef.n // 2, ef.n), (min(64, ef.n), min(129, ef.n))]:
        assert ef.select_range(a, b).tolist() == values[a:b]


def test_boundaries_are_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10_000))
    assert sum(map(len, token_store.EliasFano.build(values).parts())) * 8 / len(values) < 13


def test_token_files(spark, odd, none, library, tmp_path):
    listed = token_store.write_tokens(spark, odd, BPE, str(tmp_path / "t"), files=3)
    rows = token_store.read_tokens(listed).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts for ids in [library.encode(t, add_special_tokens=False).ids + [2]]}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(texts)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    first = listed.orderBy("file").head()
    reader = token_store.Reader(first.path)
    assert [len(reader.ids(i)) for i in range(first.docs)] == [r.n_tokens for r in ordered[: first.docs]]
    assert list(zip(*reader.documents(docs=2)))[0] == tuple(ids[: first.docs])
    for r in listed.collect():
        own = token_store.Reader(r.path)
        names = [x[0] for x in own.documents()]
        assert all(own.find(x) == names.index(x) for x in names if x is not None) and own.find(10**9) == r.docs
    assert token_store.read_tokens(token_store.write_tokens(spark, none, BPE, str(tmp_path / "n"))).count() == 0


@pytest.mark.parametrize("block", [1, 1 << 24])
def test_counts(spark, odd, none, library, block):
    rows = token_count.count_tokens(spark, odd, BPE, block=block).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=key) == sorted(((i, len(t.encode()), n, n > 512) for i, t in texts for n in [len(library.encode(t, add_special_tokens=False))]), key=key)
    assert token_count.count_tokens(spark, none, BPE).count() == 0


def test_a_task_that_runs_again_replaces_no_block(spark, library, tmp_path, monkeypatch):
    """Its rows in another order make other codes: the files of the first run stay, and its numbers lead to them."""
    texts = ["one two three", "three four", "five one six"]
    kept = {}
    for order in ([0, 1, 2], [2, 0, 1], [0, 1, 2]):
        block = token_count._Block()
        block.add(order, [texts[i] for i in order], *token_count._tokenizer(BPE))
        number = block.save(str(tmp_path), 7)
        kept.setdefault(number, []).append([list(block.codes), block.ids])
        names, _, _, _ = token_count._Block.load(f"{tmp_path}/{number}")
        assert names[0].tolist() == order
    assert len(kept) == 2 and all(x == same[0] for same in kept.values() for x in same)
    assert len(list(tmp_path.iterdir())) == 2


def test_units_without_spaces():
    """Long ones are cut where nothing reaches across, and what is left is encoded in linear time, with the same ids."""
    random.seed(3)
    viterbi = unigram._viterbi(PIECES)
    for alphabet in ("theandof", "abcdefghijklmnopqrstuvwxyz0123456789+/", "日本語中文é🙂the", "ab"):
        text = "".join(random.choice(alphabet) for _ in range(1500)).encode()
        cuts = viterbi.cuts(text)
        assert viterbi._one(text) == viterbi._batch([text])[0] == viterbi([text])[0]
        assert cuts[0] == 0 and cuts[-1] == len(text) and b"".join(viterbi._one(text[a:b]) for a, b in zip(cuts, cuts[1:])) == viterbi._one(text)
    ids, _ = unigram.encode(PIECES, ["theandofinto" * 20_000])
    assert unigram.decode(PIECES, ids) == "theandofinto" * 20_000


def test_models_that_change_texts_are_refused():
    put = lambda f, b: _varint(f << 3 | 2) + _varint(len(b)) + b
    flag = lambda f, n: _varint(f << 3) + _varint(n)
    good = flag(unigram.DUMMY_PREFIX, 1) + flag(unigram.NO_EXTRA_SPACES, 0)
    unigram._check_normalizer([(unigram.NORMALIZER, good)])
    for bad in ([(unigram.NORMALIZER, good + put(unigram.CHARSMAP, b"x"))], [(unigram.NORMALIZER, flag(unigram.NO_EXTRA_SPACES, 0) + flag(unigram.DUMMY_PREFIX, 0))], [], [(unigram.NORMALIZER, good), (unigram.PIECE, flag(unigram.PIECE_TYPE, unigram.USER_DEFINED))]):
        with pytest.raises(ValueError):
            unigram._check_normalizer(bad)


def brute_score(model: unigram.Model, text: bytes) -> float:
    """The best total of any segmentation."""
    table = {model.pieces[i]: model.scores[i] for i in np.flatnonzero(model.normal)[::-1]}
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        if best[i] == -np.inf:
            continue
        width = 1 + (text[i] >= 0xC0) + (text[i] >= 0xE0) + (text[i] >= 0xF0)
        if text[i : i + width] not in table:
            best[i + width] = max(best[i + width], best[i] + model.unknown_score)
        for j in range(i + 1, min(len(text), i + 50) + 1):
            if text[i:j] in table:
                best[j] = max(best[j], best[i] + table[text[i:j]])
    return best[-1]


def test_viterbi_is_best_and_decodes():
    model = unigram.load_model(PIECES)
    random.seed(7)
    texts = ["".join(random.choice("the and  ingé中🙂▁\n&&#") for _ in range(random.randint(1, 25))) for _ in range(400)] + ["", "x" * 3000, "\U0010ffff", "  "]
    ids, counts = unigram.encode(PIECES, texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert unigram.decode(PIECES, own) == t
        if not t:
            continue
        # bytes of one uncovered character count once
        total, k = 0.0, 0
        while k < len(own):
            if model.normal[own[k]]:
                total, k = total + model.scores[own[k]], k + 1
            else:
                b = model.pieces[own[k]][0]
                total, k = total + model.unknown_score, k + 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
        assert total == pytest.approx(brute_score(model, (" " + t).encode())), t


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def test_equals_the_library_on_a_unigram_model():
    """The library, given the same pieces and scores as a unigram model, finds the same ids where no two are equally good."""
    model = unigram.load_model(PIECES)
    proto = sentencepiece.SentencePieceProcessor(model_file=PIECES).serialized_model_proto()
    put = lambda f, b: _varint(f << 3 | 2) + _varint(len(b)) + b
    out, k = b"", 0
    for f, v in unigram._fields(proto):
        if f == 1:
            d = dict(unigram._fields(v))
            out += put(1, put(1, d[1]) + _varint(2 << 3 | 5) + struct.pack("<f", model.scores[k]) + (_varint(3 << 3) + _varint(d[3]) if 3 in d else b""))
            k += 1
        elif f == 2:
            own = b""
            for g, x in unigram._fields(v):
                x = 1 if g == 3 else x
                own += _varint(g << 3) + _varint(x) if isinstance(x, int) else _varint(g << 3 | 5) + x if g == 10 and len(x) == 4 else put(g, x)
            out += put(2, own)
        else:
            out += put(f, v)
    lib = sentencepiece.SentencePieceProcessor()
    lib.load_from_serialized_proto(out)
    texts = ["the quick brown fox", "Über allen Gipfeln ist Ruh", "l'été et le déjà vu", "naïve 中文 text 🙂", "a b  c   d"]
    ids, counts = unigram.encode(PIECES, texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == lib.encode(texts)


def test_encode_documents_odd_rows(odd, none):
    rows = unigram.encode_documents(odd, PIECES).collect()
    assert len(rows) == odd.count() and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    assert unigram.encode_documents(none, PIECES).count() == 0
