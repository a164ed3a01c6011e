"""Subword encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces and scores come from a SentencePiece model file. A unigram model's scores are used as they are; a BPE model has
merge ranks instead of log scores, and its pieces get the log of a Zipf law over their ranks. Text that no piece
covers falls back to byte pieces. The whitespace marker stands for a space, and a text starts with one, so decoding
gives back every text exactly; a marker character that a text itself holds is encoded by its bytes.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, clean_texts, free_name, give_back, text_blocks
from .pretokens import MARK, Encoder, word_starts

MARKER = "▁"
#: An uncovered character costs so much more than the worst piece.
UNKNOWN_COST = 10.0
#: Encoded units that a worker remembers, twice.
REMEMBERED = 120_000
#: Longer units are cut where no piece and no character can reach across, which changes nothing.
LONG = 512
#: So few units of like length are encoded one by one, more of them together.
FEW = 64


def _fields(data: bytes):
    """(number, value) pairs of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 2: None, 5: 4}[kind]
            n = varint() if n is None else n
            yield key >> 3, data[i : i + n]
            i += n


@dataclass(frozen=True)
class Model:
    """pieces: the bytes that each id stands for; scores; normal: ids that Viterbi may use; byte_ids: of the 256 bytes."""

    pieces: list[bytes]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray
    unknown: int

    @property
    def unknown_score(self) -> float:
        return float(self.scores[self.normal].min()) - UNKNOWN_COST


#: Numbers of fields in the model's messages and of piece types, fixed by its format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TYPE, USER_DEFINED = 3, 4
CHARSMAP, DUMMY_PREFIX, NO_EXTRA_SPACES, ESCAPE_SPACES, RULES = 2, 3, 4, 5, 6


def _check_normalizer(parts: list[tuple[int, object]]) -> None:
    """Refuses models whose texts are changed before they are cut: only identity with a space put in front is supported."""
    spec = dict(_fields(next((v for k, v in parts if k == NORMALIZER), b"")))
    if spec.get(CHARSMAP) or spec.get(RULES):
        raise ValueError("the model maps characters before it encodes, which is not supported")
    if not spec.get(DUMMY_PREFIX, 1) or spec.get(NO_EXTRA_SPACES, 1) or not spec.get(ESCAPE_SPACES, 1):
        raise ValueError("only models that put one space in front of a text and keep all others are supported")
    if any(dict(_fields(v)).get(PIECE_TYPE) == USER_DEFINED for k, v in parts if k == PIECE):
        raise ValueError("user-defined symbols are not supported")


@cache
def load_model(path: str) -> Model:
    """The pieces of a model file. Models that normalise texts or have user-defined symbols are refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    parts = list(_fields(sp.serialized_model_proto()))
    _check_normalizer(parts)
    trainer = next(v for k, v in parts if k == TRAINER)
    unigram = dict(_fields(trainer)).get(3, 1) == 1
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
    byte_ids = np.full(256, -1, np.int64)
    pieces, normal = [], np.zeros(n, bool)
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(name.replace(MARKER, " ").encode())
            normal[i] = True
    if not unigram:
        ranks = -scores
        total = math.log(sum(1 / (r + 1) for r in ranks[normal]))
        scores = np.where(normal, -np.log(np.where(normal, ranks, 0) + 1) - total, 0.0)
    return Model(pieces, scores, normal, byte_ids, sp.unk_id())


@dataclass(frozen=True)
class DoubleArray:
    """A trie over bytes: from state s, byte c leads to t = base[s] + c + 1 if check[t] is s. State 1 is the root, 0 none."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 12
        base, check, value = [0] * size, [0] * size, [-1] * size
        check[0] = check[1] = -1
        free_from = 2
        queue = [(1, 0, len(keys), 0)]
        for state, a, b, depth in queue:
            if a < b and len(keys[a][0]) == depth:
                value[state] = keys[a][1]
                a += 1
            children = []
            while a < b:
                c, end = keys[a][0][depth], a + 1
                while end < b and keys[end][0][depth] == c:
                    end += 1
                children.append((c + 1, a, end))
                a = end
            if not children:
                continue
            while free_from < size and check[free_from]:
                free_from += 1
            at, tries = max(1, free_from - children[0][0]), 0
            while True:
                if at + 257 >= size:
                    base += [0] * size
                    check += [0] * size
                    value += [-1] * size
                    size *= 2
                if not any(check[at + c] for c, _, _ in children):
                    break
                at, tries = at + 1, tries + 1
            if tries > 64:  # the holes passed over are too small to be worth another look
                free_from = max(free_from, at)
            base[state] = at
            for c, begin, end in children:
                check[at + c] = state
                queue.append((at + c, begin, end, depth + 1))
        return cls(np.array(base, np.int64), np.array(check, np.int64), np.array(value, np.int64))

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        to = self.base[states] + chars + 1
        return np.where((to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == states), to, 0)


class Viterbi:
    """Best segmentations of many units at once; of equal ones, the longest first piece from the end wins."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # a piece that is listed twice counts by its first id
        first: dict[bytes, int] = {}
        for i in np.flatnonzero(model.normal):
            first.setdefault(model.pieces[i], int(i))
        self.trie = DoubleArray.build(list(first.items()))
        self.longest = max(map(len, first), default=1)
        #: Does some piece hold a space behind another character? Then units may not be cut before spaces.
        self.whole = any(b" " in p.lstrip(b" ") for p in first)

    def cuts(self, text: bytes) -> np.ndarray:
        """Places that no piece and no character of the text spans: 0, ..., the length. The parts between are encoded alone."""
        n = len(text)
        chars = np.frombuffer(text, np.uint8).astype(np.int64)
        width = 1 + (chars >= 0xC0).astype(np.int64) + (chars >= 0xE0) + (chars >= 0xF0)
        reach = np.minimum(np.arange(n) + width, n)
        reach[(chars & 0xC0) == 0x80] = 0  # no character begins here
        live, states = np.arange(n), np.ones(n, np.int64)
        for d in range(min(self.longest, n)):
            keep = live + d < n
            live, states = live[keep], states[keep]
            states = self.trie.step(states, chars[live + d])
            live, states = live[states > 0], states[states > 0]
            hit = live[self.trie.value[states] >= 0]
            reach[hit] = np.maximum(reach[hit], hit + d + 1)
            if not len(live):
                break
        furthest = np.maximum.accumulate(reach)
        return np.concatenate(([0], np.flatnonzero(furthest <= np.arange(1, n + 1)) + 1))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers."""
        ends = [self.cuts(t).tolist() if len(t) > LONG else [0, len(t)] for t in texts]
        found = iter(self._units([t[a:b] for t, cuts in zip(texts, ends) for a, b in zip(cuts, cuts[1:])]))
        return [b"".join(next(found) for _ in cuts[1:]) for cuts in ends]

    def _units(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        a = 0
        while a < len(order):  # units of like length share a matrix of bounded size
            b, top = a + 1, max(8, int(sizes[order[a]]) * 2)
            while b < len(order) and sizes[order[b]] <= top and (b - a) * top < 1 << 18:
                b += 1
            group = [texts[i] for i in order[a:b]]
            for i, ids in zip(order[a:b], self._batch(group) if b - a >= FEW else map(self._one, group)):
                out[i] = ids
            a = b
        return out

    @cached_property
    def _lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.model.scores.tolist()

    def _one(self, text: bytes) -> bytes:
        """The same for one unit, byte by byte in plain numbers: linear in its length, however long it is."""
        base, check, value, scores = self._lists
        n, size, unknown = len(text), len(check), self.model.unknown_score
        best, back, used = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i, c in enumerate(text):
            score = best[i]
            if score == -math.inf:
                continue
            width = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0)
            state, j, alone = 1, i, False
            while j < n:
                to = base[state] + text[j] + 1
                if to >= size or check[to] != state:
                    break
                state, j = to, j + 1
                piece = value[state]
                if piece >= 0:
                    alone |= j - i == width
                    if score + scores[piece] > best[j]:
                        best[j], back[j], used[j] = score + scores[piece], i, piece
            if not alone and i + width <= n and score + unknown > best[i + width]:
                best[i + width], back[i + width], used[i + width] = score + unknown, i, -1
        out, end = [], n
        while end:
            begin = back[end]
            if used[end] >= 0:
                out.append(used[end])
            elif self.model.byte_ids[0] >= 0:
                out += [int(self.model.byte_ids[c]) for c in reversed(text[begin:end])]
            else:
                out.append(self.model.unknown)
            end = begin
        return np.array(out[::-1], np.uint32).tobytes()

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        m, trie = self.model, self.trie
        n, top = len(texts), max(map(len, texts))
        if not top:
            return [b""] * n
        size = np.fromiter(map(len, texts), np.int64, n)
        chars = np.frombuffer(b"".join(t.ljust(top, b"\0") for t in texts), np.uint8).reshape(n, top).astype(np.int64)
        best = np.full((top + 1, n), -np.inf)
        best[0] = 0
        back, used = np.zeros((top + 1, n), np.int32), np.full((top + 1, n), -1, np.int32)
        for i in range(top):
            rows = np.flatnonzero((size > i) & (best[i] > -np.inf))
            if not len(rows):
                continue
            lead = chars[rows, i]
            width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            score = best[i, rows]
            alone = np.zeros(len(rows), bool)
            live, states = np.arange(len(rows)), np.ones(len(rows), np.int64)
            for d in range(min(self.longest, top - i)):
                here = rows[live]
                states = trie.step(states, chars[here, i + d])
                keep = (states > 0) & (size[here] > i + d)
                live, states = live[keep], states[keep]
                if not len(live):
                    break
                piece = trie.value[states]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    self._relax(best, back, used, i, i + d + 1, rows[live[hit]], score[live[hit]] + m.scores[piece[hit]], piece[hit])
                    alone[live[hit[width[live[hit]] == d + 1]]] = True
            for w in range(1, 5):
                odd = np.flatnonzero(~alone & (width == w))
                if len(odd) and i + w <= top:
                    self._relax(best, back, used, i, i + w, rows[odd], score[odd] + m.unknown_score, np.full(len(odd), -1))
        at, steps = size.copy(), []
        while (live := np.flatnonzero(at > 0)).size:
            token, begin = np.full(n, -2, np.int64), at.copy()
            token[live] = used[at[live], live]
            begin[live] = back[at[live], live]
            steps.append((token, begin, at))
            at = begin
        out: list[list[int]] = [[] for _ in range(n)]
        for token, begin, end in reversed(steps):
            for j in np.flatnonzero(token != -2):
                if token[j] >= 0:
                    out[j].append(int(token[j]))
                elif m.byte_ids[0] >= 0:
                    out[j] += [int(m.byte_ids[c]) for c in texts[j][begin[j] : end[j]]]
                else:
                    out[j].append(m.unknown)
        return [np.array(ids, np.uint32).tobytes() for ids in out]

    @staticmethod
    def _relax(best, back, used, begin, end, rows, score, piece) -> None:
        better = score > best[end, rows]
        rows = rows[better]
        best[end, rows], back[end, rows], used[end, rows] = score[better], begin, piece[better]


@cache
def _viterbi(path: str) -> Viterbi:
    return Viterbi(load_model(path))


@cache
def encoder(path: str) -> Encoder:
    viterbi = _viterbi(path)

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32) for x in viterbi([t.encode("utf-8", "surrogatepass") for t in texts])]

    return Encoder(word_starts, viterbi, whole, (lambda text: True) if viterbi.whole else (lambda text: MARK in text), REMEMBERED)


def encode(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the number of ids of each text; an empty text has none."""
    return encoder(path)([f" {t}" if t else "" for t in texts])


def decode(path: str, ids: np.ndarray) -> str:
    pieces = load_model(path).pieces
    return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


def _encoded(model_path: str, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_tokens, ids, round_trip of each text."""
    ids, counts = encode(model_path, texts)
    ends = np.concatenate(([0], np.cumsum(counts)))
    same = [decode(model_path, ids[ends[i] : ends[i + 1]]) == t for i, t in enumerate(texts)]
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_())


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (does decoding the ids give the text?).

    Reads doc_id and text, whatever other columns there are. Null and empty texts have no ids and decode to the empty
    text; texts of any length are encoded whole; null and repeated doc_ids give a row each; an empty table gives none.
    Of segmentations with the same score the one with the longer pieces from the end counts.
    """

    def run(batches):
        for batch, texts in text_blocks(batches, 1 << 19):
            name = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([name, *_encoded(model_path, texts)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return clean_texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")


def with_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of docs, but for those of the same names, with n_tokens, ids and round_trip; rows as in encode_documents."""
    bounded(docs.sparkSession)

    @F.arrow_udf("n_tokens bigint, ids array<int>, round_trip boolean")
    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [x or "" for x in column.to_pylist()]
            parts = [pa.StructArray.from_arrays(_encoded(model_path, texts[a:b]), ["n_tokens", "ids", "round_trip"]) for a, b in blocks(texts, 1 << 19)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]))
            give_back()

    name, new = free_name(docs, "_coded"), ("n_tokens", "ids", "round_trip")
    found = docs.withColumn(name, coded("text"))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new), f"{name}.*")
