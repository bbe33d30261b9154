"""SentencePiece-style encoding and decoding: Viterbi over a double-array trie.

The trie holds the UTF-8 bytes of the pieces: node s goes by byte b to base[s] + b if
check there is s. Each place of a text walks the trie once; see ``unigram`` for scores
and ties. A character that no piece covers becomes its byte pieces (or the unknown id in
a vocabulary without them). Decoding joins pieces, turns byte pieces into bytes and
space marks into spaces and takes off the space that encoding put in front.

Null and empty texts have no ids and decode to the empty text; a very long text is cut
before its space marks, and an unbroken string of any length takes 20 bytes for each of its
own; ties are those of ``unigram``. Repeated rows are encoded row by row; other columns,
whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, pick, slices_by_bytes
from .unigram import BYTE, CONTROL, SPACE, UNKNOWN, Vocabulary


NONE = float("-inf")
#: From this many bytes on, a segment's numbers are held in arrays.
LONG = 4096


class DoubleArray:
    """base, check and the value at each node (-1: none)."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0] = 0
        free, end, todo = 1, 1, [(0, tree)]
        while todo:
            at, node = todo.pop()
            self.value[at] = node.get(-1, -1)
            steps = sorted(b for b in node if b >= 0)
            if not steps:
                continue
            while self.check[free] >= 0:
                free += 1
                self._room(free + 512)
            # the first gap that fits, if one is found soon, else behind all others
            for base in range(max(free - steps[0], 1), free + 64):
                self._room(base + 512)
                if all(self.check[base + b] < 0 for b in steps):
                    break
            else:
                base = max(end - steps[0], 1)
                self._room(base + 512)
            end = max(end, base + steps[-1] + 1)
            self.base[at] = base
            for b in steps:
                self.check[base + b] = at
            todo += [(base + b, node[b]) for b in steps]
        self.base, self.check, self.value = self.base.tolist(), self.check.tolist(), self.value.tolist()

    def _room(self, n: int) -> None:
        if n >= len(self.check):
            more = len(self.check)
            self.base += array("i", [0]) * more
            self.check += array("i", [-1]) * more
            self.value += array("i", [-1]) * more


class Encoder(Memo):
    """segment -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(self.coded)
        self.vocabulary = v = vocabulary
        self.trie = DoubleArray([(p.encode("utf-8"), i) for p, i, _ in v.matchable()])
        self.byte_of = {i: b for b, i in enumerate(v.byte_id) if i >= 0}
        self.bytes = [bytes([self.byte_of[i]]) if t == BYTE and i in self.byte_of else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode("utf-8") for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True))]

    def best(self, segment: str) -> list[int]:
        v, text = self.vocabulary, segment.encode("utf-8", "surrogatepass")
        n = len(text)
        # numbers take four times the room in a list, and less time
        if n < LONG:
            score, came, by = [NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        else:
            score, came, by = array("d", [NONE]) * (n + 1), array("q", bytes(8 * (n + 1))), array("i", [-1]) * (n + 1)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        score[0], start = 0.0, 0
        scores = v.scores
        while start < n:
            here, first = score[start], text[start]
            size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            single = False
            at = 0
            for i in range(start, n):
                to = base[at] + text[i]
                if check[to] != at:
                    break
                at = to
                piece = value[at]
                if piece >= 0:
                    end = i + 1
                    if end - start == size:
                        single = True
                    s = here + scores[piece]
                    if s > score[end]:
                        score[end], came[end], by[end] = s, start, piece
            if not single:
                end = start + size
                s = here + v.unknown_score
                if s > score[end]:
                    score[end], came[end], by[end] = s, start, -1
            start += size
        ids: list[int] = []
        while n:
            start, piece = came[n], by[n]
            if piece >= 0:
                ids.append(piece)
            elif v.byte_id[0] >= 0:
                ids += [v.byte_id[b] for b in reversed(text[start:n])]
            else:
                ids.append(v.unknown)
            n = start
        return ids[::-1]

    def coded(self, segment: str) -> bytes:
        return np.array(self.best(segment), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.vocabulary.segments(text)))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes[i] for i in ids])
        if self.vocabulary.add_dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary, key: str) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids (array<int>), n_bytes (byte pieces among them)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    key = vocabulary.digest()

    def run(batches):
        encoder = encoder_of(shared.value, key)
        is_byte = np.zeros(len(encoder.bytes), bool)
        is_byte[list(encoder.byte_of)] = True
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                made = [np.frombuffer(encoder.encode(x or ""), "<u4") for x in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                flat = np.concatenate(made) if made else np.zeros(0, "<u4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                yield pa.record_batch([batch.column(0), ids, pa.array([int(is_byte[x].sum()) for x in made], pa.int64())], names=["doc_id", "ids", "n_bytes"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>, n_bytes bigint")


def decode_pieces(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text, from doc_id and ids."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    key = vocabulary.digest()

    def run(batches):
        encoder = encoder_of(shared.value, key)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.record_batch([batch.column(0), pa.array([encoder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return pick(coded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, ids, n_bytes, same (the text came back)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = vocabulary.digest()

    def run(batches):
        encoder = encoder_of(shared.value, key)
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                made = [np.frombuffer(encoder.encode(x), "<u4") for x in texts]
                back = [encoder.decode(x.tolist()) == t for x, t in zip(made, texts, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
                flat = np.concatenate(made) if made else np.zeros(0, "<u4")
                low, high = min(encoder.byte_of, default=1), max(encoder.byte_of, default=0)
                n_bytes = [int(((x >= low) & (x <= high)).sum()) for x in made]
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(n_bytes, pa.int64()), pa.array(back)], names=["doc_id", "ids", "n_bytes", "same"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>, n_bytes bigint, same boolean")
