"""A unigram vocabulary read from a SentencePiece model file, with its tie rules.

The file is a protocol buffer; only pieces, scores, types and the normalizer's flags
are read. The best segmentation of a text has the highest sum of scores. Positions are
settled from left to right and a later candidate replaces an earlier one only if it is
strictly better, candidates with an earlier start (longer pieces) coming first: so of
equal sums the one whose last piece is longer wins, as in the library. A character that
no piece covers costs the lowest score less ten and is written as its UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    add_dummy_prefix: bool = True
    squeeze: bool = False
    byte_id: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        at = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.byte_id = [at.get(f"<0x{b:02X}>", -1) for b in range(256)]
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        used = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.unknown_score = (min(used) if used else 0.0) - PENALTY
        # a text may be cut before a space mark if no piece holds one after another character
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER))

    def digest(self) -> str:
        """Of all that a segmentation depends on; workers keep what they built under it."""
        return hashlib.sha256(repr((self.pieces, self.scores, self.types, self.add_dummy_prefix, self.squeeze)).encode("utf-8", "surrogatepass")).hexdigest()

    def matchable(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)) if t == NORMAL and p]

    def prepare(self, text: str) -> str:
        """The text with spaces as marks, and the mark that is put before it."""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.add_dummy_prefix else "") + text.replace(" ", SPACE)

    def segments(self, text: str) -> list[str]:
        """Parts of the prepared text that can be segmented on their own: each is a
        word with the marks before it."""
        made = self.prepare(text)
        if not made:
            return []
        if not self.cuts:
            return [made]
        parts = made.split(SPACE)
        out, marks = [], 0
        if parts[0]:
            out.append(parts[0])
        for x in parts[1:]:
            marks += 1
            if x:
                out.append(SPACE * marks + x)
                marks = 0
        if marks:
            out.append(SPACE * marks)
        return out


def _fields(raw: bytes):
    i, n = 0, len(raw)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < n:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            size = varint()
            yield key >> 3, raw[i : i + size]
            i += size
        elif wire == 5:
            yield key >> 3, raw[i : i + 4]
            i += 4
        else:
            yield key >> 3, raw[i : i + 8]
            i += 8


def read_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, types, flags = [], [], [], {3: 1, 4: 1, 5: 1}
    for number, value in _fields(raw):
        if number == 1:
            one = dict(_fields(value))
            pieces.append(one.get(1, b"").decode("utf-8"))
            scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            types.append(one.get(3, NORMAL))
        elif number == 3:
            made = dict(_fields(value))
            if made.get(2):
                raise ValueError("a vocabulary with a character map for normalizing is not supported")
            flags |= {k: v for k, v in made.items() if k in flags}
    if not flags[5]:
        raise ValueError("a vocabulary that keeps spaces as they are is not supported")
    return Vocabulary(pieces, scores, types, bool(flags[3]), bool(flags[4]))
