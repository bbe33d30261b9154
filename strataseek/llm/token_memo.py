"""Token ids by the tokenizers library, with a bounded memory of pieces.

A BPE tokenizer first cuts a text into pre-tokens and works on each alone. So a text
may be cut wherever no pre-token can cross, each distinct piece be encoded once per
worker, and the pieces' ids be joined. Which cuts are safe depends on the
pre-tokenizer; both kinds here fall back to one call for the whole text where the
rules below do not apply.

Cuts are marked in the texts by a character that no cut text holds, so Arrow numbers the
distinct pieces of many texts at once. Only these are looked up, one by one, in the
worker's memory; the ids of all pieces are then gathered by their numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of pieces and ids kept per worker; beyond it, the younger half is forgotten.
MEMO_BYTES = 128 << 20
#: What a piece costs besides its characters and ids.
MEMO_EACH = 200
#: Longer pieces (unbroken strings) are encoded each time and never kept.
MEMO_CHARS = 64

#: Python's white space has these four, the tokenizers' \s does not; \0 marks pieces.
_ODD = "\x1c\x1d\x1e\x1f\0"
#: Stands between pieces; texts that hold it are odd.
_CUT = "\x1c"
#: Pieces whose ids are gathered at a time, so that what is computed from them stays in cache.
AT_A_TIME = 1 << 17
#: White space other than space and line feed.
_RARE = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(r"\s\s")
_SPACED = re.compile(r"\s*\S+|\s+")
_WORD = re.compile(r"[^\s\0]+")


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD)


def _runs(text: str) -> bool:
    """Whether two white space characters follow each other."""
    if any(c in text for c in _RARE):
        return _RUN.search(text) is not None
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def _stops(text: str) -> bool:
    """Whether a comma or full stop follows what is neither a letter nor a digit, so that
    a cut before it is not safe."""
    parts = text.replace(",", ".").split(".")
    ends = [x[-1:] for x in parts[1:-1]]
    return "" in ends or bool(ends) and not "".join(ends).isalnum() or len(parts) > 1 and parts[0] != "" and not parts[0][-1].isalnum()


def kind_of(spec: str) -> str:
    """``byte`` for a byte-level pre-tokenizer that keeps spaces, ``word`` for one
    that lower-cases and drops white space, ``whole`` for any other."""
    import json

    made = json.loads(spec)
    pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    parts = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if parts == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in steps[0].get("pattern", {}).get("Regex", ""):
        return "word"
    return "whole"


class TokenMemo:
    """``ids(text)`` gives what ``encode(text, add_special_tokens=False).ids`` does, as
    little-endian unsigned 32-bit integers. A text that may hold the string of a special
    token goes to the library whole."""

    def __init__(self, spec: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = json.loads(spec)
        self.full = Tokenizer.from_str(spec)
        self.bare = Tokenizer.from_str(json.dumps(made | {"normalizer": None}))
        # what all strings of special tokens begin with, up to the first letter
        self.probe = re.match(r"[^\w\s]*", os.path.commonprefix([x["content"] for x in made.get("added_tokens", [])]))[0]
        special = bool(made.get("added_tokens"))
        self.kind = kind_of(spec) if self.probe or not special else "whole"
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        self.cut = {"byte": self._byte_cut, "word": self._word_cut, "whole": lambda text: None}[self.kind]
        # in a run of words, each begins (byte) or, of letters only, ends (word) with such a token
        mark = {"byte": lambda x: x.startswith("\u0120"), "word": lambda x: x.endswith("</w>"), "whole": lambda x: False}[self.kind]
        vocab = self.full.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for x, i in vocab.items() if mark(x)]] = True

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.probe and self.probe in x else self.cut(x) for x in texts]
        made = iter(self._gather([x.encode() for x in cut if x is not None]))
        return [self._whole(x) if c is None else next(made) for x, c in zip(texts, cut, strict=True)]

    def _gather(self, cut: list[bytes]) -> list[bytes]:
        """The ids of each text, given with its cuts marked."""
        if not cut:
            return []
        mark = _CUT.encode()
        joined = mark.join(cut) + mark
        # a piece has the mark behind it, so that one's end is the next one's start
        edges = np.concatenate([[0], np.flatnonzero(np.frombuffer(joined, np.uint8) == mark[0]) + 1])
        last = np.searchsorted(edges, np.cumsum([len(x) + 1 for x in cut]))  # pieces up to each text's end
        coded = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(joined)).dictionary_encode()
        _, ends, names = coded.dictionary.buffers()
        end = int(np.frombuffer(ends, np.int64)[len(coded.dictionary)])
        found = self._find(str(memoryview(names)[:end], "utf-8").split(_CUT)[:-1])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        out = np.empty(ends[-1], "<u4")
        for s in range(0, len(which), AT_A_TIME):
            some, to = which[s : s + AT_A_TIME], ends[s : s + AT_A_TIME + 1]
            out[to[0] : to[-1]] = ids[np.repeat(starts[some] - to[:-1], sizes[some]) + np.arange(to[0], to[-1])]
        stops = ends[last].tolist()
        return [out[i:j].tobytes() for i, j in zip([0, *stops], stops, strict=False)]

    def _find(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if self.held > MEMO_BYTES:
            for old in list(self.pieces)[len(self.pieces) // 2 :]:
                self.held -= len(old) + len(self.pieces.pop(old)) + MEMO_EACH
        found = list(map(self.pieces.get, keys))
        at = [i for i, x in enumerate(found) if x is None]
        new = [keys[i] for i in at]
        self._learn(new)
        for i, ids in zip(at, map(self.pieces.__getitem__, new), strict=True):
            found[i] = ids
        for x in new if max(map(len, new), default=0) > MEMO_CHARS else ():
            if len(x) > MEMO_CHARS:
                self.held -= len(x) + len(self.pieces.pop(x)) + MEMO_EACH
        self.held += sum(map(len, new)) + sum(len(found[i]) for i in at) + MEMO_EACH * len(new)
        return found

    def _learn(self, new: list[str], run: int = 400) -> None:
        """Encode many new words in one call, and the rest in another."""
        words = [x for x in new if (x.isalpha() or _WORD.fullmatch(x) if self.kind == "byte" else x.isalpha() and _plain(x))]
        runs = [words[i : i + run] for i in range(0, len(words), run)]
        lead = " " if self.kind == "byte" else ""
        for held, made in zip(runs, self.bare.encode_batch_fast([lead + " ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.asarray(made.ids, dtype="<u4")
            at = np.flatnonzero(self.edge[ids])
            ends = np.append(at[1:], len(ids)) if self.kind == "byte" else at + 1
            if len(ends) != len(held):
                continue  # not as expected: with the rest
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            self.pieces.update(zip(held, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [x for x in new if x not in self.pieces]
        if self.kind == "byte":
            # a leading \0 marks a piece that has no space before it
            self._encode(self.full, rest, [x[1:] if x[:1] == "\0" else " " + x for x in rest])
        else:
            plain = [x for x in rest if _plain(x)]
            self._encode(self.bare, plain, plain)
            other = [x for x in rest if not _plain(x)]
            self._encode(self.full, other, other)

    def _encode(self, tokenizer, keys: list[str], texts: list[str], at_a_time: int = 4096) -> None:
        for i in range(0, len(keys), at_a_time):
            made = tokenizer.encode_batch_fast(texts[i : i + at_a_time], add_special_tokens=False)
            self.pieces.update((k, np.asarray(m.ids, dtype="<u4").tobytes()) for k, m in zip(keys[i : i + at_a_time], made, strict=True))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _byte_cut(self, text: str) -> str | None:
        if _odd(text):
            return None
        if _runs(text) or _stops(text):
            return _CUT.join("\0" + x for x in _SPACED.findall(text)) or "\0"
        return "\0" + text.replace(" ", _CUT).replace(",", _CUT + "\0,").replace(".", _CUT + "\0.").replace("\n", f"{_CUT}\0\n{_CUT}\0")

    def _word_cut(self, text: str) -> str | None:
        if _odd(text):
            return None
        if _latin(text):
            text = text.lower()  # these letters are lower-cased alike everywhere
            if not _stops(text):
                text = text.replace(",", " ,").replace(".", " .")
        return _CUT.join(text.split())


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _plain(key: str) -> bool:
    """Whether normalizing leaves it as it is."""
    return _latin(key) and key == key.lower()


@lru_cache(2)
def memo_of(spec: str) -> TokenMemo:
    """One memo per worker process and tokenizer; it outlives a task."""
    return TokenMemo(spec)


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()
