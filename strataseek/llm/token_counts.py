"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each place of
a text; dynamic programming carries, for each place, the best score and the number of
pieces on its path, and nothing else. See ``unigram`` for scores, ties and bytes.

Null and empty texts have 0 tokens and score 0; a very long text is cut before its space
marks, and an unbroken string of any length takes 16 bytes a character; of equal sums the
one whose last piece is longer wins. Repeated rows are counted row by row; other columns,
whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, pick, slices_by_bytes
from .unigram import Vocabulary

#: From this many characters on, a segment's numbers are held in arrays.
LONG = 4096


class Counter(Memo):
    """segment -> (tokens, score)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(self.best)
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in vocabulary.matchable():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def best(self, text: str) -> tuple[int, float]:
        n, unknown = len(text), self.vocabulary.unknown_score
        # numbers take four times the room in a list, and less time
        score, count = ([0.0] * (n + 1), [0] * (n + 1)) if n < LONG else (array("d", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1))))
        at, best, pieces, single = 0, 0.0, 0, True
        # matches come by their ends, long ones first: of equal sums the earlier start stays
        for last, match in chain(self.automaton.iter(text), [(n, None)]):
            while at <= last:
                if not single:
                    s = score[at - 1] + unknown
                    if best is None or s > best:
                        best, pieces = s, count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
                score[at], count[at] = best, pieces
                at += 1
                best, single = None, False
            if match is None:
                break
            size, s = match
            start = at - size
            s += score[start]
            if best is None or s > best:
                best, pieces = s, count[start] + 1
            if size == 1:
                single = True
        return count[n], score[n]


_COUNTERS: dict[str, Counter] = {}


def counter_of(vocabulary: Vocabulary, key: str) -> Counter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens and score (the sum over the best segmentation)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file
    key = vocabulary.digest()

    def run(batches):
        memo = counter_of(shared.value, key)
        get = memo.__getitem__
        cut = memo.vocabulary.segments
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                counts, scores = [], []
                for text in batch.column(1).to_pylist():
                    parts = list(map(get, cut(text or "")))
                    counts.append(sum(x[0] for x in parts))
                    scores.append(float(sum(x[1] for x in parts)))
                yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "score"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
