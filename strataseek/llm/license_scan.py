"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and Spark-joined to the k-gram hashes of
the templates. A match at word i of the text and word j of a template votes for the
diagonal i - j. Votes are summed by (document, template, diagonal). Short phrases
(k = 2) must fill their diagonal: each full one is a place. Long templates (k = 4) may
have words put in or left out: neighbouring diagonals, at most ``DRIFT`` apart, are merged
if the one goes on, in the text and in the template, where the other ended; what begins
the template anew is another copy. A merged span must hold the share ``SHARE`` of the
template's k-grams, and they that share of the span. Then it is verified by its words: the
longest sequence of words that span and template have in common must be ``WORDS`` of
either or more; that share is the span's. For this a document's own row carries each of
its words as one number: its place in the templates' vocabulary, 0 for any other.

The templates are fixed text, so the side that is sent to all tasks has a proven size.
Null and empty texts have no words and no labels; a very long text is scanned whole and
alone; labels are sorted, so there are no ties. Repeated rows are scanned row by row;
other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, pick, slices_by_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHORT, LONG = 2, 4
DRIFT = 6
SHARE = 0.6
WORDS = 0.8

# The phrases and their labels, and the opening notices that the licenses
# themselves ask for, in lower case.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "apache-2.0-notice": "licensed under the apache license version 2.0",
    "apache-2.0-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4.0",
    "cc-by-sa-4.0-notice": "licensed under cc by sa 4.0",
    "cc-by-4.0-text": "this work is licensed under a creative commons attribution 4.0 international license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}

_LOWER = {i: i + 32 for i in range(65, 91)}
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


#: word -> XXH64, for the words that a worker met last.
_HASHES = Memo(_word_hash)


def gram_hashes(words: list[str], k: int) -> np.ndarray:
    """Rolling hashes of all k-grams, as signed longs."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    h = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def templates(spark: SparkSession) -> DataFrame:
    """template, tpos, gram, and the fixed head row that every document's own row meets."""
    rows = [(-1, 0, 0)]
    for t, (text, k) in enumerate(all_templates()):
        rows += [(t, j, int(h)) for j, h in enumerate(gram_hashes(words_of(text), k))]
    return spark.createDataFrame(rows, "template int, tpos int, gram bigint")


def all_templates() -> list[tuple[str, int]]:
    return [(x, SHORT) for x in PHRASES] + [(x, LONG) for x in NOTICES.values()]


def vocabulary() -> dict[str, int]:
    """The words of the long templates, from 1."""
    return {w: i for i, w in enumerate(sorted({w for x in NOTICES.values() for w in words_of(x)}), 1)}


def codes_of(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w, 0) for w in words], np.uint16)


def scan(docs: DataFrame, least: float = SHARE, drift: int = DRIFT) -> DataFrame:
    """For each document: n_words, the places of phrases, and verified spans.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels and labels
    (sorted, comma-joined), score (share of the best span), spans (label, first and
    last word, share)."""

    def grams(batches):
        shard, n, words_known = TaskContext.get().partitionId(), 0, vocabulary()
        for whole in batches:
            for batch in slices_by_bytes(whole, 1, 1 << 20):
                rows, counts, held, at, codes = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    rows.append(shard << 40 | n)
                    n += 1
                    counts.append(len(words))
                    short, long = gram_hashes(words, SHORT), gram_hashes(words, LONG)
                    # the head, then at place i (from 0): the 2-gram and the 4-gram
                    held.append(np.concatenate([[0], short, long]).astype(np.int64))
                    at.append(len(short))
                    codes.append(codes_of(words, words_known).tobytes())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                values = np.concatenate(held)
                # a document's words go with its head alone
                heads = np.full(len(values), -1, np.int64)
                heads[offsets[:-1]] = np.arange(len(codes))
                own = pa.array(codes, pa.binary()).take(pa.array(heads, mask=heads < 0))
                each = pa.StructArray.from_arrays([pa.array(values), own], names=["gram", "words"])
                yield pa.record_batch([pa.array(rows, pa.int64()), batch.column(0), pa.array(counts, pa.int64()), pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), each)], names=["row", "doc_id", "n_words", "n_short", "grams"])

    spark = docs.sparkSession
    made = pick(docs, doc_id="bigint", text="string").mapInArrow(grams, "row bigint, doc_id bigint, n_words bigint, n_short int, grams array<struct<gram:bigint,words:binary>>")
    each = made.select("row", "doc_id", "n_words", "n_short", F.posexplode("grams").alias("p", "g")).select("row", "doc_id", "n_words", "n_short", "p", "g.gram", "g.words")
    known = F.broadcast(templates(spark))  # fixed text, some hundreds of rows
    hit = each.join(known, "gram").where((F.col("template") == -1) == (F.col("p") == 0))
    place = F.when(F.col("p") <= F.col("n_short"), F.col("p") - 1).otherwise(F.col("p") - 1 - F.col("n_short"))
    hit = hit.withColumn("i", F.when(F.col("p") == 0, F.lit(0)).otherwise(place))
    # (i, tpos) is met once on a diagonal, so the count is one of distinct places; the head is
    # a diagonal of its own
    votes = hit.groupBy("row", "doc_id", "n_words", "template", (F.col("i") - F.col("tpos")).alias("diagonal"), "words").agg(F.count("*").alias("votes"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    # the votes of one document: few, as only k-grams of templates vote
    vote = F.when(F.col("template") >= 0, F.struct("template", "diagonal", "votes", "i0", "i1"))
    per = votes.groupBy("row", "doc_id", "n_words").agg(F.collect_list(vote).alias("v"), F.collect_list("words").alias("words"))

    def judge(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for v, words in zip(batch.column("v").to_pylist(), batch.column("words"), strict=True):
                    codes = np.frombuffer(words[0].as_py(), np.uint16) if v else np.zeros(0, np.uint16)
                    rows.append(verdict([(x["template"], x["diagonal"], x["votes"], x["i0"], x["i1"]) for x in v], codes, least, drift))
                yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=names)

    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,share:double>>"
    return per.select("doc_id", "n_words", "v", "words").mapInArrow(judge, schema)


def chains(votes: list[tuple[int, int, int, int, int]], drift: int = DRIFT) -> list[list[tuple[int, int, int, int, int]]]:
    """Diagonals of one template as copies: each goes on where one before it ended."""
    out: list[list[tuple[int, int, int, int, int]]] = []
    for x in sorted(votes, key=lambda x: (x[3], x[1])):
        _, diagonal, _, i0, _ = x
        for chain in reversed(out):
            _, d, _, _, i1 = chain[-1]
            if abs(diagonal - d) <= drift and i0 > i1 and i0 - diagonal > i1 - d:
                chain.append(x)
                break
        else:
            out.append([x])
    return out


def in_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of ``a`` (0 matches nothing) and ``b``, and
    the first and last place in ``a`` of one such."""
    n, m = len(a), len(b)
    size = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        same = (a[i] == b) & (a[i] > 0)
        row = np.where(same, size[i + 1, 1:] + 1, size[i + 1, :-1])
        size[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    at, i, j = [], 0, 0
    while i < n and j < m and size[i, j]:
        if a[i] == b[j] and a[i] > 0 and size[i, j] == size[i + 1, j + 1] + 1:
            at.append(i)
            i, j = i + 1, j + 1
        elif size[i + 1, j] == size[i, j]:
            i += 1
        else:
            j += 1
    return len(at), at[0] if at else 0, at[-1] if at else -1


def verdict(votes: list[tuple[int, int, int, int, int]], codes: np.ndarray, least: float = SHARE, drift: int = DRIFT) -> tuple:
    """From one document's (template, diagonal, votes, first and last matched place) and its
    words: n_base, first_word, last_word, base_labels, labels, score, spans."""
    texts, labels, need = _templates()
    places, spans, long = [], [], {}
    for x in sorted(votes):
        if x[0] < len(PHRASES):
            if x[2] == need[x[0]]:
                places.append((x[1], labels[x[0]]))
        else:
            long.setdefault(x[0], []).append(x)
    for t, own in long.items():
        for chain in chains(own, drift):
            n, i0, i1 = sum(x[2] for x in chain), chain[0][3], max(x[4] for x in chain)
            if min(n / need[t], n / (i1 - i0 + 1)) < least:
                continue
            # where the template would begin and end
            size = len(texts[t])
            lo = max(0, i0 - (chain[0][3] - chain[0][1]))
            hi = min(len(codes), i1 + size - (chain[-1][4] - chain[-1][1]))
            same, first, last = in_common(codes[lo:hi], texts[t])
            share = same / max(size, last - first + 1)
            if share >= WORDS:
                spans.append({"label": labels[t], "first": lo + first, "last": lo + last, "share": share})
    spans.sort(key=lambda x: (x["first"], x["label"]))
    base = sorted({x for _, x in places})
    at = [x for x, _ in places]
    score = 1.0 if places else max([x["share"] for x in spans], default=0.0)
    return len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x["label"] for x in spans)})), score, spans


@lru_cache(1)
def _templates() -> tuple[list[np.ndarray], list[str], list[int]]:
    """Words (as numbers), label and number of k-grams of each template."""
    known = vocabulary()
    return [codes_of(words_of(x), known) for x, _ in all_templates()], [*PHRASES.values(), *NOTICES], [len(words_of(x)) - k + 1 for x, k in all_templates()]
