"""Quality rules whose cutoffs adapt to each language and source.

For every document a few ratios are taken over its whole text. Each ratio's values in a
(lang, source) group are kept as a quantile sketch with logarithmic buckets (DDSketch,
Masson et al., 2019): counts by bucket, so sketches merge by addition in any order and
a quantile is known within 2 %. A group's sketch is merged with its language's, which
weighs as much as ``LANG_WEIGHT`` documents, and with that of all, which weighs as much as
``ALL_WEIGHT``: a large group speaks for itself, a small one is drawn towards its parents,
and nothing changes at any size. The cutoff is the upper quartile plus ``SPREADS`` times
the distance between the quartiles; ``GUARD`` stands in for that distance where values are
all but equal, so that a language or source in which a ratio is nearly always 0 does not
lose each document in which it is not. A group's cutoff may exceed its language's by the
factor ``STRETCH`` at most, so a source that is mostly junk cannot set its own standard. A
document is kept if it meets the base rules and none of its ratios passes its cutoff.

Null texts count as empty and fail the base rules. Null lang or source are groups of
their own. A value at the cutoff stays. A very long text is measured whole and alone.
Repeated rows are judged row by row; other columns, whatever their names, are left out by
``judge`` and kept by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, place_of, stash, without_appended

GROWTH = 1.04
SPREADS = 6
LANG_WEIGHT, ALL_WEIGHT = 64, 16
STRETCH = 3
#: In 1/10000: the least distance between quartiles.
GUARD = {"symbols": 100, "dup_lines": 600, "repeats": 500, "capitals": 20, "marks": 120, "long_words": 1000}
#: Weights of sketches are whole numbers of this share of a document.
UNIT = 1_000_000
SYMBOLS = frozenset("#*$%&|<>")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[!?;:=~^@\\/\[\]{}(){}_+]")


def measures(text: str | None) -> dict[str, int]:
    """The base counts of one text, and what the ratios need."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if _has_word(x)]
    covered = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        twice = {w for w, c in Counter(windows).items() if c > 1}
        if twice:
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    covered += i + 3 - max(i, end)
                    end = i + 3
    letters = sum(map(len, words))
    return {
        "n_words": n,
        "word_chars": letters,
        "n_symbols": sum(text.count(x) for x in SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": covered,
        "n_lines": len(lines),
        "n_upper": len(_UPPER.findall(text)),
        "n_marks": len(_MARKS.findall(text)),
    }


def _has_word(line: str) -> bool:
    return bool(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


ALL = (*BASE, "n_lines", "n_upper", "n_marks")


MEASURES = T.StructType([T.StructField(x, T.LongType()) for x in ALL])


def measure_arrays(texts: list[str | None]) -> list[pa.Array]:
    rows = [measures(x) for x in texts]
    return [pa.array([r[x] for r in rows], pa.int64()) for x in ALL]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts, a row for each row of ``docs``."""
    made = append_columns(pick(docs, doc_id="bigint", lang="string", source="string", text="string"), "text", measure_arrays, MEASURES)
    return made.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(("doc_id", "lang", "source"))], *ALL)


def ratios() -> dict[str, F.Column]:
    """Whole numbers of 1/10000."""
    over = lambda a, b: F.floor(F.lit(10000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("bigint")
    return {"symbols": over("n_symbols", "n_words"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "capitals": over("n_upper", "word_chars"), "marks": over("n_marks", "n_words"), "long_words": over("word_chars", "n_words")}


def bucket(x: F.Column) -> F.Column:
    """0 for 0, and 1 + floor(log_GROWTH x) for a whole number."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.lit(1) + F.floor(F.log(x.cast("double")) / F.log(F.lit(GROWTH)))).cast("int")


def bucket_top(b: F.Column) -> F.Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), b.cast("double")))


def fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The cutoff of each sketch (keys, ratio, bucket, w); null keys are keys."""
    run = Window.partitionBy(*keys, "ratio").orderBy("bucket")
    at = sketch.withColumn("upto", F.sum("w").over(run)).withColumn("n", F.sum("w").over(Window.partitionBy(*keys, "ratio")))
    first = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("n") * q, bucket_top(F.col("bucket"))))
    guard = F.create_map(*[F.lit(x) for kv in GUARD.items() for x in kv])[F.col("ratio")].cast("double")
    q = at.groupBy(*keys, "ratio").agg(first(1).alias("q1"), first(3).alias("q3"))
    return q.select(*keys, "ratio", (F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q1"), guard)).alias(name))


def cutoffs(counts: DataFrame) -> DataFrame:
    """lang, source, ratio and cutoff of every (lang, source) group in ``counts``."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()]))
    # texts that fail the base rules have no say in what is usual
    sound = counts.where(~base_failed())
    fine = stash(sound.select("lang", "source", named.alias("x")).select("lang", "source", "x.*").groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("c")), "quality-sketch")
    by_lang = fine.groupBy("lang", "ratio", "bucket").agg(F.sum("c").alias("c"))
    overall = fine.groupBy("ratio", "bucket").agg(F.sum("c").alias("c"))

    def share(sketch: DataFrame, keys: list[str], weight: int) -> DataFrame:
        n = F.sum("c").over(Window.partitionBy(*keys, "ratio"))
        return sketch.withColumn("n", n).select(*keys, "ratio", "bucket", F.expr(f"{weight * UNIT}L * c div n").alias("w"))

    own = lambda sketch, keys: sketch.select(*keys, "ratio", "bucket", (F.col("c") * UNIT).alias("w"))
    # every group has each ratio, so parents are joined by it; a parent has a few hundred buckets
    langs = by_lang.select("lang", "ratio").distinct()
    groups = fine.select("lang", "source", "ratio").distinct()
    of_all = share(overall, [], ALL_WEIGHT)
    of_lang = share(by_lang, ["lang"], LANG_WEIGHT).select(F.col("lang").alias("l2"), F.col("ratio").alias("r2"), "bucket", "w")
    same = F.col("lang").eqNullSafe(F.col("l2")) & (F.col("ratio") == F.col("r2"))
    merged_lang = own(by_lang, ["lang"]).unionByName(langs.join(of_all, "ratio"))
    merged = own(fine, ["lang", "source"]).unionByName(groups.join(of_lang, same).drop("l2", "r2")).unionByName(groups.join(of_all, "ratio"))
    add = lambda df, keys: df.groupBy(*keys, "ratio", "bucket").agg(F.sum("w").alias("w"))
    wide = fences(add(merged_lang, ["lang"]), ["lang"], "wide").select(F.col("lang").alias("l2"), F.col("ratio").alias("r2"), "wide")
    fine_cut = fences(add(merged, ["lang", "source"]), ["lang", "source"], "own")
    joined = fine_cut.join(wide, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("ratio") == F.col("r2")))
    return joined.select("lang", "source", "ratio", F.least("own", F.col("wide") * STRETCH).alias("cutoff"))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def verdicts(counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds base_failed, reasons (ratios past their cutoff) and kept to stored counts."""
    marks = cutoffs(counts.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *ALL))
    marks = marks.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", "cutoff"))).alias("cut"))
    # stored, so the engine knows how small the table is: it is sent to all tasks and rows
    # stay where they are; one too large for that is joined, and hot groups are split
    marks = stash(marks.select(F.col("lang").alias("l2"), F.col("source").alias("s2"), "cut"), "quality-cutoffs")
    both = counts.join(marks, F.col(lang).eqNullSafe(F.col("l2")) & F.col(source).eqNullSafe(F.col("s2")), "left").drop("l2", "s2")
    past = [F.when(v.cast("double") > F.col("cut")[k], F.lit(k)) for k, v in ratios().items()]
    out = both.withColumn("base_failed", base_failed()).withColumn("reasons", F.array_compact(F.array(*past))).drop("cut")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document, base_failed, reasons and kept."""
    return verdicts(stash(measured(docs), "quality")).select("doc_id", *ALL, "base_failed", "reasons", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The whole rows that ``judge`` keeps. Texts are measured once and stored with their
    counts, which alone are read for the sketches; no text is dealt out."""
    held = append_columns(docs, "text", measure_arrays, MEASURES)
    lang, source = (f"_c{place_of(docs, x)}" for x in ("lang", "source"))
    judged = verdicts(stash(held, "quality-rows"), lang, source)
    return without_appended(judged.where("kept"), docs.columns)
