"""Text expressions: all of them columns, but for stemming and accents."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schemas import FTS_OPERATORS, SEARCH_STOPWORDS

WHITE = r"[ \t\n\r\f\x0B]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+$", "")


def normalize(x: Column) -> Column:
    """Stripped, with line feeds alone as line ends and no more than one empty line."""
    one = F.regexp_replace(strip(x), r"\r\n?", "\n")
    return F.regexp_replace(one, r"\n{3,}", "\n\n")


def auto_title(x: Column, most: int = 80) -> Column:
    """The first line of ten characters or more, without heading marks."""
    lines = F.transform(F.split(x, "\n"), lambda t: strip(F.regexp_replace(strip(t), "^#+", "")))
    found = F.try_element_at(F.filter(lines, lambda t: F.length(t) >= 10), F.lit(1))
    return F.substring(F.coalesce(found, strip(F.substring(x, 1, most))), 1, most)


def canonical_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.lower(strip(t)))))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def normalize_name(x: Column) -> Column:
    plain = F.regexp_replace(F.lower(x), "['’]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def ascii_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) > 0)


def words(x: Column) -> Column:
    """Letters and digits of any script, in lower case and without accents."""
    return F.filter(F.split(F.lower(strip_accents(x)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def query_tokens(x: Column) -> Column:
    """Words of a query in order, repeats kept: at least two characters, no stop words and no
    operators."""
    cut = F.split(F.regexp_replace(strip_accents(x), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+")
    kept = F.filter(cut, lambda t: ~F.upper(t).isin(FTS_OPERATORS))
    return F.filter(F.transform(kept, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(SEARCH_STOPWORDS))


def lower_simple(x: Column) -> Column:
    """Lower case letter by letter: a capital I with a dot becomes one letter, as in SQL."""
    return F.lower(F.translate(x, "İ", "i"))


def keywords(x: Column, stopwords: list[str]) -> Column:
    """Runs of a-z that no ASCII letter, digit or underscore touches. What ``\\b`` takes for a
    letter depends on the Java release, so it is spelled out."""
    words = F.regexp_extract_all(lower_simple(x), F.lit(r"(?<![a-zA-Z0-9_])[a-z]{3,}(?![a-zA-Z0-9_])"), 0)
    return F.filter(words, lambda t: ~t.isin(stopwords))


def overlap(words: Column, text: Column) -> Column:
    """Share of ``words`` that ``text`` contains."""
    low = lower_simple(text)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.contains(low, t))) / F.size(words)).otherwise(F.lit(0.0))


def find(surface: Column, content: Column) -> Column:
    """Place of the surface form, from 0; null if it is absent."""
    at = F.call_function("locate", surface, content)
    return F.when(at > 0, at - 1).cast("bigint")


def reason(content: Column, title: Column) -> Column:
    tokens = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    common = F.filter(tokens(content), lambda t: F.array_contains(tokens(title), t))
    short = F.substring(F.trim(title), 1, 80)
    named = F.concat(F.lit("name match: '"), F.array_join(F.slice(common, 1, 3), " "), F.lit("' → "), short)
    return F.when(F.size(common) > 0, named).otherwise(F.concat(F.lit("content overlap → "), short))


# Patterns in order, days (0: the number found, times the last), tolerance.
OFFSETS = [
    (r"(\d+)\s+days?\s+ago", 0, 2, 1),
    (r"a\s+couple\s+(?:of\s+)?days?\s+ago", 2, 2, 0),
    (r"yesterday", 1, 1, 0),
    (r"a\s+week\s+ago", 7, 3, 0),
    (r"(\d+)\s+weeks?\s+ago", 0, 5, 7),
    (r"last\s+week", 7, 3, 0),
    (r"a\s+month\s+ago", 30, 7, 0),
    (r"(\d+)\s+months?\s+ago", 0, 10, 30),
    (r"last\s+month", 30, 7, 0),
    (r"last\s+year", 365, 30, 0),
    (r"a\s+year\s+ago", 365, 30, 0),
    (r"recently", 14, 14, 0),
]


def day_offset(question: Column) -> Column:
    """struct(days, tolerance) of the first relative date that a question names, or null."""
    q, out = F.lower(question), None
    for pattern, days, tolerance, times in OFFSETS:
        n = F.regexp_extract(q, pattern, 1).cast("int") * times if times else F.lit(days)
        value = F.struct(n.alias("days"), F.lit(tolerance).alias("tolerance"))
        out = F.when(q.rlike(pattern), value) if out is None else out.when(q.rlike(pattern), value)
    return out


@F.pandas_udf(StringType())
def strip_accents(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


_VOWEL_RUN = re.compile("v+c+")


def _shape(stem: str) -> str:
    out = []
    for i, c in enumerate(stem):
        out.append("v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_VOWEL_RUN.findall(_shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# Suffixes and what replaces them (Porter, 1980).
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short_end(w):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                if _measure(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + table[s]
                break
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stem(x: pd.Series) -> pd.Series:
    known = {t: porter(t) for t in x.dropna().unique()}
    return x.map(known)
