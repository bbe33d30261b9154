"""The inverted index as tables: postings, lengths and document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import DF_FALLBACK_WORDS, DF_MIN_DOCS, DF_RATIO


TOKENS = {"ascii": T.ascii_tokens, "words": T.words}


def postings(docs: DataFrame, key: list[str], fields: dict[str, Column], stem: bool = False, tokens: str = "ascii") -> DataFrame:
    """key, term and tf by field.

    One pass over the texts; counts are partial aggregates before the shuffle by
    (key, term). ``tokens`` is ``ascii``, or ``words`` for letters and digits of any script,
    without accents; stems are found once for each distinct term."""
    cut = TOKENS[tokens]
    named = F.array(*[F.struct(F.lit(f).alias("field"), cut(F.coalesce(c, F.lit(""))).alias("toks")) for f, c in fields.items()])
    each = docs.select(*key, F.explode(named).alias("f")).select(*key, "f.field", F.explode("f.toks").alias("term"))
    if stem:
        each = each.groupBy(*key, "field", "term").count()
        stems = each.select("term").distinct().withColumn("stem", T.stem("term"))
        each = each.join(stems, "term").withColumn("term", F.col("stem"))
        count = lambda f: F.sum(F.when(F.col("field") == f, F.col("count")).otherwise(0))
    else:
        count = lambda f: F.count_if(F.col("field") == f)
    return each.groupBy(*key, "term").agg(*[count(f).cast("bigint").alias(f"tf_{f}") for f in fields])


def lengths(docs: DataFrame, key: list[str], fields: dict[str, Column], tokens: str = "ascii") -> DataFrame:
    total = sum((F.size(TOKENS[tokens](F.coalesce(c, F.lit("")))) for c in fields.values()), F.lit(0))
    return docs.select(*key, total.cast("bigint").alias("dl"))


def query_terms(queries: DataFrame, text: str = "query", tokens: str = "ascii") -> DataFrame:
    """query_id, pos and prefix, repeats kept: no operators, stop words or single letters."""
    if tokens == "words":
        toks = T.query_tokens(F.col(text))
    else:
        toks = F.filter(T.ascii_tokens(F.col(text)), lambda t: (F.length(t) >= 2) & ~t.isin(T.SEARCH_STOPWORDS))
    return queries.select("query_id", F.posexplode(toks).alias("pos", "prefix"))


def matching_terms(post: DataFrame, terms: DataFrame) -> DataFrame:
    """prefix and each term of the vocabulary that begins with it. A term's own beginnings
    are joined to the prefixes by equality, up to the length of the longest prefix."""
    asked = terms.select("prefix").distinct()
    longest = asked.agg(F.max(F.length("prefix")).alias("longest"))
    known = post.select("term").distinct().crossJoin(F.broadcast(longest))  # one row
    upto = F.least(F.length("term"), F.col("longest"))
    begins = known.where(upto >= 1).select("term", F.explode(F.sequence(F.lit(1), upto)).alias("n"))
    return begins.select("term", F.substring(F.col("term"), F.lit(1), F.col("n")).alias("prefix")).join(asked, "prefix")


def prefix_frequency(terms: DataFrame, post: DataFrame, doc: str = "id") -> DataFrame:
    """prefix and the number of documents with a term that begins so."""
    known = matching_terms(post, terms)
    return post.select("term", doc).join(known, "term").select("prefix", doc).distinct().groupBy("prefix").agg(F.count("*").alias("df"))


def prune(terms: DataFrame, df: DataFrame, n_docs: int, ratio: float = DF_RATIO) -> DataFrame:
    """Drops prefixes that over ``ratio`` of the documents have, in a corpus of over 100;
    a query that would lose all keeps its first three words."""
    if n_docs <= DF_MIN_DOCS:
        return terms
    from pyspark.sql import Window

    most = int(n_docs * ratio)
    marked = terms.join(df, "prefix", "left").withColumn("ok", F.coalesce("df", F.lit(0)) <= most)
    per = Window.partitionBy("query_id")
    nth = F.row_number().over(per.orderBy("pos"))
    marked = marked.withColumn("any", F.max("ok").over(per)).withColumn("nth", nth)
    return marked.where(F.col("ok") | (~F.col("any") & (F.col("nth") <= DF_FALLBACK_WORDS))).select(*terms.columns)
