"""BM25 over the postings tables: OR of prefixes, weights by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BM25_B, BM25_K1, IDF_FLOOR
from .index import matching_terms


def score(terms: DataFrame, post: DataFrame, lens: DataFrame, weights: dict[str, float], key: str = "id", by_corpus: bool = False) -> DataFrame:
    """query_id, key and score (higher is better).

    Query prefixes are matched with the distinct vocabulary, and postings are joined on the
    exact term; what a prefix finds in a document is summed once, however many queries have
    it. Postings are narrow and texts are never carried. For each query word: tf is the
    weighted sum over fields and matching terms, idf = ln((N - n + 0.5) / (n + 0.5)), at
    least ``IDF_FLOOR``."""
    place = ["corpus"] if by_corpus else []
    tf = sum((F.col(f"tf_{f}") * w for f, w in weights.items()), F.lit(0.0))
    known = matching_terms(post, terms)
    found = post.join(known, "term").groupBy(*place, "prefix", key).agg(F.sum(tf).alias("f"))
    total = lens.groupBy(*place).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = found.groupBy(*place, "prefix").agg(F.count("*").alias("n"))
    per = found.join(df, [*place, "prefix"]).join(lens, [*place, key])
    per = per.join(total, place) if place else per.crossJoin(F.broadcast(total))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    asked = terms.groupBy("query_id", "prefix").agg(F.count("*").alias("times"))  # a repeated word counts again
    each = per.select(*place, "prefix", key, part.alias("part")).join(asked, "prefix")
    return each.groupBy(*place, "query_id", key).agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))


def top(scored: DataFrame, n: int, key: str = "id", place: list[str] | None = None, order: list | None = None) -> DataFrame:
    """The best n of each query, with rank; ties by key."""
    per = Window.partitionBy(*(place or []), "query_id").orderBy(*(order or [F.desc("score"), F.asc(key)]))
    return scored.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= n)


def best_chunk(scored: DataFrame, n: int) -> DataFrame:
    """From chunk scores (query_id, id, chunk_index, score), each memory's best chunk and
    the best n memories."""
    per = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), F.asc("chunk_index"))
    one = scored.withColumn("rn", F.row_number().over(per)).where("rn = 1").drop("rn")
    return top(one, n, order=[F.desc("score"), F.asc("chunk_index"), F.asc("id")])
