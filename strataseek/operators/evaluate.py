"""Retrieval quality: recall and NDCG at k, by type; overlap and date boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 30, 50)


def recall_ndcg(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, k, recall_any, recall_all and ndcg. ``ranked``: (query_id, id, rank);
    ``truth``: (query_id, id). The ideal order is that of what was retrieved."""
    hits = ranked.join(truth.select("query_id", "id").distinct().withColumn("rel", F.lit(1.0)), ["query_id", "id"], "left").fillna({"rel": 0.0})
    want = truth.groupBy("query_id").agg(F.countDistinct("id").alias("n_true"))
    at = hits.select("query_id", "id", "rank", "rel", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    per = at.groupBy("query_id", "k").agg(F.sum("rel").alias("got"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("got").cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    every = want.select("query_id", "n_true", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).join(per, ["query_id", "k"], "left").fillna({"got": 0.0, "dcg": 0.0})
    ndcg = F.when(F.col("got") > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0))
    return every.select("query_id", "k", (F.col("got") > 0).cast("double").alias("recall_any"), (F.col("got") >= F.col("n_true")).cast("double").alias("recall_all"), F.round(ndcg, 6).alias("ndcg"))


def holding(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id) of the documents (id, text) that hold a query's text as it is.

    Whoever holds a passage holds its words from the second to the last but one, so the
    first ``k`` of these are hashed and joined with all windows of ``k`` words; what meets is
    compared in full. Passages too short for that are compared with each document."""
    words = lambda c: F.split(c, r"\s+")
    gram = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, k), " "))
    long = F.size(words(F.col("query"))) >= k + 2
    keys = queries.where(long).select("query_id", "query", gram(words(F.col("query")), 2).alias("gram"))
    cut = docs.select("id", "text", words(F.col("text")).alias("w")).where(F.size("w") >= k)
    grams = cut.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: gram(F.col("w"), i)))).alias("gram"))
    met = grams.join(keys.select("query_id", "gram"), "gram").select("query_id", "id").distinct()
    found = met.join(docs.select("id", "text"), "id").join(queries, "query_id")
    short = docs.crossJoin(queries.where(~long))  # a stated set of queries
    return found.select("query_id", "id", "text", "query").unionByName(short.select("query_id", "id", "text", "query")).where(F.contains("text", "query")).select("query_id", "id")


def report(measured: DataFrame, types: DataFrame) -> DataFrame:
    """Means by type and k, and over all (type null)."""
    both = measured.join(types, "query_id")
    return both.rollup("k", "type").agg(F.round(F.avg("recall_any"), 6).alias("recall_any"), F.round(F.avg("recall_all"), 6).alias("recall_all"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n")).where("k is not null")


def session_of(turn_id: Column) -> Column:
    return F.regexp_replace(turn_id, r"_turn_[^_]*$", "")


def overlap_fused(rank: Column, n: Column, share: Column, weight: float = 0.30) -> Column:
    """Lower is better: the place in the list, less for shared keywords."""
    return rank / F.greatest(n, F.lit(1)) * (1.0 - weight * share)


def date_boost(fused: Column, days_apart: Column, tolerance: Column) -> Column:
    near = F.lit(0.40) * (1.0 - (days_apart - tolerance) / (tolerance * 2))
    return F.when(days_apart <= tolerance, fused * 0.60).when(days_apart <= tolerance * 3, fused * (1.0 - near)).otherwise(fused)


def sessions(turns: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """One document for each conversation: its turns' texts in order, line by line."""
    kept = turns if roles is None else turns.where(F.col("role").isin(roles))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("content"), F.count("*").alias("n_turns"))


def turn_docs(turns: DataFrame) -> DataFrame:
    return turns.select(F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("_turn_"), F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")


def accuracy(judged: DataFrame) -> DataFrame:
    return judged.groupBy("type").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def rank_by(df: DataFrame, value: str, *ties: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(value, *ties)))
