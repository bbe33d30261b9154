"""Exact nearest neighbours of a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, l2

#: Numbers of queries times dimensions that are sent to every task; more are dealt out.
BROADCAST_NUMBERS = 1 << 20


def distances(vectors: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    """query_id, the columns of ``vectors`` but the embedding, and distance. The set of
    queries is counted: one within the bound goes to every task, others in blocks."""
    size = queries.agg(F.sum(F.size("qvec"))).first()[0] or 0
    d = F.round(F.lit(1.0) - cosine(F.col("embedding"), F.col("qvec")) if metric == "cosine" else l2(F.col("embedding"), F.col("qvec")), 6)
    kept = [c for c in vectors.columns if c != "embedding"]
    if size <= BROADCAST_NUMBERS:
        both = vectors.crossJoin(F.broadcast(queries))  # a stated set of queries against all rows
    else:
        blocks = -(-size // BROADCAST_NUMBERS)
        dealt = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        both = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_b")
    return both.select("query_id", *kept, d.alias("distance"))


def knn(vectors: DataFrame, queries: DataFrame, n: int, metric: str = "cosine") -> DataFrame:
    """query_id, id, distance and rank. ``vectors`` (id, embedding) is scanned once;
    filters on it belong before the call, so a result is never short."""
    scored = distances(vectors.select("id", "embedding"), queries, metric)
    per = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= n)


def knn_groups(vectors: DataFrame, queries: DataFrame, group: str, n: int, metric: str = "cosine") -> DataFrame:
    """query_id, group, id, distance and rank: the nearest row of each group, as a partial
    aggregate, then the nearest n groups."""
    scored = distances(vectors.select("id", group, "embedding"), queries, metric)
    one = scored.groupBy("query_id", group).agg(F.min(F.struct("distance", "id")).alias("best")).select("query_id", group, "best.id", "best.distance")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= n)


def best_per_group(near: DataFrame, group: str, n: int) -> DataFrame:
    """The nearest row of each group, then the nearest n groups."""
    one = near.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", group).orderBy("distance", "id"))).where("rn = 1").drop("rn", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= n)
