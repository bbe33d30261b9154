"""Fusing ranked lists: weighted reciprocal ranks, min-max, boosts, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def vector_weight(quality: float) -> float:
    return max(S.VECTOR_WEIGHT_FLOOR, quality)


def rrf(lists: DataFrame, weights: dict[str, float], k: int = S.RRF_K) -> DataFrame:
    """From (query_id, corpus, corpus_ord, channel, channel_ord, id, rank) the sum of
    w / (k + rank), and where an id was seen first."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")]
    return lists.groupBy("query_id", "corpus", "corpus_ord", "id").agg(F.sum(w / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("channel_ord", "rank")).alias("first"))


def min_max(fused: DataFrame, value: str = "rrf") -> DataFrame:
    """Scaled to 0..1 within each query and corpus; a lone hit gets 0."""
    ends = fused.groupBy("query_id", "corpus").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return fused.join(ends, ["query_id", "corpus"]).withColumn("norm", (F.col(value) - F.col("lo")) / width).drop("lo", "hi")


def tag_boost(tags: Column, wanted: Column) -> Column:
    return F.least(F.size(F.array_intersect(tags, wanted)) * F.lit(S.TAG_BOOST), F.lit(S.TAG_BOOST_CAP))


def recency(accessed_at: Column, now: Column) -> Column:
    age = F.greatest(now - accessed_at, F.lit(0.0))
    return S.RECENCY_AMPLITUDE * F.exp(-F.log(F.lit(2.0)) * age / S.HALF_LIFE_S)


def boosted(norm: Column, tags: Column, wanted: Column, accessed_at: Column, now: Column, corpus: Column) -> Column:
    home = F.when(corpus == "project", F.lit(S.PROJECT_BOOST)).otherwise(F.lit(0.0))
    return F.round(norm + tag_boost(tags, wanted) + recency(accessed_at, now) + home, 6)


FINAL_ORDER = [F.desc, "score"], [F.asc, "corpus_ord"], [F.asc, "first"], [F.asc, "id"]


def final_order() -> list[Column]:
    return [way(c) for way, c in FINAL_ORDER]


def dedup_top(scored: DataFrame, limit: int) -> DataFrame:
    """The first of each content_hash in final order, then the first ``limit``; ``total``
    counts all candidates."""
    per = Window.partitionBy("query_id")
    out = scored.withColumn("total", F.count("*").over(per))
    out = out.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "content_hash").orderBy(*final_order()))).where("copy = 1")
    return out.withColumn("rank", F.row_number().over(per.orderBy(*final_order()))).where(F.col("rank") <= limit).drop("copy")


def blended(rrf_score: Column, llm: Column, position: Column, curve: tuple[float, float, float] = S.BLEND) -> Column:
    w = F.when(position <= 3, F.lit(curve[0])).when(position <= 10, F.lit(curve[1])).otherwise(F.lit(curve[2]))
    ok = F.when(position < 1, F.raise_error(F.lit("positions start at 1")).cast("double"))
    return F.when(position < 1, ok).when(llm.isNull(), rrf_score).otherwise(w * rrf_score + (1 - w) * llm)


def rerank(ranked: DataFrame, scores: DataFrame, top_k: int = S.RERANK_TOP_K, least: float = S.RERANK_MIN_COVERAGE, curve: tuple[float, float, float] = S.BLEND) -> DataFrame:
    """``ranked`` (query_id, id, score, rank) and ``scores`` (query_id, id, llm): the head is
    blended and ordered anew if enough of it has a score; the tail stays behind it."""
    head = F.col("rank") <= top_k
    both = ranked.join(scores, ["query_id", "id"], "left")
    per = Window.partitionBy("query_id")
    covered = F.avg(F.when(head, F.col("llm").isNotNull().cast("double"))).over(per)
    both = both.withColumn("coverage", covered)
    value = F.when(head & (F.col("coverage") >= least), blended(F.col("score"), F.col("llm"), F.col("rank"), curve)).otherwise(F.col("score"))
    both = both.withColumn("blended", F.round(value, 6))
    order = per.orderBy(F.when(head, 0).otherwise(1), F.when(head & (F.col("coverage") >= least), -F.col("blended")).otherwise(F.lit(0.0)), "rank")
    return both.withColumn("new_rank", F.row_number().over(order))


def clean_scores(raw: DataFrame, head: DataFrame) -> DataFrame:
    """Model output (query_id, pos, id, score as text): unknown ids go, the first of an id
    stays, a score that is no number goes, the rest are held to 0..1."""
    known = raw.join(head.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").withColumn("llm", F.expr("try_cast(score as double)")).where("llm is not null and not isnan(llm)")
    one = known.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))).where("rn = 1")
    return one.select("query_id", "id", F.greatest(F.least("llm", F.lit(1.0)), F.lit(0.0)).alias("llm"))


def bm25_norm(score: Column) -> Column:
    return F.abs(score) / (1 + F.abs(score))


def strong_signal(ranked: DataFrame, top1: float = S.STRONG_TOP1, ratio: float = S.STRONG_RATIO) -> DataFrame:
    """Whether the probe's best hit is good and well ahead, so expansion can be skipped."""
    n = bm25_norm(F.col("score"))
    per = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, n)).alias("n1"), F.max(F.when(F.col("rank") == 2, n)).alias("n2"))
    second = F.coalesce("n2", F.lit(0.0))
    strong = (F.col("n1") >= top1) & ((second == 0) | (F.col("n1") >= ratio * second))
    return per.select("query_id", F.round("n1", 6).alias("n1"), F.round(second, 6).alias("n2"), F.coalesce(strong, F.lit(False)).alias("strong"))
