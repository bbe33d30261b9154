"""The local hashed embedder as columns and aggregates, and the choice of embedder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EMBED_DIM, EMBED_QUALITY, EMBED_STOPWORDS, VECTOR_QUALITY_GATE


def tokens(x: Column) -> Column:
    parts = F.split(F.lower(x), "[^a-z0-9]+")  # an underscore cuts a word too
    return F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(EMBED_STOPWORDS))


def features(toks: Column) -> Column:
    """Array of (feature, weight): words, word pairs and character 3- to 5-grams."""
    item = lambda f, w: F.struct(f.alias("feature"), F.lit(w).alias("weight"))
    full, n = F.array_join(toks, " "), F.size(toks)
    none = F.array().cast("array<struct<feature:string,weight:double>>")
    words = F.transform(toks, lambda t: item(F.concat(F.lit("w:"), t), 1.0))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: item(F.concat(F.lit("b:"), F.element_at(toks, i), F.lit(" "), F.element_at(toks, i + 1)), 1.5))).otherwise(none)

    def grams(k: int, w: float) -> Column:
        at = F.sequence(F.lit(1), F.length(full) - (k - 1))
        return F.when(F.length(full) >= k, F.transform(at, lambda i: item(F.concat(F.lit(f"c{k}:"), F.substr(full, i, F.lit(k))), w))).otherwise(none)

    return F.concat(words, pairs, *[grams(k, w) for k, w in ((3, 0.5), (4, 0.7), (5, 0.6))])


def bucket(feature: Column, dim: int = EMBED_DIM) -> Column:
    """The first four bytes of the MD5 digest, little-endian, modulo the dimension."""
    h = F.md5(feature)
    turned = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.pmod(F.conv(turned, 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def sign(feature: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(feature), 9, 2), 16, 10).cast("int") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


def bucket_weights(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, weight) of the vectors before scaling, nonzero buckets only."""
    each = texts.select(key, F.explode(features(tokens(F.col(text)))).alias("f"))
    tf = each.groupBy(key, F.col("f.feature").alias("feature")).agg(F.sum("f.weight").alias("w"))
    w = F.when(F.col("w") > 1, F.lit(1.0) + F.log("w")).otherwise(F.col("w"))
    return tf.groupBy(key, bucket(F.col("feature")).alias("bucket")).agg(F.sum(sign(F.col("feature")) * w).alias("weight"))


def local_embed(texts: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """(key, embedding): unit vectors; 1e-6 throughout for a text without tokens."""
    per = bucket_weights(texts, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(1.0)))
    return texts.select(key).join(per, key, "left").select(key, F.coalesce(F.when(F.col("m").isNotNull(), full), F.array_repeat(F.lit(1e-6), dim)).cast("array<float>").alias("embedding"))


@dataclass(frozen=True)
class Embedder:
    name: str
    version: str
    dim: int
    quality: float
    max_chars: int = 8192

    def usable(self) -> bool:
        return self.quality >= VECTOR_QUALITY_GATE


LOCAL = Embedder("local", "tfidf-v1", EMBED_DIM, EMBED_QUALITY)


class DimensionMismatch(ValueError):
    """No embedder that is at hand fits the corpus."""


def resolve(corpus_dim: int | None, hosted: list[Embedder], fast: Embedder | None = None) -> Embedder:
    """The best embedder at hand whose dimension is the corpus's: hosted, then the fast
    local model, then the hashed one."""
    tiers = [*hosted, *([fast] if fast else []), LOCAL]
    if corpus_dim is None:
        return tiers[0]
    for e in tiers:
        if e.dim == corpus_dim:
            return e
    raise DimensionMismatch(f"the corpus has {corpus_dim} dimensions, at hand are {sorted({e.dim for e in tiers})}")
