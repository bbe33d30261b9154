"""Upkeep of a corpus: chunks, vectors at both levels, backups, what is stale, and the worker.

Vectors lie in a folder for each generation (``vectors-<n>``); the newest one counts, older
ones are backups. A full re-embedding writes the next generation, so what was there stays
until it is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas as S
from .functions import chunker
from .functions.embed import Embedder
from .operators.entities import latest
from .sources.corpus import Corpus, stale

VECTOR = S._schema("level string, id string, chunk_index int, model_name string, model_version string, dim int, created_at double")
VECTOR.add("embedding", T.ArrayType(T.FloatType()))
CHUNK = S._schema("id string, chunk_index int, text string, start int, end int, version bigint")

Embed = Callable[[DataFrame, str], DataFrame]


def persist_chunks(corpus: Corpus, memories: DataFrame, was_chunked: DataFrame | None = None) -> DataFrame:
    """Chunks of changed memories (id, content, version), appended. A memory that had chunks
    keeps some until it falls under the lower threshold, even if it is short by now."""
    if was_chunked is None:
        force = F.lit(False)
        kept = memories
    else:
        had = was_chunked.select("id").distinct().withColumn("_had", F.lit(True))
        kept = memories.join(had, "id", "left").withColumn("_had", F.coalesce("_had", F.lit(False)))
        kept = kept.where(chunker.keep_chunked(F.col("_had"), F.col("content")))
        force = F.col("_had")
    made = chunker.explode_chunks(kept, force).join(memories.select("id", "version"), "id")
    corpus.append(made.select(*CHUNK.names), "chunks")
    return made


def chunks(corpus: Corpus) -> DataFrame:
    """Chunks of the live versions, each once, however often they were written."""
    return corpus.table("chunks", CHUNK).dropDuplicates(["id", "chunk_index", "version"]).join(corpus.live().select("id", "version"), ["id", "version"], "left_semi")


def generations(corpus: Corpus) -> list[int]:
    """Generations of vectors, old ones first: a listing of folders."""
    spark = corpus.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(corpus.path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"vectors-(\d+)", n)))


def vectors(corpus: Corpus, generation: int | None = None) -> DataFrame:
    """The latest vector of each live memory and chunk."""
    known = generations(corpus)
    n = generation if generation is not None else (known[-1] if known else 0)
    rows = latest(corpus.table(f"vectors-{n}", VECTOR), ["level", "id", "chunk_index"], ["created_at"])
    return rows.join(corpus.live().select("id"), "id", "left_semi")


def current_dim(corpus: Corpus) -> int | None:
    row = vectors(corpus).select("dim").limit(1).first()
    return row[0] if row else None


def rows_of(corpus: Corpus, level: str) -> DataFrame:
    """id, chunk_index (null for memories) and the text that is embedded."""
    if level == "memory":
        return corpus.live().select("id", F.lit(None).cast("int").alias("chunk_index"), F.concat_ws(". ", "title", "content").alias("text"))
    return chunks(corpus).select("id", "chunk_index", "text")


def pending(corpus: Corpus, level: str, embedder: Embedder, ids: DataFrame | None = None) -> DataFrame:
    """Rows of a level whose vector is missing or of another model."""
    key = F.concat_ws("\0", "id", F.coalesce(F.col("chunk_index").cast("string"), F.lit("")))
    rows = rows_of(corpus, level)
    rows = rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")
    meta = vectors(corpus).where(F.col("level") == level).select(key.alias("id"), "model_name", "model_version", "dim")
    keyed = rows.select(key.alias("id"), F.col("id").alias("row_id"), "chunk_index", "text")
    return stale(meta, keyed, embedder.name, embedder.version, embedder.dim)


def embed_pending(corpus: Corpus, embedder: Embedder, embed: Embed, now: float, level: str = "memory", ids: DataFrame | None = None, generation: int | None = None) -> int:
    """Embeds what is pending and appends it; how many rows were. Nothing is done for an
    embedder under the quality gate, nor for one of another dimension than the corpus."""
    if not embedder.usable():
        return 0
    known = generations(corpus)
    n = generation if generation is not None else (known[-1] if known else 0)
    todo = pending(corpus, level, embedder, ids) if generation is None else rows_of(corpus, level).select(F.concat_ws("\0", "id", F.coalesce(F.col("chunk_index").cast("string"), F.lit(""))).alias("id"), F.col("id").alias("row_id"), "chunk_index", "text")
    made = embed(todo.select("id", "text"), "text").join(todo.select("id", "row_id", "chunk_index"), "id")
    made = made.select(F.lit(level).alias("level"), F.col("row_id").alias("id"), "chunk_index", F.lit(embedder.name).alias("model_name"), F.lit(embedder.version).alias("model_version"), F.lit(embedder.dim).alias("dim"), F.lit(now).alias("created_at"), F.col("embedding").cast("array<float>").alias("embedding"))
    before = corpus.table(f"vectors-{n}", VECTOR).count()
    corpus.append(made.select(*VECTOR.names), f"vectors-{n}")
    return corpus.table(f"vectors-{n}", VECTOR).count() - before


def reembed(corpus: Corpus, embedder: Embedder, embed: Embed, now: float) -> int:
    """All vectors anew, at any dimension, as the next generation; the old one is a backup."""
    n = max(generations(corpus), default=-1) + 1
    return sum(embed_pending(corpus, embedder, embed, now, level, generation=n) for level in ("memory", "chunk"))


def backups(corpus: Corpus) -> list[int]:
    return generations(corpus)[:-1]


def drop_backup(corpus: Corpus, generation: int) -> None:
    if generation not in backups(corpus):
        raise ValueError(f"{generation} is no backup, these are: {backups(corpus)}")
    from .sources.scratch import remove

    remove(corpus.spark, [f"{corpus.path}/vectors-{generation}"])


def status(corpus: Corpus, embedder: Embedder) -> DataFrame:
    """level, total and stale: one row for memories and one for chunks."""
    out = None
    for level in ("memory", "chunk"):
        total, waiting = rows_of(corpus, level), pending(corpus, level, embedder)
        one = total.agg(F.count("*").alias("total")).crossJoin(waiting.agg(F.count("*").alias("stale"))).select(F.lit(level).alias("level"), "total", "stale")
        out = one if out is None else out.unionByName(one)
    return out


def worker_needed(state: DataFrame, waiting: DataFrame, embedder: Embedder, extraction: bool) -> bool:
    """Whether there is work: open tasks that a handler is at hand for, or stale vectors for a
    usable embedder."""
    kinds = (["extract", "dedup"] if extraction else []) + (["reembed"] if embedder.usable() else [])
    if not state.where(F.col("status").isin("pending", "running") & F.col("task_type").isin(kinds)).isEmpty():
        return True
    return embedder.usable() and not waiting.isEmpty()
