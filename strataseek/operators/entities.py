"""Entities: payload checks, upserts, mentions, relations and resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import find, normalize_name
from .components import components

# The vocabulary of entity types.
ENTITY_TYPES = ["PERSON", "CONCEPT", "TECHNOLOGY", "PROJECT", "EVENT", "OTHER"]
RELATION_TYPES = list(S.RELATION_WEIGHTS)

#: Vectors of one type that are compared with as many at once.
TILE = 4096


def payload_errors(entities: Column, relations: Column, types: list[str] = ENTITY_TYPES) -> Column:
    """All that is wrong with an agent's payload, as an array of messages; items that are
    not wrong stay valid. A payload over its cap has that one message."""
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    at = lambda name, i, field, said: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{field}: {said}"))
    ents = F.coalesce(entities, F.array().cast("array<struct<name:string,type:string,surface_form:string>>"))
    rels = F.coalesce(relations, F.array().cast("array<struct<from:string,to:string,rel:string>>"))
    e = F.transform(ents, lambda x, i: F.when(blank(x["name"]), at("entities", i, "name", "must be a non-empty string")).when(F.length(x["name"]) > S.NAME_CHARS, at("entities", i, "name", f"is over {S.NAME_CHARS} characters")).when(~F.coalesce(x["type"].isin(types), F.lit(False)), at("entities", i, "type", "is not in the vocabulary")))
    r = F.transform(rels, lambda x, i: F.when(blank(x["from"]), at("relations", i, "from", "must be a non-empty string")).when(blank(x["to"]), at("relations", i, "to", "must be a non-empty string")).when(~F.coalesce(x["rel"].isin(RELATION_TYPES), F.lit(False)), at("relations", i, "rel", "is not in the vocabulary")))
    return F.when(F.size(ents) > S.AGENT_ENTITIES, F.array(F.lit(f"entities: over the cap of {S.AGENT_ENTITIES}"))).when(F.size(rels) > S.AGENT_RELATIONS, F.array(F.lit(f"relations: over the cap of {S.AGENT_RELATIONS}"))).otherwise(F.array_compact(F.concat(e, r)))


def cleaned(entities: Column, relations: Column, types: list[str] = ENTITY_TYPES, n_entities: int = S.LLM_ENTITIES, n_relations: int = S.LLM_RELATIONS) -> tuple[Column, Column]:
    """What a model found, without the items that are wrong, cut at the caps."""
    full = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    ents = F.filter(F.coalesce(entities, F.array().cast("array<struct<name:string,type:string,surface_form:string>>")), lambda x: full(x["name"]) & (F.length(x["name"]) <= S.NAME_CHARS) & F.coalesce(x["type"].isin(types), F.lit(False)))
    rels = F.filter(F.coalesce(relations, F.array().cast("array<struct<from:string,to:string,rel:string>>")), lambda x: full(x["from"]) & full(x["to"]) & F.coalesce(x["rel"].isin(RELATION_TYPES), F.lit(False)))
    return F.slice(ents, 1, n_entities), F.slice(rels, 1, n_relations)


def upsert(found: DataFrame) -> DataFrame:
    """One entity for each (normalized name, type): the first display name, and how often.
    ``found``: (memory_id, name, type, ord)."""
    keyed = found.withColumn("name_normalized", normalize_name(F.col("name")))
    per = keyed.groupBy("name_normalized", "type").agg(F.min_by("name", F.struct("memory_id", "ord")).alias("name"), F.count("*").alias("mention_count"))
    return per.withColumn("id", F.md5(F.concat_ws("\0", "name_normalized", "type")))


def mentions(found: DataFrame, content: DataFrame) -> DataFrame:
    """(memory_id, entity_id, surface_form, start, end), each once, however often replayed."""
    keyed = found.select("memory_id", F.md5(F.concat_ws("\0", normalize_name(F.col("name")), "type")).alias("entity_id"), F.coalesce("surface_form", "name").alias("surface_form")).distinct()
    start = find(F.col("surface_form"), F.col("content"))
    return keyed.join(content.select(F.col("id").alias("memory_id"), "content"), "memory_id").select("memory_id", "entity_id", "surface_form", start.alias("start"), (start + F.length("surface_form")).alias("end"))


def resolve(names: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The entity of each name: one of the same memory's batch first, of any type, else the
    stored one that is mentioned most."""
    key = names.select("memory_id", "name", normalize_name(F.col("name")).alias("name_normalized"))
    own = key.join(batch.select("memory_id", "name_normalized", F.col("id").alias("entity_id")), ["memory_id", "name_normalized"]).select("memory_id", "name", "entity_id", F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("c"))
    old = key.join(stored.select("name_normalized", F.col("id").alias("entity_id"), "mention_count"), "name_normalized").select("memory_id", "name", "entity_id", F.lit(1).alias("p"), (-F.col("mention_count")).alias("c"))
    return own.unionByName(old).groupBy("memory_id", "name").agg(F.min_by("entity_id", F.struct("p", "c", "entity_id")).alias("entity_id"))


def duplicate_pairs(entities: DataFrame, least: float = S.DEDUP_COSINE, tile: int = TILE) -> DataFrame:
    """Pairs a < b of one type whose vectors have cosine >= ``least``, which is above 0.

    ``entities``: (id, type, embedding). The pass is exact. A type with more than ``tile``
    vectors is cut into tiles by a hash; two tiles meet in one group, in blocks, and only
    pairs that hold are given out, so no group holds more than two tiles and pairs that do
    not hold are never rows. Null types, and vectors that are null, zero or of another length
    or have a component that is null or not finite, pair with nothing."""
    if least <= 0:
        raise ValueError("the least cosine is above 0")
    big = F.lit(float("inf"))
    rows = entities.select("id", "type", F.col("embedding").cast("array<double>").alias("embedding")).where("type is not null and id is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))
    key = ["type", "dim"]
    large = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > tile)
    tiled = rows.join(large, key, "left").withColumn("tiles", F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int"))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = tiled.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "embedding")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        own, ids = group.column("own").to_numpy(), group.column("id").to_numpy()
        x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            near = np.round(x[rows] @ x[right].T, 6)
            a, b = np.nonzero(near >= least)
            cosines, a, b = near[a, b], rows[a], right[b]
            # within a tile each pair is met from both sides
            keep = (ids[a] < ids[b]) if i == j else (ids[a] != ids[b])
            a, b, cosines = a[keep], b[keep], cosines[keep]
            turn = ids[a] > ids[b]
            found.append((np.where(turn, b, a), np.where(turn, a, b), cosines))
        a, b, cosines = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        kind = group.schema.field("id").type
        return pa.table({"type": group.column("type").take(pa.array(a, pa.int64())), "a": pa.array(ids[a], kind), "b": pa.array(ids[b], kind), "cosine": pa.array(cosines, pa.float64())})

    kinds = dict(entities.select("id", "type").dtypes)
    return dealt.groupBy(*key, "i", "j").applyInArrow(compare, f"type {kinds['type']}, a {kinds['id']}, b {kinds['id']}, cosine double")


def canonical(pairs: DataFrame) -> DataFrame:
    """(id, canonical): the least id that each paired entity reaches, however long the chain."""
    return components(pairs.select("a", "b"), "canonical").select(F.col("node").alias("id"), F.col("root").alias("canonical"))


def candidates(entities: DataFrame, least: int = 2) -> DataFrame:
    """Entities that a dedup pass looks at: not merged yet, and mentioned ``least`` times."""
    return entities.where(F.col("canonical_id").isNull() & (F.col("mention_count") >= least))


def merge(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``entities`` with canonical_id set by confirmed pairs (a, b), chains resolved; the
    least id of a group stays without one."""
    roots = canonical(pairs).where("id <> canonical").select("id", F.col("canonical").alias("_root"))
    return entities.join(roots, "id", "left").withColumn("canonical_id", F.coalesce("_root", "canonical_id")).drop("_root")


def new_relations(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations (source_entity_id, target_entity_id, relation_type, source_memory_id,
    confidence) that are not stored yet, each once; replays add nothing. Of repeats the most
    certain stays; endpoints that could not be resolved, and loops, are left out."""
    key = ["source_entity_id", "target_entity_id", "relation_type", "source_memory_id"]
    whole = found.where("source_entity_id is not null and target_entity_id is not null and source_entity_id <> target_entity_id")
    one = whole.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    same = F.lit(True)
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in key])
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return one.join(old, same, "left_anti")


def write_extraction(payloads: DataFrame, contents: DataFrame, entities: DataFrame, mentioned: DataFrame, related: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What payloads (memory_id, entities, relations) add to the stored tables: all entities
    with their new counts, new mentions and new relations. Replaying a payload adds no
    mention and no relation."""
    each = payloads.select("memory_id", F.posexplode("entities").alias("ord", "e")).select("memory_id", "ord", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.coalesce("e.surface_form", "e.name").alias("surface_form"))
    batch = upsert(each)
    kept = entities.select("id", F.col("name").alias("_name"), F.col("mention_count").alias("_n"), "canonical_id")
    both = batch.join(kept, "id", "full")
    old = entities.select("id", F.col("name_normalized").alias("_nn"), F.col("type").alias("_type"))
    both = both.join(old, "id", "left").select("id", F.coalesce("_name", "name").alias("name"), F.coalesce("name_normalized", "_nn").alias("name_normalized"), F.coalesce("type", "_type").alias("type"), "canonical_id", (F.coalesce("_n", F.lit(0)) + F.coalesce("mention_count", F.lit(0))).alias("mention_count"))
    said = mentions(each, contents).join(mentioned.select("memory_id", "entity_id", "surface_form"), ["memory_id", "entity_id", "surface_form"], "left_anti")
    rels = payloads.select("memory_id", F.explode("relations").alias("r")).select("memory_id", F.col("r.from").alias("f"), F.col("r.to").alias("t"), F.col("r.rel").alias("relation_type"))
    names = rels.select("memory_id", F.col("f").alias("name")).unionByName(rels.select("memory_id", F.col("t").alias("name"))).distinct()
    keyed = each.select("memory_id", normalize_name(F.col("name")).alias("name_normalized"), "type").distinct().withColumn("id", F.md5(F.concat_ws("\0", "name_normalized", "type")))
    known = resolve(names, keyed, both)
    at = lambda c, out: known.select("memory_id", F.col("name").alias(c), F.col("entity_id").alias(out))
    found = rels.join(at("f", "source_entity_id"), ["memory_id", "f"], "left").join(at("t", "target_entity_id"), ["memory_id", "t"], "left")
    fresh = new_relations(found.select("source_entity_id", "target_entity_id", "relation_type", F.col("memory_id").alias("source_memory_id"), F.lit(1.0).alias("confidence")), related)
    return both, said, fresh


def dedup_summary(pairs: DataFrame, confirmed: Column) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(confirmed).alias("merged"), F.round(F.count("*") * S.CONFIRM_COST, 6).alias("cost"))


def write_counts(found: DataFrame) -> DataFrame:
    """How many entities and mentions each memory writes."""
    return found.groupBy("memory_id").agg(F.countDistinct(normalize_name(F.col("name")), "type").alias("entities"), F.count("*").alias("mentions"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
