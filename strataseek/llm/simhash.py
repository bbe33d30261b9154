"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: 64 bits over the XXH64 hashes of a text's 3-word shingles. Two
fingerprints link at ``radius`` (2) or fewer differing bits. Bit i is given a nonzero
vector f(i) of radius + 1 bits; table v keeps the bits whose f(i) has odd overlap with
v. Any ``radius`` vectors leave some v orthogonal to all of them, so every pair within
the radius agrees in one of the 2^(radius+1) - 1 tables (Pagh, 2016).

A bucket of up to ``PAIRWISE`` fingerprints is joined pair by pair; the fingerprints of
larger ones meet at their one-bit neighbours, which at most 65 fingerprints share. Both
ways link the same fingerprints.

Nulls, empty texts and texts of white space have fingerprint 0 and link like any other; a
very long text is read whole and alone, its hashes counted some at a time. Rows with a
null doc_id keep their fingerprint and have a null component_id. Rows that repeat a doc_id
each have the component of their own fingerprint; of documents that tie the smallest id
stays. Other columns, whatever their names, are left out by ``near_duplicates`` and kept by
``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, place_of, slices_by_bytes, stash, without_appended
from ..operators.components import components

BITS = 64
#: A bucket with more distinct fingerprints is joined through one-bit neighbours.
PAIRWISE = 128


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    of = xxhash.xxh64_digest
    held = np.frombuffer(b"".join([of(x, 42) for x in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(held), 1 << 16):
        counts += np.unpackbits(held[i : i + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(held)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row for each row of ``docs``."""

    def run(batches):
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
                yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of the tables, as signed longs."""
    top = 1 << (radius + 1)
    out = []
    for v in range(1, top):
        mask = sum(1 << i for i in range(bits) if ((i % (top - 1) + 1) & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``radius``.

    ``distinct`` has fp and node, one row for each fingerprint; ``radius`` is 1 or 2.
    Buckets of up to ``pairwise`` fingerprints are joined pair by pair and verified. In a
    larger bucket fingerprints that share a neighbour at one flipped bit lie within 2 bits
    of each other, and any two within 2 share one: they are linked to the least of them, so
    no pairs are listed.
    """
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    masks = covering_masks(radius)
    keyed = distinct.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "node", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, ["t", "key"])
    small = held.where(F.col("n") <= pairwise).select("t", "key", "fp", "node")
    other = small.select("t", "key", F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius
    links = small.join(other, ["t", "key"]).where((F.col("fp") < F.col("fp_b")) & near).select(F.col("node").alias("a"), "b")
    large = held.where(F.col("n") > pairwise).select("fp", "node").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint")) for i in range(BITS)]
    around = large.select("node", F.explode(F.array(*flips)).alias("near"))
    if radius == 2:
        # at most 65 fingerprints have a neighbour in common
        met = around.groupBy("near").agg(F.min("node").alias("b"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
        return links.unionByName(met.select(F.explode("all").alias("a"), "b").where("a <> b").distinct())
    exact = large.select(F.col("fp").alias("near"), F.col("node").alias("b"))
    return links.unionByName(around.join(exact, "near").where("node <> b").select(F.col("node").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a document reaches by links."""
    fps = stash(fingerprints(docs), "simhash")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = stash(nodes, "simhash-nodes")
    roots = components(fingerprint_links(nodes, radius), "simhash-links")
    per = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = fps.join(per, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One whole row of each component: the one with the smallest doc_id, a null one last.
    Each row is a row of its own, so repeated and null ids are removed like any other."""
    fields = T.StructType([T.StructField("fp", T.LongType())])
    made = append_columns(docs, "text", lambda texts: [pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))], fields)
    # numbered once and stored, so a row has the same number whenever it is read
    held = stash(made.withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    doc_id = F.col(f"_c{place_of(docs, 'doc_id')}").cast("bigint")
    best = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("row")))
    nodes = stash(held.groupBy("fp").agg(F.min("row").alias("node"), best.alias("best")), "simhash-nodes")
    roots = components(fingerprint_links(nodes, radius), "simhash-links")
    per = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"), "best")
    best = per.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.row").alias("kept_row"))
    best = stash(per.select("fp", "root").join(best, "root").select("fp", "kept_row"), "simhash-kept")
    rows = held.select("row", "fp").join(best, "fp").where("row <> kept_row")
    # a number is that of the task and the place in it; what goes is a bit for each place
    gone = rows.select(F.shiftright("row", 33).alias("task"), F.col("row").bitwiseAND((1 << 33) - 1).alias("place"))

    def bits(group: pa.Table) -> pa.Table:
        place = group.column("place").to_numpy()
        marks = np.zeros(-(-(int(place.max()) + 1) // 64) * 64, np.uint8)
        marks[place] = 1
        words = np.packbits(marks, bitorder="little").view("<i8")
        return pa.table({"task": group.column("task").slice(0, 1), "marks": pa.array([words.tolist()], pa.list_(pa.int64()))})

    # stored, so the engine knows its size: a bit a row goes to all tasks while that is
    # small, and is joined by task, each of which has its share of rows, when it is not
    marks = stash(gone.groupBy("task").applyInArrow(bits, "task bigint, marks array<bigint>"), "simhash-gone")
    place = F.col("row").bitwiseAND((1 << 33) - 1)
    word = F.coalesce(F.get("marks", (place / 64).cast("int")), F.lit(0))
    both = held.withColumn("task", F.shiftright("row", 33)).join(marks, "task", "left")
    return without_appended(both.where(F.getbit(word, (place % 64).cast("int")) == 0), docs.columns)
