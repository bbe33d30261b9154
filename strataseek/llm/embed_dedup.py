"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= t differ by at most 2 - 2t in squared distance. A random
rotation spreads that over the dimensions; the rotated vectors are split into blocks,
each with a share of the budget in proportion to its dimensions. Of two near vectors at
least one block must be within its share (pigeonhole). Each block is range-joined on
its own: pivots taken from the vectors cut the block's space into cells; a vector is at
home in the cell of its nearest pivot and visits each cell whose border (the plane
halfway to its own pivot) lies within the budget, so near vectors always meet where one
of them is at home.

The range join sees ids and the block's coordinates alone, a byte each; what rounding may
move is added to the budget, so no pair is lost. It gives out, cell by cell, the vectors
that have a candidate there, never the pairs. Only these vectors are joined in whole and
compared again in those cells: the first block within its share claims a pair (so the
union holds it once), and claimed pairs are verified by cosine in double precision. A cell
gives out, for each vector at home there, its number of links and its root in a spanning
forest.

Pivots grow with the largest label: one for ``PER_PIVOT`` vectors, ``PIVOTS`` at most. Both
change the work, never the result. A large cell is cut into tiles of ``TILE`` members by a
hash, so no task holds more than two tiles.

Equal vectors with one label (told by 128 bits of hash) are joined as one, with their
number. Vectors or labels that are null, zero vectors and vectors with null, NaN or
infinite components link with nothing. Vectors of other lengths link only within their
length. Rows that repeat a vec_id are vectors like any other and share its component; of
those that tie for the smallest id each is kept; a null vec_id links with nothing. Other
columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import pick, stash

BLOCKS = 4
PER_PIVOT = 256
LEAST_PIVOTS, PIVOTS = 16, 4096
TILE = 4096
SEED = 20
SLACK = 1e-6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def budgets(dim: int, least: float, blocks: int = BLOCKS) -> np.ndarray:
    """Squared distance that each block may have, with slack for rounding."""
    return np.array([(2 - 2 * least) * (j - i) / dim + SLACK for i, j in blocks_of(dim, blocks)])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def visits(x: np.ndarray, pivots: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and cell of each visit of one block's vectors ``x``, and the home of each row."""
    d = squared_distances(x, pivots)
    home = d.argmin(1)
    gaps = np.sqrt(squared_distances(pivots, pivots))[home]
    to_border = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * gaps, 1e-12)
    near = to_border <= np.sqrt(budget) + SLACK
    near[np.arange(len(x)), home] = True
    row, cell = np.nonzero(near)
    return row, cell, home


def cell_links(x: np.ndarray, at_home: np.ndarray, other: np.ndarray, ids: np.ndarray, weight: np.ndarray, block: int, least: float, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """For vectors x[at_home] of a cell against x[other]: links (by weight), and a root
    for each row of ``x`` in a forest that spans all links claimed by ``block``."""
    dim = x.shape[1]
    u = unit(x)
    rot = u @ rotation(dim)
    cuts, most = blocks_of(dim, blocks), budgets(dim, least, blocks)
    links = np.zeros(len(at_home), np.int64)
    root = np.arange(len(x))

    def merge(left: np.ndarray, right: np.ndarray) -> None:
        for m, n in zip(left.tolist(), right.tolist(), strict=True):
            while root[m] != m:
                m = root[m]
            while root[n] != n:
                n = root[n]
            if m != n:
                low, high = (m, n) if ids[m] <= ids[n] else (n, m)
                root[high] = low

    def flatten() -> None:
        while (root[root] != root).any():
            root[:] = root[root]

    i, j = cuts[block]
    for s in range(0, len(at_home), 512):
        rows = at_home[s : s + 512]
        a, b = np.nonzero(squared_distances(rot[rows, i:j], rot[other, i:j]) <= most[block])
        for p in range(0, len(a), 1 << 17):
            y, z = a[p : p + (1 << 17)], b[p : p + (1 << 17)]
            left, right = rows[y], other[z]
            keep = left != right
            y, left, right = y[keep], left[keep], right[keep]
            for k in range(block):
                i2, j2 = cuts[k]
                diff = rot[left, i2:j2] - rot[right, i2:j2]
                fits = (diff * diff).sum(1) <= most[k]
                y, left, right = y[~fits], left[~fits], right[~fits]
            good = np.einsum("ij,ij->i", u[left], u[right]) >= least
            y, left, right = y[good], left[good], right[good]
            np.add.at(links, s + y, weight[right])
            if len(left):
                # one link of each row first: what is joined by then needs no more work
                _, first = np.unique(left, return_index=True)
                merge(left[first], right[first])
                flatten()
                apart = np.unique(np.stack([root[left], root[right]], 1)[root[left] != root[right]], axis=0)
                merge(apart[:, 0], apart[:, 1])
                flatten()
    return links, root


def rough(x: np.ndarray, dim: int) -> np.ndarray:
    """Coordinates as bytes. Holding them to a range brings vectors nearer, never apart."""
    return np.clip(np.rint(x * rough_scale(dim)), -127, 127).astype(np.int8)


def rough_scale(dim: int) -> float:
    return 127 * np.sqrt(dim) / 4


def rough_budget(dim: int, size: int, budget: float) -> float:
    """Squared distance in rough coordinates that vectors within ``budget`` can have."""
    return (np.sqrt(budget) * rough_scale(dim) + np.sqrt(size)) ** 2 + 1e-3


#: block, cell, at home and length of a vector in one number
_HOME, _CELL, _BLOCK = 1, 1 << 1, 1 << 21


def near_vectors(vectors: DataFrame, least: float = 0.98, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each vector."""
    rows = pick(vectors, vec_id="bigint", embedding="array<double>", label="bigint")
    big = F.lit(float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0 and 0 are one
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))).withColumn("usable", usable)
    rows = stash(rows.withColumn("k1", F.xxhash64(F.lit(1), "embedding")).withColumn("k2", F.xxhash64(F.lit(2), "embedding")), "vectors")
    same = ["label", "k1", "k2"]
    ids = rows.where("usable").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    ids = stash(ids, "vectors-reps")
    # rows that repeat a vec_id may hold other vectors, so the key is matched too
    one = rows.where("usable").select(*same, F.col("vec_id").alias("rep"), "embedding").join(ids, [*same, "rep"]).dropDuplicates([*same, "rep"])
    largest = ids.groupBy("label").count().agg(F.max("count")).first()[0]
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    reps = stash(one.select(F.xxhash64("rep", *same).alias("node"), "rep", "label", "embedding", "copies", *same[1:]), "vectors-whole")
    wanted = max(LEAST_PIVOTS, min(pivots, largest // PER_PIVOT))
    sample = [r[0] for r in reps.select("embedding").orderBy("node", "rep").limit(wanted).collect()]
    by_dim: dict[int, np.ndarray] = {}
    for dim in {len(x) for x in sample}:
        by_dim[dim] = unit(np.array([x for x in sample if len(x) == dim])) @ rotation(dim)

    def place(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                values = batch.column("embedding").to_pylist()
                for dim in sorted({len(x) for x in values}):
                    pick_ = np.array([k for k, x in enumerate(values) if len(x) == dim])
                    rot = unit(np.array([values[k] for k in pick_], np.float64)) @ rotation(dim)
                    centres = by_dim.get(dim, rot[:0])
                    for b, (i, j) in enumerate(blocks_of(dim)):
                        if len(centres):
                            row, cell, home = visits(rot[:, i:j], centres[:, i:j], budgets(dim, least)[b])
                        else:
                            row, cell, home = np.arange(len(rot)), np.zeros(len(rot), int), np.zeros(len(rot), int)
                        take = pa.array(pick_[row])
                        key = b * _BLOCK + cell * _CELL
                        near = [x.tobytes() for x in rough(rot[:, i:j], dim)]
                        yield pa.record_batch([batch.column("label").take(take), pa.array(np.full(len(row), dim), pa.int32()), pa.array(key, pa.int32()), pa.array(cell == home[row]), batch.column("rep").take(take), batch.column("node").take(take), pa.array([near[r] for r in row.tolist()], pa.binary())], names=["label", "dim", "cell", "home", "rep", "node", "near"])

    key = ["label", "dim", "cell"]
    placed = stash(reps.select("rep", "node", "label", "embedding").mapInArrow(place, "label bigint, dim int, cell int, home boolean, rep bigint, node bigint, near binary"), "vectors-placed")
    # only cells that must be cut are listed here
    large = placed.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") > tile)
    tiled = placed.join(large, key, "left").withColumn("tiles", F.ceil(F.coalesce("members", F.lit(1)) / tile).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("h"), F.lit(True).alias("m")))
    as_home = F.when(F.col("home"), F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("h"), F.lit(False).alias("m")))).otherwise(F.array().cast("array<struct<i:int,j:int,h:boolean,m:boolean>>"))
    as_member = F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("h"), F.lit(True).alias("m")))
    dealt = tiled.withColumn("t", F.explode(F.when(F.col("tiles") == 1, single).otherwise(F.concat(as_home, as_member)))).select(*key, "t.i", "t.j", "t.h", "t.m", "rep", "node", "near")
    tile_key = [*key, "i", "j"]

    def flags(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(group.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("h", "m"))

    def candidates(group: pa.Table) -> pa.Table:
        """The rows of a tile that have a candidate in it, as they came."""
        dim, block = group.column("dim")[0].as_py(), group.column("cell")[0].as_py() // _BLOCK
        h, m = flags(group)
        seen = np.zeros(len(h), bool)
        if h.any() and len(h) > 1:
            near = np.frombuffer(b"".join(group.column("near").to_pylist()), np.int8).reshape(len(h), -1).astype(np.float32)
            node = group.column("node").to_numpy()
            most = rough_budget(dim, near.shape[1], budgets(dim, least)[block])
            homes, others = np.flatnonzero(h), np.flatnonzero(m)
            for s in range(0, len(homes), 512):
                rows = homes[s : s + 512]
                close = squared_distances(near[rows], near[others]) <= most
                close &= node[rows][:, None] != node[others][None, :]
                seen[rows] |= close.any(1)
                seen[others] |= close.any(0)
        return group.select([*tile_key, "h", "m", "rep", "node"]).filter(pa.array(seen))

    found = stash(dealt.groupBy(*tile_key).applyInArrow(candidates, "label bigint, dim int, cell int, i int, j int, h boolean, m boolean, rep bigint, node bigint"), "vectors-candidates")
    # vectors without a candidate go no further
    whole = found.join(reps.select("node", "rep", "copies", "embedding"), ["rep", "node"])

    def link(group: pa.Table) -> pa.Table:
        block = group.column("cell")[0].as_py() // _BLOCK
        ids, weight, node = (group.column(x).to_numpy() for x in ("rep", "copies", "node"))
        h, m = flags(group)
        x = np.asarray(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
        # in a tile a vector may stand twice, as a home and as a member
        _, same = np.unique(node, return_inverse=True)
        first = np.full(same.max() + 1, -1)
        first[same[::-1]] = np.arange(len(ids))[::-1]
        at_home, other = first[same[h]], first[same[m]]
        links, root = cell_links(x, at_home, other, ids, weight, block, least)
        seen = np.zeros(len(ids), np.int64)
        seen[at_home] = links
        out = (seen > 0) | (root != np.arange(len(ids)))
        return pa.table({"node": pa.array(node[out]), "rep": pa.array(ids[out]), "links": pa.array(seen[out]), "root": pa.array(ids[root[out]])})

    told = stash(whole.groupBy(*tile_key).applyInArrow(link, "node bigint, rep bigint, links bigint, root bigint"), "vectors-links")
    total = told.groupBy("rep", "node").agg(F.sum("links").alias("links"))
    # rows that repeat a vec_id tie the components of their vectors together: ids are the nodes
    roots = components(told.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vectors-components")
    per = reps.select("rep", "node", "copies", *same).join(total, ["rep", "node"], "left")
    per = stash(per.select(*same, "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")), "vectors-sums")
    # vectors stay where they are: rows are joined by their keys alone
    out = rows.select("vec_id", "usable", *same).join(per, same, "left").join(roots, F.col("rep") == F.col("node"), "left")
    root = F.when(F.col("usable"), F.coalesce("root", "rep")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
