"""Traversal of typed edges and the entity-proximity channel.

Both run as a frontier of a few levels, each an equality join and an anti-join; nothing
is gathered on the driver. Neighbours through entities are a union of equality joins,
as a disjunctive join would compare all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.scratch import stash

DIRECTIONS = ("outbound", "inbound", "both")
CURVES = ("linear", "harmonic", "type-weighted")
MAX_DEPTH = 5


def upsert_edges(log: DataFrame) -> DataFrame:
    """The latest event of each (source_id, target_id, relation), deletions gone;
    self-loops never come in. Ties of ts fall to the larger seq."""
    last = log.where("source_id <> target_id").groupBy("source_id", "target_id", "relation").agg(F.max(F.struct("ts", "seq", "properties", "deleted")).alias("e"))
    return last.where("not e.deleted").select("source_id", "target_id", "relation", "e.properties", "e.ts")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "source_id", "target_id", "relation")
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), "source_id", "target_id", "relation")
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "outbound", relation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (start, id, depth) without the start, and the edges walked, each once.
    ``starts`` has ``start``; the relation filter holds for both directions."""
    depth = max(1, min(depth, MAX_DEPTH))
    steps = _steps(edges if relation is None else edges.where(F.col("relation") == relation), direction)
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"))
    frontier, walked = seen, []
    for level in range(1, depth + 1):
        step = frontier.join(steps, F.col("id") == F.col("at"))
        walked.append(step.select("start", "source_id", "target_id", "relation"))
        new = step.select("start", F.col("to").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        frontier = new.withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0"), reduce(DataFrame.unionByName, walked).distinct()


def entity_links(mentions: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory_id, e): each memory and the entities that it mentions, canonical ones too;
    (s, t, relation): relations between entities, likewise. Memories that relations join
    meet through these two; the pairs of memories are never listed."""
    canon = entities.select(F.col("id").alias("entity_id"), F.coalesce("canonical_id", "id").alias("canon"))
    on = mentions.select("memory_id", "entity_id").distinct().join(canon, "entity_id")
    names = on.select("memory_id", F.explode(F.array_distinct(F.array("entity_id", "canon"))).alias("e")).distinct()
    r = relations.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"), F.col("relation_type").alias("relation")).distinct()
    c = canon.select(F.col("entity_id").alias("s"), F.col("canon").alias("sc"))
    r = r.join(c, "s").join(c.select(F.col("s").alias("t"), F.col("sc").alias("tc")), "t")
    ends = r.select("relation", F.explode(F.array_distinct(F.array("s", "sc"))).alias("s"), "t", "tc").select("relation", "s", F.explode(F.array_distinct(F.array("t", "tc"))).alias("t")).distinct()
    return names, ends


def entity_neighbours(frontier: DataFrame, names: DataFrame, ends: DataFrame) -> DataFrame:
    """From (at): (at, to, relation), memories whose entities a relation joins, source to
    target."""
    reached = frontier.join(names, F.col("at") == F.col("memory_id")).join(ends, F.col("e") == F.col("s")).select("at", "t", "relation").distinct()
    return reached.join(names.select(F.col("memory_id").alias("to"), F.col("e").alias("t")), "t").where("at <> to").select("at", "to", "relation").distinct()


def seed_entities(queries: DataFrame, mentions: DataFrame, entities: DataFrame, least: int = 0) -> DataFrame:
    """(query_id, canon): exact normalized names and surface forms that hold a query token.
    The parts of the distinct surface forms, of the lengths that tokens have, are joined to the
    tokens by equality; ``least`` can set a shortest token."""
    canon = entities.select(F.col("id").alias("entity_id"), "name_normalized", F.coalesce("canonical_id", "id").alias("canon"))
    named = queries.join(canon, F.col("token") == F.col("name_normalized")).select("query_id", "canon")
    surface = mentions.join(canon, "entity_id").select(F.lower("surface_form").alias("form"), "canon").distinct()
    tokens = queries.where(F.length("token") >= max(least, 1))
    sizes = tokens.agg(F.collect_set(F.length("token")).alias("sizes"))  # one row, as long as the longest token
    forms = surface.select("form").distinct().crossJoin(F.broadcast(sizes)).select("form", F.explode("sizes").alias("n")).where(F.length("form") >= F.col("n"))
    parts = forms.select("form", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("form") - F.col("n") + 1), lambda i: F.substr("form", i, F.col("n"))))).alias("token"))
    held = parts.join(tokens, "token").select("query_id", "form").distinct().join(surface, "form").select("query_id", "canon")
    return named.unionByName(held).distinct()


def weight(source: Column, relation: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in S.RELATION_WEIGHTS.items() for x in kv])
    return F.when(source == "edges", F.lit(S.MANUAL_WEIGHT)).otherwise(F.coalesce(F.try_element_at(table, relation), F.lit(S.RELATION_WEIGHT_DEFAULT)))


def bonus(source: Column, relation: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in S.RELATION_BONUS.items() for x in kv])
    return F.when(source == "edges", F.lit(S.MANUAL_BONUS)).otherwise(F.coalesce(F.try_element_at(table, relation), F.lit(S.RELATION_BONUS_DEFAULT)))


def hop_rank(distance: Column, source: Column, relation: Column, curve: str = "linear") -> Column:
    if curve not in CURVES:
        raise ValueError(f"curve is one of {CURVES}")
    d, w = distance.cast("double"), weight(source, relation)
    if curve == "harmonic":
        grown = F.aggregate(F.sequence(F.lit(1), F.greatest(distance, F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / i)
        far = 1.0 + grown / w
    elif curve == "type-weighted":
        far = 1.0 + d / (w * bonus(source, relation))
    else:
        far = 1.0 + d / w
    return F.when(distance == 0, F.lit(1.0)).otherwise(far)


def proximity(seeds: DataFrame, direct: DataFrame, names: DataFrame, ends: DataFrame, live: DataFrame, limit: int, depth: int = 2, curve: str = "linear") -> DataFrame:
    """query_id, id, distance, value and rank of memories near the seeds.

    ``seeds``: (query_id, id); ``direct``: (at, to, relation); ``names`` and ``ends`` as
    from ``entity_links``; ``live``: id. A nearer hop wins; at one distance the lower value
    does. A level goes from memories to entities, over relations and back, with one row for
    each query and entity between, so a popular entity is met once a level."""
    seen = seeds.select("query_id", "id").distinct().withColumn("distance", F.lit(0)).withColumn("value", F.lit(1.0))
    frontier = seen
    for level in range(1, depth + 1):
        at = frontier.select("query_id", F.col("id").alias("at"))
        value = lambda source, level=level: hop_rank(F.lit(level), F.lit(source), F.col("relation"), curve).alias("value")
        one = at.join(direct.select("at", "to", "relation"), "at").select("query_id", F.col("to").alias("id"), value("edges"))
        said = at.join(names, F.col("at") == F.col("memory_id")).select("query_id", F.col("e").alias("s")).distinct()
        over = said.join(ends, "s").select("query_id", F.col("t").alias("e"), value("relations")).groupBy("query_id", "e").agg(F.min("value").alias("value"))
        two = over.join(names, "e").select("query_id", F.col("memory_id").alias("id"), "value")
        new = one.unionByName(two).groupBy("query_id", "id").agg(F.min("value").alias("value"))
        frontier = new.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(level).alias("distance"), "value")
        seen = seen.unionByName(frontier)
    kept = seen.join(live.select("id"), "id", "left_semi").withColumn("value", F.round("value", 6))
    per = Window.partitionBy("query_id").orderBy("value", "id")
    return kept.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= limit)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes (relation, id) that lie on a cycle. ``edges``: (relation, src, dst).

    Two steps alternate until nothing changes. Edges from nodes that none leads to, and to
    nodes that none leaves, are taken off. A node with one edge in and one out, if it draws
    a higher lot than both its neighbours, is taken out and its two edges become one: a third
    of a path goes in each round, so rounds grow with the logarithm of its length. What is
    left are cycles and what lies between; there, and then for the nodes taken out, last ones
    first, an edge is on a cycle if both its ends are in one component of mutual reach.
    """
    left = stash(edges.select("relation", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct(), "cycles")
    taken: list[DataFrame] = []
    n, quiet, done = left.count(), 0, 0
    while n and quiet < 2:  # lots may fall badly: a round without change is tried again
        ins, outs = left.groupBy("relation", F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.min("src").alias("u")), left.groupBy("relation", F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.min("dst").alias("x"))
        nodes = ins.join(outs, ["relation", "id"])
        lot = lambda c, done=done: F.xxhash64(F.lit(done), F.col(c))
        chain = nodes.where((F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("u") != F.col("id")) & (lot("id") > lot("u")) & (lot("id") > lot("x")))
        chain = stash(chain.select("relation", "id", "u", "x"), "cycles-taken")
        both = nodes.select("relation", "id")
        kept = left.join(both.withColumnRenamed("id", "src"), ["relation", "src"], "left_semi").join(both.withColumnRenamed("id", "dst"), ["relation", "dst"], "left_semi")
        gone = chain.select("relation", "id")
        kept = kept.join(gone.withColumnRenamed("id", "src"), ["relation", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["relation", "dst"], "left_anti")
        left = stash(kept.select("relation", "src", "dst").unionByName(chain.select("relation", F.col("u").alias("src"), F.col("x").alias("dst"))).distinct(), "cycles")
        m = left.count()
        taken.append(chain)
        quiet, n, done = (quiet + 1 if m == n else 0), m, done + 1
    member = _mutual(left)
    for chain in reversed(taken):
        at = chain.join(member.select("relation", F.col("id").alias("u"), "comp"), ["relation", "u"]).join(member.select("relation", F.col("id").alias("x"), F.col("comp").alias("c2")), ["relation", "x"])
        # both ends are one node (then its loop was the cycle) or in one component
        member = stash(member.unionByName(at.where("comp = c2").select("relation", "id", "comp")), "cycles-members")
    return member.select("relation", "id").distinct()


def _mutual(edges: DataFrame) -> DataFrame:
    """(relation, id, comp) of nodes on cycles: comp is one for nodes that reach each other.

    Colours go forward along edges, the least winning; of each colour, what reaches its
    source backwards within it is one component, and goes; until no edge is left."""
    found = None
    loops = edges.where("src = dst").select("relation", F.col("src").alias("id"))
    left = edges.where("src <> dst")
    while not left.isEmpty():
        nodes = left.select("relation", F.col("src").alias("id")).unionByName(left.select("relation", F.col("dst").alias("id"))).distinct()
        colour = _spread(nodes.withColumn("c", F.col("id")), left, "src", "dst")
        named = colour.select("relation", "id", F.col("c").alias("comp"))
        inside = left.join(named.select("relation", F.col("id").alias("src"), F.col("comp").alias("a")), ["relation", "src"]).join(named.select("relation", F.col("id").alias("dst"), F.col("comp").alias("b")), ["relation", "dst"]).where("a = b").select("relation", "src", "dst")
        inside = stash(inside, "cycles-inside")
        # 0 for the source of a colour, 1 for others; 0 goes backwards
        reach = _spread(named.select("relation", "id", F.when(F.col("id") == F.col("comp"), "0").otherwise("1").alias("c")), inside, "dst", "src").where("c = '0'").select("relation", "id")
        part = stash(named.join(reach, ["relation", "id"]), "cycles-part")
        size = part.groupBy("relation", "comp").agg(F.count("*").alias("n")).where("n > 1").select("relation", "comp")
        own = stash(part.join(size, ["relation", "comp"], "left_semi").select("relation", "id", "comp"), "cycles-found")
        found = own if found is None else found.unionByName(own)
        gone = part.select("relation", "id")
        left = stash(inside.join(gone.withColumnRenamed("id", "src"), ["relation", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["relation", "dst"], "left_anti"), "cycles").select("relation", "src", "dst")
    alone = loops.withColumn("comp", F.col("id"))
    if found is None:
        return alone
    return found.unionByName(alone.join(found.select("relation", "id"), ["relation", "id"], "left_anti"))


def _spread(values: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """The least ``c`` that reaches each node (relation, id, c), until nothing changes."""
    now = stash(values, "cycles-spread")
    while True:
        near = edges.join(now.select("relation", F.col("id").alias(source), F.col("c").alias("m")), ["relation", source]).groupBy("relation", F.col(target).alias("id")).agg(F.min("m").alias("m"))
        new = stash(now.join(near, ["relation", "id"], "left").select("relation", "id", F.least("c", F.coalesce("m", "c")).alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")), "cycles-spread")
        now = new.select("relation", "id", "c")
        if new.where("moved").isEmpty():
            return now
