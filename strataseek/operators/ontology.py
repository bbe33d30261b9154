"""Checks of typed entities and relations, each a relational expression.

Entities: (id, type, properties map); relations: (from_id, from_type, rel, to_id, to_type).
Every check gives (severity, check, subject, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cycle_nodes

# The core schema.
REQUIRED = {"Task": ["title", "status"], "Person": ["name"], "Project": ["name"], "Event": ["title", "start"], "Document": ["title"], "Goal": ["description"], "Note": ["content"]}
ALLOWED = {("Task", "status"): ["open", "in_progress", "blocked", "done", "cancelled"], ("Task", "priority"): ["low", "medium", "high", "urgent"], ("Project", "status"): ["planning", "active", "paused", "completed", "archived"]}
FORBIDDEN = {"Credential": ["password", "secret", "token", "key", "api_key"]}
RELATIONS = {
    "has_owner": (["Project", "Task"], ["Person"], "many_to_one", False),
    "has_task": (["Project"], ["Task"], "one_to_many", False),
    "assigned_to": (["Task"], ["Person"], "many_to_one", False),
    "blocks": (["Task"], ["Task"], "many_to_many", True),
    "part_of": (["Task", "Document", "Event"], ["Project"], "many_to_one", False),
    "depends_on": (["Task", "Project"], ["Task", "Project", "Event"], "many_to_many", True),
    "member_of": (["Person"], ["Organization"], "many_to_many", False),
    "has_goal": (["Project"], ["Goal"], "one_to_many", False),
    "mentions": (["Document", "Message", "Note"], ["Person", "Project", "Task", "Event"], "many_to_many", False),
    "follows_up": (["Task", "Event"], ["Event", "Message"], "many_to_one", False),
    "attendee_of": (["Person"], ["Event"], "many_to_many", False),
}


def _found(df: DataFrame, severity: str, check: str, subject, detail) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _table(spec: dict) -> F.Column:
    return F.create_map(*[x for k, v in spec.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])


def required(entities: DataFrame, spec: dict[str, list[str]] = REQUIRED) -> DataFrame:
    needed = entities.select("id", "properties", F.explode(F.try_element_at(_table(spec), F.col("type"))).alias("p"))
    value = F.try_element_at("properties", F.col("p"))
    return _found(needed.where(value.isNull() | (value == "")), "error", "required", F.col("id"), F.col("p"))


def enums(entities: DataFrame, spec: dict[tuple[str, str], list[str]] = ALLOWED) -> DataFrame:
    parts = []
    for (kind, prop), values in spec.items():
        v = F.try_element_at("properties", F.lit(prop))
        parts.append(_found(entities.where((F.col("type") == kind) & v.isNotNull() & ~v.isin(values)), "error", "enum", F.col("id"), F.concat(F.lit(f"{prop}="), v)))
    return reduce(DataFrame.unionByName, parts)


def forbidden(entities: DataFrame, spec: dict[str, list[str]] = FORBIDDEN) -> DataFrame:
    bad = entities.select("id", F.explode(F.array_intersect(F.map_keys("properties"), F.try_element_at(_table(spec), F.col("type")))).alias("p"))
    return _found(bad, "error", "forbidden", F.col("id"), F.col("p"))


def event_times(entities: DataFrame) -> DataFrame:
    start, end = (F.try_to_timestamp(F.try_element_at("properties", F.lit(p))) for p in ("start", "end"))
    return _found(entities.where((F.col("type") == "Event") & (end < start)), "error", "event_time", F.col("id"), F.lit("end before start"))


def cardinality(relations: DataFrame, spec: dict = RELATIONS) -> DataFrame:
    one = [r for r, x in spec.items() if x[2] == "many_to_one"]
    many = [r for r, x in spec.items() if x[2] == "one_to_many"]
    out = relations.where(F.col("rel").isin(one)).groupBy("rel", F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("n"))
    into = relations.where(F.col("rel").isin(many)).groupBy("rel", F.col("to_id").alias("id")).agg(F.countDistinct("from_id").alias("n"))
    return _found(out.unionByName(into).where("n > 1"), "error", "cardinality", F.col("id"), F.concat("rel", F.lit(" "), F.col("n").cast("string")))


def endpoint_types(relations: DataFrame, spec: dict = RELATIONS) -> DataFrame:
    froms, tos = (_table({r: x[i] for r, x in spec.items()}) for i in (0, 1))
    bad = ~F.array_contains(F.try_element_at(froms, F.col("rel")), F.col("from_type")) | ~F.array_contains(F.try_element_at(tos, F.col("rel")), F.col("to_type"))
    return _found(relations.where(bad), "warning", "endpoint_type", F.concat("from_id", F.lit("->"), "to_id"), F.col("rel"))


def acyclic(relations: DataFrame, spec: dict = RELATIONS) -> DataFrame:
    names = [r for r, x in spec.items() if x[3]]
    left = cycle_nodes(relations.where(F.col("rel").isin(names)).select(F.col("rel").alias("relation"), F.col("from_id").alias("src"), F.col("to_id").alias("dst")))
    return _found(left, "error", "cycle", F.col("id"), F.col("relation"))


def validate(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """All findings; a graph is valid if none is an error."""
    return reduce(DataFrame.unionByName, [required(entities), enums(entities), forbidden(entities), event_times(entities), cardinality(relations), endpoint_types(relations), acyclic(relations)])
