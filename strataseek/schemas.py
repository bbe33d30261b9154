"""Schemas and the constants that define results."""

from pyspark.sql import types as T

# They must be these for right results.
RRF_K = 60
VECTOR_QUALITY_GATE = 0.6
VECTOR_WEIGHT_FLOOR = 0.5
BM25_WEIGHT = 1.0
GRAPH_WEIGHT = 0.7
OVERFETCH_FILTERED = 3
HALF_LIFE_S = 14 * 86400
RECENCY_AMPLITUDE = 0.05
TAG_BOOST, TAG_BOOST_CAP = 0.03, 0.15
PROJECT_BOOST = 0.10
DF_RATIO, DF_MIN_DOCS, DF_FALLBACK_WORDS = 0.20, 100, 3
COLUMN_WEIGHTS = {"title": 10.0, "content": 3.0, "tags": 1.0}
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RERANK_TOP_K, RERANK_MIN_COVERAGE, RERANK_MAX_TOKENS = 15, 0.5, 8192
BLEND = (0.75, 0.6, 0.4)
STRONG_TOP1, STRONG_RATIO = 0.4, 2.0
CHUNK_THRESHOLD, CHUNK_LOW, CHUNK_MAX, CHUNK_TARGET, CHUNK_OVERLAP, CHUNK_MIN, CHUNK_CAP, CHUNK_LOOKBACK = 2000, 1500, 1200, 600, 60, 120, 200, 200
EMBED_DIM, EMBED_QUALITY, EMBED_MAX_CHARS = 384, 0.45, 8192
DEDUP_COSINE, CONFIRM_COST = 0.9, 0.0002
AGENT_ENTITIES, AGENT_RELATIONS, LLM_ENTITIES, LLM_RELATIONS, NAME_CHARS = 50, 100, 10, 15, 200
STALE_S, RETENTION_DAYS, PRUNE_EVERY_H, REEMBED_BATCHES, REEMBED_BATCH = 300, 30, 24, 32, 50
SUGGEST_CHARS = 2000
SEARCH_STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could to of in for on with "
    "at by from as into through during before after above below between out off over under again further then once here there when where "
    "why how all each every both few more most other some such no nor not only own same so than too very and but or if this that it its "
    "what which who whom whose need use add get set make also just def self cls return import class async await none true false "
    "function method code file work using used way like new data type types value values based"
).split()
EMBED_STOPWORDS = [x for x in SEARCH_STOPWORDS if x not in {"also", "just", "function", "method", "code", "file", "work", "using", "used", "way", "like", "new", "data", "type", "types", "value", "values", "based"}]
FTS_OPERATORS = ["AND", "OR", "NOT", "NEAR"]
RELATION_WEIGHTS = {"implements": 1.0, "contains": 1.0, "depends_on": 1.0, "mentions": 0.7, "references": 0.7, "relates_to": 0.7, "contradicts": 1.1, "supersedes": 1.1, "alternative_to": 1.1, "derived_from": 1.0}
RELATION_WEIGHT_DEFAULT, MANUAL_WEIGHT = 0.7, 1.2
RELATION_BONUS = {"contradicts": 1.4, "supersedes": 1.4, "alternative_to": 1.4, "implements": 1.0, "contains": 1.0, "depends_on": 1.0, "derived_from": 1.0, "mentions": 0.6, "references": 0.6, "relates_to": 0.6}
RELATION_BONUS_DEFAULT, MANUAL_BONUS = 0.8, 1.5
STATUSES = ("active", "invalidated", "archived")

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in spec.split(", "))])


MEMORY = _schema("corpus string, corpus_ord int, id string, title string, content string, tags array<string>, content_hash string, status string, created_at double, updated_at double, accessed_at double, access_count bigint")
VERSION = T.StructType([*MEMORY.fields, T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType())])
EDGE_EVENT = _schema("source_id string, target_id string, relation string, properties string, ts double, seq bigint, deleted boolean")
EDGE = _schema("source_id string, target_id string, relation string, properties string, created_at double")
ENTITY = _schema("id string, name string, name_normalized string, type string, canonical_id string, mention_count bigint")
ENTITY_VERSION = T.StructType([*ENTITY.fields, T.StructField("version", T.LongType())])
MENTION = _schema("memory_id string, entity_id string, surface_form string, start bigint, end bigint, confidence double")
RELATION = _schema("source_entity_id string, target_entity_id string, relation_type string, source_memory_id string, confidence double")
TASK = _schema("task_id string, memory_id string, task_type string, status string, attempts int, last_error string, ts double")
