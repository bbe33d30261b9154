"""The facade: store, search, update, delete, list, link, extract, graph and set_project."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from . import upkeep
from .functions import text as T
from .functions.embed import LOCAL, Embedder
from .operators import bm25, entities, fusion, graph, index, knn
from .providers import Registry, variants
from .sources.corpus import Corpus, dedup, has_tags, prepare, touch
from .sources.scratch import stash
from .streaming import tasks

CHANNELS = ("fts", "chunk_fts", "vec", "chunk_vec", "graph")
FIELDS = ("title", "content", "tags")


class Engine:
    """Two corpora, project and global; every operation is a batch."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder = LOCAL, embed=None, providers: Registry | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.embed, self.providers = embedder, embed, providers or Registry()
        self._indexes: dict[str, tuple] = {}
        self.timings: dict[str, float] = {}
        self.reason: str | None = None
        self.set_project("default")

    def set_project(self, name: str) -> dict[str, str]:
        self.project = name
        self.corpora = {"project": Corpus(self.spark, f"{self.root}/projects/{name}", "project"), "global": Corpus(self.spark, f"{self.root}/global", "global")}
        return {"project": name}

    def scopes(self, scope: str) -> list[Corpus]:
        return list(self.corpora.values()) if scope == "all" else [self.corpora["global"]] if scope == "global" else [self.corpora["project"], self.corpora["global"]]

    def live(self, scope: str = "project") -> DataFrame:
        parts = [c.live() for c in self.scopes(scope)]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # writes

    def store(self, raw: DataFrame, scope: str = "project", now: float | None = None) -> DataFrame:
        """Takes (id, title, content, tags); returns (id, stored), false for copies and
        texts that are too short."""
        corpus, now = self.corpora[scope], now or time.time()
        version = self._version(corpus, now)
        made = dedup(prepare(raw, F.lit(scope), F.lit(now)), corpus.live()).withColumn("version", F.lit(version)).withColumn("deleted", F.lit(False))
        corpus.append(made.select(*S.VERSION.names), "memories")
        self._follow_up(corpus, version, now)
        stored = corpus.live().select("id").withColumn("stored", F.lit(True))
        return raw.select(F.col("id").cast("string").alias("id")).join(stored, "id", "left").fillna({"stored": False})

    def _version(self, corpus: Corpus, now: float) -> int:
        """Later than all versions of the corpus, also if two writes have one ``now``."""
        last = corpus.versions.agg(F.max("version")).first()[0]
        return max(int(now * 1e6), (last or 0) + 1)

    def _follow_up(self, corpus: Corpus, version: int, now: float) -> None:
        """Chunks of what was written, its vectors if an embedder is set, and its tasks."""
        new = corpus.live().where(F.col("version") == version)
        had = corpus.table("chunks", upkeep.CHUNK)
        upkeep.persist_chunks(corpus, new, had.where(F.col("version") < version))
        if self.embed is not None:
            for level in ("memory", "chunk"):
                upkeep.embed_pending(corpus, self.embedder, self.embed, now, level, new)
        state = tasks.current(corpus.table("tasks", S.TASK))
        todo = tasks.to_extract(new.withColumn("agent_provided", F.lit(not self.providers.is_configured("extract"))), F.lit(now))
        corpus.append(tasks.enqueue_once(todo, state).select(*S.TASK.names), "tasks")

    def suggest(self, ids: DataFrame, scope: str = "project", limit: int = 3) -> DataFrame:
        """id, target_id, score, rank and reason: memories that those of ``ids`` may be linked to."""
        live = self.corpora[scope].live()
        src = live.join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.substring("content", 1, S.SUGGEST_CHARS).alias("query"))
        post, lens = self._index(live.select("id", *[self.fields()[f].alias(f) for f in FIELDS]), ["id"], {f: F.col(f) for f in FIELDS})
        terms = index.query_terms(src, tokens="words")
        terms = index.prune(terms, index.prefix_frequency(terms, post), live.count())
        scored = bm25.score(terms, post, lens, dict.fromkeys(S.COLUMN_WEIGHTS, 1.0)).where("id <> query_id").join(live.where("status = 'active'").select("id"), "id", "left_semi")
        best = bm25.top(scored, limit)
        told = best.join(live.select("id", "title"), "id").join(src, "query_id")
        return told.select(F.col("query_id").alias("id"), F.col("id").alias("target_id"), "score", "rank", T.reason(F.col("query"), F.col("title")).alias("reason"))

    def update(self, changes: DataFrame, scope: str = "project", now: float | None = None) -> DataFrame:
        """Takes (id, title, content, tags, status), null for what stays; rows whose new text
        another memory has, or that an earlier row of the batch takes too, change nothing. An
        unknown status is an error. Returns what changed."""
        corpus, now = self.corpora[scope], now or time.time()
        wrong = changes.where(F.col("status").isNotNull() & ~F.col("status").isin(*S.STATUSES)).select("status").first()
        if wrong:
            raise ValueError(f"status is one of {S.STATUSES}, not {wrong[0]}")
        live, version = corpus.live(), self._version(corpus, now)
        c = changes.select(F.col("id").cast("string").alias("id"), *[F.col(x).alias(f"new_{x}") for x in ("title", "content", "tags", "status")])
        text = F.coalesce(F.nullif(T.normalize(F.col("new_content")), F.lit("")), F.col("content"))
        new = live.join(c.where(F.col("new_status").isNull() | F.col("new_status").isin(*S.STATUSES)), "id").withColumns({"title": F.coalesce("new_title", "title"), "content": text, "tags": F.coalesce(T.canonical_tags(F.col("new_tags")), F.col("tags")), "status": F.coalesce("new_status", "status")})
        new = new.withColumns({"content_hash": T.content_hash(F.col("content")), "updated_at": F.lit(now), "version": F.lit(version), "deleted": F.lit(False)})
        other = live.select(F.col("id").alias("other"), F.col("content_hash").alias("h"))
        new = new.join(other, (F.col("content_hash") == F.col("h")) & (F.col("id") != F.col("other")), "left_anti").select(*S.VERSION.names)
        corpus.append(dedup(new), "memories")
        self._follow_up(corpus, version, now)
        return corpus.live().where(F.col("version") == version)

    def delete(self, ids: DataFrame, scope: str = "project", now: float | None = None) -> int:
        corpus, now = self.corpora[scope], now or time.time()
        gone = corpus.live().join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi").withColumn("version", F.lit(self._version(corpus, now))).withColumn("deleted", F.lit(True))
        n = gone.count()
        corpus.append(gone.select(*S.VERSION.names), "memories")
        return n

    def list(self, scope: str = "project", tags: list[str] | None = None, limit: int = 20, offset: int = 0, archived: bool = False) -> DataFrame:
        return self.corpora[scope].page(tags, limit, offset, archived)

    # edges

    def link(self, events: DataFrame, scope: str = "project", now: float | None = None) -> None:
        """Takes (source_id, target_id, relation, properties, deleted); edges to unknown
        memories and to oneself are left out."""
        corpus, now = self.corpora[scope], now or time.time()
        ids = corpus.live().select("id")
        ok = events.where("source_id <> target_id").join(ids, F.col("source_id") == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")
        corpus.append(ok.withColumn("ts", F.lit(now)).withColumn("seq", F.lit(int(now * 1e6))).select(*S.EDGE_EVENT.names), "edges")

    def edges(self, scope: str = "project") -> DataFrame:
        corpus = self.corpora[scope]
        ids = corpus.live().select("id")
        return graph.upsert_edges(corpus.table("edges", S.EDGE_EVENT)).join(ids, F.col("source_id") == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")

    def graph(self, start: str, relation: str | None = None, direction: str = "outbound", depth: int = 1, scope: str = "project") -> tuple[DataFrame, DataFrame]:
        nodes, edges = graph.traverse(self.edges(scope), self.spark.createDataFrame([(start,)], "start string"), depth, direction, relation)
        return nodes.join(self.corpora[scope].live().select("id", "title", "tags", "status"), "id").drop("start"), edges.drop("start")

    # entities

    def extract(self, payloads: DataFrame, scope: str = "project", now: float | None = None) -> DataFrame:
        """Takes (memory_id, entities, relations) of live memories and writes what they name.
        Returns (memory_id, errors): items that are wrong are left out, and payloads over a cap
        add nothing. Writing a payload again adds no mention and no relation."""
        corpus, now = self.corpora[scope], now or time.time()
        live = corpus.live().select("id", "content")
        last = corpus.table("entities", S.ENTITY_VERSION).agg(F.max("version")).first()[0]
        own = payloads.join(live.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        told = own.select("memory_id", entities.payload_errors(F.col("entities"), F.col("relations")).alias("errors"), "entities", "relations")
        over = (F.size("entities") > S.AGENT_ENTITIES) | (F.size("relations") > S.AGENT_RELATIONS)
        ents, rels = entities.cleaned(F.col("entities"), F.col("relations"), n_entities=S.AGENT_ENTITIES, n_relations=S.AGENT_RELATIONS)
        sound = told.where(~F.coalesce(over, F.lit(False))).select("memory_id", ents.alias("entities"), rels.alias("relations"))
        made, said, related = entities.write_extraction(sound, live, *self.knowledge(corpus))
        version = max(int(now * 1e6), (last or 0) + 1)
        corpus.append(said.withColumn("confidence", F.lit(1.0)).select([F.col(f.name).cast(f.dataType) for f in S.MENTION]), "mentions")
        corpus.append(related.select(*S.RELATION.names), "relations")
        corpus.append(made.withColumn("version", F.lit(version)).select([F.col(f.name).cast(f.dataType) for f in S.ENTITY_VERSION]), "entities")
        return told.select("memory_id", "errors")

    def knowledge(self, corpus: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entities in their latest version, mentions in live memories, and relations."""
        ents = entities.latest(corpus.table("entities", S.ENTITY_VERSION), ["id"], ["version"]).drop("version")
        said = corpus.table("mentions", S.MENTION).join(corpus.live().select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        return ents, said.select(*S.MENTION.names), corpus.table("relations", S.RELATION)

    def linked(self, corpus: Corpus) -> tuple[DataFrame, ...] | None:
        """Entities, mentions, and what ``entity_links`` makes of them: made once for a state of
        the corpus, stored, and read by every search until something is written; null if there
        are no entities."""
        last = corpus.table("entities", S.ENTITY_VERSION).agg(F.max("version")).first()[0]
        if last is None:
            return None
        state, what = (self.project, corpus.versions.agg(F.max("version")).first()[0], last), f"entities of {corpus.name}"
        if self._indexes.get(what, (None,))[0] != state:
            ents, said, rels = (stash(x, "knowledge") for x in self.knowledge(corpus))
            self._indexes[what] = (state, (ents, said, *(stash(x, "entity-links") for x in graph.entity_links(said, ents, rels))))
        return self._indexes[what][1]

    def proximity(self, queries: DataFrame, scope: str = "project", limit: int = 50, depth: int = 2, curve: str = "linear") -> DataFrame | None:
        """(query_id, corpus, id, rank): memories near the entities that a query names; null if
        no corpus of the scope has entities."""
        tokens = queries.select("query_id", F.explode(F.split(T.normalize_name(F.col("query")), " ")).alias("token")).where("token <> ''").distinct()
        parts = []
        for corpus in self.scopes(scope):
            held = self.linked(corpus)
            if held is None:
                continue
            ents, said, names, ends = held
            asked = graph.seed_entities(tokens, said, ents)
            seeds = stash(asked.join(names, F.col("canon") == F.col("e")).select("query_id", F.col("memory_id").alias("id")).distinct(), "seeds")
            direct = stash(self.edges(corpus.name).select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "relation"), "direct")
            near = graph.proximity(seeds, direct, names, ends, corpus.live().where("status = 'active'").select("id"), limit, depth, curve)
            parts.append(near.select("query_id", F.lit(corpus.name).alias("corpus"), "id", "rank"))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    # search

    def fields(self) -> dict[str, Column]:
        return {"title": F.col("title"), "content": F.col("content"), "tags": F.array_join("tags", " ")}

    def _index(self, docs: DataFrame, key: list[str], fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
        return stash(index.postings(docs, key, fields, tokens="words"), "postings"), stash(index.lengths(docs, key, fields, tokens="words"), "lengths")

    def indexed(self, what: str) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of all live memories, or chunks, of both corpora: made once for
        a state of them, stored, and read by every search until something is written."""
        state = tuple(c.versions.agg(F.max("version")).first()[0] for c in self.corpora.values())
        if self._indexes.get(what, (None,))[0] != (self.project, state):
            live = self.live("all")
            if what == "memories":
                made = self._index(live, ["corpus", "id"], self.fields())
            else:
                parts = [upkeep.chunks(c).select(F.lit(c.name).alias("corpus"), F.concat_ws("\0", "id", "chunk_index").alias("key"), "text") for c in self.corpora.values()]
                made = self._index(parts[0].unionByName(parts[1]), ["corpus", "key"], {"text": F.col("text")})
            self._indexes[what] = ((self.project, state), made)
        return self._indexes[what][1]

    def expanded(self, queries: DataFrame, expand: bool | None, n_probe: int = 3) -> DataFrame:
        """The queries and their variants (query_id, query, variant, vec). Only queries without
        a strong signal are expanded; a stated set of queries goes through the hook."""
        plain = queries.select("query_id", "query", F.lit(0).alias("variant"), F.col("query").alias("vec"))
        if not self.providers.enabled("expand", expand):
            return plain
        post, lens = self.indexed("memories")
        own = lambda df: df.where("corpus = 'project'").drop("corpus")
        probe = bm25.top(bm25.score(index.query_terms(queries, tokens="words"), own(post), own(lens), S.COLUMN_WEIGHTS), n_probe)
        strong = {r["query_id"] for r in fusion.strong_signal(probe).where("strong").select("query_id").collect()}
        rows = []
        for r in queries.select("query_id", "query").collect():
            told = variants(self.providers.call("expand", r["query"]) if r["query_id"] not in strong else None, r["query"])
            rows += [(r["query_id"], q, i, told["vec"]) for i, q in enumerate([r["query"], *told["lex"]])]
        return self.spark.createDataFrame(rows, plain.schema)

    def reranked(self, queries: DataFrame, best: DataFrame, live: DataFrame) -> DataFrame | None:
        """Scores (query_id, id, llm) of the head of each query by the hook, checked; null if
        the hook fails. Contents are cut so that a head fits the hook's budget."""
        share = max(1, S.RERANK_MAX_TOKENS // S.RERANK_TOP_K * 4)
        head = best.where(F.col("rank") <= S.RERANK_TOP_K).join(live.select("corpus", "id", F.substring("content", 1, share).alias("content")), ["corpus", "id"])
        raw = []
        asked = {r["query_id"]: r["query"] for r in queries.select("query_id", "query").collect()}
        for q, items in head.groupBy("query_id").agg(F.collect_list(F.struct("rank", "id", "content")).alias("c")).collect():
            if len(items) < 2:
                continue
            said = self.providers.call("rerank", asked[q], [{"id": i, "content": x["content"]} for i, x in enumerate(sorted(items), 1)])
            ids = {i: x["id"] for i, x in enumerate(sorted(items), 1)}
            for n, x in enumerate(said if isinstance(said, list) else []):
                place = str(x.get("id", "")).strip() if isinstance(x, dict) else ""
                if place.isdigit() and int(place) in ids:
                    raw.append((q, ids[int(place)], n, str(x.get("score"))))
        if not raw:
            return None
        kind = dict(queries.dtypes)["query_id"]
        made = self.spark.createDataFrame(raw, f"query_id {kind}, id string, pos int, score string")
        return fusion.clean_scores(made, head)

    def timed(self, name: str, start: float) -> float:
        now = time.perf_counter()
        self.timings[f"{name}_ms"] = round((now - start) * 1000, 3)
        return now

    def search(self, queries: DataFrame, scope: str = "project", tags: list[str] | None = None, filter_tags: list[str] | None = None, limit: int = 5, strategy: str = "hybrid", channels: tuple[str, ...] | None = None, now: float | None = None, rerank_scores: DataFrame | None = None, proximity: DataFrame | None = None, expand: bool | None = None, rerank: bool | None = None) -> DataFrame:
        """``queries``: (query_id, query). Returns (query_id, rank, id, title, content, tags,
        score, source, total). Texts are joined at the end, to what is returned alone.
        ``proximity`` can give the graph channel's list (query_id, corpus, id, rank), which is
        else found from stored entities and edges. ``expand`` and ``rerank`` ask for the stages
        that hooks provide; ``timings`` tells what each took, and ``reason`` why a result is
        empty."""
        self.timings, self.reason = {}, "no_channels_selected" if channels is not None and not channels else None
        clock = time.perf_counter()
        chosen = CHANNELS if channels is None else tuple(c for c in channels if c in CHANNELS)
        limit, now = max(1, min(limit, 50)), now or time.time()
        queries = queries.where(F.length(F.trim("query")) >= 2)
        live = self.live(scope)
        live = live.where("status = 'active'").where(has_tags(F.col("tags"), filter_tags or []))
        n = limit * 2 * (S.OVERFETCH_FILTERED if filter_tags else 1)
        lists = []
        asked = self.expanded(queries, expand) if {"fts", "chunk_fts"} & set(chosen) else queries.withColumn("vec", F.col("query")).withColumn("variant", F.lit(0))
        clock = self.timed("expansion", clock)
        # variants are words of the same query: each adds to what a memory scores
        terms = index.query_terms(asked.select("query_id", "query"), tokens="words") if {"fts", "chunk_fts"} & set(chosen) else None
        allowed = live.select("corpus", "id")
        if "fts" in chosen:
            post, lens = self.indexed("memories")
            scored = bm25.score(terms, post, lens, S.COLUMN_WEIGHTS, by_corpus=True).join(allowed, ["corpus", "id"], "left_semi")
            lists.append(bm25.top(scored, n, place=["corpus"]).select("query_id", "corpus", "id", "rank", F.lit("fts").alias("channel")))
        if "chunk_fts" in chosen:
            post, lens = self.indexed("chunks")
            scored = bm25.score(terms, post, lens, {"text": 1.0}, "key", True)
            scored = scored.select("query_id", "corpus", F.substring_index("key", "\0", 1).alias("id"), "score").groupBy("query_id", "corpus", "id").agg(F.max("score").alias("score")).join(allowed, ["corpus", "id"], "left_semi")
            lists.append(bm25.top(scored, n, place=["corpus"]).select("query_id", "corpus", "id", "rank", F.lit("chunk_fts").alias("channel")))
        if strategy != "keyword" and self.embed is not None and self.embedder.usable() and {"vec", "chunk_vec"} & set(chosen):
            asked = self.embed(asked.where("variant = 0").select("query_id", F.col("vec").alias("query")).withColumn("id", F.col("query_id")), "query").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
            for corpus in self.scopes(scope):
                own = live.where(F.col("corpus") == corpus.name)
                if "vec" in chosen:
                    held = upkeep.vectors(corpus).where("level = 'memory'").join(own.select("id"), "id", "left_semi")
                    near = knn.knn(held.select("id", "embedding"), asked, n)
                    lists.append(near.select("query_id", F.lit(corpus.name).alias("corpus"), "id", "rank", F.lit("vec").alias("channel")))
                if "chunk_vec" in chosen:
                    held = upkeep.vectors(corpus).where("level = 'chunk'").join(own.select("id"), "id", "left_semi")
                    near = knn.knn(held.select(F.concat_ws("\0", "id", "chunk_index").alias("id"), "embedding"), asked, 3 * n)
                    near = knn.best_per_group(near.withColumn("memory", F.substring_index("id", "\0", 1)), "memory", n)
                    lists.append(near.select("query_id", F.lit(corpus.name).alias("corpus"), F.col("memory").alias("id"), "rank", F.lit("chunk_vec").alias("channel")))
        if "graph" in chosen and proximity is None:
            proximity = self.proximity(queries, scope)
        if "graph" in chosen and proximity is not None:
            lists.append(proximity.join(live.select("corpus", "id"), ["corpus", "id"], "left_semi").select("query_id", "corpus", "id", "rank", F.lit("graph").alias("channel")))
        if not lists:
            return self.spark.createDataFrame([], "query_id string, rank int, id string, title string, content string, tags array<string>, score double, source string, total bigint")
        ranked = lists[0]
        for x in lists[1:]:
            ranked = ranked.unionByName(x)
        order = F.create_map(*[F.lit(x) for i, c in enumerate(CHANNELS) for x in (c, i)])
        ranked = ranked.withColumn("channel_ord", order[F.col("channel")]).withColumn("corpus_ord", F.when(F.col("corpus") == "project", 0).otherwise(1))
        weights = {"fts": S.BM25_WEIGHT, "chunk_fts": S.BM25_WEIGHT, "vec": fusion.vector_weight(self.embedder.quality), "chunk_vec": fusion.vector_weight(self.embedder.quality), "graph": S.GRAPH_WEIGHT}
        fused = fusion.min_max(fusion.rrf(ranked, weights))
        meta = live.select("corpus", "id", "tags", "accessed_at", "content_hash")
        wanted = F.array(*[F.lit(t.strip().lower()) for t in tags]) if tags else F.array().cast("array<string>")
        scored = fused.join(meta, ["corpus", "id"]).withColumn("score", fusion.boosted(F.col("norm"), F.col("tags"), wanted, F.col("accessed_at"), F.lit(now), F.col("corpus")))
        clock = self.timed("planning", clock)
        hooked = self.providers.enabled("rerank", rerank)
        best = fusion.dedup_top(scored, max(limit, S.RERANK_TOP_K) if rerank_scores is not None or hooked else limit)
        if hooked and rerank_scores is None:
            best = stash(best, "search-head")
            rerank_scores = self.reranked(queries, best, live)
            best = best if rerank_scores is not None else best.where(F.col("rank") <= limit)
            clock = self.timed("rerank", clock)
        if rerank_scores is not None:
            best = fusion.rerank(best, rerank_scores).withColumn("rank", F.col("new_rank")).where(F.col("rank") <= limit)
        return best.select("query_id", "rank", "corpus", "id", "score", "total").join(live.select("corpus", "id", "title", "content", "tags"), ["corpus", "id"]).select("query_id", "rank", "id", "title", "content", "tags", "score", F.col("corpus").alias("source"), "total")

    def record_access(self, hits: DataFrame, scope: str = "project") -> DataFrame:
        """Live memories with access events (id, ts) merged in."""
        return touch(self.corpora[scope].live(), hits)

    def call(self, operation: str, /, **args: Any) -> dict[str, Any]:
        """An operation by name; what goes wrong is told in the answer."""
        try:
            if operation not in ("store", "search", "suggest", "update", "delete", "list", "link", "extract", "graph", "set_project"):
                raise ValueError(f"no operation {operation}")
            return {"result": getattr(self, operation)(**args), "project": self.project}
        except Exception as e:
            return {"error": str(e), "project": self.project}
