"""python -m strataseek ROOT status|queue|reindex|dedup ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from . import upkeep
from .engine import Engine
from .streaming import tasks


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser("strataseek")
    made.add_argument("root")
    made.add_argument("--project", default="default")
    made.add_argument("--scope", choices=("project", "global"), default="project")
    do = made.add_subparsers(dest="command", required=True)
    do.add_parser("status", help="memories and chunks, and how many vectors are stale")
    queue = do.add_parser("queue", help="tasks by status and type")
    queue.add_argument("action", nargs="?", choices=("depth", "prune"), default="depth")
    index = do.add_parser("reindex", help="embed what is stale, all of it anew, or look after backups")
    index.add_argument("--full", action="store_true")
    index.add_argument("--backups", action="store_true")
    index.add_argument("--drop-backup", type=int)
    return made


def run(spark: SparkSession, args: argparse.Namespace, engine: Engine | None = None) -> list[dict]:
    engine = engine or Engine(spark, args.root)
    engine.set_project(args.project)
    corpus = engine.corpora[args.scope]
    if args.command == "status":
        return [r.asDict() for r in upkeep.status(corpus, engine.embedder).collect()]
    if args.command == "queue":
        state = tasks.current(corpus.table("tasks", S.TASK))
        if args.action == "prune":
            state = tasks.prune(state, F.lit(time.time()))
        return [r.asDict() for r in tasks.depth(state).orderBy("status", "task_type").collect()]
    if args.drop_backup is not None:
        upkeep.drop_backup(corpus, args.drop_backup)
    if args.backups or args.drop_backup is not None:
        return [{"backup": n} for n in upkeep.backups(corpus)]
    if engine.embed is None:
        return [{"error": "no embedder is set"}]
    if args.full:
        return [{"embedded": upkeep.reembed(corpus, engine.embedder, engine.embed, time.time())}]
    return [{"level": x, "embedded": upkeep.embed_pending(corpus, engine.embedder, engine.embed, time.time(), x)} for x in ("memory", "chunk")]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for row in run(SparkSession.builder.appName("strataseek").getOrCreate(), args):
        print(json.dumps(row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
