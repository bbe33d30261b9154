"""The task queue and the access log as event logs, in batch and as streams.

A task's state is its latest event, so nothing is claimed or updated in place. The
stream reads new event files, keeps each batch once by its id and hands pending tasks to
a handler; checkpoints take the place of recovery of what was running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.entities import latest

TYPES = ("extract", "dedup", "reembed")


def current(events: DataFrame) -> DataFrame:
    """The latest event of each task."""
    return latest(events, ["task_id"], ["ts", "status"])


def depth(state: DataFrame) -> DataFrame:
    """Tasks by status and type, with totals by status (type null) and overall."""
    return state.rollup("status", "task_type").agg(F.count("*").alias("n"))


def recover(state: DataFrame, now: Column) -> DataFrame:
    """Events that put back tasks that have run too long."""
    return state.where((F.col("status") == "running") & (now - F.col("ts") > S.STALE_S)).withColumn("status", F.lit("pending")).withColumn("ts", now)


def prune(state: DataFrame, now: Column, days: int = S.RETENTION_DAYS) -> DataFrame:
    """What is left when old finished tasks go."""
    return state.where(~(F.col("status").isin("done", "failed") & (now - F.col("ts") > days * 86400)))


def prune_due(last: float | None, now: float) -> bool:
    return last is None or now - last >= S.PRUNE_EVERY_H * 3600


def to_extract(memories: DataFrame, now: Column) -> DataFrame:
    """Tasks for memories that no agent has extracted and that are over 50 characters."""
    kept = memories.where((F.length("content") > 50) & ~F.coalesce(F.col("agent_provided"), F.lit(False)))
    return event(kept, "extract", now)


def to_reembed(stale: DataFrame, now: Column, quality: float, batches: int = S.REEMBED_BATCHES) -> DataFrame:
    if quality < S.VECTOR_QUALITY_GATE:
        return event(stale.limit(0), "reembed", now)
    return event(stale.orderBy("id").limit(batches * S.REEMBED_BATCH), "reembed", now)  # a work limit of one pass


def event(memories: DataFrame, kind: str, now: Column) -> DataFrame:
    return memories.select(F.concat(F.lit(f"{kind}:"), "id").alias("task_id"), F.col("id").alias("memory_id"), F.lit(kind).alias("task_type"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), now.alias("ts"))


def enqueue_once(new: DataFrame, state: DataFrame) -> DataFrame:
    """New tasks but for those that are waiting already."""
    return new.join(state.where("status = 'pending'").select("task_id"), "task_id", "left_anti").select(*new.columns)


def claim(state: DataFrame, order: list[str]) -> DataFrame:
    """Of each type the pending task that has waited longest, as a partial aggregate."""
    first = F.min(F.struct(*order, *[c for c in state.columns if c not in order])).alias("t")
    return state.where("status = 'pending'").groupBy("task_type").agg(first).select("t.*")


def run_stream(spark: SparkSession, events: str, out: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]):
    """Starts a query over event files: pending tasks of each type go through its handler,
    which returns (task_id, error); done or failed events are appended to ``out``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        pending = current(batch).where("status = 'pending'")
        # a task that no handler is set for fails, so it is seen
        other = pending.where(~F.col("task_type").isin(list(handlers)))
        parts = [other.withColumn("status", F.lit("failed")).withColumn("last_error", F.concat(F.lit("no handler for "), "task_type")).withColumn("attempts", F.col("attempts") + 1).select(*S.TASK.names)]
        for kind, handle in handlers.items():
            own = pending.where(F.col("task_type") == kind)
            told = handle(own).select("task_id", "error")
            parts.append(own.join(told, "task_id", "left").withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed")).withColumn("last_error", F.col("error")).withColumn("attempts", F.col("attempts") + 1).select(*S.TASK.names))
        done = parts[0]
        for p in parts[1:]:
            done = done.unionByName(p)
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return spark.readStream.schema(S.TASK).parquet(events).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_windows(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Accesses by event type in tumbling windows of event time. An addition of ours: the
    same plan runs over a stream, with a watermark, and over a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
