"""Connected components over tables of links, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_dir, remove


def components(links: DataFrame, what: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    ``links`` has columns a and b of one kind. Alternating large-star and small-star steps
    (Kiveris et al., 2014) point every node at ever smaller ones until the links form
    stars; minima are partial aggregates, so a hub costs no more than any other node.
    Nodes without links are not listed. Each round is a table in the shared folder that
    goes when the next is written; rounds grow with the logarithm of the longest path, and
    more than ``rounds`` are an error.
    """
    spark = links.sparkSession
    old: list[str] = []

    def held(df: DataFrame) -> DataFrame:
        path = new_dir(spark, what)
        df.write.option("compression", "zstd").parquet(path)
        old.append(path)
        return spark.read.schema(df.schema).parquet(path)

    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = held(links.select(hi, lo).where("hi <> lo").distinct())
    for _ in range(rounds):
        if _is_stars(now):
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # what the large star says of a node, once for itself and once for what it points at
        large = held(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = held(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        remove(spark, old[:-1])
        del old[:-1]
    raise RuntimeError(f"components not found in {rounds} rounds")


def _is_stars(links: DataFrame) -> bool:
    """Every node points at one smaller node, which points at none."""
    seen = links.select(F.col("hi").alias("n"), F.lit(1).alias("up")).unionByName(links.select(F.col("lo").alias("n"), F.lit(0).alias("up")).distinct())
    return seen.groupBy("n").agg(F.sum("up").alias("up"), F.count("*").alias("c")).where("up > 1 or (up > 0 and c > up)").isEmpty()
