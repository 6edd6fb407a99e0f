"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tasks that a node's edges to greater nodes are dealt to.
SALTS = 4


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b: long), root being the least node of its component.

    Large-star and small-star rounds: each node's edges are pointed at its least neighbour until nothing changes, in about
    log(diameter) rounds. A node's neighbours are only ever aggregated, never gathered, so a hub's edges may be many.
    Each round is written to the shared folder and the round before it deleted; an edge table without rows gives none.
    """
    spark, path = edges.sparkSession, None

    def step(df: DataFrame) -> DataFrame:
        nonlocal path
        old, path = path, common.scratch(spark, "edges")
        df.write.parquet(path)
        if old:
            common.drop(old, spark)
        return spark.read.schema("a long, b long").parquet(path)

    now = step(_tidy(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))))
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
        # large star: an edge's greater end points at the least of the lesser end and its neighbours. A hub's edges are dealt to SALTS tasks.
        least = now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        large = _tidy(now.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(least, ["b", "salt"], "left").select("a", F.coalesce("m", "b").alias("b")))
        # small star: lesser neighbours and the node itself point at the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = step(_tidy(small.where("a > b")))
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()
