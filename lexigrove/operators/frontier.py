"""Link frontiers: admission and breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.session import cut, cut_by


def admit(candidates: DataFrame, queued: DataFrame, done: DataFrame, by: str = "href", said: str = "already_crawled") -> DataFrame:
    """Each candidate once with its status: already_in_queue, else `said`, else admitted."""
    q = queued.select(by).distinct().withColumn("q_", F.lit(True))
    d = done.select(by).distinct().withColumn("d_", F.lit(True))
    got = candidates.select(by).distinct().join(q, by, "left").join(d, by, "left")
    return got.select(by, F.when(F.col("q_"), "already_in_queue").when(F.col("d_"), said).otherwise("admitted").alias("status"))


def insert(seeds: DataFrame, queued: DataFrame, done: DataFrame, by: str = "href", start: str = "/wiki/") -> tuple[DataFrame, DataFrame]:
    """What became of each seed (admit(), or `refused` if it doesn't begin with `start`), and the queue with those admitted."""
    good = F.coalesce(F.startswith(F.col(by), F.lit(start)), F.lit(False))
    status = admit(seeds.where(good), queued, done, by).unionByName(seeds.where(~good).select(by).distinct().withColumn("status", F.lit("refused")))
    return status, queued.select(by).distinct().unionByName(status.where("status = 'admitted'").select(by))


def breadth_first(links: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """node, depth of what is reached from seeds (node) over links (src, dst) in so many rounds, at the least
    depth. Each round joins only the newest nodes and drops those seen."""
    links = cut_by(links.select("src", "dst").distinct(), "src", 1)  # written once; rounds only shuffle the newest nodes
    seen = new = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        step = new.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen
