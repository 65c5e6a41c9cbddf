"""A crawl as a stream: links arrive in a queue, are admitted once by state kept for each link, and what their pages hold
arrives in the queue in turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lexigrove.session import _settings

#: A link in the queue: how far from the seeds, and its place: the positions of the links on the way to it. Places of one
#: depth sort as a first-in-first-out queue would have them.
QUEUED = "link string, depth int, place array<int>"
#: What became of sightings of a link in a batch: n of them.
SEEN = f"{QUEUED}, status string, n long"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Admission(StatefulProcessor):
    """Each link is admitted when it is first seen, at its least (depth, place); later sightings are told by what they met."""

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "depth int, place array<int>")

    def handleInputRows(self, key, rows, timerValues):
        (link,), best, n = key, None, 0
        for r in rows:  # one at a time: a page that all link to is seen by many
            n += 1
            if best is None or (r.depth, r.place) < best:
                best = (r.depth, r.place)
        if self.first.exists():
            yield Row(link=link, depth=best[0], place=best[1], status="already_crawled", n=n)
            return
        self.first.update(best)
        yield Row(link=link, depth=best[0], place=best[1], status="admitted", n=1)
        if n > 1:
            yield Row(link=link, depth=best[0], place=best[1], status="already_in_queue", n=n - 1)

    def close(self) -> None:
        pass


def enqueue(links: DataFrame, path: str) -> None:
    """Add links (link, depth, place) to the queue, each of the least (depth, place) that they are seen with here."""
    best = links.where("link is not null").groupBy("link").agg(F.min(F.struct("depth", "place")).alias("b"))
    best.select("link", "b.depth", "b.place").write.mode("append").parquet(f"{path}/queue")


def seed(spark: SparkSession, seeds: list[str], path: str) -> None:
    """Queue the seeds in their order; a crawl that has seen them already goes on without."""
    rows = [(s, 0, [k]) for k, s in enumerate(dict.fromkeys(seeds))]
    enqueue(spark.createDataFrame(rows, QUEUED), path)


def start(spark: SparkSession, expand: Callable[[DataFrame], DataFrame], path: str, rounds: int | None = None, interval: str = "0 seconds", files: int | None = None) -> StreamingQuery:
    """Crawl on from the queue in `path`, from its checkpoint if there is one.

    A micro-batch takes what has arrived (at most `files` files, the oldest first), admits each link once and asks
    expand(frame of link, depth, place) for (link, dst, pos): the links of the admitted pages, pos their place there. Those go to the queue
    as the next batch's input, unless they are over `rounds` away. A batch that is run again adds to the queue
    again, which changes nothing, as links are admitted by state; its record of sightings is written over.
    """
    before = _settings(spark, ROCKS)
    try:
        source = spark.readStream.schema(QUEUED).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(f"{path}/queue")
        told = source.groupBy("link").transformWithState(Admission(), SEEN, "Append", "None")

        def write(batch: DataFrame, number: int) -> None:
            seen = f"{path}/seen/batch={number}"
            batch.write.mode("overwrite").parquet(seen)
            new = spark.read.schema(SEEN).parquet(seen).where("status = 'admitted'").drop("status", "n")
            if rounds is not None:
                new = new.where(F.col("depth") < rounds)
            if not new.isEmpty():
                found = expand(new).join(new, "link")
                enqueue(found.select(F.col("dst").alias("link"), (F.col("depth") + 1).alias("depth"), F.concat("place", F.array("pos")).alias("place")), path)

        return told.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=interval).start()
    finally:
        _settings(spark, before)


def run(spark: SparkSession, expand, path: str, rounds: int | None = None) -> None:
    """Crawl until nothing new is found."""
    query = start(spark, expand, path, rounds)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def over_links(links: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """expand() over a table (src, dst, pos) of known links."""
    return lambda new: new.select("link").join(links, F.col("link") == F.col("src")).select("link", "dst", "pos")


def sightings(spark: SparkSession, path: str) -> DataFrame:
    """SEEN rows of all batches, with `batch`."""
    return spark.read.schema(f"{SEEN}, batch long").parquet(f"{path}/seen")


def crawled(spark: SparkSession, path: str) -> DataFrame:
    """node, depth, place of each page, once."""
    return sightings(spark, path).where("status = 'admitted'").select(F.col("link").alias("node"), "depth", "place")


def queue_order(nodes: DataFrame) -> DataFrame:
    """Adds seq: of each depth the place in the queue, from 1. A depth's places are counted by their first two steps, so that
    no task sorts them all."""
    head = F.slice("place", 1, 2)
    parts = nodes.groupBy("depth", head.alias("head")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("depth").orderBy("head").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("m")
    inside = F.row_number().over(Window.partitionBy("depth", "head").orderBy("place", "node"))
    return nodes.withColumn("head", head).withColumn("k", inside).join(parts, ["depth", "head"]).withColumn("seq", F.col("k") + F.col("before")).drop("head", "k", "before")
