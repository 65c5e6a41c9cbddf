"""Queries that are run again and again, and a log of those whose results have grown."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.operators import search

#: Columns of the log, and seconds between two runs.
GROWTH = "timestamp string, query string, count long, node string, previous_count long"
SECONDS = 60


def counter(postings: Callable[[], DataFrame], stopwords=None) -> Callable[[str], int]:
    """count(query): its total results in what postings() is at that time."""
    return lambda q: search.total_results(postings(), q, stopwords).first()[0] or 0


class Tracker:
    """Runs queries on a schedule; a row goes to the log only if a query's count exceeds all before.

    count(query) is asked on each run. The log is a folder of CSV files with a header at `path`/log, one for each run with growth; the
    largest counts so far are read from it, so that they outlive the driver. A run that is run again writes its file again.
    """

    def __init__(self, spark: SparkSession, count: Callable[[str], int], queries: list[str], path: str, node: str = "driver", now: Callable[[], float] = time.time):
        self.spark, self.count, self.queries, self.path, self.node, self.now = spark, count, queries, path, node, now

    def log(self) -> DataFrame:
        """GROWTH rows with their run."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{GROWTH}, run long")
        return self.spark.read.schema(f"{GROWTH}, run long").option("header", True).csv(f"{self.path}/log")

    def most(self, before: int) -> dict[str, int]:
        """The largest count of each query in earlier runs: a row for each tracked query at most."""
        rows = self.log().where(F.col("run") < before).where(F.col("query").isin(self.queries)).groupBy("query").agg(F.max("count").alias("most"))
        return {r["query"]: r["most"] for r in rows.collect()}

    def step(self, run: int) -> list[tuple]:
        """One run; its rows of the log."""
        most, at = self.most(run), time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(self.now()))
        counts = [(q, self.count(q)) for q in self.queries]
        rows = [(at, q, n, self.node, most.get(q, 0)) for q, n in counts if n > most.get(q, 0)]
        if rows:
            self.spark.createDataFrame(rows, GROWTH).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.path}/log/run={run}")
        return rows

    def start(self, seconds: float = SECONDS) -> StreamingQuery:
        """Run every so many seconds, numbered on from the checkpoint, until the query is stopped."""
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        out = ticks.writeStream.foreachBatch(lambda _, run: self.step(run) and None)
        return out.option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime=f"{seconds} seconds").start()

    def run_times(self, times: int, seconds: float = 0, patience: float = 600) -> None:
        """Run `times` times, then stop."""
        query, until = self.start(seconds), time.time() + patience
        try:
            while query.isActive and time.time() < until:
                last = query.lastProgress
                if last is not None and last.batchId >= times - 1:
                    break
                time.sleep(0.05)
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()


def merged(logs: DataFrame, by: str = "query", at: str = "timestamp", count: str = "count", node: str = "node") -> DataFrame:
    """What nodes report of each query, merged: by, count, at, node.

    Of all nodes' entries the one with the latest time counts, of equally late ones that of the smallest node, then the largest count. One
    aggregate that combines before the shuffle, whatever the number of nodes and entries; entries without a time or key are left out.
    """
    rows = logs.where(F.col(at).isNotNull() & F.col(by).isNotNull())
    late = F.struct((-F.unix_micros(F.col(at).cast("timestamp"))).alias("t"), F.col(node).alias("n"), (-F.col(count)).alias("c"))
    best = rows.groupBy(F.col(by).alias("by_")).agg(F.min_by(F.struct(F.col(count).alias("c"), F.col(at).alias("a"), F.col(node).alias("n")), late).alias("b_"))
    return best.select(F.col("by_").alias(by), F.col("b_.c").alias(count), F.col("b_.a").alias(at), F.col("b_.n").alias(node))


def maps_as_rows(maps: DataFrame, node: str = "node", data: str = "queries") -> DataFrame:
    """Rows (query, timestamp, count, node) of each node's map from queries to (timestamp, count), for merged()."""
    return maps.select(F.col(node).alias("node"), F.explode(data).alias("query", "d")).select("query", "d.timestamp", "d.count", "node")
