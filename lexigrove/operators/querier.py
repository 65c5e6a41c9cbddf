"""Searches that are counted and timed, and statistics of what they did."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexigrove.session import Scratch, cut

#: A question that was asked: `range` questions are those for descendants.
ASKED = "node string, kind string, query string, ms double, results long, failed boolean"
#: The questions that probe a service, and seconds between them.
PROBES = ("citrus", "leafy sour", "north water seed")


class Querier:
    """Asks questions, of which each becomes a row of ASKED in the table at `path`.

    answer(query) and descend(taxon) give frames. An answer is written to the shared folder once, where an observation counts its rows
    as they pass; only the rows asked for come to the driver. An answer that raises is a failed question without rows.
    """

    def __init__(self, spark: SparkSession, path: str, answer: Callable[[str], DataFrame], descend: Callable[[str], DataFrame] | None = None, node: str = "driver", clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.node, self.clock = spark, path, node, clock
        self.kinds = {"query": answer, "range": descend}

    def ask(self, query: str, kind: str = "query", limit: int = 20, order: str | None = None) -> tuple[list, int]:
        """The first `limit` rows of an answer, by a column if one is named, and how many it has in all; raises what the answer
        raised, after it is written down."""
        rows, error, n, began = [], None, 0, self.clock()
        try:
            with Scratch(self.spark):
                seen = Observation()
                whole = cut(self.kinds[kind](query).observe(seen, F.count(F.lit(1)).alias("n")))
                n = seen.get["n"]
                if limit:
                    rows = (whole.orderBy(order) if order else whole).limit(limit).collect()
        except Exception as e:  # noqa: BLE001  counted, then raised
            error = e
        ms = float(self.clock() - began) * 1000
        told = self.spark.createDataFrame([(self.node, kind, query, ms, n, error is not None)], ASKED)
        told.coalesce(1).write.mode("append").parquet(self.path)
        if error is not None:
            raise error
        return rows, n

    def asked(self) -> DataFrame:
        return self.spark.read.schema(ASKED).parquet(self.path)

    def probe(self, queries=PROBES, pause: float = 0) -> tuple[float, float]:
        """Average ms and average results of some questions; those that fail count as 0 and 0."""
        times, counts = [], []
        for k, q in enumerate(queries):
            if k:
                time.sleep(pause)
            began = self.clock()
            try:
                counts.append(self.ask(q, limit=0)[1])
                times.append(float(self.clock() - began) * 1000)
            except Exception:  # noqa: BLE001  the log has it
                times.append(0.0)
                counts.append(0)
        return average(times), average(counts)


def average(numbers) -> float:
    return sum(numbers) / len(numbers) if numbers else 0.0


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def node_statistics(asked: DataFrame) -> DataFrame:
    """One row for each node: totals, failed and empty questions, and averages that are 0 where there is nothing to divide by."""
    query, fine = F.col("kind") == "query", ~F.coalesce(F.col("failed"), F.lit(False))
    sums = asked.groupBy("node").agg(
        F.count_if(query).alias("queries"), F.count_if(F.col("kind") == "range").alias("ranges"),
        F.count_if(query & ~fine).alias("failed"), F.count_if(query & fine & (F.coalesce("results", F.lit(0)) == 0)).alias("empty"),
        F.coalesce(F.sum(F.when(query & fine, F.col("results"))), F.lit(0)).alias("results"),
        F.coalesce(F.sum(F.when(query, F.col("ms"))), F.lit(0.0)).alias("query_ms"), F.coalesce(F.sum(F.when(F.col("kind") == "range", F.col("ms"))), F.lit(0.0)).alias("range_ms"),
    )
    return sums.select(
        "node", "queries", "ranges", (F.col("queries") + F.col("ranges")).alias("total"), "failed", "empty", "results",
        _ratio(F.col("query_ms"), F.col("queries")).alias("avg_query_ms"), _ratio(F.col("range_ms"), F.col("ranges")).alias("avg_range_ms"),
        _ratio(F.col("results"), F.col("queries") - F.col("failed")).alias("avg_results"),
    )


def cluster_statistics(nodes: DataFrame) -> DataFrame:
    """One row over all nodes: sums of their totals, the averages of their average times, results over all questions that didn't fail."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = nodes.agg(F.count("*").alias("nodes"), *(total(c) for c in ("queries", "ranges", "total", "failed", "empty", "results")), F.coalesce(F.avg("avg_query_ms"), F.lit(0.0)).alias("avg_query_ms"), F.coalesce(F.avg("avg_range_ms"), F.lit(0.0)).alias("avg_range_ms"))
    return sums.withColumn("avg_results", _ratio(F.col("results"), F.col("queries") - F.col("failed")))
