"""Continuous forms: an index that stays current, and items that are handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators import index, search


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_index(docs: DataFrame, out: str, checkpoint: str, stopwords=None, interval: str | None = None):
    """Append each micro-batch's postings to `out` in a folder of its own; a batch that is run again
    overwrites its folder, so that each counts once. A document is marked done by the checkpoint after its
    postings are written. Later versions of a (term, doc_id) win on reading (current_index). With an interval, such as
    "10 seconds", it goes on until it is stopped; without, it ends when it has caught up."""

    def write(batch: DataFrame, number: int) -> None:
        rows = index.document_terms(batch, stopwords).drop("leads").withColumn("prefix2", F.substring("term", 1, 2)).withColumn("version", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


class Job:
    """A stream that can be paused and resumed: start is a function that starts it, at its checkpoint. A job made anew
    over the same checkpoint, as after a crash, goes on where the last one was."""

    def __init__(self, start):
        self.start, self.query = start, None

    def resume(self) -> Job:
        if self.query is None or not self.query.isActive:
            self.query = self.start()
        return self

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()

    def caught_up(self) -> Job:
        """Wait for what has arrived to be handled."""
        self.query.processAllAvailable() if self.query.isActive else self.query.awaitTermination()
        return self

    def progress(self) -> list[tuple[int, int, float]]:
        """(batch, rows, rows a second) of the last batches."""
        return [(p.batchId, p.numInputRows, p.processedRowsPerSecond) for p in self.query.recentProgress] if self.query is not None else []


def track(postings: DataFrame, queries: list[str], path: str, run: int, stopwords=None) -> None:
    """Run tracked queries again and add run, query and results to the log at `path`; a schedule's every call is a run."""
    spark = postings.sparkSession
    rows = [(run, q, search.total_results(postings, q, stopwords).first()[0]) for q in queries]
    spark.createDataFrame(rows, "run int, query string, results long").coalesce(1).write.mode("append").parquet(path)


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """query, previous, current: results of the last run and of the one before it (0 for none)."""
    last = F.slice(F.sort_array(F.collect_list(F.struct("run", "results")), False), 1, 2)
    got = spark.read.parquet(path).groupBy("query").agg(last.alias("r"))
    return got.select("query", F.coalesce(F.get("r", F.lit(1))["results"], F.lit(0)).alias("previous"), F.get("r", F.lit(0))["results"].alias("current"))


def current_index(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    return index.upsert(rows.limit(0), rows).drop("batch")


def stream_distinct(events: DataFrame, by: list[str], out: str, checkpoint: str, at: str | None = None, late: str = "1 hour"):
    """Append each key's first row to `out`. With an event time the state is bounded by a watermark."""
    rows = events.withWatermark(at, late).dropDuplicatesWithinWatermark(by) if at else events.dropDuplicates(by)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
