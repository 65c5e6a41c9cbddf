"""Operational metrics: rates, windows, growth and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requests that a process may make in a window, and the most prefixes that a summary shows.
RATE, RATE_MICROS, MOST_PREFIXES = 3, 1_000_000, 6160


def latest(metrics: DataFrame, by: list[str], at: list[str], values: list[str]) -> DataFrame:
    """Of each key the values seen last, by one aggregate that combines before the shuffle."""
    got = metrics.groupBy(*by).agg(F.max_by(F.struct(*at, *values), F.struct(*at)).alias("s"))
    return got.select(*by, *[F.col("s")[c].alias(c) for c in [*at, *values] if c in at[:1] + values])


def throughput(ops: Column, ms: Column) -> Column:
    """Operations a second, 0 where no time is known."""
    return F.coalesce(F.try_divide(ops, ms / 1000), F.lit(0.0))


def summary(events: DataFrame) -> DataFrame:
    """service, ops, throughput (of the nodes, added up), avg_value."""
    nodes = events.groupBy("event_type", "user_id").agg(F.count("*").alias("ops"), F.sum("value").alias("ms"))
    got = nodes.groupBy(F.col("event_type").alias("service")).agg(
        F.sum("ops").alias("ops"), F.sum(throughput(F.col("ops"), F.col("ms"))).alias("throughput"), F.try_divide(F.sum("ms"), F.sum("ops")).alias("avg_value")
    )
    return got.withColumn("avg_value", F.coalesce("avg_value", F.lit(0.0)))


def prefix_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.least(F.sum("prefixes"), F.lit(MOST_PREFIXES)).alias("prefixes"))


def per_minute(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.avg("value").alias("avg_value")).select(F.col("w.start").alias("window_start"), "event_type", "avg_value")


def throttled(events: DataFrame) -> DataFrame:
    """event_id, in_window, throttled: how many of a user's events lie in the second up to this one."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-(RATE_MICROS - 1), 0)
    return events.where("ts is not null").select("event_id", F.count("*").over(w).alias("in_window")).withColumn("throttled", F.col("in_window") > RATE)


def errors(events: DataFrame, kind: str = "error") -> DataFrame:
    return events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count_if(F.col("event_type") == kind).alias("errors"), F.count("*").alias("total"))


def growth(log: DataFrame, query: str = "event_type", count: str = "value", order=("ts", "event_id")) -> DataFrame:
    """Rows whose count exceeds all before of that query, with the largest before (0 for none).

    The maxima of hours run up first, a row for each; then each hour's rows by themselves, so that no task holds
    all of a query's history."""
    at = F.col(order[0])
    hour = F.floor((F.unix_micros(at.cast("timestamp")) / 3_600_000_000) if "timestamp" in log.schema[order[0]].dataType.typeName() else at / 3600)
    rows = log.where(F.col(count).isNotNull()).withColumn("hour_", F.coalesce(hour, F.lit(-(2**62))))
    hours = rows.groupBy(query, "hour_").agg(F.max(count).alias("m_"))
    before = F.max("m_").over(Window.partitionBy(query).orderBy("hour_").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(hours.withColumn("b_", before).drop("m_"), [query, "hour_"])
    w = Window.partitionBy(query, "hour_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("previous_value", F.coalesce(F.greatest(F.max(count).over(w), "b_"), F.lit(0.0)))
    return rows.where(F.col(count) > F.col("previous_value")).drop("hour_", "b_")


def growth_rate(now: DataFrame, before: DataFrame) -> DataFrame:
    """event_type, previous, current, pct of two tables of maxima; only where there was something before."""
    got = now.join(before, "event_type").where("previous > 0")
    pct = F.greatest(F.lit(0.0), F.col("current") - F.col("previous")) / F.col("previous") * 100
    return got.select("event_type", "previous", "current", F.round(pct, 2).alias("pct"))


def service_statistics(events: DataFrame) -> DataFrame:
    """One row for each service: ops, nodes, least, average and greatest value; errors are a service, too."""
    v = F.col("value")
    return events.groupBy(F.col("event_type").alias("service")).agg(
        F.count("*").alias("ops"), F.count_distinct("user_id").alias("nodes"), F.min(v).alias("least"), F.avg(v).alias("average"), F.max(v).alias("greatest")
    )


def cluster_statistics(services: DataFrame) -> DataFrame:
    """One row over all services: services, ops, busiest, share of the busiest."""
    busiest = F.max_by("service", F.struct("ops", "service"))
    return services.agg(F.count("*").alias("services"), F.sum("ops").alias("ops"), busiest.alias("busiest"), (F.max("ops") / F.sum("ops")).alias("share"))


def resumed(snapshots: DataFrame, since: DataFrame, by: str = "service", at: str = "at", value: str = "ops") -> DataFrame:
    """Counters after a restart: of each key the last snapshot's value plus what has come since."""
    last = snapshots.groupBy(by).agg(F.max_by(value, at).alias("was"))
    return last.join(since.select(by, F.col(value).alias("more")), by, "full").select(by, (F.coalesce("was", F.lit(0)) + F.coalesce("more", F.lit(0))).alias(value))
