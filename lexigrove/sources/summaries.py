"""Titles and descriptions from summaries that come as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text

#: What is read of a payload; all else in it is left alone.
SUMMARY = "title string, extract string"


def with_summaries(records: DataFrame, summaries: DataFrame, by: str = "url", name: str = "binomial", payload: str = "payload") -> DataFrame:
    """The records with title and description of their summary, found by `by`.

    A record without a summary, with one that isn't JSON or tells of no page or title, takes its name as title; a title's first
    letter is a capital; control characters of a description are blanks, none is empty. Of several summaries of a key the least
    payload counts; records stay as many as they are.
    """
    one = summaries.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(payload).alias("payload_"))
    got = records.join(one, by, "left").withColumn("s_", F.from_json("payload_", SUMMARY))
    title = text.title_of(F.nullif(F.col("s_.title"), F.lit("")), F.coalesce(F.col(name), F.lit("")))
    return got.select(*records.columns, title.alias("title"), text.scrub(F.coalesce("s_.extract", F.lit(""))).alias("description"))
