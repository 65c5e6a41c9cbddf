"""The corpus pipeline: five stages over `documents`, each of which reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import jaccard, langid, mixing, packing, substring
from lexigrove.session import Scratch, cut, drop, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null and empty text, text without letters, and text few of whose words are known.
    Ids, nulls in other columns, repeated rows and extra columns are left as they are; of an empty table nothing comes."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles one stays: that with the smallest doc_id. Rows of one doc_id stay or go together; rows without
    a doc_id, and those of null text or no words, stay; an empty table stays empty; extra columns stay under whatever names."""
    return jaccard.one_of_each(docs)


#: Words of a repeated passage.
PASSAGE_WORDS = 51


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or of substring.LENGTH bytes that occur more than once are cut out, in one document or several,
    rows without a doc_id among them. Rows of which nothing is left go, repeated rows of that length with them; rows of null or empty text
    stay; an empty table stays empty; extra columns stay, n_chars counts what is left."""
    return substring.without_passages(docs, PASSAGE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them: 0, 1 or 2 times. A null source is a source; a null doc_id counts as any other; rows of one
    doc_id, text and source share a decision; rows without words are never taken; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. Null and empty text are one token, the end; a null doc_id is kept; repeated rows are packed
    each; very long texts are cut into pieces; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: The stages can't be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's result is written once and read by the next; what it was made from is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as scratch:
            now = scratch.keep(cut(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = now
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(docs)
    return out
