"""The inverted index: counts, weights, boosts, shards and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import text

RANKS = ("kingdom", "phylum", "class_", "order_", "family", "genus", "species")
# Boost of a term by the rank whose name holds it.
BOOSTS = {"kingdom": 5.0, "phylum": 4.0, "class_": 3.0, "class": 3.0, "order_": 2.5, "order": 2.5, "family": 2.0, "genus": 1.5}
#: Number of documents that idf takes where there are none.
NO_DOCS = 10_000


def word_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))


def document_terms(docs: DataFrame, stopwords=None) -> DataFrame:
    """(doc_id, term, n, tf, leads) of kept words, documents being one row each: n how often, tf that over the number of
    distinct terms, leads true for one of a document's terms. Nothing is shuffled: a row's words are sorted and runs counted."""
    return counted_terms(docs.select("doc_id", text.kept(F.col("text"), stopwords).alias("words")))


#: Runs of a word in sorted words, with blanks between.
RUNS = r"([^ ]++)(?: \1(?![^ ]))*+"


def counted_terms(rows: DataFrame) -> DataFrame:
    """Adds term, n, tf and leads to rows with an array `words` (without blanks), which goes; a row for each distinct word."""
    others = [c for c in rows.columns if c != "words"]
    # not by a filter on words, which would be pushed below what makes them, and make them again
    runs = F.regexp_extract_all(F.concat_ws(" ", F.sort_array("words")), F.lit(RUNS), F.lit(0))
    w = rows.select(*others, runs.alias("s")).select("*", F.size("s").alias("size"))
    got = w.select(*others, "size", F.posexplode("s").alias("k", "run")).withColumn("term", F.substring_index("run", " ", 1))
    got = got.withColumn("n", F.expr("(octet_length(run) + 1) div (octet_length(term) + 1)"))
    return got.select(*others, "term", "n", (F.col("n") / F.col("size")).alias("tf"), (F.col("k") == 0).alias("leads"))


def word_counts(docs: DataFrame, stopwords=None) -> DataFrame:
    """(doc_id, term, n) of kept words."""
    return document_terms(docs, stopwords).select("doc_id", "term", "n")


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    n = F.when(n_docs == 0, F.lit(NO_DOCS)).otherwise(n_docs)
    return F.log((n + 1) / (df + 1)) + 1


def hierarchy_entries(rows: Column) -> Column:
    """Of (rank, name) pairs each rank once: where it first stands, with the name it has last."""
    ranks = F.array_distinct(F.transform(rows, lambda r: r["rank"]))
    last = lambda rank: F.element_at(F.filter(rows, lambda r: r["rank"] == rank), -1)["name"]
    return F.transform(ranks, lambda rank: F.struct(rank.alias("rank"), last(rank).alias("name")))


def species(docs: DataFrame, stopwords=None) -> DataFrame:
    """Plain documents as species records: a document's first seven kept words name its ranks."""
    # an array of one, so that words are made once: a filter would be pushed below what makes them
    enough = F.filter(F.array(text.kept(F.col("text"), stopwords)), lambda w: F.size(w) >= len(RANKS))
    k = docs.select("doc_id", "n_chars", F.explode(enough).alias("words"))
    named = F.array(*[F.struct(F.lit(r).alias("rank"), F.col("words")[i].alias("name")) for i, r in enumerate(RANKS)])
    return k.select("doc_id", "n_chars", "words", named.alias("hierarchy"), F.concat_ws(" ", F.col("words")[5], F.col("words")[6]).alias("binomial"))


def postings(records: DataFrame) -> DataFrame:
    """One row for each term of each record: tf, the rank that names it, its boosts and base score.

    The rank is the first whose name holds the term as a substring; words are counted and ranks found where the
    record is, and nothing is shuffled.
    """
    name = lambda rank: F.get(F.filter("hierarchy", lambda r: r["rank"] == rank), F.lit(0))["name"]
    boost = F.coalesce(*[F.when(F.col("taxonomy_level") == r, F.lit(b)) for r, b in BOOSTS.items()], F.lit(1.0))
    # once for each record: its names, and its ranks, one after the other; a term's first place among the names tells its rank
    line = lambda c: F.array_join(F.transform("hierarchy", lambda r: F.coalesce(r[c], F.lit(""))), "\n")
    own = records.select("doc_id", "binomial", "words", line("name").alias("names"), line("rank").alias("ranks"), name("kingdom").alias("kingdom"), name("family").alias("family"))
    p = counted_terms(own).withColumn("at", F.instr("names", F.col("term")))
    place = "length(substring(names, 1, at)) - length(replace(substring(names, 1, at), '\\n', '')) + 1"
    rank = F.expr(f"substring_index(substring_index(ranks, '\\n', {place}), '\\n', -1)")
    p = p.withColumn("taxonomy_level", F.when(F.col("at") > 0, F.nullif(rank, F.lit(""))))
    p = p.withColumns({
        "taxonomy_boost": boost,
        "is_binomial": F.coalesce(F.contains("binomial", F.col("term")), F.lit(False)),
        "prefix": text.smart_prefix(F.col("term")),
    })
    p = p.withColumns({
        "binomial_boost": F.when(F.col("is_binomial"), 4.0).otherwise(1.0),
        "position_boost": F.when(F.contains("kingdom", F.col("term")), 3.0).when(F.contains("family", F.col("term")), 2.0).otherwise(1.0),
    })
    score = F.col("tf") * F.col("taxonomy_boost") * F.col("binomial_boost") * F.col("position_boost")
    return p.withColumn("base_score", score).drop("names", "ranks", "at", "n")


def upsert(index: DataFrame, batch: DataFrame, at: str = "version") -> DataFrame:
    """Index rows with those of a batch: of each (term, doc_id) the row with the latest `at` stays."""
    w = Window.partitionBy("term", "doc_id").orderBy(F.col(at).desc())
    return index.unionByName(batch).withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def write_index(rows: DataFrame, path: str, mode: str = "overwrite", salts: int = 1) -> None:
    """Shards as folders, one for each prefix: a search reads only those of its terms. Common prefixes are
    split already (smart_prefix); salts, of documents, keep a large shard from being one task's and one file."""
    rows.repartition("prefix", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).write.mode(mode).partitionBy("prefix").parquet(path)


def in_shards(rows: DataFrame) -> DataFrame:
    """Rows where they are, sorted by term, and so by prefix: written as they are, each file has a prefix's rows, and a term's, in one run,
    and a search reads only the pages of its own. Nothing is shuffled, however much of the index one prefix has; few large files (dealt())
    are written far faster than a folder for each of thousands of prefixes (write_index)."""
    return rows.sortWithinPartitions("term")


#: Documents whose postings are sorted, and written, by one task.
DOCS_A_TASK = 5_000


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """n documents in tasks of about DOCS_A_TASK: texts are far smaller than their postings."""
    return docs.repartition(1 + n // DOCS_A_TASK, F.xxhash64("doc_id", "text"))


def read_shards(spark, path: str, prefixes: list[str] | None = None) -> DataFrame:
    got = spark.read.parquet(path)
    return got if prefixes is None else got.where(F.col("prefix").isin(prefixes))


def n_documents(rows: DataFrame) -> int:
    """How many documents an index holds, by one column of it."""
    return rows.where("leads").count()


def top_terms(counts: DataFrame, letters: int = 2, most: int = 3) -> DataFrame:
    """prefix, place, term, df: the terms of each prefix that most documents have; ties by term."""
    df = document_frequencies(counts).withColumn("prefix", F.substring("term", 1, letters))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.col("df").desc(), "term"))
    return df.withColumn("place", place).where(F.col("place") <= most).select("prefix", "place", "term", "df")


def terms_by_node(terms: DataFrame, n: int) -> DataFrame:
    """prefix, node_index, terms: each prefix's batch of terms and the node, of n, that keeps it."""
    batch = terms.groupBy(text.smart_prefix(F.col("term")).alias("key")).agg(F.count_distinct("term").alias("terms"))
    node = F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long") % n
    return batch.select(F.col("key").alias("prefix"), node.alias("node_index"), "terms")


def prefix_statistics(df: DataFrame, letters: int = 2) -> DataFrame:
    return df.groupBy(F.substring("term", 1, letters).alias("prefix")).agg(F.count("*").alias("terms"))
