"""Ranked keyword search over the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions import text
from lexigrove.operators.index import idf

#: Documents that a group of terms passes on, and results.
GROUP_TOP, TOP = 100, 20
COLUMNS = "group_ord int, prefix string, pos int, term string"


def term_rows(spark, query: str, stopwords=None, common=None) -> DataFrame:
    return spark.createDataFrame(text.query_groups(text.query_terms(query, stopwords), common), COLUMNS)


def group_scores(postings: DataFrame, n_docs: int, query: str, stopwords=None, common=None) -> DataFrame:
    """For each group of terms of one prefix its GROUP_TOP documents: matched_terms and score.

    Filters on prefix and term are literals, which reach the scan of the shards. A document's first
    matched term counts once, later ones 2.5 times; more than one term, and more than half of them, multiply.
    """
    terms = text.query_groups(text.query_terms(query, stopwords), common)
    spark = postings.sparkSession
    hit = postings.where(F.col("prefix").isin(sorted({t[1] for t in terms})) & F.col("term").isin(sorted({t[3] for t in terms})))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # one row for each of the query's terms
    of_group = {g: sum(1 for t in terms if t[0] == g) for g, *_ in terms}
    asked = spark.createDataFrame([(*t, of_group[t[0]]) for t in terms], f"{COLUMNS}, n_terms int")
    s = F.col("tf") * idf(F.lit(n_docs), F.col("df")) * F.col("taxonomy_boost") * F.col("binomial_boost") * F.col("position_boost")
    rows = hit.drop("prefix").join(F.broadcast(df), "term").join(F.broadcast(asked), "term").withColumn("s", s)
    meta = F.struct("taxonomy_level", "is_binomial", "kingdom", "family", "binomial")
    got = rows.groupBy("group_ord", "prefix", "n_terms", "doc_id").agg(
        F.count("*").alias("matched_terms"), F.sum("s").alias("all"), F.min_by("s", "pos").alias("first"), F.max_by(meta, "pos").alias("meta")
    )
    m, ratio = F.col("matched_terms"), F.col("matched_terms") / F.col("n_terms")
    score = (F.col("all") * 2.5 - F.col("first") * 1.5) * F.when(m > 1, F.pow(F.lit(2.0), m - 1) * F.when(ratio > 0.5, ratio + 1).otherwise(1.0)).otherwise(1.0)
    got = got.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("group_ord").orderBy(F.col("matched_terms").desc(), F.col("score").desc(), "doc_id")
    return got.withColumn("k", F.row_number().over(w)).where(F.col("k") <= GROUP_TOP).drop("k", "all", "first", "n_terms")


def total_results(postings: DataFrame, query: str, stopwords=None, common=None) -> DataFrame:
    """total_results: matches of all groups before they are cut; a document in two groups counts twice."""
    terms = text.query_groups(text.query_terms(query, stopwords), common)
    asked = postings.sparkSession.createDataFrame(terms, COLUMNS).select("term", "group_ord").distinct()
    hit = postings.where(F.col("term").isin(sorted({t[3] for t in terms}))).join(F.broadcast(asked), "term")
    return hit.select("group_ord", "doc_id").distinct().agg(F.count("*").alias("total_results"))


def merged(groups: DataFrame, query: str, stopwords=None, common=None) -> DataFrame:
    """Documents of all groups: scores add up, and a document is credited with all distinct terms of each
    group that it is in; match_ratio divides by the number of terms of the first group."""
    terms = text.query_groups(text.query_terms(query, stopwords), common)
    distinct = {g: len({t[3] for t in terms if t[0] == g}) for g, *_ in terms}
    first = sum(1 for t in terms if t[0] == 0)
    credit = F.coalesce(*[F.when(F.col("group_ord") == g, F.lit(n)) for g, n in distinct.items()], F.lit(0))
    got = groups.groupBy("doc_id").agg(F.sum(credit).alias("matched_terms"), F.sum("score").alias("score"), F.min_by("meta", "group_ord").alias("meta"))
    got = got.withColumn("match_ratio", F.col("matched_terms") / F.lit(float(first or 1)))
    bonus = F.when(F.col("match_ratio") >= 0.75, 2.0).when(F.col("match_ratio") >= 0.5, 1.5).otherwise(1.0)
    m = F.col("matched_terms")
    return got.withColumn("score", F.round(F.col("score") * F.when(m > 1, F.pow(F.lit(3.0), m - 1) * bonus).otherwise(1.0), 9))


def deduplicated(results: DataFrame) -> DataFrame:
    """Of each lower-cased binomial name (without one, each document) the best."""
    key = F.when(F.coalesce(F.col("meta.binomial"), F.lit("")) != "", F.lower("meta.binomial")).otherwise(F.col("doc_id").cast("string"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "doc_id")
    return results.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def search(postings: DataFrame, n_docs: int, query: str, limit: int | None = TOP, stopwords=None, common=None) -> DataFrame:
    """rank, doc_id, matched_terms, match_ratio, score, meta of a query's results. A query without terms has none."""
    if not text.query_terms(query, stopwords):
        query = ""
    groups = group_scores(postings, n_docs, query, stopwords, common) if query else None
    if groups is None:
        return postings.sparkSession.createDataFrame([], "rank int, doc_id long, matched_terms long, match_ratio double, score double")
    got = deduplicated(merged(groups, query, stopwords, common))
    order = [F.col("matched_terms").desc(), F.col("score").desc(), F.col("doc_id")]
    top = got.orderBy(*order).limit(limit) if limit else got
    # of at most GROUP_TOP rows for each of the query's groups
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "doc_id", "matched_terms", "match_ratio", "score", "meta")
