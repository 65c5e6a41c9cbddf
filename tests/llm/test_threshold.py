"""The pipeline's threshold of known words is that of all held-out documents."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigrove.llm import langid


def test_least_known_of_all_held_out_documents(spark):
    model = langid.Model(pa.array(["en", "de"]), pa.array(["known", "andere"]), np.array([1, 1]))
    # of ids in the order of their hashes, the first texts have few known words, the last ones many
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).where(langid.fold(F.col("doc_id")) == 0)
    ids = [r[0] for r in docs.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    assert len(ids) > 1100
    texts = {i: ("known " * k + "qqq " * (40 - k)) for i, k in zip(ids, np.linspace(1, 39, len(ids)).astype(int).tolist(), strict=True)}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    shares = [(min(40, t.count("known")) + langid.SLACK) / (40 + langid.SLACK) for t in texts.values()]
    assert abs(langid.least_known(df, model) - langid.LEAST_KNOWN * np.median(shares)) < 1e-4
    assert langid.least_known(df.where("doc_id < 0"), model) == 0.0
