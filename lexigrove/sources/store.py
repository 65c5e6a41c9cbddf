"""Documents by key: put, get, list, delete; queues and state as tables."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.session import cut


def bucket(key="key", n: int = 64):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.concat(F.lit("/wiki/doc_"), F.col("doc_id").cast("string")))


def put(rows: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Rows (key, ...) into folders by a hash of the key, from which get() reads one."""
    rows.withColumn("bucket", bucket("key", buckets)).write.mode(mode).partitionBy("bucket").parquet(path)


def get(spark, path: str, key: str, buckets: int = 64) -> DataFrame:
    rows = spark.read.parquet(path)
    which = spark.range(1).select(F.lit(key).alias("key")).select(bucket("key", buckets)).first()[0]
    return rows.where((F.col("bucket") == which) & (F.col("key") == key))


def put_sorted(rows: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """As put(), each bucket one sorted file: a read of some keys takes their buckets' files, and of these the row groups
    whose range of keys holds one. Choose as many buckets as make files of some 100 MB."""
    dealt = rows.withColumn("bucket", bucket("key", buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    dealt.write.mode(mode).partitionBy("bucket").parquet(path)


def bucket_of(key: str, buckets: int = 64) -> int:
    """As bucket(), without a job."""
    h = xxhash.xxh64_intdigest(key.encode(), seed=42)
    return (h - 2**64 if h >= 2**63 else h) % buckets


def get_many(spark, path: str, keys: list[str], schema=None, buckets: int = 64) -> DataFrame:
    """The rows of many keys in one read, of what put() or put_sorted() wrote: only the folders of the keys' buckets are listed and
    opened, and the filter on keys reaches the scan. Keys that aren't there give no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    some = [f"{path}/{name}" for name in sorted({f"bucket={bucket_of(k, buckets)}" for k in keys}) if name in there]
    read = spark.read.schema(schema) if schema is not None else spark.read
    if not some:
        return (read.parquet(path) if schema is None else spark.createDataFrame([], schema)).limit(0)
    return read.option("basePath", path).parquet(*some).where(F.col("key").isin(list(dict.fromkeys(keys)))).drop("bucket")


def get_frame(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose keys are in a table of any size."""
    return rows.join(keys.select("key").distinct(), "key", "left_semi")


KEY = "/wiki/doc_"


def lookup_documents(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keyed() documents of some keys; the filter is on the stored id, and reaches the scan."""
    ids = [int(k[len(KEY) :]) for k in keys if k.startswith(KEY) and k[len(KEY) :].isdecimal()]
    return keyed(docs.where(F.col("doc_id").isin(ids)))


def lookup(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(F.col("key").isin(keys))


def latest(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Of each key the row written last."""
    w = Window.partitionBy(*by).orderBy(F.col(at).desc())
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


#: Fixed value: files that a file system puts beside the keys.
SYSTEM = [".DS_Store"]


def without_system_files(rows: DataFrame, by: str = "key") -> DataFrame:
    """Rows whose key is not, and doesn't lead to, a system file."""
    return rows.where(~F.coalesce(F.element_at(F.split(by, "/"), -1).isin(SYSTEM), F.lit(False)))


class Memory:
    """Rows (key, ...) by key in the executors' memory: put, get and delete, without files until PUTS changes have come, when all is
    written to the shared folder once. What a lost executor held is made again from what it was made from."""

    PUTS = 16

    def __init__(self, rows: DataFrame):
        self.rows, self.changes = rows.limit(0), 0
        self.put(rows)

    def _hold(self, rows: DataFrame) -> None:
        self.changes += 1
        was, self.rows = self.rows, (cut(rows) if self.changes % self.PUTS == 0 else rows).persist()
        self.rows.count()
        was.unpersist()

    def put(self, rows: DataFrame) -> None:
        """Rows take the place of those with their keys; of several with one key any one stays."""
        self._hold(delete(self.rows, rows).unionByName(rows.dropDuplicates(["key"])))

    def get(self, key: str | None = None) -> DataFrame:
        """The row of a key; without one all keys."""
        return self.rows.select("key") if key is None else self.rows.where(F.col("key") == key)

    def delete(self, key: str) -> bool:
        """Take a key out; False if it isn't there."""
        if self.get(key).isEmpty():
            return False
        self._hold(self.rows.where(F.col("key") != key))
        return True


def delete(rows: DataFrame, keys: DataFrame, by: str = "key") -> DataFrame:
    return rows.join(keys.select(by).distinct(), by, "left_anti")


def batch_of_keys(rows: DataFrame, index: int, size: int, by: str = "key") -> DataFrame:
    """The index-th batch of sorted keys: a top-k of (index + 1) * size keys, never a sort of all in one task."""
    return rows.select(by).orderBy(by).offset(index * size).limit(size)


def restored(lines: DataFrame) -> DataFrame:
    """seq, url of the distinct lines that aren't blank in (text), in the order of their first occurrence."""
    urls = lines.select(F.posexplode(F.split("text", "\n")).alias("seq", "url")).where(F.length(F.trim("url")) > 0)
    return urls.groupBy("url").agg(F.min("seq").alias("seq")).select("seq", "url")


def save_queue(urls: DataFrame, path: str, by: str = "url") -> None:
    """A snapshot of a queue: a text file's lines, for restored_queue()."""
    urls.select(F.col(by).alias("value")).write.mode("overwrite").text(path)


def restored_queue(spark, path: str) -> DataFrame:
    """url of each distinct line that isn't blank; seeds are files of this form, too."""
    return spark.read.text(path).select(F.col("value").alias("url")).where(F.length(F.trim("url")) > 0).distinct()


def queue_with_documents(queue: DataFrame, docs: DataFrame, by: str = "key") -> DataFrame:
    """Each key in the queue, once, with its document or nulls."""
    return queue.select(by).distinct().join(docs, by, "left")


def append_snapshot(rows: DataFrame, path: str, at: int) -> None:
    """State as of `at`; later snapshots count (latest)."""
    rows.withColumn("at", F.lit(at)).write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A log as CSV files with a header."""
    rows.write.mode("append").option("header", True).csv(path)
