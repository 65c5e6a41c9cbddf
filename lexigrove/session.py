"""Session helpers that every part of the library shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Makes Spark delete an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexigrove")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset on a single machine, as in tests,
    a temporary folder that goes when the process ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        path = tempfile.mkdtemp(prefix="lexigrove-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class _Scopes(threading.local):
    """A thread's open scopes, the innermost last."""

    def __init__(self):
        self.open: list[Scratch] = []


_scopes = _Scopes()


class Scratch:
    """A scope at whose end the tables go that cut() and cut_by() wrote in it, but for those given to keep(), which
    belong to the scope around it from then on, or to the caller. What a kept table is made from must be kept, too,
    unless it is a table that was written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}

    def __enter__(self) -> Scratch:
        _scopes.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        at = df.__dict__.get("written_at")
        if at in self.made:
            name = self.made.pop(at)
            if len(_scopes.open) > 1:
                _scopes.open[-2].made[at] = name
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scope that nothing reads any more."""
        at = df.__dict__.get("written_at")
        if at in self.made:
            remove(self.spark, at, self.made.pop(at))

    def __exit__(self, *_) -> None:
        _scopes.open.remove(self)
        for at, name in self.made.items():
            remove(self.spark, at, name)


def remove(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Delete a written table's folder, and its entry in the catalog if it has one."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> bool:
    """Delete the table that cut() or cut_by() wrote for df, such as an operator's result that its caller is done with; False if df
    itself is no such table."""
    at = df.__dict__.get("written_at")
    if at is None:
        return False
    for scope in _scopes.open:
        scope.made.pop(at, None)
    remove(df.sparkSession, at, df.__dict__.get("written_as"))
    return True


def _written(df: DataFrame, path: str, name: str | None) -> DataFrame:
    df.__dict__["written_at"] = path
    df.__dict__["written_as"] = name
    if _scopes.open:
        _scopes.open[-1].made[path] = name
    return df


def _settings(spark: SparkSession, values: dict[str, str]) -> dict[str, str | None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return before


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later failures restart from here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = _settings(spark, {CLEAN: "true"})  # nothing reads this write's shuffles again
    try:
        df.write.parquet(path)
    finally:
        _settings(spark, before)
    return _written(spark.read.schema(df.schema).parquet(path), path, None)


#: Spark's own limit (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As cut(), but in buckets of key, so that a later join or grouping by key need not shuffle df again.
    There are as many buckets as shuffle partitions at least."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = min(MOST_BUCKETS, max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    before = _settings(spark, {CLEAN: "true"})
    try:
        dealt = df.repartition(buckets, key)  # as bucketBy deals out: one file for each bucket
        dealt.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    finally:
        _settings(spark, before)
    return _written(spark.table(name), path, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python, and Spark's own default for it.
BATCH_BYTES, UNSET = "4194304b", "67108864b"


def batches(spark) -> None:
    """Arrow batches of about BATCH_BYTES, so that a batch of long texts stays small, unless the session has a setting
    of its own. All operators use the same, so that it does not matter which was called last; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == UNSET:
        spark.conf.set(key, BATCH_BYTES)
