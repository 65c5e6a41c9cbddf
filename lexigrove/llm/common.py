"""Parts that several corpus operators share."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.session import batches, cut  # noqa: F401  operators take both from here

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lean(run):
    """`run`, a function of frames for mapInPandas, after which the worker gives memory back that it no longer uses:
    workers live on, and what one operator has freed would count against the next one."""

    def wrapped(frames):
        try:
            yield from run(frames)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Most partitions that an operator deals anything out to. Buckets may be more: a task takes its buckets one after the other.
MOST_PARTS = 100_000


def parts(n: int, each: int, least: int = 1) -> int:
    """Number of buckets so that n items make buckets of about `each`, however many items there are."""
    return max(least, -(-n // each))


def tasks(buckets: int) -> int:
    """Number of partitions for so many buckets."""
    return min(MOST_PARTS, buckets)


#: Keys that hold more than one HEAVY-th of all rows each are fewer than HEAVY, whatever the data.
HEAVY = 1000


def attach(df: DataFrame, key: str, values: DataFrame, rows: str) -> DataFrame:
    """df with the columns of values (key, ..., rows), one row for each key (a long), null where it has none; `rows` is how
    many rows of df have the key. df and values must be written tables.

    The values of keys with over one HEAVY-th of all rows, fewer than HEAVY of them, are broadcast, so that such a
    key's rows stay where they are; other rows meet their values in a join. Rows with a null key go.
    """
    much = values.where(F.col(rows) > df.count() / HEAVY)
    marked = df.where(F.col(key).isNotNull()).join(F.broadcast(much), key, "left")
    few = marked.where(F.col(rows).isNull()).select(*df.columns).join(values.join(much.select(key), key, "left_anti"), key, "left")
    return few.unionByName(marked.where(F.col(rows).isNotNull()))


def counted(df: DataFrame, key: str, n: str) -> DataFrame:
    """The rows of df, a written table, whose key isn't null, with n, how many rows have it. Rows are counted before
    they are shuffled, and join as attach() tells. An empty table gives no rows."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1))
    return attach(df, key, counts, n).withColumn(n, F.coalesce(n, F.lit(1).cast("long")))


def repeated(df: DataFrame, key: str, n: str) -> DataFrame:
    """The rows of counted() whose key is in several rows."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) > 1))
    return attach(df, key, counts, n).where(F.col(n).isNotNull())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component_id) per node that has an edge.

    component_id is the smallest id of the component. Alternating large-star and small-star rounds: each
    round only needs a minimum per node (combined before the shuffle) and a join, and every round is
    written to the shared folder. Self-loops and repeated edges are ignored; no edges give no rows.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
            .select(F.col("s.b").alias("a"), F.col("s.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )


def grouped(frames, cols: list[str]):
    """The rows of each group of cols as one frame, from frames that are sorted by cols."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[cols].to_numpy()
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            key = tuple(keys[a])
            if held and key != last:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
            held.append(frame.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held, ignore_index=True)


class Union:
    """Union-find over hashable items; the smaller item is the root."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
