"""Order MinHash fingerprints, whose likeness follows the edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import batches, lean, parts

#: Code points in a k-mer, tuples in a fingerprint, k-mers in a tuple.
K, TUPLES, PER = 8, 64, 2
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
BITS = TUPLES.bit_length() - 1
FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
#: Documents of a neighbourhood, which one task reads in order.
NEAR = 2_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * ODD[1]
    x ^= x >> U(29)
    x = x * ODD[2]
    return x ^ (x >> U(32))


def sketch(text: str) -> np.ndarray:
    """16 bits for each tuple; 0 stands for a tuple without k-mers.

    Every k-mer with its occurrence number is hashed; the hash deals it to one of TUPLES groups (one
    permutation in place of one for each tuple). Of each group the PER smallest are taken, in the order in
    which they stand in the text, and hashed together. A group with fewer k-mers, as in short texts, takes the rest
    from all others by an order of its own, so that a tuple keeps order and texts of any lengths compare. A text
    shorter than K is one k-mer.
    """
    out = np.zeros(TUPLES, dtype=np.uint16)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(x):
        return out
    if len(x) < K:
        x = np.concatenate([x, np.full(K - len(x), 0x110000, dtype=np.uint64)])
    x = (x + U(1)) * ODD[0]
    step = 1
    while step < K:  # a window of 2, 4, 8 code points from two of half the length
        x = x[:-step] * (ODD[3] + U(2 * step)) + (x[step:] ^ (x[step:] >> U(23)))
        step *= 2
    h = _mix(x)
    bits = U(max(20, len(h).bit_length()))
    pos = np.arange(len(h), dtype=np.uint64)
    low = (U(1) << bits) - U(1)
    packed = np.sort((h & ~low) | pos)
    top = packed >> bits
    same = top[1:] == top[:-1]
    if same.any():
        index = np.arange(len(top))
        starts = np.where(np.concatenate([[True], ~same]), index, 0)
        times = (index - np.maximum.accumulate(starts)).astype(np.uint64)
        item = _mix(top * ODD[0] + times * ODD[3])
    else:
        item = _mix(top * ODD[0])
    pos = packed & low
    # of each group, enough of the smallest for PER of them
    share = 16 * TUPLES / len(item)
    if share < 1:
        few = (item << U(BITS)) < U(int(share * 2.0**63)) * U(2)
        if np.bincount((item[few] >> U(64 - BITS)).astype(np.int64), minlength=TUPLES).min() >= PER:
            item, pos = item[few], pos[few]
    order = np.argsort(item, kind="stable")
    item, pos = item[order], pos[order]
    first = np.searchsorted(item, np.arange(TUPLES, dtype=np.uint64) << U(64 - BITS))
    ends = np.append(first[1:], len(item))
    # a row for each group: its PER smallest, where it has so many, in the order of the text
    take = first[:, None] + np.arange(PER)
    has = take < ends[:, None]
    take = np.minimum(take, len(item) - 1)
    few = np.flatnonzero(ends - first < PER)
    if len(few):
        g = few.astype(np.uint64)[:, None]
        own = item[None, :] >> U(64 - BITS) == g
        key = np.where(own, item >> U(1), (_mix(item + (g + U(1)) * ODD[3]) >> U(1)) | U(1 << 63))
        n = min(PER, len(item))
        take[few, :n] = np.argsort(key, axis=1, kind="stable")[:, :n]
        has[few, :n] = True
    where = np.where(has, pos[take], ~U(0))
    value = np.take_along_axis(np.where(has, item[take], U(0)), np.argsort(where, axis=1, kind="stable"), axis=1)
    v = np.zeros(TUPLES, dtype=np.uint64)
    for k in range(PER):
        v = v * ODD[0] + (value[:, k] ^ (value[:, k] >> U(29)))
    some = has[:, 0]
    out[some] = np.maximum(_mix(v[some]) >> U(48), U(1))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples among those that either has; two empty texts are alike."""
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def shown(a: np.ndarray) -> str:
    return a.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_of(spark, splits: list[int]):
    """A column function: how many of the sorted splits are below an id. Only ids go to Python, not texts."""
    shared = spark.sparkContext.broadcast(np.asarray(splits, np.int64))
    return F.arrow_udf(lambda ids: pa.array(np.searchsorted(shared.value, ids.to_numpy(zero_copy_only=False)).astype(np.int32)), "int")


def fingerprint_documents(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    next document is the one with the next smaller doc_id, after the last the first; the edited text
    ends, in place of its last n_chars // 2 code points, with as many of the next one's first.

    Documents go once to ranges of doc_id, in which a task reads them in descending order and keeps one
    at a time; a range also gets a copy of the document that comes after its last.
    Cases: null text is empty; rows of one doc_id follow one another by text; a row without a doc_id is its own next, as
    is a single document; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    alone, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    n = min(65536, parts(docs.count(), near))
    splits = []
    if n > 1:
        q = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0]
        splits = sorted(set(q or []))
    dealt = docs.withColumn("pid", range_of(spark, splits)("doc_id") if splits else F.lit(0))
    heads = {r["pid"]: r["m"] for r in dealt.groupBy("pid").agg(F.max("doc_id").alias("m")).collect()}
    ranges = sorted(heads, reverse=True)
    after = [(heads[ranges[(k + 1) % len(ranges)]], pid) for k, pid in enumerate(ranges)]
    copies = spark.createDataFrame(after, "doc_id long, pid int")
    ends = docs.join(F.broadcast(copies), "doc_id").groupBy("pid").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rows = dealt.select("pid", F.lit(False).alias("end"), "doc_id", "text").union(ends.select("pid", F.lit(True), "doc_id", "text"))
    rows = rows.repartition(max(len(ranges), 1), "pid").sortWithinPartitions("pid", "end", F.col("doc_id").desc(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(doc, text, own, after, next_own):
        new = edited(text, after)
        other = sketch(new)
        return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(own), shown(other), likeness(own, other), likeness(own, next_own)

    def run(frames):
        last = None
        for frame in frames:
            out = []
            for pid, end, doc, text in zip(frame["pid"], frame["end"], frame["doc_id"], frame["text"], strict=True):
                own = sketch(text)
                if last and last[0] == pid:
                    out.append(row(*last[1:], text, own))
                last = None if end else (pid, doc, text, own)
            yield pd.DataFrame(out, columns=FIELDS)

    def single(frames):
        for frame in frames:
            out = [row(None, t, own, t, own) for t in frame["text"] for own in [sketch(t)]]
            yield pd.DataFrame(out, columns=FIELDS).astype({"doc_id": "Int64"})

    return rows.mapInPandas(lean(run), schema).union(alone.select("text").mapInPandas(lean(single), schema))
