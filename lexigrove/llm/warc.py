"""WARC records and a Merkle audit of their fixity."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import parts
from lexigrove.session import Scratch, cut

#: Children of a tree node, and records of a segment (one WARC file) about.
FANOUT, SEGMENT = 16, 512
HEAD = re.compile(rb"WARC/[\d.]+\r\n")


def record_text(url: Column, body: Column) -> Column:
    """A resource record: version, headers, an empty line, the body, two line ends."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def to_records(pages: DataFrame) -> DataFrame:
    """page_id and record (binary) of each page. Null url and html are empty; a null page_id is kept."""
    return pages.select("page_id", record_text(F.col("url"), F.col("html")).cast("binary").alias("record"))


def measured(record: Column) -> Column:
    """What an audit needs of a record: struct(length, digest)."""
    return F.struct(F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def laid_out(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Adds segment, seq and offset to rows (page_id, length, digest, ...): segments are ranges of hashed ids, in
    which records lie one after the other by page_id, those of one page_id (null first) by digest. Records are
    measured before; their bytes aren't shuffled."""
    n = parts(rows.count(), segment)
    rows = rows.withColumn("segment", F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.col("digest"))), F.lit(n)))
    by = Window.partitionBy("segment").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seq", F.row_number().over(by) - 1).withColumn("offset", F.sum("length").over(by) - F.col("length"))


def leaves(records: DataFrame) -> DataFrame:
    """One leaf for each record: hash over its offset, length and its bytes' hash."""
    range_ = F.concat_ws(":", "offset", "length", "digest")
    return records.select("segment", F.col("seq").cast("long").alias("node"), F.sha2(range_.cast("binary"), 256).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above: each hashes the hashes of up to `fanout` children in their order."""
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(kids, lambda c: F.concat_ws("=", c["node"], c["hash"])), "|")
    return level.groupBy("segment", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(text.cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up to one root for each segment, each written to the shared folder."""
    levels = [cut(leaves(records))]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        levels.append(cut(parents(levels[-1], fanout)))
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves at which two replicas differ: segment, node, hash_left, hash_right.

    Both are (segment, seq, offset, length, digest). Only the roots of all segments are compared; below,
    only children of nodes that differ. A record that one side lacks has a null hash there.
    """
    a, b = tree(left, fanout), tree(right, fanout)
    while len(a) < len(b):
        a.append(cut(parents(a[-1], fanout)))
    while len(b) < len(a):
        b.append(cut(parents(b[-1], fanout)))
    bad = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        x, y = (t.select("segment", "node", F.col("hash").alias(n)) for t, n in ((x, "hash_left"), (y, "hash_right")))
        if bad is not None:
            up = bad.select("segment", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["segment", "up"], "left_semi").drop("up") for t in (x, y))
        bad = cut(x.join(y, ["segment", "node"], "full").where(~F.col("hash_left").eqNullSafe(F.col("hash_right"))))
    return bad


def fixity(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """page_id, segment, seq, offset, length, digest, damaged for each record of the left replica, both as laid_out()
    gives them; damaged tells whether the audit found the right one to differ there.

    Empty replicas give no rows; repeated rows are records each; other columns are not read.
    """
    with Scratch(left.sparkSession) as scratch:
        left = cut(left.select("page_id", "segment", "seq", "offset", "length", "digest"))
        bad = audit(left, right, fanout).select("segment", F.col("node").alias("seq"), F.lit(True).alias("bad"))
        return scratch.keep(cut(left.join(bad, ["segment", "seq"], "left").select("page_id", "segment", "seq", "offset", "length", "digest", F.coalesce("bad", F.lit(False)).alias("damaged"))))


def unpacked(data: bytes) -> bytes:
    """The bytes of a file of gzip members, up to a damaged one, or those of any other file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse_warc(data: bytes):
    """(offset, headers, body) of each whole record in a WARC file's bytes, gzip members or plain. What comes after a record that is
    cut off, or doesn't tell its length, can't be found and is left out."""
    data, at = unpacked(data), 0
    while (m := HEAD.match(data, at)) is not None:
        end = data.find(b"\r\n\r\n", at)
        pairs = (line.split(b":", 1) for line in data[m.end() : max(end, 0)].split(b"\r\n") if b":" in line)
        head = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}
        size = head.get("content-length", "")
        if end < 0 or not size.isascii() or not size.isdigit() or end + 4 + int(size) > len(data):
            return
        yield at, head, data[end + 4 : end + 4 + int(size)]
        at = end + 8 + int(size)


def read_warc(spark, path: str) -> DataFrame:
    """url, html, offset, source of the records of WARC files; each file is read whole by one task."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(h.get("warc-target-uri"), b.decode("utf-8", "replace"), at, p) for p, data in zip(frame["path"], frame["content"], strict=True) for at, h, b in parse_warc(data)]
            yield pd.DataFrame(rows, columns=["url", "html", "offset", "source"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "url string, html string, offset long, source string")
