"""Placement of keys on nodes by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import hash_id

#: (ip, port) of the nodes in the catalogue's queries.
NODES = [("127.0.0.1", p) for p in range(7110, 7118)]


def node_id(ip: str, port: int) -> str:
    import hashlib

    return hashlib.sha256(f'{{"ip":"{ip}","port":{port}}}'.encode()).hexdigest()


def modulo(hex_: Column, n: int) -> Column:
    """A 256-bit hexadecimal number modulo n, digit by digit."""
    digit = lambda i: F.conv(F.substring(hex_, i, F.lit(1)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda a, i: (a * 16 + digit(i)) % n)


def naive(keys: DataFrame, ids: list[str]) -> DataFrame:
    """key, nid: the sorted node ids' (hash mod n)-th."""
    ids = sorted(ids)
    nid = F.element_at(F.array(*[F.lit(i) for i in ids]), modulo(hash_id(F.col("key")), len(ids)).cast("int") + 1)
    return keys.select("key", nid.alias("nid"))


def ring(keys: DataFrame, ids: list[str]) -> DataFrame:
    """key, nid: the next node id after the key's hash, after the last the first."""
    ids = F.array(*[F.lit(i) for i in sorted(ids)])
    h = hash_id(F.col("key"))
    after = F.filter(ids, lambda i: i > h)
    return keys.select("key", F.coalesce(F.array_min(after), F.array_min(ids)).alias("nid"))


def rendezvous(keys: DataFrame, ids: list[str]) -> DataFrame:
    """key, nid: the node of which the hash over both ids is largest."""
    h = hash_id(F.col("key"))
    scores = F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.struct(F.sha2(F.concat(h, i), 256).alias("s"), i.alias("nid")))
    return keys.select("key", F.array_max(scores)["nid"].alias("nid"))


def by_link(keys: DataFrame, n: int) -> DataFrame:
    """key, node_index: the first eight digits of the key's SHA-256 modulo n, in the group's own order."""
    return keys.select("key", (F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long") % n).alias("node_index"))


def scatter(keys: DataFrame, call, n: int) -> DataFrame:
    """key, node_index, result, error of call(node_index, key) on each key's node; a call that raises is a row with
    its error, and the others go on."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for key, node in zip(frame["key"], frame["node_index"], strict=True):
                try:
                    out.append((key, node, str(call(node, key)), None))
                except Exception as e:  # noqa: BLE001  whatever a node may raise
                    out.append((key, node, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "node_index", "result", "error"])

    return by_link(keys, n).mapInPandas(run, "key string, node_index long, result string, error string")


def gathered(answers: DataFrame) -> DataFrame:
    """node_index, answers, errors of each node."""
    return answers.groupBy("node_index").agg(F.count("result").alias("answers"), F.count("error").alias("errors"))
