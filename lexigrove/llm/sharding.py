"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime; bounds the broadcast table to half a megabyte.
SLOTS, SHARDS = 65_537, 256


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that owns it.

    Each shard has a preference order of its own, (offset + j * skip) mod slots, which meets every slot as
    the number of slots is prime. The shards take turns; each claims the next slot in its order that is free.
    Slot counts differ by one at most, and taking one shard away moves few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and differently")
    if len(shards) > slots or slots < 3 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, and not below the number of shards")
    start, skip = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(h[:8], "big") % slots)
        skip.append(int.from_bytes(h[8:16], "big") % (slots - 1) + 1)
    owner, at, free = [-1] * slots, list(start), slots
    while free:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + skip[k]) % slots
            owner[slot], at[k] = k, (slot + skip[k]) % slots
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot; null keys share slot 0."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(key), F.lit(slots))).cast("int")


def shard_documents(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, slot, shard (its index), shard_name for each row: no shuffle, one array access per row.

    The table goes to the executors as one constant of `slots` small integers, whatever the data.
    Cases: rows with a null key go to the owner of slot 0; equal keys go to one shard (choose a key that
    spreads a hot source, such as doc_id); text is not read; an empty table gives no rows.
    """
    names = shards or [f"shard-{k:05d}" for k in range(SHARDS)]
    spark = docs.sparkSession
    table = np.asarray(lookup_table(names, slots), dtype=np.int32)
    # one string of two base-36 digits a slot is a constant that needs no row-wise array building
    if len(names) > 36**3:
        raise ValueError("at most 46656 shards")
    text = "".join(np.base_repr(int(x), 36).rjust(3, "0") for x in table)
    wide = spark.createDataFrame([(text,)], "t string")
    owners = wide.select(F.posexplode(F.split("t", "(?<=\\G...)")).alias("slot", "o")).where("o <> ''")
    owners = owners.select("slot", F.conv("o", 36, 10).cast("int").alias("shard"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("shard") + 1)
    placed = docs.select("doc_id", slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(owners), "slot").select("doc_id", "slot", "shard", label.alias("shard_name"))
