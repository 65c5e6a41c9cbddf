"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import WORD, parts, tasks
from lexigrove.session import Scratch, cut

#: Words in a block; each source's words, in the order of its documents' hashes, are cut into such blocks. A source of few
#: words has shorter blocks, so that there are about LEAST_BLOCKS of them.
BLOCK_WORDS, LEAST_BLOCKS = 64, 256
#: Slots of an output shard, and slots that one task draws.
SHARD_SLOTS, TASK_SLOTS = 4096, 100_000
#: Rounds of the index permutation, and steps of its walk back into the range.
ROUNDS, WALK = 4, 32
#: Points of an interval of the draw: hashes are taken modulo it.
POINTS = 1 << 52


def source_targets(sized: DataFrame, weights=(3.0, 1.0, 2.0), ratio=1.5, cap=2.0) -> DataFrame:
    """(src, source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn. A target is min(weight * level,
    cap * source_size) with the one level at which the targets add up to ratio * all sizes: what repeated
    resharing of the excess ends in. The windows run over one row for each source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("w"), "src")
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (ratio * F.sum("source_size").over(everything) - before) / after
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("src", "source", "source_size", F.least(F.col("w") * F.col("level"), F.col("most")).alias("target"))


def permuted(i: Column, n: Column, *seed: Column) -> Column:
    """Place of index i (0 <= i < n) in a pseudorandom permutation of 0..n-1.

    A Feistel network on a grid of ceil(sqrt(n)) columns, which has fewer than sqrt(n) + 1 cells too many;
    who lands on one of those walks on until it is below n. No walk over fewer than WALK cells too many takes more steps;
    with more cells, one that did (a chance below 2**-150) would be an error, never a lost slot.
    """
    cols = F.ceil(F.sqrt(n)).cast("long")
    rows = F.ceil(n / cols).cast("long")

    def step(x: Column) -> Column:
        left, right = F.floor(x / rows), x % rows
        cell = F.struct(left.alias("l"), right.alias("r"))
        turns = F.sequence(F.lit(1), F.lit(ROUNDS))

        def turn(c, k):
            r = F.pmod(c["r"] + F.pmod(F.xxhash64(*seed, k, F.lit(0), c["l"]), rows), rows)
            return F.struct(F.pmod(c["l"] + F.pmod(F.xxhash64(*seed, k, F.lit(1), r), cols), cols).alias("l"), r.alias("r"))

        return F.aggregate(turns, cell, turn, lambda c: c["l"] * rows + c["r"])

    first = step(i)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(step(x)))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("the walk of a permuted index did not end")).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source, size: rid is a hash of the row's id and text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(_rid(), "doc_id", "source", size.alias("size"))


def _rid() -> Column:
    return F.xxhash64("doc_id", "text", "source").alias("rid")


def draw_slots(src: DataFrame, seed: Column, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, src, j): which of a source's slots each output shard has, from rows (src, slots).

    Each slot of each shard draws its source with probability slots / all slots, so that a shard's counts are
    multinomial. A shard's slots of a source follow those of the shards before it, j = 0, 1, ... As draws come near the
    sources' slots only on average, the residue is corrected: j beyond a source's slots go, and those that lack are
    dealt out to shards by their hashes. A slot's point meets the intervals of the sources in cells, of which there are
    as many as sources or shards: no slot meets more than a few sources, no cell holds more than a shard.
    """
    n = src.count()
    total = src.agg(F.sum("slots")).first()[0] or 0
    spark = src.sparkSession
    if not total:
        return spark.createDataFrame([], "shard long, src long, j long")
    shards = parts(total, shard_slots)
    # where sources lie in 0..total: sums of chunks of sources, then sums within a chunk
    chunk = F.floor(F.col("src") / 4096)
    base = src.groupBy(chunk.alias("chunk")).agg(F.sum("slots").alias("m"))
    base = base.select("chunk", (F.sum("m").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("base"))
    inside = Window.partitionBy("chunk").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    placed = src.where("slots > 0").withColumn("chunk", chunk).withColumn("hi", F.sum("slots").over(inside)).join(base, "chunk")
    placed = placed.select("src", (F.col("base") + F.col("hi") - F.col("slots")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi"))
    cell = -(-total // max(n, shards))
    placed = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    slots = spark.range(0, total, 1, tasks(parts(total, TASK_SLOTS))).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.floor(F.pmod(F.xxhash64(seed, "id"), F.lit(POINTS)) * (total / POINTS)).cast("long").alias("at"))
    drawn = slots.withColumn("cell", F.floor(F.col("at") / cell)).join(placed, "cell").where("lo <= at and at < hi")
    counts = cut(drawn.groupBy("src", "shard").agg(F.count("*").alias("k")))
    order = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("end", F.sum("k").over(order)).join(src.select("src", "slots"), "src")
    first = F.col("end") - F.col("k")
    got = counts.where(first < F.col("slots")).repartition(tasks(parts(total, TASK_SLOTS)), "src", "shard")
    got = got.select("shard", "src", F.explode(F.sequence(first, F.least("end", "slots") - 1)).alias("j"))
    had = counts.groupBy("src").agg(F.sum("k").alias("had"))
    lack = src.where("slots > 0").join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    lack = lack.select("src", F.explode(F.sequence("had", F.col("slots") - 1)).alias("j"))
    return got.unionByName(lack.select(F.pmod(F.xxhash64(seed, "src", "j"), F.lit(shards)).alias("shard"), "src", "j"))


def mix_blocks(sized: DataFrame, weights=(3.0, 1.0, 2.0), ratio=1.5, cap=2, block_words=BLOCK_WORDS, seed=7) -> tuple[DataFrame, DataFrame]:
    """The mix itself, (shard, src, j, block), and the sources, (src, source, source_size, target, words, n, slots), of
    rows (source, size): `words` in a block, n blocks. The j-th slot of a source with n blocks takes block perm(j mod n),
    where perm is a permutation of its own for each pass over the source. No block is taken more than `cap` times."""
    size, target = F.col("source_size"), F.col("target")
    words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(size / LEAST_BLOCKS))).cast("long")
    src = source_targets(sized, weights, ratio, cap).withColumn("words", words).withColumn("n", F.ceil(size / F.col("words")).cast("long"))
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0)
    src = src.withColumn("slots", F.least(F.col("n") * cap, (passes * F.col("n") + F.round((target - passes * size) / F.col("words")))).cast("long"))
    src = cut(src)
    seed = F.lit(seed)
    slot = draw_slots(src, seed).join(src.select("src", "n"), "src")
    block = permuted(F.col("j") % F.col("n"), F.col("n"), seed, F.col("src"), F.floor(F.col("j") / F.col("n")))
    return slot.select("shard", "src", "j", block.alias("block")), src


def mix_sources(docs: DataFrame, weights=(3.0, 1.0, 2.0), ratio=1.5, cap=2, block_words=BLOCK_WORDS, seed=7) -> DataFrame:
    """Words that a mix takes from each document: doc_id, size, source_size, target, taken, source.

    1. Each source's words are packed into blocks of block_words (the last one may be shorter).
    2. Each output shard draws its numbers of slots for all sources from a multinomial distribution; the residue
       against the sources' targets is corrected (draw_slots).
    3. Slots map to blocks through a permutation of its own for each source and pass (mix_blocks).
    4. Slots and blocks meet in a join on (source, block).

    Cases: null text has size 0, takes 0; a null source is a source; a null doc_id is kept; repeated rows
    count each by itself; an empty table gives no rows; other columns are not read. Equal inputs give equal
    results, whatever the partitioning.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(cut(_taken(cut(_sized(docs)), weights, ratio, cap, block_words, seed))).drop("rid")


def _taken(sized: DataFrame, weights=(3.0, 1.0, 2.0), ratio=1.5, cap=2, block_words=BLOCK_WORDS, seed=7) -> DataFrame:
    """rid, doc_id, size, source_size, target, taken, source."""
    mix, src = mix_blocks(sized, weights, ratio, cap, block_words, seed)
    used = mix.groupBy("src", "block").agg(F.count("*").alias("uses"))
    seed = F.lit(seed)
    # where each document's words lie in its source: sums of small chunks, then sums within a chunk
    chunks = parts(sized.count(), 256)
    d = sized.join(src.select("src", "source_size", "target", "words", F.col("source").alias("s_")), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    d = d.withColumn("chunk", F.pmod(F.xxhash64(seed, F.col("rid")), F.lit(chunks)))
    sums = d.groupBy("src", "chunk").agg(F.sum("size").alias("m"))
    sums = sums.select("src", "chunk", (F.sum("m").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("base"))
    inside = Window.partitionBy("src", "chunk").orderBy(F.xxhash64(seed, F.col("rid"), F.lit(1)), "rid", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("k", F.row_number().over(inside)).withColumn("end", F.sum("size").over(inside))
    d = d.join(sums, ["src", "chunk"]).withColumn("end", F.col("end") + F.col("base")).withColumn("start", F.col("end") - F.col("size"))
    first, last = F.floor(F.col("start") / F.col("words")), F.floor((F.col("end") - 1) / F.col("words"))
    piece = d.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    within = F.least(F.col("end"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
    return (
        piece.withColumn("within", within)
        .join(used.hint("merge"), ["src", "block"], "left")
        .groupBy("src", "chunk", "k", "rid", "doc_id", "size", "source_size", "target", "source")
        .agg(F.coalesce(F.sum(F.col("within") * F.col("uses")), F.lit(0)).cast("long").alias("taken"))
        .select("rid", "doc_id", "size", "source_size", "target", "taken", "source")
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as the mix takes them: each row as many times (0, 1 or 2) as its words are taken; all columns
    stay, under whatever names.

    A document whose taken words are a part of a pass is kept or left out for that pass by a hash of its
    id and text, with the probability of that part. Rows of one doc_id, text and source share one decision. Cases: rows
    without words are never taken; null ids and sources count as all others; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        took = _taken(cut(_sized(docs)), **params).groupBy("rid").agg(F.sum("taken").alias("t"), F.sum("size").alias("z"))
        u = F.pmod(F.xxhash64(F.lit("copies"), F.col("rid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        copies = F.floor(F.col("t") / F.col("z") + u).cast("int")
        took = scratch.keep(cut(took.where("t > 0").select("rid", copies.alias("copies")).where("copies > 0")))
    rows = docs.select(_rid(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = rows.join(took, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
