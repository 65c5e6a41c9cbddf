"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import attach, components, grouped, parts, tasks
from lexigrove.session import Scratch, cut

#: Least cosine of a link.
COSINE = 0.95
#: A vector is described by its NEAREST pivots in order; candidates have SHARED of them in common.
NEAREST, SHARED = 8, 2
#: There are about twice the square root of the number of vectors as pivots, the vectors farthest from one another of
#: WIDER times as many; they are the only thing that is broadcast, and so MOST_PIVOTS at most. Beyond that many
#: lists are long, and are told apart by a second pivot (LONG), of which there are MOST_PIVOTS for each.
MOST_PIVOTS, WIDER = 4096, 3
#: Members of an inverted list that one task compares with as many others, and blocks of a list from which on its
#: members are listed by their second shared pivot, too.
BLOCK, LONG = 1024, 4


def pivots_of(sample: np.ndarray, want: int) -> np.ndarray:
    """Up to `want` unit vectors of the sample, each the farthest from those before it; no vector comes twice.

    Directions count from the sample's mean, so that pivots of vectors that all point one way still differ."""
    if not len(sample):
        return sample
    away = sample - sample.mean(axis=0)
    near = np.full(len(sample), -np.inf)
    kept, k = [], 0
    while len(kept) < want and near[k] < 1 - 1e-12:
        kept.append(k)
        d = ((away - away[k]) ** 2).sum(axis=1)
        near = np.maximum(near, 1 - d / 2)
        k = int(near.argmin())
    return sample[kept]


def _unit(rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        m[k, : len(r)] = r
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m, norm


def compare(a: dict, b: dict, rank: int, second: int, same: bool) -> tuple:
    """Links between two blocks of an inverted list: that of the pivot with this rank or, with `second` (else -1), of
    its members that have that pivot, too.

    Candidates share SHARED pivots at least; a pair is taken in the list of its first common pivot, or first two, only.
    Returns each member's number of linked copies on the other side, and edges to the least id that it reaches.
    """
    width = max(x["near"].max() for x in (a, b)) + 1
    have = []
    for x in (a, b):
        m = np.zeros((len(x["ent"]), width), np.float32)
        m[np.arange(len(m))[:, None], x["near"]] = 1
        have.append(m)
    shared = have[0] @ have[1].T >= SHARED
    before = [*range(rank), *range(rank + 1, second)]
    if before:
        shared &= have[0][:, before] @ have[1][:, before].T == 0
    link = shared & (cosines(a, b) >= COSINE) & (a["dim"][:, None] == b["dim"][None, :])
    if same:
        np.fill_diagonal(link, False)
    left, right = (link * b["copies"]).sum(axis=1), (link.T * a["copies"]).sum(axis=1)
    low_a, low_b = a["ent"].copy(), b["ent"].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(low_a, np.where(link, low_b[None, :], top).min(axis=1))
        new_b = np.minimum(low_b, np.where(link, new_a[:, None], top).min(axis=0))
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    return left, right, low_a, low_b


def cosines(a: dict, b: dict) -> np.ndarray:
    return (a["v"] @ b["v"].T) / (a["norm"] * b["norm"].T)


def link_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding).

    Links are pairs of cosine COSINE or more, in double precision, that share SHARED of their NEAREST pivots.
    Equal vectors are compared once and counted as often as they occur. Pivots are ordered from rare to
    frequent; as in any prefix filter, a vector only needs its entries in the lists of its first
    NEAREST - SHARED + 1 pivots. A list of over LONG blocks is divided by its members' further pivots. A list is split into
    blocks, and each two blocks meet in a task of their own, which returns counts and a spanning forest, never pairs.
    Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths with one another; rows of one vec_id each keep their row, and count; rows without a
    vec_id link with nothing, have no component and are kept; an empty table gives no rows; other columns (labels too)
    are not read.
    """
    with Scratch(vectors.sparkSession) as scratch:
        return scratch.keep(cut(_linked(vectors)))


def _linked(vectors: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # minus zero is zero
    v = v.withColumn("v", F.when(good, plain)).withColumn("ent", F.when(good, F.xxhash64(plain)))
    names = cut(v.select("vec_id", "ent"))
    ents = cut(v.where("ent is not null").groupBy("ent").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("v").alias("v")))
    n, width = ents.agg(F.count("*"), F.max(F.size("v"))).first()
    want = min(MOST_PIVOTS, max(32, int(2 * n**0.5)))
    sample = [np.asarray(r[0]) for r in ents.orderBy(F.xxhash64("ent", F.lit(1)), "ent").limit(WIDER * want).select("v").collect()]
    m, norm = _unit(sample, width or 1)
    pivots = pivots_of(m / np.where(norm > 0, norm, 1), want)
    k = min(NEAREST, len(pivots))
    least = max(1, min(SHARED, k))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def nearest(frames):
        for frame in frames:
            m, norm = _unit(frame["v"].tolist(), width)
            order = np.argsort(-(m @ shared.value.T) / norm, axis=1, kind="stable")[:, :k]
            frame["near"] = order.astype(np.int32).tolist()
            yield frame[["ent", "copies", "v", "near"]]

    def answer(found):
        e = ents.select("ent", "copies", "low")
        if found is not None:
            roots = components(found.where("ent <> low").select(F.col("ent").alias("a"), F.col("low").alias("b")))
            total = found.groupBy("ent").agg(F.sum("links").alias("links"))
            e = e.join(total, "ent", "left").join(roots.withColumnRenamed("id", "ent").withColumnRenamed("component_id", "root"), "ent", "left")
        else:
            e = e.withColumn("links", F.lit(0)).withColumn("root", F.col("ent"))
        e = e.withColumn("root", F.coalesce("root", "ent")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        e = e.join(e.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("ent", "copies", "n_links", "component_id")
        out = attach(names, "ent", cut(e), "copies").unionByName(names.where("ent is null"), allowMissingColumns=True)
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

    if not len(pivots):
        return answer(None)
    described = cut(ents.select("ent", "copies", "v").mapInPandas(nearest, "ent long, copies long, v array<double>, near array<int>"))
    sizes = {r[0]: r[1] for r in described.select(F.explode("near").alias("p")).groupBy("p").count().collect()}
    rank = {p: r for r, p in enumerate(sorted(range(len(pivots)), key=lambda p: (sizes.get(p, 0), p)))}
    ranks = F.array(*[F.lit(rank[p]) for p in range(len(pivots))])
    described = cut(described.withColumn("near", F.array_sort(F.transform("near", lambda p: F.element_at(ranks, p + 1)))))
    # a list for each of the first pivots, and for the members of long lists one for each further pivot, too
    single = described.select("*", F.explode(F.slice("near", 1, k - least + 1)).alias("rank"), F.lit(-1).alias("second"))
    long_ = single.groupBy("rank").agg(F.count("*").alias("members")).where(F.col("members") > LONG * BLOCK).select("rank", F.lit(True).alias("long"))
    single = single.join(F.broadcast(long_), "rank", "left")  # a row for each pivot at most
    further = F.filter("near", lambda p: p > F.col("rank")) if least > 1 else F.array(F.lit(-1))
    lists = F.when(F.col("long"), further).otherwise(F.array(F.lit(-1)))
    entry = single.withColumn("second", F.explode(lists)).drop("long")
    # rows of the lists' sizes stay few: lists of one block need none
    blocks = entry.groupBy("rank", "second").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    entry = entry.join(cut(blocks), ["rank", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entry = entry.withColumn("own", F.pmod(F.xxhash64("ent", F.lit(2)), "blocks").cast("int"))
    entry = entry.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entry = entry.select("rank", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ent", "copies", "v", "near")

    def meet(frames):
        for rows in grouped(frames, ["rank", "second", "i", "j"]):
            r, s, i, j = (int(rows[c].iat[0]) for c in ("rank", "second", "i", "j"))

            def side(part):
                m, norm = _unit(part["v"].tolist(), width)
                near = np.stack(part["near"].tolist())
                return {"ent": part["ent"].to_numpy(np.int64), "copies": part["copies"].to_numpy(np.int64), "v": m, "norm": norm, "near": near, "dim": part["v"].map(len).to_numpy()}

            mine, others = rows[rows["own"] == i], rows[rows["own"] == j]
            if not len(mine) or not len(others):
                continue
            a = side(mine)
            b = a if i == j else side(others)
            left, right, low_a, low_b = compare(a, b, r, s, i == j)
            sides = [(a, left, low_a)] if i == j else [(a, left, low_a), (b, right, low_b)]
            for x, links, low in sides:
                some = links > 0
                yield pd.DataFrame({"ent": x["ent"][some], "links": links[some].astype(np.int64), "low": low[some]})

    dealt = entry.repartition(tasks(parts(n * (k - least + 1), 10_000, 24)), "rank", "second", "i", "j").sortWithinPartitions("rank", "second", "i", "j")
    return answer(cut(dealt.mapInPandas(meet, "ent long, links long, low long")))
