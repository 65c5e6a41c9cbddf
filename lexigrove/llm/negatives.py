"""Hard negatives of anchors, by product quantisation with stored residual norms and exact scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.llm.common import batches, lean
from lexigrove.session import Scratch, cut

#: Scores are products of floor(GRID * x).
GRID = 256
#: Positives of an anchor, negatives of a positive, and the window of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components beyond this count as this, so that sums of up to 2**12 products, times 100, are exact in 64 bits.
MOST = 1 << 21
#: Components that share a codebook, its centroids, vectors that it is fitted on at most (the only sample), rounds of the fit.
DIMS, CENTROIDS, FIT, ROUNDS = 2, 256, 4096, 8
#: Anchors that one pass over the vectors serves: what is collected and broadcast at a time, in numbers (16 MB).
ANCHOR_NUMBERS = 1 << 21
#: Rows times anchors, and components, that a task scores at a time.
PAIRS, COMPONENTS = 1 << 20, 1 << 21
FOUND = "anchor_id long, slot int, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, components on the grid."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * GRID))).cast("int"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad).select("vec_id", F.col("label").cast("long").alias("label"), q.alias("q"))


def matrix(rows, width: int) -> np.ndarray:
    """Rows of integers, the shorter ones followed by zeros."""
    m = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        m[k, : len(r)] = r
    return m


def codebooks(sample: np.ndarray) -> np.ndarray:
    """(groups, centroids, DIMS): for each group of components the centroids of the sample's values, by Lloyd's rounds."""
    n, width = sample.shape
    x = np.zeros((n, -(-width // DIMS) * DIMS))
    x[:, :width] = sample
    x = x.reshape(n, -1, DIMS)
    books = np.zeros((x.shape[1], CENTROIDS, DIMS))
    for g in range(x.shape[1]):
        own = np.unique(x[:, g], axis=0)
        book = own[np.random.default_rng(g).permutation(len(own))[:CENTROIDS]]
        for _ in range(ROUNDS):
            near = nearest(x[:, g], book)
            used, at, count = np.unique(near, return_inverse=True, return_counts=True)
            means = np.stack([np.bincount(at, x[:, g, d]) / count for d in range(DIMS)], axis=1)
            book[used] = means
        books[g, : len(book)], books[g, len(book) :] = book, book[-1]
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x @ (-2 * book.T) + (book**2).sum(axis=1)).argmin(axis=1)


def encode(m: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and group the nearest centroid and the norm of what it leaves (rounded up)."""
    groups = len(books)
    x = np.zeros((len(m), groups * DIMS))
    x[:, : m.shape[1]] = m
    codes, norms = np.zeros((len(m), groups), np.uint8), np.zeros((len(m), groups), np.float32)
    for g, book in enumerate(books):
        part = x[:, g * DIMS : (g + 1) * DIMS]
        near = nearest(part, book)
        codes[:, g] = near
        norms[:, g] = np.nextafter(np.sqrt(((part - book[near]) ** 2).sum(axis=1)).astype(np.float32), np.float32(np.inf))
    return codes, norms


def index(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, q, codes, norms) of each row of (vec_id, label, q): a code and a residual norm for each group."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(frames):
        for frame in frames:
            for part in _slices(frame, max(1, COMPONENTS // max(1, width))):
                codes, norms = encode(matrix(part["q"].tolist(), width), shared.value)
                yield part.assign(codes=[c.tobytes() for c in codes], norms=[x.tobytes() for x in norms])

    return vectors.mapInPandas(lean(run), "vec_id long, label long, q array<int>, codes binary, norms binary")


def _slices(frame: pd.DataFrame, n: int):
    return (frame.iloc[k : k + n] for k in range(0, len(frame), n))


class Bounds:
    """Lower and upper bounds of the scores of anchors with encoded rows.

    A score is the sum over groups of anchor part times centroid, looked up in a table, plus anchor part times
    residual, of which by Cauchy and Schwarz only the product of both norms is needed."""

    def __init__(self, anchors: np.ndarray, books: np.ndarray):
        groups = len(books)
        x = np.zeros((len(anchors), groups * DIMS))
        x[:, : anchors.shape[1]] = anchors
        x = x.reshape(len(anchors), groups, DIMS)
        self.table = np.matmul(books, x.transpose(1, 2, 0)).astype(np.float32)
        self.norms = np.linalg.norm(x, axis=2).astype(np.float32)
        # single precision: each of the sum's terms and partial sums is off by less than 2**-23 of all terms' sizes
        self.slack = (np.abs(self.table).max(axis=1).sum(axis=0).astype(np.float64) * (groups + 4) * 2.0**-22 + 1e-3).astype(np.float32)

    def of(self, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros((len(codes), self.table.shape[2]), np.float32)
        for g, table in enumerate(self.table):
            score += table[codes[:, g]]
        # widened for the bounds' own rounding
        off = (norms @ self.norms.T) * np.float32(1 + 1e-5 + 1e-6 * norms.shape[1]) + self.slack
        return score - off, score + off


def exact(q: np.ndarray, anchors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer scores of the pairs (rows[k], cols[k])."""
    small = max(np.abs(q).max(initial=0), 1) * max(np.abs(anchors).max(initial=0), 1) * q.shape[1] < 2**53
    if small and len(rows) * 4 > len(q) * len(anchors):
        return (q @ anchors.T)[rows, cols].astype(np.int64)
    out = np.zeros(len(rows), np.int64)
    step = max(1, COMPONENTS // max(1, q.shape[1]))
    kind = np.float64 if small else np.int64
    for k in range(0, len(rows), step):
        a, b = q[rows[k : k + step]].astype(kind), anchors[cols[k : k + step]].astype(kind)
        out[k : k + step] = np.einsum("ij,ij->i", a, b).astype(np.int64)
    return out


NONE = np.iinfo(np.int64).min


class Best:
    """The `most` highest exact scores of each slot (an anchor, or one of its windows), each vec_id once, ties to the smaller one."""

    def __init__(self, slots: int, most: int):
        self.score, self.id = np.full((slots, most), NONE), np.full((slots, most), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """What a score must reach to get in."""
        return self.score[:, -1]

    def add(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slots):
            return
        most, touched = self.score.shape[1], np.unique(slots)
        old = self.score[touched] > NONE
        s = np.concatenate([slots, np.repeat(touched, old.sum(axis=1))])
        i, v = np.concatenate([ids, self.id[touched][old]]), np.concatenate([scores, self.score[touched][old]])
        order = np.lexsort((i, -v, s))
        s, i, v = s[order], i[order], v[order]
        pair = np.lexsort((np.arange(len(s)), i, s))  # of each slot's rows with one id the best
        again = np.zeros(len(s), bool)
        again[pair[1:]] = (s[pair[1:]] == s[pair[:-1]]) & (i[pair[1:]] == i[pair[:-1]])
        s, i, v = s[~again], i[~again], v[~again]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        rank = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        s, i, v, rank = (x[rank < most] for x in (s, i, v, rank))
        self.score[touched], self.id[touched] = NONE, np.iinfo(np.int64).max
        self.score[s, rank], self.id[s, rank] = v, i

    def rows(self, anchors: np.ndarray) -> pd.DataFrame:
        per = max(1, len(self.score) // max(1, len(anchors)))
        slot, k = np.nonzero(self.score > NONE)
        return pd.DataFrame({"anchor_id": anchors[slot // per], "slot": (slot % per).astype(np.int32), "vec_id": self.id[slot, k], "score": self.score[slot, k]})


def scan(indexed: DataFrame, books: np.ndarray, anchors: dict, windows: np.ndarray | None) -> DataFrame:
    """The best rows of each task for each anchor (FOUND): of its label, or with `windows`, the scores of each
    anchor's positives (NONE: no positive), of other labels in the window of each of them, which is a slot then.

    Rows stay where they are. A task bounds the scores of its rows with all anchors, takes those that may get in, scores them
    exactly, and goes on with what it has as the bar. No task returns more rows than slots times their places.
    """
    shared = indexed.sparkSession.sparkContext.broadcast((books, anchors, windows))

    def run(frames):
        books, anchors, windows = shared.value
        width, n = anchors["q"].shape[1], len(anchors["q"])
        per = 1 if windows is None else windows.shape[1]
        best = Best(n * per, POSITIVES if windows is None else NEGATIVES)
        step = max(1, min(512, COMPONENTS // max(1, len(books) * CENTROIDS)))
        for frame in frames:
            for part in _slices(frame, max(1, min(PAIRS // step, COMPONENTS // max(1, width)))):
                q = matrix(part["q"].tolist(), width)
                ids, labels = part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
                codes = np.stack([np.frombuffer(c, np.uint8) for c in part["codes"]])
                norms = np.stack([np.frombuffer(c, np.float32) for c in part["norms"]])
                for k in range(0, n, step):
                    own = slice(k, k + step)
                    low, high = Bounds(anchors["q"][own], books).of(codes, norms)
                    same = labels[:, None] == anchors["label"][None, own]
                    other = ids[:, None] != anchors["vec_id"][None, own]
                    if windows is None:
                        rows, cols = np.nonzero(same & other & (high >= best.least()[own]))
                        best.add(cols + k, ids[rows], exact(q, anchors["q"][own], rows, cols))
                        continue
                    valid = windows[own] >= 0  # NONE is below, too
                    top = np.where(valid, windows[own], 0)
                    bars = np.where(valid, np.maximum(-(-LOW * top // 100), best.least().reshape(n, per)[own]), np.iinfo(np.int64).max)
                    most = np.where(valid, HIGH * top // 100, -1).max(axis=1)
                    rows, cols = np.nonzero(~same & other & (high >= bars.min(axis=1)) & (low <= most))
                    scores = exact(q, anchors["q"][own], rows, cols)
                    for j in range(per):
                        p = top[cols, j]
                        fits = valid[cols, j] & (LOW * p <= 100 * scores) & (100 * scores <= HIGH * p) & (scores >= best.least()[(cols + k) * per + j])
                        best.add((cols[fits] + k) * per + j, ids[rows[fits]], scores[fits])
        yield best.rows(anchors["vec_id"])

    return indexed.mapInPandas(lean(run), FOUND)


def _top(found: DataFrame, most: int) -> DataFrame:
    once = found.groupBy("anchor_id", "slot", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def anchor_blocks(asked: DataFrame, width: int):
    """The anchors (vec_id, label, q) in blocks of a bounded size, in the order of their ids: for each the first ids not yet taken."""
    each, last = max(1, ANCHOR_NUMBERS // max(1, width)), None
    while True:
        more = asked if last is None else asked.where(F.col("vec_id") > last)
        rows = more.orderBy("vec_id").limit(each).toArrow()
        ids = rows["vec_id"].to_numpy()
        if len(ids):
            yield {"vec_id": ids, "label": rows["label"].to_numpy(), "q": matrix(rows["q"].to_numpy(), width)}
        if len(ids) < each:
            return
        last = int(ids[-1])


def hard_negatives(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """For each anchor and each of its POSITIVES best rows of the same label the NEGATIVES best rows of other labels whose
    score is LOW to HIGH hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows (vec_id, label, embedding); a score is the integer inner product on the grid of GRID. Codebooks are fitted on FIT
    vectors at most; every row is encoded, with the norms of its residuals. Anchors are taken in blocks
    of ANCHOR_NUMBERS components; each block goes over the vectors twice, for positives, then for their windows, without a shuffle
    of vectors: bounds leave the candidates, which are scored exactly, so that results don't depend on the codebooks.
    Cases: rows with a null id, label or vector, or any null or non-finite component take no part; components beyond MOST on the grid count as
    MOST; a shorter vector counts as if zeros followed; an empty one has score 0 with all; of rows of one vec_id and
    label only the best score counts, and the least (label, vector) of one vec_id is the anchor; ties go to the smaller vec_id; positives of
    a negative score have no window; an empty table, or one without anchors, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    batches(spark)
    with Scratch(spark) as scratch:
        rows = cut(quantised(vectors))
        asked = cut(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("m")).select("vec_id", "m.label", "m.q"))
        width = rows.agg(F.max(F.size("q"))).first()[0] or 0
        sample = rows.select("vec_id", "label", "q").orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(max(1, min(FIT, ANCHOR_NUMBERS // max(1, width)))).select("q").collect()
        books = codebooks(matrix([r[0] for r in sample], width)) if sample else np.zeros((0, CENTROIDS, DIMS))
        indexed = cut(index(rows, books, width))
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        for block in anchor_blocks(asked, width):
            best = cut(_top(scan(indexed, books, block, None), POSITIVES))
            windows = np.full((len(block["vec_id"]), POSITIVES), NONE)
            told = best.select("anchor_id", "rank", "score").toArrow()  # POSITIVES rows for each anchor of the block
            windows[np.searchsorted(block["vec_id"], told["anchor_id"].to_numpy()), told["rank"].to_numpy() - 1] = told["score"].to_numpy()
            positives = best.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            got = _top(scan(indexed, books, block, windows), NEGATIVES).select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            got = got.join(positives, ["anchor_id", "slot"])
            out = out.unionByName(cut(got.select(*out.columns)))
        return scratch.keep(cut(out))
