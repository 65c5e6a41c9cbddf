"""Best-fit packing: documents' tokens into sequences of a fixed length."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import batches, lean, parts
from lexigrove.session import Scratch, cut

LENGTH, END_ID = 2048, 0
#: Words whose ids a worker keeps, in each of two halves: the newer, and the older, which goes when the newer is full.
CACHE = 100_000
#: A worker's tokenizers, kept from task to task.
WORKER: dict = {}
#: Pieces that one task packs.
SHARD_PIECES = 40_000
#: Sequences with at least this share of room are packed again, as long as that leaves GAIN less pieces to pack.
REOPEN, GAIN = 0.02, 0.1
#: Bits of a sequence's number within its shard.
BINS = 32
#: White space for str.split() but not for the tokenizer, which must see such texts whole.
ODD = re.compile("[\x1c-\x1f]")


class Recent:
    """A mapping of the last CACHE to 2 * CACHE keys that were asked for."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self[key] = got
        return got

    def __setitem__(self, key, value) -> None:
        if len(self.new) >= CACHE:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Tokens:
    """Ids of texts as little-endian bytes, the tokenizer's own.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of its
    white-space-separated words, each worked out once. Words of characters below SIMPLE are split and
    lower-cased here (they are in composed form, and lower-casing them depends on no neighbour) and only
    their parts go to the BPE model; other words, and texts that hold a string of an added token or a
    control character that counts as white space here but not there, go to the tokenizer whole.
    """

    SIMPLE = "\u0130"
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known, self.part = Recent(), Recent()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def encode(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def bpe(self, part: str) -> bytes:
        ids = [t.id for t in self.model.model.tokenize("".join([self.shown[b] for b in part.encode()]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, word: str) -> bytes:
        if word and max(word) >= self.SIMPLE:
            return self.encode(word)
        out = []
        for x in self.PARTS.findall(word.lower()):
            if (ids := self.part.get(x)) is None:
                ids = self.part[x] = self.bpe(x)
            out.append(ids)
        return b"".join(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [any(a in t for a in self.added) or ODD.search(t) is not None for t in texts]
        words = pc.utf8_split_whitespace(pa.array(["" if odd else t for t, odd in zip(texts, whole, strict=True)], pa.large_string()))
        coded = words.flatten().dictionary_encode()
        unique, known = [], self.known
        for w in coded.dictionary.to_pylist():
            if (ids := known.get(w)) is None:
                ids = known[w] = self.learn(w)
            unique.append(ids)
        size = np.fromiter(map(len, unique), np.int64, len(unique)) // 4
        pool = np.frombuffer(b"".join(unique), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        count = size[at]
        ends = np.concatenate([[0], np.cumsum(count)])
        where = np.repeat((np.cumsum(size) - size)[at] - ends[:-1], count) + np.arange(ends[-1])
        raw = pool[where].tobytes()
        cuts = (4 * ends[np.asarray(words.offsets) - words.offsets[0].as_py()]).tolist()
        return [self.encode(t) if odd else raw[cuts[k] : cuts[k + 1]] for k, (t, odd) in enumerate(zip(texts, whole, strict=True))]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most `length`: doc_id, piece, start, length, ids_crc32. Null text counts as empty."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(frames):
        tokens = WORKER.get(path) or WORKER.setdefault(path, Tokens(path))
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["d"], tokens([t or "" for t in frame["text"]]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    batches(docs.sparkSession)
    # ids may be null, and must not turn into floating-point numbers on their way
    kind = F.col("doc_id").cast("string").alias("d")
    return docs.select(kind, "text").mapInPandas(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin number of each item: the bin, open or new, after which the sum over residual gaps of the squared
    number of open bins with that gap is smallest; ties go to the tightest bin. Items come largest first."""
    count = np.zeros(length + 1, dtype=np.int64)
    count[0] = count[length] = 0
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    out, bins = np.empty(len(sizes), dtype=np.int64), 0
    order = np.argsort(-sizes, kind="stable")
    for i in order.tolist():
        s = int(sizes[i])
        # into a gap g in s..length-1: N(g) falls by one, N(g - s) grows by one unless the bin is full
        at = -1
        if s < length:
            left = 2 * count[0 : length - s] + 1
            left[0] = 0  # a full bin has no gap
            change = left - 2 * count[s:length] + 1
            change[count[s:length] == 0] = 1 << 40
            at = int(change.argmin())
        fresh = 2 * int(count[length - s]) + 1 if s < length else 0
        if at >= 0 and change[at] < (1 << 40) and int(change[at]) <= fresh:
            gap = s + at
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, bins
            bins += 1
        out[i] = b
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return out


def pack_pieces(cut_pieces: DataFrame, length: int = LENGTH, shard: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` column. cut_pieces must be a written table.

    Shards of about `shard` pieces are packed each in a task of its own. What lies in sequences with room
    left is then dealt out anew, to as many shards as that takes, and packed again, so that what is left open does not
    grow with the number of shards; a task never gets more than about `shard` pieces. It ends when all fit in one shard,
    or when a pass has closed few of the sequences that it opened, as with pieces of which no two fit together.
    """
    cols = cut_pieces.columns
    schema = f"{cut_pieces._jdf.schema().toDDL()}, sequence_id long, offset long, fill long"

    def packer(before: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            base = before + int(frame["shard_"].iloc[0])
            frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").drop(columns="shard_")
            sizes = frame["length"].to_numpy(dtype=np.int64)
            frame["b"] = sum_of_squares(sizes, length)
            frame = frame.sort_values("b", kind="stable")
            ends = frame.groupby("b")["length"].cumsum()
            frame["offset"] = ends - frame["length"]
            frame["fill"] = frame.groupby("b")["length"].transform("sum")
            frame["sequence_id"] = frame["b"] + (base << BINS)
            return frame[[*cols, "sequence_id", "offset", "fill"]]

        return run

    def dealt(df: DataFrame, n: int, seed: int) -> DataFrame:
        # copies of a row go to several shards, too
        return df.withColumn("shard_", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(seed)), F.lit(n)))

    done, rest, size, before, level = None, cut_pieces, cut_pieces.count(), 0, 0
    while True:
        n = parts(size, shard)
        got = cut(dealt(rest, n, level).groupBy("shard_").applyInPandas(packer(before), schema))
        left = got.where(F.col("fill") < (1 - REOPEN) * length).select(*cols)
        before, level, was = before + n, level + 1, size
        size = left.count() if n > 1 else 0
        if n == 1 or size == 0 or size > (1 - GAIN) * was and level > 1:
            return (got if done is None else done.union(got)).drop("fill")
        full = got.where(F.col("fill") >= (1 - REOPEN) * length)
        done, rest = full if done is None else done.union(full), left


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Sequences of at most `length` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then end_id; only longer ones are cut. Cases: null and empty text are the one
    id end_id; a null doc_id is kept; repeated rows are packed each; an empty table gives no rows; other
    columns are not read. sequence_id has no meaning but identity.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(cut(pack_pieces(cut(pieces(docs, tokenizer, length, end_id)), length)))
