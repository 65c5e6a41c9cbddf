"""Removal of repeated passages by a distributed merge sort of suffixes."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import attach, batches, grouped, lean, parts, release, repeated, tasks
from lexigrove.session import Scratch, cut, cut_by

#: Bytes of a passage.
LENGTH = 400
#: Suffixes that go on in more than HOT different ways are told apart by more bytes: their passages are divided among
#: SPLIT suffixes each, which have more bytes in common, and so on; a suffix of all bytes goes on in one way.
HOT, SPLIT = 200, 8
#: Suffixes to divide that are broadcast, 24 bytes each.
FEW = 200_000
#: Passages of a text that are hashed at a time, and bits that hold a place among them.
PART, PLACE = 1 << 18, np.uint64(20)
#: Characters of texts, and symbols of blocks, that are hashed together.
TOGETHER = 1 << 14
#: Suffixes that a task sorts into one run, documents for each bucket, suffixes that the bounds of the buckets are taken from.
RUN, BUCKET_DOCS, SAMPLE = 40_000, 1_500, 50_000
#: Documents of one task where texts are read.
TABLE_DOCS = 4_500
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
TABLE = np.random.Generator(np.random.PCG64(17)).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


class Kind(NamedTuple):
    """Passages of `length` symbols: the bytes of a text (unit 1), or hashes of its words (unit 8, bytes of one). Each
    passage has an anchor, the least of the strings of `gram` symbols that start in its first `window` ones, and
    holds at least `depth` symbols from there on. Places and lengths count symbols."""

    length: int
    gram: int
    window: int
    unit: int

    @property
    def depth(self) -> int:
        return self.length - self.window

    def width(self, level: int) -> int:
        """How many neighbouring passages share a suffix at a level."""
        w = self.window
        for _ in range(level):
            w = -(-w // SPLIT)
        return w

    def deep(self, level: int) -> int:
        """How many symbols of a suffix are in all its passages."""
        return self.length - self.width(level) + 1 if level else self.depth

    def parts(self, low: int, level: int) -> Iterator[tuple[int, int]]:
        """The ranges of the next level in that from `low` on: of how far a passage starts before its anchor."""
        high, w = self.top(low, level), self.width(level + 1)
        return ((a, min(high, a + w)) for a in range(low, high, w))

    def top(self, low: int, level: int) -> int:
        """The end of the range of a level that starts at `low`."""
        a, high = 0, self.window
        for k in range(1, level + 1):
            w = self.width(k)
            a += (low - a) // w * w
            high = min(high, a + w)
        return high

    def raw(self, text: str | None) -> bytes:
        return self.symbols([text])[0]

    def symbols(self, texts: list[str | None]) -> tuple[bytes, np.ndarray]:
        """The symbols of all texts, one after the other, and how many each has."""
        raws = [(t or "").encode() for t in texts]
        if self.unit == 1:
            return b"".join(raws), np.array([len(x) for x in raws], dtype=np.int64)
        ends = np.cumsum([len(x) + 1 for x in raws])
        words, starts = word_hashes(b"\n".join(raws))
        return words.tobytes(), np.diff(np.searchsorted(starts, ends), prepend=0)


def of_bytes(length: int) -> Kind:
    window = max(1, length // 2)
    return Kind(length, min(16, length - window + 1, max(1, length - window)), window, 1)


def of_words(length: int) -> Kind:
    window = max(1, length * 5 // 8)
    return Kind(length, min(4, max(1, length - window)), window, 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0..n, and the inverses, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(2 * n, 1 << 17)
        both = [np.cumprod(np.concatenate([[U(1)], np.full(size, U(b))]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64))]
        _powers[:] = both
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Text:
    """Hashes of all substrings of some symbols."""

    def __init__(self, raw: bytes, unit: int = 1):
        b = TABLE[np.frombuffer(raw, np.uint8)] if unit == 1 else np.frombuffer(raw, np.uint64)
        up, self.down = powers(len(b))
        self.n = len(b)
        self.sums = np.concatenate([[U(0)], np.cumsum(b * up[:-1], dtype=np.uint64)])

    def hashes(self, at: np.ndarray | slice, size: int | np.ndarray) -> np.ndarray:
        if isinstance(at, slice):
            a, b = at.start, at.stop
            return _mix((self.sums[a + size : b + size] - self.sums[a:b]) * self.down[a:b])
        return _mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def anchors(self, kind: Kind, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and last passage start that has each, of PART passages at most; with `sizes` the symbols are of
        several texts, which no passage crosses."""
        count, window = self.n - kind.length + 1, kind.window
        grams = count + window - 1
        value = (self.hashes(slice(0, grams), kind.gram) >> PLACE << PLACE) | np.arange(grams, dtype=np.uint64)
        pad = np.full(-(-grams // window) * window, ~U(0))
        pad[:grams] = value
        rows = pad.reshape(-1, window)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:count], ahead[window - 1 : window - 1 + count])
        a = (least & ((U(1) << PLACE) - U(1))).astype(np.int64)
        if sizes is None:
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            return a[first], first, np.append(first[1:], count) - 1
        whole = np.maximum(sizes - kind.length + 1, 0)
        starts = np.flatnonzero(np.repeat(np.tile([True, False], len(sizes)), np.stack([whole, sizes - whole], axis=1).ravel())[:count])
        a = a[starts]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        return a[first], starts[first], starts[np.append(first[1:], len(a))[: len(first)] - 1]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start and end."""
    b = np.frombuffer(raw, np.uint8)
    inside = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, of about PART bytes at a time, and where it starts."""
    start, end = word_bounds(raw)
    out = np.zeros(len(start), np.uint64)
    k = 0
    while k < len(start):
        lo = start[k]
        to = max(k + 1, int(np.searchsorted(end, lo + PART, "right")))
        out[k:to] = Text(raw[lo : end[to - 1]]).hashes(start[k:to] - lo, end[k:to] - start[k:to])
        k = to
    return out, start


def together(texts: list[str | None], kind: Kind) -> Iterator[slice]:
    """Neighbouring texts of TOGETHER characters in all (twice as many for words, of which there are fewer), or a longer one alone."""
    a, held, most = 0, 0, TOGETHER * (1 if kind.unit == 1 else 2)
    for b, text in enumerate(texts):
        n = len(text or "")
        if held + n > most and b > a:
            yield slice(a, b)
            a, held = b, 0
        held += n
    if a < len(texts):
        yield slice(a, len(texts))


def anchors_of(raw: bytes, sizes: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As anchors(), for the symbols of several texts, or of one of any length."""
    if len(sizes) == 1 or len(raw) // kind.unit < kind.length:
        return anchors(raw, kind)
    t = Text(raw, kind.unit)
    found = t.anchors(kind, sizes)
    return *found, t.hashes(found[0], kind.depth)


def anchors(raw: bytes, kind: Kind = of_bytes(LENGTH)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, the first and last passage start that has each, and the hash of the `depth` symbols from each. A text
    of any length is hashed PART passages at a time."""
    unit = kind.unit
    count = len(raw) // unit - kind.length + 1
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none.astype(np.uint64))]
    for at in range(0, count, PART):
        t = Text(raw[at * unit : (min(at + PART, count) + kind.length - 1) * unit], unit)
        anchor, first, last = t.anchors(kind)
        part = [anchor + at, first + at, last + at, t.hashes(anchor, kind.depth)]
        before = found[-1]
        if len(before[0]) and before[0][-1] == part[0][0]:  # an anchor that the part before has, too
            before[2][-1] = part[2][0]
            part = [x[1:] for x in part]
        if len(part[0]):
            found.append(tuple(part))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which h is known."""
    n = min(len(a), len(b))
    step = 32
    while h < n:
        x, y = a[h : h + step], b[h : h + step]
        if x == y:
            h += step
            step *= 2
            continue
        if step <= 8:
            while h < n and a[h] == b[h]:
                h += 1
            return h
        step = max(8, step // 4)
    return n


def encode_run(items: list[tuple]) -> list[tuple]:
    """Front coding of sorted (suffix, *rest): (prefix in common with the one before, what follows, *rest)."""
    out, last = [], b""
    for suffix, *rest in items:
        h = common(last, suffix, 0)
        out.append((h, suffix[h:], *rest))
        last = suffix
    return out


def merge_runs(runs: list[list[tuple]]):
    """(suffix, prefix in common with the one before, *rest) of all runs in order, by a loser tree.

    Each player in the tree carries how long a prefix it shares with the string that won last. Of two
    players the one that shares more comes first, unread; only when they share equally much are they
    compared, from there on. A run's next string knows by its front code how much it shares with the
    last one, which has just won.
    """
    k = max(1, len(runs))
    at = [0] * k
    text: list = [None] * k  # the current string of each run, None at its end
    share = [0] * k

    def advance(r: int) -> None:
        if at[r] < len(runs[r]) if runs else False:
            h, tail = runs[r][at[r]][:2]
            text[r] = (text[r] or b"")[:h] + tail
            share[r] = h
            at[r] += 1
        else:
            text[r], share[r] = None, -1

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; the loser's share then counts against the winner."""
        if text[b] is None:
            return True
        if text[a] is None:
            return False
        if share[a] != share[b]:
            return share[a] > share[b]
        x, y = text[a], text[b]
        h = common(x, y, share[a])
        a_first = x[h : h + 1] < y[h : h + 1] or (h == len(x) == len(y) and a < b) or (h == len(x) < len(y))
        if a_first:
            share[b] = h
        else:
            share[a] = h
        return a_first

    for r in range(k):
        advance(r)
        share[r] = 0 if text[r] is not None else -1
    # losers[1:] are the inner nodes of a tree whose leaves are k..2k-1
    losers, winner = [0] * k, [0] * (2 * k)
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        first = beats(a, b)
        winner[node], losers[node] = (a, b) if first else (b, a)
    top = winner[1] if k > 1 else 0
    while text[top] is not None:
        yield (text[top], share[top], *runs[top][at[top] - 1][2:])
        advance(top)
        node = (top + k) // 2
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node //= 2


def repeated_windows(groups: list[list[tuple[bytes, int]]], kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of blocks (bytes, place of the anchor in them) with `depth` symbols in common from their anchors on:
    (block, start, end) of the passages that another block of the group has too, neighbours joined; blocks are counted
    through all groups."""
    raws = [raw for g in groups for raw, _ in g]
    anchor = np.array([at for g in groups for _, at in g], dtype=np.int64)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    size = np.array([len(raw) // kind.unit for raw in raws], dtype=np.int64)
    count = size - kind.length + 1
    of = np.repeat(np.arange(len(raws)), count)
    at = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    hashes = Text(b"".join(raws), kind.unit).hashes((np.cumsum(size) - size)[of] + at, kind.length)
    key = _mix(hashes ^ _mix((anchor[of] - at).astype(np.uint64) ^ (group[of].astype(np.uint64) << U(32))))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    # a block has a passage at one offset from its anchor but once
    many = np.zeros(len(of) + 2, bool)
    many[order[1:][same] + 1] = True
    many[order[:-1][same] + 1] = True
    new = np.diff(of, prepend=-1) != 0
    first = np.flatnonzero(many[1:-1] & ~(many[:-2] & ~new))
    last = np.flatnonzero(many[1:-1] & ~(many[2:] & ~np.append(new[1:], True)))
    return of[first], at[first], at[last] + kind.length


def merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Ranges in order, those of a rid that touch or overlap joined."""
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    if len(rid):
        other = np.diff(rid, prepend=rid[0]) != 0
        far = np.cumsum(other) << 40  # ends of another rid are beyond all before
        reach = np.maximum.accumulate(end + far)
        first = np.flatnonzero(np.append(True, start[1:] + far[1:] > reach[:-1]))
        rid, start, end = rid[first], start[first], (reach - far)[np.append(first[1:], len(rid)) - 1]
    return pd.DataFrame({"rid": rid, "start": start, "end": end})


class Posts:
    """The symbols of some texts, one after the other, and for some anchors of each the first and last passage start that each
    has. Places count from the first text's start; `start` is where an anchor's own text starts."""

    def __init__(self, texts: list[str | None], places: list[np.ndarray], kind: Kind):
        self.kind = kind
        self.raw, sizes = kind.symbols(texts)
        self.start = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in places])
        self.places = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64) + self.start
        anchor, first, last, _ = anchors_of(self.raw, sizes, kind)
        at = np.searchsorted(anchor, self.places)
        self.first, self.last = first[at], last[at]

    def ranges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last of the passages that start low..high-1 symbols before each of the anchors; where there
        is none the first comes after the last."""
        return np.maximum(self.first, self.places - high + 1), np.minimum(self.last, self.places - low)

    def cut(self, lo: int, hi: int) -> bytes:
        """The symbols of the passages lo..hi."""
        return self.raw[lo * self.kind.unit : (hi + self.kind.length) * self.kind.unit]


class Buckets:
    """Where suffixes meet. Those of level 0 go to ranges of the symbols that all their passages share, between bounds that have
    about equally many suffixes between them; where there are fewer bounds than it takes, ranges are divided by a hash of those
    symbols. At higher levels, where very many suffixes begin alike for long, the hash of what their passages share says it all.
    Suffixes with so much in common, which are to be compared, always meet."""

    def __init__(self, bounds: list[bytes], buckets: int, kind: Kind):
        self.bounds, self.buckets, self.kind = bounds, buckets, kind
        self.spread = -(-buckets // (len(bounds) + 1))
        self.ranged = (len(bounds) + 1) * self.spread

    def of(self, suffix: bytes, level: int) -> int:
        deep = suffix[: self.kind.deep(level) * self.kind.unit]
        if level:
            return self.ranged + (level - 1) * self.buckets + zlib.crc32(deep) % self.buckets
        return bisect_right(self.bounds, deep) * self.spread + (zlib.crc32(deep) % self.spread if self.spread > 1 else 0)

    def level(self, bucket: int) -> int:
        return 0 if bucket < self.ranged else 1 + (bucket - self.ranged) // self.buckets


def suffix_rows(frames, buckets: Buckets):
    """Rows (bucket, kind, data, rid, start, end) of documents with repeated suffixes: kind 0 are sorted,
    front-coded runs of suffixes, 1 passages that are repeated within this task."""
    kind, unit = buckets.kind, buckets.kind.unit
    blocks: dict[tuple[bytes, int, int], list] = {}
    held = 0

    def flush():
        nonlocal held
        local, items = [], []
        for (raw, at, level), refs in blocks.items():
            if len(refs) > 1:
                local += [(rid, lo, lo + len(raw) // unit) for rid, lo in refs]
            items.append((raw[at * unit :], level, raw[: at * unit], *refs[0], len(refs)))
        items.sort(key=lambda x: x[0])
        dealt: dict[int, list] = {}
        for suffix, level, *rest in items:
            dealt.setdefault(buckets.of(suffix, level), []).append((suffix, *rest))
        out = [(b, 0, zlib.compress(pickle.dumps(encode_run(x), 5), 1), 0, 0, 0) for b, x in dealt.items()]
        settled = merged(*(np.array(x, dtype=np.int64) for x in zip(*local, strict=True))) if local else None
        out += [] if settled is None else [(-1 - rid % buckets.buckets, 1, b"", rid, a, b) for rid, a, b in zip(*(settled[c].tolist() for c in settled), strict=True)]
        blocks.clear()
        held = 0
        return pd.DataFrame(out, columns=["bucket", "kind", "data", "rid", "start", "end"])

    for frame in frames:
        texts = frame["text"].tolist()
        for part in together(texts, kind):
            some = frame.iloc[part]
            posts = Posts(texts[part], list(some["places"]), kind)
            if not len(posts.places):
                continue
            rids = np.repeat(some["rid"].to_numpy(np.int64), [len(x) for x in some["places"]])
            lows, levels = (np.concatenate(list(some[c])).astype(np.int64) for c in ("lows", "levels"))
            high = np.full(len(lows), kind.window)
            for k in np.flatnonzero(levels):
                high[k] = kind.top(int(lows[k]), int(levels[k]))
            los, his = posts.ranges(lows, high)
            for rid, at, lo, hi, level, own in zip(*(x.tolist() for x in (rids, posts.places - lows, los, his, levels, los - posts.start)), strict=True):
                blocks.setdefault((posts.cut(lo, hi), at - lo, level), []).append((rid, own))
            held += len(lows)
            if held >= RUN:
                yield flush()
    yield flush()


def resolve(frames, buckets: Buckets):
    """Rows (rid, start, end): ranges of repeated passages, from the rows of suffix_rows by bucket."""
    for rows in grouped(frames, ["bucket"]):
        if int(rows["kind"].iloc[0]):
            yield rows[["rid", "start", "end"]]
            continue
        kind = buckets.kind
        deep = kind.deep(buckets.level(int(rows["bucket"].iloc[0]))) * kind.unit
        out: list[tuple[np.ndarray, ...]] = []
        groups: list[list[tuple]] = []
        held = 0
        group: list[tuple] = []
        for item in merge_runs([pickle.loads(zlib.decompress(d)) for d in rows["data"]]):
            if item[1] < deep and group:
                if _meets(group):
                    groups.append(group)
                    held += sum(len(x[0]) + len(x[2]) for x in group)
                    if held > 2 * TOGETHER * kind.unit:
                        out.append(_settle(groups, kind))
                        groups, held = [], 0
                group = []
            group.append(item)
        if _meets(group):
            groups.append(group)
        if groups:
            out.append(_settle(groups, kind))
        if out:
            yield merged(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _meets(group: list[tuple]) -> bool:
    return len(group) > 1 and any(x[-1] == 1 for x in group)


def _settle(groups: list[list[tuple]], kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, end) of repeated passages in groups of what merge_runs() gives, of what isn't settled yet."""
    of, start, end = repeated_windows([[(left + suffix, len(left) // kind.unit) for suffix, _, left, *_ in g] for g in groups], kind)
    rid, lo, n = (np.array(x, dtype=np.int64) for x in zip(*(x[3:] for g in groups for x in g), strict=True))
    one = n[of] == 1
    of, start, end = of[one], start[one], end[one]
    return rid[of], lo[of] + start, lo[of] + end


def _salted(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _mix(h ^ salt.astype(np.uint64) * U(BASE)).view(np.int64)


def divided(posts: Posts, lows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor the hash of its block at a level, which is all bytes of its passages; and for the parts at the next level: which
    anchor, low, hash of what all its passages share, hash of its own block."""
    kind = posts.kind
    deep = kind.deep(level + 1)
    of, low, high = (np.array(x, dtype=np.int64) for x in zip(*((k, a, b) for k, x in enumerate(lows.tolist()) for a, b in kind.parts(x, level)), strict=True))
    top = np.array([kind.top(x, level) for x in lows.tolist()], dtype=np.int64)
    lo, hi = posts.ranges(lows, top)
    first, last = np.maximum(posts.first[of], posts.places[of] - high + 1), np.minimum(posts.last[of], posts.places[of] - low)
    some = first <= last
    of, low, first, last = of[some], low[some], first[some], last[some]
    at = posts.places[of] - low
    block, part, own = np.zeros(len(lows), np.int64), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    near = (hi + kind.length) // PART  # anchors whose blocks are hashed at a time
    for k in np.unique(near):
        a = near == k
        base = int(lo[a].min())
        text = Text(posts.raw[base * kind.unit : (int(hi[a].max()) + kind.length) * kind.unit], kind.unit)
        block[a] = _salted(text.hashes(lo[a] - base, hi[a] - lo[a] + kind.length), posts.places[a] - lo[a])
        b = a[of]
        part[b] = _salted(text.hashes(at[b] - base, deep), low[b])
        own[b] = _salted(text.hashes(first[b] - base, last[b] - first[b] + kind.length), posts.places[of][b] - first[b])
    return block, of, low, part, own


def _meet(rows: DataFrame, ways: DataFrame, size: int) -> DataFrame:
    """rows with the columns of ways, null where it lacks their suffix: by broadcast up to FEW suffixes, else by joins."""
    return rows.join(F.broadcast(ways), "suffix", "left") if size <= FEW else attach(rows, "suffix", ways, "rows")


def repeated_suffixes(docs: DataFrame, kind: Kind) -> DataFrame:
    """(rid, places, lows, levels) for rows (rid, text) that have repeated suffixes. Each level tells
    those apart that go on in more than HOT ways at the level before."""

    def post(frames):
        for frame in frames:
            texts, rids = frame["text"].tolist(), frame["rid"].to_numpy(np.int64)
            out = []
            for part in together(texts, kind):
                raw, sizes = kind.symbols(texts[part])
                place, _, _, suffix = anchors_of(raw, sizes, kind)
                of = np.searchsorted(np.cumsum(sizes), place, "right")
                out.append((rids[part][of], place - (np.cumsum(sizes) - sizes)[of], suffix.view(np.int64)))
            if out:
                rid, place, suffix = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"rid": rid, "place": place, "low": np.zeros(len(rid), np.int64), "suffix": suffix})

    def divide(level: int):
        """The parts at the next level of each entry of a level, with the hashes of the entry's block and of their own."""

        def run(frames):
            for frame in frames:
                texts = frame["text"].tolist()
                for k in together(texts, kind):
                    some = frame.iloc[k]
                    posts = Posts(texts[k], list(some["places"]), kind)
                    if not len(posts.places):
                        continue
                    rid = np.repeat(some["rid"].to_numpy(np.int64), [len(x) for x in some["places"]])
                    lows, suffix = (np.concatenate(list(some[c])).astype(np.int64) for c in ("lows", "suffixes"))
                    block, of, low, part, own = divided(posts, lows, level)
                    yield pd.DataFrame({"rid": rid[of], "place": (posts.places - posts.start)[of], "low": low, "part": part, "own": own, "suffix": suffix[of], "block": block[of]})

        return run

    def parts_of(entries: DataFrame, level: int) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("place", "low", "suffix")))
        hot = entries.groupBy("rid").agg(ordered.alias("e"))
        hot = hot.select("rid", F.col("e.place").alias("places"), F.col("e.low").alias("lows"), F.col("e.suffix").alias("suffixes"))
        return cut(docs.join(hot, "rid").mapInPandas(lean(divide(level)), "rid long, place int, low int, part long, own long, suffix long, block long"))

    def of_many_ways(blocks: DataFrame) -> DataFrame:
        ways = blocks.groupBy("suffix", "block").agg(F.count("*").alias("rows")).groupBy("suffix").agg(F.sum("rows").alias("rows"), F.count("*").alias("ways"))
        return cut(ways.where(F.col("ways") > HOT))

    posted = cut(docs.mapInPandas(lean(post), "rid long, place int, low int, suffix long"))
    level, settled = 0, None
    while True:
        found = cut(repeated(posted, "suffix", "n"))
        split = halves = None
        if kind.width(level) > 1:
            hot = found.where(F.col("n") > HOT)
            if not level:  # blocks aren't known yet; beyond, each part has its own with it
                halves = parts_of(hot, level)
            split = of_many_ways(hot if level else halves)
            size = split.count()
            split = split if size else None
        met = None if split is None else _meet(found, split, size)
        rest = (found if met is None else met.where(F.col("ways").isNull())).select("rid", F.struct("place", "low", F.lit(level).alias("level")).alias("e"))
        settled = rest if settled is None else settled.union(rest)
        if split is None:
            break
        if level:  # only entries that go on in many ways are divided
            many = parts_of(met.where(F.col("ways").isNotNull()).select("rid", "place", "low", "suffix"), level)
        else:
            many = _meet(halves, split, size).where(F.col("ways").isNotNull())
        posted = cut(many.select("rid", "place", "low", F.col("part").alias("suffix"), F.col("own").alias("block")))
        level += 1
    settled = settled.groupBy("rid").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return cut(settled.select("rid", F.col("e.place").alias("places"), F.col("e.low").alias("lows"), F.col("e.level").alias("levels")))


def buckets_for(docs: DataFrame, found: DataFrame, kind: Kind) -> Buckets:
    """Buckets for the suffixes of repeated_suffixes(), of BUCKET_DOCS documents each: a sample of documents with about SAMPLE
    suffixes sets the bounds, in which a head counts as often as it comes."""

    def heads(frames):
        for frame in frames:
            out = []
            for rid, text, places, levels in zip(frame["rid"].tolist(), frame["text"], frame["places"], frame["levels"], strict=True):
                raw = kind.raw(text)
                own = [int(a) for a, level in zip(places, levels, strict=True) if not level]
                out += [(rid ^ a, raw[a * kind.unit :][: kind.depth * kind.unit]) for a in own]
            yield pd.DataFrame(out, columns=["key", "head"])

    buckets = parts(docs.count(), BUCKET_DOCS, 12)
    rate = max(1, found.count() // (SAMPLE // 25))
    sample = docs.join(found.where(F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(rate)) == 0), "rid").mapInPandas(lean(heads), "key long, head binary")
    ordered = sorted(bytes(r[0]) for r in sample.orderBy(F.xxhash64("key"), "key", "head").limit(SAMPLE).select("head").collect())
    bounds = sorted({ordered[k * len(ordered) // buckets] for k in range(1, buckets)}) if ordered else []
    del ordered
    release()
    return Buckets(bounds, buckets, kind)


def repeated_ranges(docs: DataFrame, kind: Kind) -> DataFrame:
    """(rid, ranges) for rows (rid, text) that have repeated passages; ranges are sorted (start, end), in symbols."""
    with Scratch(docs.sparkSession) as scratch:
        found = repeated_suffixes(docs, kind)
        buckets = buckets_for(docs, found, kind)
        shared = docs.sparkSession.sparkContext.broadcast(buckets)
        rows = docs.join(found, "rid").mapInPandas(lean(lambda f: suffix_rows(f, shared.value)), "bucket long, kind int, data binary, rid long, start long, end long")
        dealt = rows.repartition(tasks(2 * buckets.buckets), "bucket").sortWithinPartitions("bucket")
        ranges = dealt.mapInPandas(lean(lambda f: resolve(f, shared.value)), "rid long, start long, end long")
        return scratch.keep(cut(ranges.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))))


def joined(starts, ends) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap joined."""
    got = merged(np.zeros(len(starts), np.int64), np.asarray(starts, np.int64), np.asarray(ends, np.int64))
    return list(zip(got["start"], got["end"], strict=True))


def without(text: str | None, starts, ends) -> tuple[bytes, int, int]:
    """A text's bytes without those of the sorted ranges; their number; how many runs they make, where ranges
    that touch or overlap are one."""
    raw, at, runs, kept = (text or "").encode(), 0, 0, []
    for a, b in zip(starts, ends, strict=True) if starts is not None else ():
        if not runs or a > at:
            kept.append(raw[at:a])
            runs += 1
        at = max(at, int(b))
    kept.append(raw[at:])
    left = b"".join(kept)
    return left, len(raw), runs


def _with_ranges(docs: DataFrame, words: int | None = None) -> DataFrame:
    """docs, which have a rid and a text, and the arrays starts and ends of their ranges, or null; with `words`
    also first and last, of passages of so many words, in words. Texts are shuffled once, to buckets of rid,
    and not again for the joins."""
    docs = cut_by(docs, "rid", parts(docs.count(), TABLE_DOCS, 12))
    out = docs
    for kind, a, b in [(of_bytes(LENGTH), "starts", "ends")] + ([(of_words(words), "first", "last")] if words else []):
        ranges = repeated_ranges(docs.select("rid", "text"), kind)
        out = out.join(ranges.select("rid", F.col("ranges.start").alias(a), F.col("ranges.end").alias(b)), "rid", "left")
    return out


def byte_ranges(text: str, starts, ends, first, last) -> list[tuple[int, int]]:
    """Sorted byte ranges: those of starts and ends, and those from word `first` up to the word `last`, with the white
    space before that."""
    out = [] if starts is None else [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]
    if first is not None:
        raw = text.encode()
        at = np.append(word_bounds(raw)[0], len(raw))
        out += [(int(at[a]), int(at[b])) for a, b in zip(first, last, strict=True)]
    return sorted(out)


def strip_passages(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for each row; with `words` also n_passage_words, how many of its words are
    in runs of so many that start elsewhere, too, however short and whatever white space is between them, and left (binary), the
    text without those runs and without what kept lacks.

    Every byte is removed that a LENGTH-byte string covers which starts elsewhere too, in the same document
    or another. A string's anchor follows from its bytes alone, so equal strings have equal anchors: suffixes
    from anchors of which half as many bytes occur again are sorted, in runs that are exchanged front-coded by ranges
    of their first bytes and merged; neighbours with so many bytes in common then tell which strings occur twice.
    Suffixes that go on in many ways are first divided into such with more bytes in common, until no group is large.
    What a task holds several times it settles itself and sends once.
    Cases: null text is empty; texts below LENGTH bytes are kept whole; of copies nothing is left; repeated
    rows are copies of one another; a null doc_id is kept; an empty table gives no rows.
    """
    batches(docs.sparkSession)

    def strip(frames):
        for frame in frames:
            out = []
            none = [None] * len(frame)
            for doc, text, starts, ends, first, last in zip(frame["d"], frame["text"], frame["starts"], frame["ends"], *((frame["first"], frame["last"]) if words else (none, none)), strict=True):
                kept, size, runs = without(text, starts, ends)
                n, left = 0, None  # left is kept itself
                if first is not None:
                    n = int(sum(b - a for a, b in joined(first, last)))
                    left = without(text, *zip(*byte_ranges(text, starts, ends, first, last), strict=True))[0]
                out.append((doc, kept, size, size - len(kept), runs, n, left))
            yield pd.DataFrame(out, columns=["d", "kept", "n_bytes", "n_removed", "n_spans", "n_passage_words", "left"])[names]

    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("string").alias("d"), "text")
    names = ["d", "kept", "n_bytes", "n_removed", "n_spans"] + (["n_passage_words", "left"] if words else [])
    schema = "d string, kept binary, n_bytes long, n_removed long, n_spans long" + (", n_passage_words long, left binary" if words else "")
    got = _with_ranges(rows, words).drop("rid").mapInPandas(lean(strip), schema)
    got = got.withColumn("left", F.coalesce("left", "kept")) if words else got
    return got.select(F.col("d").cast("long").alias("doc_id"), *names[1:])


def without_passages(docs: DataFrame, words: int | None = None) -> DataFrame:
    """The documents with their repeated passages cut out: LENGTH-byte strings (bytes that no longer form a character
    go, too) and, with `words`, also runs of so many words, however short, whatever white space is between them.
    Those of which nothing is left go, after a cut of words also those of which only white space is. n_chars, where
    there is one, counts what stays. All columns stay, under whatever names."""
    batches(docs.sparkSession)

    def cut_text(text: pd.Series, starts: pd.Series, ends: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for t, a, b, c, d in zip(text, starts, ends, first, last, strict=True):
            if a is None and c is None:
                out.append(None)
                continue
            ranges = byte_ranges(t, a, b, c, d)
            left = without(t, [x for x, _ in ranges], [x for _, x in ranges])[0]
            out.append("" if c is not None and not left.strip() else left.decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    # not to be worked out for the filter and again for the column
    shortened = F.pandas_udf(cut_text, "string").asNondeterministic()
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "text", F.struct(*others).alias("row"))
    got = _with_ranges(rows, words)
    if not words:
        none = F.lit(None).cast("array<long>")
        got = got.withColumns({"first": none, "last": none})
    hurt = F.when(F.col("starts").isNotNull() | F.col("first").isNotNull(), F.col("text"))  # other texts need not go to Python
    got = got.withColumn("stays", shortened(hurt, "starts", "ends", "first", "last")).where("stays is null or stays <> ''")
    cols = {c: F.col("row")[c] for c in others} | {"text": F.coalesce("stays", "text")}
    if "n_chars" in others:
        cols["n_chars"] = F.when(F.col("stays").isNotNull(), F.length("stays").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return got.select(*(cols[c].alias(c) for c in docs.columns))
