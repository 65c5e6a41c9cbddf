"""Jaccard join of word shingles through a token-group matrix."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import Union, attach, batches, components, counted, grouped, lean, parts, repeated, tasks
from lexigrove.session import Scratch, cut, cut_by

#: Words in a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Prefixes are longer by one token in SHARE of a set, for as many in common.
SHARE = 10
#: Members of a group that one task opens, and queries that it puts to them.
MEMBERS, QUERIES = 256, 256
#: One document in SAMPLE tells which tokens are frequent; the order of tokens, which only decides how
#: many candidates there are, knows the HEAVY most frequent (16 MB at most to broadcast).
SAMPLE, HEAVY = 16, 1 << 20
#: Tokens of about this many documents go to one bucket of postings.
BUCKET_DOCS = 2_000
#: Characters of which words are held at a time, documents whose places one row of postings tells.
SLICE, BATCH = 2_000_000, 1 << 16
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pd.Series) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: A-Z lower-cased, words between ASCII white
    space; with fewer words the whole sequence is one shingle; without words the set is empty. Texts are taken
    SLICE characters at a time, or one longer text."""
    texts = texts.fillna("")
    at = np.cumsum(texts.str.len().to_numpy(np.int64)) // SLICE
    starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()]
    return [s for a, b in zip(starts, [*starts[1:], len(texts)], strict=True) for s in _shingle_sets(texts.iloc[a:b])]


def _shingle_sets(texts: pd.Series) -> list[np.ndarray]:
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = words.flatten()
    ends = np.asarray(words.offsets) - words.offsets[0].as_py()
    blank = pc.equal(coded, "").to_numpy(zero_copy_only=False)
    if blank.any():  # at the ends of a text
        ends = np.concatenate([[0], np.cumsum(~blank)])[ends]
        coded = coded.filter(pa.array(~blank))
    coded = coded.dictionary_encode()
    own = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False).astype(np.uint64)
    h = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)
    run = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        run = mix(run ^ h[k : k + len(run)], k)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(run[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            one = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                one = mix(one ^ h[k : k + 1], k - a + WORDS)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def with_sets(frames):
    """Frames with sets in place of texts, so that a group holds no texts."""
    for frame in frames:
        yield frame.drop(columns="text").assign(sets=shingle_sets(frame["text"]))


def entity(s: np.ndarray) -> int:
    """A 64-bit id of a set."""
    if not len(s):
        return 0
    total = np.add.reduce(mix(s, 11), keepdims=True) + np.array([len(s)], np.uint64) * U(0xD6E8FEB86659FD93)
    return int((mix(total, 12) ^ np.bitwise_xor.reduce(mix(s, 13), keepdims=True)).view(np.int64)[0])


def group_key(s: np.ndarray, seed: int) -> int:
    """The smallest token under a permutation: sets as alike as J share it with probability J."""
    return int(mix(s, seed).min(keepdims=True).view(np.int64)[0])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def sizes_fit(a: int, b: int) -> bool:
    return 100 * min(a, b) >= PERCENT * max(a, b)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not sizes_fit(len(a), len(b)) or not len(a):
        return False
    both = overlap(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def need(n: int) -> int:
    """Least overlap of a set of n tokens with any set that it links with."""
    return -(-PERCENT * n // 100)


def common_tokens(n: int) -> int:
    """How many tokens at least the prefixes of a set of n tokens and of any that it links with share."""
    return max(1, need(n) // SHARE)


def prefix(s: np.ndarray, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rarest tokens of a set, so many that linked sets have common_tokens() of them in common: each
    token more than those that the other set may lack is one that it must have."""
    k = len(s) - need(len(s)) + max(1, len(s) // SHARE)
    if len(heavy):
        at = np.searchsorted(heavy, s)
        at[at == len(heavy)] = 0
        w = np.where(heavy[at] == s, weight[at], 0)
        if w.any():
            return s[np.lexsort((s, w))[:k]]
    return s[:k]


def _signed(x) -> np.ndarray:
    return np.asarray(x).astype(np.uint64).view(np.int64)


def frequent_tokens(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of a sample that grows with the input, and how often they are in it."""

    def tokens(frames):
        for frame in frames:
            sets = {entity(s): s for s in shingle_sets(frame["text"]) if len(s)}
            t = np.concatenate([np.zeros(0, np.uint64), *sets.values()])
            bucket = (t % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, bucket = t[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(t) else np.zeros(0, int)
            rows = [(int(bucket[a]), t[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(t)], strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "tokens"])

    def count(frames):
        for rows in grouped(frames, ["bucket"]):
            t, n = np.unique(np.frombuffer(b"".join(rows["tokens"]), np.uint64), return_counts=True)
            yield pd.DataFrame({"token": _signed(t[n >= 3]), "n": n[n >= 3]})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    packed = sample.select("text").mapInPandas(lean(tokens), "bucket long, tokens binary")
    top = packed.repartition(tasks(buckets), "bucket").sortWithinPartitions("bucket").mapInPandas(lean(count), "token long, n long")
    got = top.orderBy(F.col("n").desc(), "token").limit(HEAVY).toPandas()
    token = got["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], got["n"].to_numpy(np.int64)[order]


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between linked documents of (doc_id, ent, key) with one key, MEMBERS of which meet at a
    time. They need not be complete: each further round over the chunks' first documents would deal out all
    texts again, and what is left is found by candidates()."""
    chunks = cut(repeated(reps, "key", "size").withColumn("chunk", F.pmod(F.xxhash64("ent"), F.ceil(F.col("size") / MEMBERS))))

    def link(frames):
        for rows in grouped(with_sets(frames), ["key", "chunk"]):
            found, firsts = Union(), []
            for ent, s in zip(rows["ent"].tolist(), rows["sets"], strict=True):
                if entity(s) != ent:
                    continue  # another row of the same doc_id
                new = True
                for other, o in firsts:
                    if found.find(other) != found.find(ent) and linked(s, o):
                        found.join(other, ent)
                        new = False
                if new:
                    firsts.append((ent, s))
            roots = [(e, found.find(e)) for e in rows["ent"].tolist()]
            yield pd.DataFrame([r for r in roots if r[0] != r[1]], columns=["a", "b"], dtype=np.int64)

    work = docs.join(chunks, "doc_id").select("key", "chunk", "ent", "text")
    dealt = work.repartition(tasks(parts(chunks.count(), BUCKET_DOCS, 24)), "key", "chunk").sortWithinPartitions("key", "chunk", "ent")
    return cut(dealt.mapInPandas(lean(link), "a long, b long"))


def near_groups(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """reps with comp, the smallest id of the linked documents found by either key, and grp and members: its group of
    similar documents, those of a comp or else of a key, in chunks of MEMBERS, and the size of that chunk's whole."""
    comps, edges = reps.withColumn("comp", F.col("ent")), None
    for key in ("key", "key2"):
        roots = cut(comps.where("ent = comp").select("doc_id", "ent", F.col(key).alias("key")))
        more = near_links(docs, roots)
        edges = more if edges is None else edges.union(more)
        found = components(edges).select(F.col("id").alias("ent"), F.col("component_id").alias("comp"))
        comps = cut(reps.join(found, "ent", "left").withColumn("comp", F.coalesce("comp", "ent")))
    comps = cut(counted(comps, "comp", "alike").withColumn("whole", F.when(F.col("alike") > 1, F.xxhash64(F.lit(1), "comp")).otherwise(F.xxhash64(F.lit(2), "key"))))
    chunk = F.pmod(F.xxhash64("ent"), F.ceil(F.col("members") / MEMBERS))
    grp = F.when(F.col("members") > 1, F.xxhash64("whole", chunk)).otherwise(F.col("ent"))
    return counted(comps, "whole", "members").withColumn("grp", grp).select("doc_id", "ent", "n", "comp", "grp", "members")


def candidates(docs: DataFrame, reps: DataFrame, heavy: np.ndarray, weight: np.ndarray, buckets: int) -> DataFrame:
    """(ent, grp): documents and groups that have enough tokens in common among their rarest ones."""
    shared = docs.sparkSession.sparkContext.broadcast((heavy, weight))
    ids = ["ent", "comp", "grp", "members", "n"]

    def postings(frames):
        heavy, weight = shared.value
        for frame in (f.iloc[k : k + BATCH] for f in frames for k in range(0, len(f), BATCH)):
            toks, rows = [], []
            for k, s in enumerate(shingle_sets(frame["text"])):
                if len(s) and entity(s) == frame["ent"].iat[k]:
                    toks.append(prefix(s, heavy, weight))
                    rows.append(k)
            t = np.concatenate([np.zeros(0, np.uint64), *toks])
            who = np.repeat(np.asarray(rows, dtype=np.int64), [len(x) for x in toks])
            bucket = (t % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, t, who = bucket[order], (t[order] // U(buckets) % U(1 << 32)).astype(np.uint32), who[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(t) else np.zeros(0, int)
            table = frame[ids].to_numpy(np.int64)
            table[:, 1:3] ^= table[:, :1]  # zero for a document alone, which costs next to nothing to shuffle
            out = []
            for a, b in zip(at, [*at[1:], len(t)], strict=True):
                own, inverse = np.unique(who[a:b], return_inverse=True)  # a document's ids once for each bucket
                out.append((int(bucket[a]), t[a:b].tobytes(), inverse.astype(np.uint16).tobytes(), table[own].tobytes("F")))
            yield pd.DataFrame(out, columns=["bucket", "tokens", "who", "ids"])

    def pairs(frames):
        for rows in grouped(frames, ["bucket"]):
            tables = [np.frombuffer(x, np.int64).reshape(len(ids), -1).T for x in rows["ids"]]
            base = np.cumsum([0, *map(len, tables)])
            who = np.concatenate([np.frombuffer(w, np.uint16).astype(np.int64) + b for w, b in zip(rows["who"], base[:-1], strict=True)])
            table = np.concatenate(tables)
            table[:, 1:3] ^= table[:, :1]
            t = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["tokens"]])
            order = np.argsort(t, kind="stable")
            t, who = t[order], who[order]
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            comp = table[who, 1]
            several = np.minimum.reduceat(comp, at) != np.maximum.reduceat(comp, at)
            ends = np.append(at[1:], len(t))
            found: Counter = Counter()
            for a, b in zip(at[several].tolist(), ends[several].tolist(), strict=True):
                _meet(table[np.unique(who[a:b])], found)
            yield pd.DataFrame([(e, g, n, c) for (e, g, n), c in found.items()], columns=["ent", "grp", "n", "tokens"], dtype=np.int64)

    rows = docs.join(reps.select("doc_id", *ids), "doc_id").select(*ids, "text")
    packed = rows.mapInPandas(lean(postings), "bucket long, tokens binary, who binary, ids binary")
    dealt = packed.repartition(tasks(buckets), "bucket").sortWithinPartitions("bucket")
    met = dealt.mapInPandas(lean(pairs), "ent long, grp long, n long, tokens long").groupBy("ent", "grp", "n").agg(F.sum("tokens").alias("tokens"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / SHARE))
    return met.where(F.col("tokens") >= least).select("ent", "grp")


def _meet(rows: np.ndarray, found: Counter) -> None:
    """Count one token: for each two groups that have it, the documents of the smaller group meet the other
    group, and those of one group meet that; only where some member is not known to be linked with the
    document and sizes are near enough for a link."""
    groups: dict[int, list] = {}
    for ent, comp, grp, members, n in rows.tolist():
        groups.setdefault(grp, []).append((ent, comp, n, members))
    about = [(m[0][3], g, m, {x[1] for x in m}, min(x[2] for x in m), max(x[2] for x in m)) for g, m in groups.items()]
    about.sort(key=lambda x: (x[0], x[1]))
    for i, (_, _, mine, _, small, large) in enumerate(about):
        for _, g, _, comps, low, high in about[i:]:
            if 100 * high < PERCENT * small or PERCENT * low > 100 * large:
                continue
            for ent, comp, n, _ in mine:
                if (len(comps) > 1 or comp not in comps) and 100 * high >= PERCENT * n and PERCENT * low <= 100 * n:
                    found[ent, g, n] += 1


def open_groups(docs: DataFrame, reps: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) between documents and members of groups that they link with.

    A group has MEMBERS about, and the union of its members' tokens. A document of n tokens of which fewer than
    need(n) are in the union links with no member, and the group stays shut.
    """
    opened = cut(found.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("salts")))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    members = reps.join(opened, "grp").select("grp", salts, F.lit(0).alias("asks"), "ent", "comp", "doc_id")
    asks = found.join(opened, "grp").join(reps.select("ent", "comp", "doc_id"), "ent")
    asks = asks.select("grp", F.pmod(F.xxhash64("ent"), "salts").alias("salt"), F.lit(1).alias("asks"), "ent", "comp", "doc_id")
    work = cut(members.union(asks))
    n = work.count()

    def link(frames):
        for rows in grouped(with_sets(frames), ["grp", "salt"]):
            all_ = zip(rows["asks"].tolist(), rows["ent"].tolist(), rows["comp"].tolist(), rows["sets"], strict=True)
            good = [(q, e, c, s) for q, e, c, s in all_ if entity(s) == e]
            mine = [(e, c, s) for q, e, c, s in good if not q]
            union = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for *_, s in mine)]))
            known, out = Union(), []
            for q, e, c, s in good:
                if q and len(union) and overlap(s, union) >= need(len(s)):
                    for m, d, o in mine:
                        if known.find(c) != known.find(d) and linked(s, o):
                            known.join(c, d)
                            out.append((e, m))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    rows = docs.join(work, "doc_id").select("grp", "salt", "asks", "ent", "comp", "text")
    dealt = rows.repartition(tasks(parts(n, BUCKET_DOCS, 24)), "grp", "salt").sortWithinPartitions("grp", "salt", "asks", "ent")
    return cut(dealt.mapInPandas(lean(link), "a long, b long"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: components of all links of similarity 0.8 or more.

    Documents of equal shingle sets are one entity. Entities are partitioned into groups of similar ones;
    a document opens a group only if enough of its rarest tokens are among the rarest of the members, and the
    group's token union covers enough of it. Every pair that links is found by these bounds, for any order of
    tokens. Sets are compared as 64-bit hashes of their shingles.
    Cases: null text and text without words have no shingles and a component of their own; rows of one
    doc_id each keep their row; rows without a doc_id link with nothing and have a null component; an empty table gives
    no rows; other columns are not read.
    """
    batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        sets, buckets = _described(docs)
        # texts are shuffled by doc_id once, not for each join
        texts = cut_by(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), "doc_id", buckets)
        return scratch.keep(cut(_components(sets, texts, buckets)))


def _described(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n, ent, key, key2 of each row, written, and the number of buckets for so many rows."""

    def describe(frames):
        for frame in frames:
            sets = shingle_sets(frame["text"])
            ids = frame["doc_id"].astype("Int64")
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "ent": [entity(s) for s in sets], "key": [group_key(s, 21) if len(s) else 0 for s in sets], "key2": [group_key(s, 22) if len(s) else 0 for s in sets]})

    rows = docs.select(F.col("doc_id").cast("string"), "text")  # ids may be null, and must not turn into floating-point numbers
    sets = cut(rows.mapInPandas(lean(describe), "doc_id long, n long, ent long, key long, key2 long"))
    return sets, parts(sets.count(), BUCKET_DOCS, 24)


def _components(sets: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_shingles, component_id of the rows of sets; docs: their doc_id and text, written in buckets of doc_id."""
    reps = cut(sets.where("n > 0 and doc_id is not null").groupBy("ent", "n", "key", "key2").agg(F.min("doc_id").alias("doc_id")))
    heavy, weight = frequent_tokens(docs, buckets)
    reps = cut(near_groups(docs, reps))
    found = cut(candidates(docs, reps, heavy, weight, buckets))
    edges = open_groups(docs, reps, found)
    edges = edges.union(reps.where("ent <> comp").select(F.col("ent").alias("a"), F.col("comp").alias("b")))
    comps = components(edges).withColumnRenamed("id", "ent").withColumnRenamed("component_id", "root")
    roots = reps.select("ent", "doc_id").join(comps, "ent", "left").withColumn("root", F.coalesce("root", "ent"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(roots.join(least, "root").select("ent", "component_id"))
    # a set that very many documents have keeps them where they are
    weights = sets.where("n > 0 and doc_id is not null").groupBy("ent").agg(F.count("*").alias("rows"))
    alike = attach(sets, "ent", cut(named.join(weights, "ent")), "rows")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return alike.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component; all columns stay, under whatever names. Repeated rows
    of one doc_id all stay or go together; rows without a doc_id stay; so do those of null text and of no words.

    Rows are shuffled by doc_id once, all their columns with them; those that go are taken out of their buckets there."""
    batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        sets, buckets = _described(docs)
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
        whole = cut_by(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", row), "doc_id", buckets)
        joined = _components(sets, whole.select("doc_id", "text"), buckets)
        go = cut(joined.where("doc_id <> component_id").select("doc_id").distinct())
        scratch.keep(whole)
        scratch.keep(go)
    stay = whole.join(go, "doc_id", "left_anti")
    kept = stay.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))
