"""Odd rows through the operators: nulls, repeated rows, clashing names, long values, damaged files."""

import gzip
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from lexigrove.llm import fingerprint, jaccard, mixing, packing, sharding, substring, urlfilter, warc


def test_shards_by_hand(spark):
    """The table filled by taking turns over whole preference orders, and slots by another hash library."""
    import hashlib

    names, slots = ["a", "b", "c", "d", "e"], 101
    orders = []
    for n in names:
        h = hashlib.sha256(n.encode()).digest()
        start, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        orders.append([(start + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, order in enumerate(orders):
            free = [s for s in order if s not in owner]
            if free:
                owner[free[0]] = k
    assert sharding.lookup_table(names, slots) == [owner[s] for s in range(slots)]
    rows = [(k, f"t{k}") for k in range(-40, 40)] + [(None, "x"), (None, "y"), (7, "again"), (7, "again"), (2**62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit(1), "shard": F.lit(2), "o": F.lit(3)})
    got = Counter(tuple(r) for r in sharding.shard_documents(df, shards=names, slots=slots).collect())

    def place(k):
        if k is None:
            return 0
        h = xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), seed=42)
        return (h - 2**64 if h >= 2**63 else h) % slots

    assert got == Counter((k, place(k), owner[place(k)], names[owner[place(k)]]) for k, _ in rows)


def test_shingles_of_few_words():
    """Slices of any number of words in all, the texts' sets as they are alone."""
    texts = ["a", "a b", "", None, "a b c", "a b c d", "a b c d e", "a b c d e f"]
    for k in range(len(texts)):
        for n in range(len(texts) - k + 1):
            some = texts[k : k + n]
            got = [x.tolist() for x in jaccard.shingle_sets(pd.Series(some, dtype=object))]
            assert got == [jaccard.shingle_sets(pd.Series([t] + ["z"] * 9, dtype=object))[0].tolist() for t in some] and [len(x) for x in got] == [max(len((t or "").split()) - 4, min(1, len((t or "").split()))) for t in some]


def test_passages_of_odd_rows(spark):
    """Copies, repeated rows and rows without an id against brute force; other columns clash."""
    import random

    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = text(450)
    rows = [(1, shared + text(300)), (2, text(200) + shared), (3, text(900)), (3, None), (None, shared), (None, shared), (4, ""), (5, text(399)), (6, text(2000)), (6, None)]
    rows += [rows[2], (7, shared[:410] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "starts": F.lit(2), "row": F.lit("x"), "bucket": F.lit(0)})
    windows = Counter(t[a : a + 400] for _, t in rows for a in range(len(t or "") - 399))
    want = Counter()
    for k, t in rows:
        t = t or ""
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 399):
            if windows[t[a : a + 400]] > 1:
                gone[a : a + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        want[k, "".join(c for c, g in zip(t, gone, strict=True) if not g), len(t), int(gone.sum()), spans] += 1
    got = Counter((x["doc_id"], bytes(x["kept"]).decode(), x["n_bytes"], x["n_removed"], x["n_spans"]) for x in substring.strip_passages(df).collect())
    assert got == want
    left = substring.without_passages(df)
    assert left.columns == df.columns and {x["doc_id"] for x in left.collect()} >= {1, 2, 5, 6}


def test_urls_of_odd_rows(spark):
    long_url = "http://" + "a." * 50_000 + "example.net/en/" + "x" * 300_000
    rows = [(None, "http://net/"), (1, "http://net/"), (1, "http://net/"), (2, long_url), (3, None), (4, "http://ex.org/fr/"), (4, "http://ex.org/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("at", "host", "rule", "path", "verdict", "key")})
    got = Counter((x["page_id"], x["rule"], x["verdict"], len(x["host"])) for x in urlfilter.filter_urls(df).collect())
    assert got == Counter({(None, "net/", "block", 3): 1, (1, "net/", "block", 3): 2, (2, "example.net/en/", "allow", 100_011): 1, (3, None, "allow", 0): 1, (4, "org/fr/", "allow", 6): 2})


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (2, ""), (3, "word " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("piece", "length", "start", "shard_", "b", "fill")})
    got = packing.pack_documents(df).collect()
    assert Counter(x["doc_id"] for x in got if x["doc_id"] != 3) == Counter(k for k, _ in rows if k != 3)
    whole = defaultdict(list)
    for x in got:
        whole[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in whole.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= packing.LENGTH
    three = sorted((x["piece"], x["start"], x["length"]) for x in got if x["doc_id"] == 3)
    assert all(n == 2048 for _, _, n in three[:-1]) and [a for _, a, _ in three] == [2048 * k for k in range(len(three))]


def test_fingerprint_of_a_long_text(spark):
    import random

    r = random.Random(3)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(250_000))
    df = spark.createDataFrame([(2, long), (1, long[:125_000] + long[125_000:].upper())], "doc_id long, text string")
    got = {x["doc_id"]: x for x in fingerprint.fingerprint_documents(df).collect()}
    # the two smallest of a group's k-mers are in the common half of all three halves for a ninth of the groups
    assert got[2]["n_chars"] == 250_000 and 0.02 < got[2]["near_next"] < 0.3 and got[2]["near_next"] == got[1]["near_next"]


def test_orders_show_in_fingerprints():
    """Likeness falls with the share of blocks that changed their places, and grows with the share of equal text: an edit
    distance would rank these texts so."""
    import random

    r = random.Random(4)
    blocks = ["".join(r.choice("abcdefghij ") for _ in range(200)) for _ in range(20)]
    text, print_ = "".join(blocks), fingerprint.sketch("".join(blocks))

    def like(other):
        return fingerprint.likeness(print_, fingerprint.sketch(other))

    edits = [like("".join(blocks[:k] + [b[::-1] for b in blocks[k:]])) for k in (20, 16, 10, 0)]
    assert edits[0] == 1 and edits == sorted(edits, reverse=True) and edits[-1] < 0.1
    halves = like("".join(blocks[10:] + blocks[:10]))
    backwards = like("".join(blocks[::-1]))  # nearly all pairs change their order, half of them if halves do
    assert like(text[:-50]) > 0.9 > halves > backwards and 0.3 < halves < 0.7 and backwards < 0.25


def test_mix_comes_near_its_targets(spark):
    """Rows of the mix, as the pipeline takes them: each source's words near its target, repeats and all."""
    import random

    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.randint(5, 120)), s) for k, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 150 + [None] * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    # a: 3, b: 1, c: 2, null: 3, of 1.5 times all; twice a source's size at most
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    while over := {s for s in open_ if weight[s] * left / sum(weight[x] for x in open_) > 2 * size[s]}:
        for s in over:
            target[s] = 2 * size[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    target |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    took = Counter()
    for x in mixing.mixed_documents(df).collect():
        took[x["source"]] += len(x["text"].split())
    for s, n in target.items():
        assert abs(took[s] - n) < 0.08 * n, (s, took[s], n)
    taken = Counter()
    for x in mixing.mix_sources(df).collect():
        taken[x["source"]] += x["taken"]
        assert x["taken"] <= 2 * x["size"]
    assert all(abs(taken[s] - n) <= 64 for s, n in target.items())


RECORD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def test_read_warc(spark, tmp_path):
    """Plain files, files of gzip members, and damaged ones, of which what comes before the damage is read."""
    texts = ["one", "", "three\r\n\r\nWARC/1.0 inside", "é" * 10]
    records = [RECORD.format(f"u{k}", len(t.encode()), t).encode() for k, t in enumerate(texts)]
    members = [gzip.compress(x) for x in records]
    files = {
        "plain": b"".join(records), "packed.gz": b"".join(members), "cut.gz": b"".join(members)[:-30], "short": b"".join(records)[:-12], "none": b"", "noise": b"\x1f\x8bnoise",
        "odd": records[0] + RECORD.format("u9", "many", "x").encode() + records[1],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = defaultdict(list)
    for x in warc.read_warc(spark, str(tmp_path)).orderBy("source", "offset").collect():
        got[x["source"].rsplit("/", 1)[1]].append((x["url"], x["html"]))
    whole = [(f"u{k}", t) for k, t in enumerate(texts)]
    assert got == {"plain": whole, "packed.gz": whole, "cut.gz": whole[:3], "short": whole[:3], "odd": whole[:1]}
    offsets = [x["offset"] for x in warc.read_warc(spark, str(tmp_path / "plain")).orderBy("offset").collect()]
    assert offsets == [0, *np.cumsum([len(x) for x in records])[:-1].tolist()]


def test_short_passages_of_many_words(spark, tmp_path):
    """op5 tells of 51 words that two documents share though they are below 400 bytes, which stay in kept_text."""
    import random

    from lexigrove.llm import queries

    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    p, q = text(51), text(50)
    long = text(90)
    rows = [(1, f"u {p} {text(20)}"), (2, f"{text(20)} v {p}"), (3, text(200)), (4, f"x {q} y"), (5, f"z {q} w"), (6, f"a {long} b"), (7, f"c {long} d"), (8, None), (9, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {k: x["n_passage_words"] for k, x in got.items()} == {1: 51, 2: 51, 3: 0, 4: 0, 5: 0, 6: 90, 7: 90, 8: 0, 9: 0}
    for k, t in rows:
        x, t = got[k], t or ""
        if k not in (6, 7):
            assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_text"]) == (len(t), 0, 0, t)
            assert x["text"] == t.replace(f"{p} ", "").replace(p, "")
        else:
            assert x["n_removed"] == len(long) + 2 and x["kept_text"] == x["text"] == t[0] + t[-1]
