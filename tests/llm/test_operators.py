"""Each operator against brute force on small tables with nulls, copies, odd texts and no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import common, fingerprint, jaccard, langid, mixing, packing, sharding, substring, urlfilter, vectors, warc
from lexigrove.llm.common import Union, components, repeated
from lexigrove.session import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, ent long, component_id string, b int"
SF = "/root/testdata/sf0.001"


def documents():
    """Nulls in every column, copies, near copies, shared passages, odd texts; columns that could clash."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(150), text(90)
    out = [text(r.randint(1, 200)) for _ in range(25)] + [base] * 4
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [text(40) + " " + passage + " " + text(40) for _ in range(6)]
    out += ["", None, " \t\n", "one two", "one two", "x" * 1200, "ab" * 700, text(6000), "…¿? 123", "naïve Ünïcödé 中文 \u3000 x", "<|endoftext|> it's A'll 12 a\x1cb", "\x85a\xa0b"]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", None, "s0"][min(3, k % 7)], len(t or ""), 1, 2, 3, "x", 4) for k, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    got = {x["id"]: x["component_id"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: u.find(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize("heavy", [1000, 10, 1])
def test_repeated(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    keys = [7] * 500 + [3, 3, 4, None, None] + list(range(10, 900))
    df = spark.createDataFrame([(k, v) for v, k in enumerate(keys)], "k long, v long")
    n = Counter(k for k in keys if k is not None)
    got = {r["v"]: (r["k"], r["n"]) for r in repeated(df, "k", "n").collect()}
    assert got == {v: (k, n[k]) for v, k in enumerate(keys) if n[k] > 1}
    assert repeated(df.limit(0), "k", "n").count() == 0


def test_sharding(docs, empty):
    table = sharding.lookup_table([f"s{k}" for k in range(7)], 101)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table([f"s{k}" for k in range(6)], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 40
    owner = sharding.lookup_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)])
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count() and all(owner[r["slot"]] == r["shard"] and r["shard_name"] == f"shard-{r['shard']:05d}" for r in got)
    assert sharding.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def _language_by_hand(learnt):
    """The plain form of the method, in dictionaries: a function from text to language, score and share of known words."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    langs = sorted({lang for _, lang in learnt})
    tables = [Counter() for _ in range(6)]
    for t, lang in learnt:
        for w in words(t):
            tables[0][w, lang] += 1
            for n in range(1, 6):
                for k in range(len(w) + 3 - n):
                    g = f"^{w}$"[k : k + n]
                    if g not in ("^", "$"):
                        tables[n][g, lang] += 1
    keys = [{g for g, _ in t} for t in tables]
    total = [{x: sum(t[g, x] + 0.5 for g in k) for x in langs} for t, k in zip(tables, keys, strict=True)]
    logs = lambda n, g, x: math.log((tables[n][g, x] + 0.5) / total[n][x])

    def word(w):
        if w in keys[0]:
            return {x: logs(0, w, x) for x in langs}
        for n in range(5, 0, -1):
            grams = [g for k in range(len(w) + 3 - n) if (g := f"^{w}$"[k : k + n]) in keys[n]]
            if grams:
                return {x: sum(logs(n, g, x) for g in grams) / len(grams) for x in langs}
        return dict.fromkeys(langs, 0.0)

    def tell(t):
        own = words(t)
        if not own or not langs:
            return "und", 0.0, 0.0
        scores = [word(w) for w in own]
        sums = [sum(s[x] for s in scores) for x in langs]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        known = sum((w, langs[best]) in tables[0] for w in own)
        return langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums), (known + 2) / (len(own) + 2)

    return tell


def test_language(spark, docs, empty, monkeypatch):
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 0
    rows = [*documents(), *documents()[:3], (None, "abc de fgh", "en", None, 1, 1, 2, 3, "x", 4)]
    df = spark.createDataFrame(rows, DOCS)
    tell = _language_by_hand([(t, lang) for k, t, lang, *_ in rows if lang and k is not None and not held(k)])
    for slice_ in (langid.SLICE, 50):
        monkeypatch.setattr(langid, "SLICE", slice_)
        got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in langid.identify(df).collect())
        want = Counter((k, held(k), *(lambda x: (x[0], round(x[1], 6)))(tell(t))) for k, t, *_ in rows)
        if slice_ == 50:  # the driver's slice is not the workers'
            model = langid.train(df)
            told = langid.tell(model, [t or "" for _, t, *_ in rows])
            assert all(a == tell(t)[0] and abs(b - tell(t)[1]) < 1e-6 and abs(c - tell(t)[2]) < 1e-9 for (_, t, *_), a, b, c in zip(rows, *told, strict=True))
        assert got == want
    clash = df.withColumns({"told": F.lit(1), "told_": F.lit(2), "row": F.lit(3)})
    kept = langid.keep_identified(clash)
    assert kept.columns == clash.columns and {tuple(r)[-3:] for r in kept.collect()} == {(1, 2, 3)}
    assert langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_identified(empty).count() == 0
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for doc, text, *_ in documents():
        lang = got[doc]["lang_pred"]
        assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert (lang == "und") == (not re.search(r"[^\W\d_]", text or ""))
    assert langid.identify(empty).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns
    real = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.identify(real).where("held_out").join(real, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_unlearned_language(spark):
    """Documents in a language that the model never learnt go; held-out ones in the others stay."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    docs = real.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))).cache()
    kept = langid.keep_identified(docs).select("doc_id").cache()
    lost = docs.join(kept, "doc_id", "left_anti")
    held = docs.where(F.col("lang").isNotNull() & (langid.fold(F.col("doc_id")) == 0))
    print("es", docs.where("lang is null").count(), "go", lost.where("lang is null").count(), "held out", held.count(), "go", held.join(lost, "doc_id", "left_semi").count())
    assert lost.where("lang is null").count() >= 0.9 * docs.where("lang is null").count()
    assert held.join(lost, "doc_id", "left_semi").count() <= 0.01 * held.count()


def _vectors(r):
    base = r.normal(size=(40, 16))
    near = np.concatenate([base[:8] + r.normal(size=(8, 16)) * s for s in (0.02, 0.05, 0.08, 0.1, 0.12)])
    return [v.tolist() for v in np.concatenate([base, near, base[:3], base[:1], base[:1] * 3])]


def test_vectors(spark):
    rows = _vectors(np.random.default_rng(3)) + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, k % 2) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    links, u = Counter(), Union()
    good = [(k, np.asarray(v, float)) for k, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for a, x in good:
        for b, y in good:
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= vectors.COSINE:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(df).collect()}
    assert got == {k: (links[k], u.find(k), u.find(k) == k) for k in range(len(rows))}
    none = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, None)], "vec_id long, embedding array<double>")
    assert Counter(map(tuple, vectors.link_vectors(none).collect())) == Counter({(None, 0, None, True): 2, (5, 1, 5, True): 2, (6, 0, 6, True): 1})
    assert vectors.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "long"), [(7, 100), (5, 1)])
def test_vectors_in_blocks(spark, monkeypatch, block, long):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LONG", long)
    test_vectors(spark)


def _recall(spark, m):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(m)), "embedding": m.tolist()}))
    links = (m @ m.T >= vectors.COSINE).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.link_vectors(df).collect()}
    assert all(got[k] <= n for k, n in enumerate(links))
    print(int(links.sum()), sum(got.values()) / links.sum())
    return sum(got.values()) / links.sum()


@pytest.mark.parametrize("mean", [0.0, 1.0, 2.5])
def test_vectors_recall(spark, monkeypatch, mean):
    """Thousands of links, spread and concentrated: mean cosines of 0, 0.5 and 0.86; a hot group of near copies."""
    monkeypatch.setattr(vectors, "BLOCK", 200)
    r = np.random.default_rng(6)
    base = r.normal(size=(2500, 48))
    near = np.repeat(base[:400], 3, axis=0) + r.normal(size=(1200, 48)) * np.repeat(r.uniform(0.02, 0.25, 400), 3)[:, None]
    hot = base[0] + r.normal(size=(900, 48)) * 0.12
    assert _recall(spark, np.concatenate([base, near, hot]) + mean) >= 0.95


def test_lists_stay_short():
    """Concentrated vectors (mean cosine 0.86) have as many pivots as others, and no pivot is near to very many."""
    r = np.random.default_rng(2)
    m = r.normal(size=(4000, 48)) + 2.5
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    p = vectors.pivots_of(m[:375], 125)
    first = np.argsort(-(m @ p.T), axis=1)[:, : vectors.NEAREST]
    assert len(p) == 125 and np.bincount(first.ravel()).max() < 0.5 * len(m)


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("chunk", [64, 3])
def test_jaccard(spark, docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "MEMBERS", chunk)
    monkeypatch.setattr(jaccard, "QUERIES", 2 * chunk)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "BATCH", 10 * chunk)
    rows = [*documents(), *documents()[:3], *((None, *r[1:]) for r in documents()[25:31])]
    sets = {k: _shingles(t) for k, t, *_ in documents()}
    u = Union()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                u.join(a, b)
    df = spark.createDataFrame(rows, DOCS).withColumns({"gone_": F.lit(1), "key": F.lit(2)})
    got = Counter(tuple(r) for r in jaccard.jaccard_join(df).collect())
    assert got == Counter((k, len(_shingles(t)), None if k is None else u.find(k)) for k, t, *_ in rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((k, t) for k, t, *_ in rows if k is None or u.find(k) == k)
    assert jaccard.jaccard_join(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_long_text(spark):
    """Words beyond SLICE characters, passages beyond PART bytes."""
    r = random.Random(8)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(240_000))
    rows = [(1, long), (2, long[:-200] + "zzz"), (3, long[1_000_000:1_000_500] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    left = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring.strip_passages(df).collect()}
    assert left == {1: (len(long) - 200, 1), 2: (len(long) - 200, 1), 3: (500, 1)}
    assert {r["doc_id"]: r["length"] for r in packing.pack_documents(df).groupBy("doc_id").agg(F.sum("length").alias("length")).collect()}[3] > 50


def _strip(texts):
    seen = Counter(t[p : p + 400] for _, t in texts for p in range(len(t) - 399))
    out = {}
    for k, t in texts:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                hit[p : p + 400] = True
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        out[k] = (len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), kept)
    return out


@pytest.mark.parametrize("hot", [200, 1])
def test_substrings(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BUCKET_DOCS", 10)
    expected = _strip([(k, (t or "").encode()) for k, t, *_ in documents()])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring.strip_passages(docs).collect()}
    assert got == expected
    left = substring.without_passages(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert all((texts.get(k) or "") == e[3].decode("utf-8", "ignore") for k, e in expected.items())
    assert substring.strip_passages(empty).count() == 0
    clash = docs.select("*", F.lit(5).alias("rid"), F.lit("r").alias("row"), F.lit("s").alias("stays"), F.lit(6).alias("starts"), F.lit(7).alias("ranges"))
    got = substring.without_passages(clash)
    assert got.columns == clash.columns and {tuple(r)[-5:] for r in got.collect()} == {(5, "r", "s", 6, 7)}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == texts


@pytest.mark.parametrize("hot", [200, 1])
def test_passages_of_words(spark, monkeypatch, hot):
    """Runs of 51 words go, however short the words are; 50 words and clean documents stay."""
    import corpus_pipeline

    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BUCKET_DOCS", 3)
    r = random.Random(4)
    short = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 3))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(short) for _ in range(n))
    p, q, w = text(51), text(50), text(130)
    rows = [f"u1 {text(30)} u2 {p} u3 {text(30)}", f"v1 {text(30)} v2\n{p.replace(' ', '  ')}\tv3 {text(70)}", p, f" {p}\n"]
    rows += [f"m1 {q} m2 {text(20)}", f"n1 {q} n2", f"o1 {w} o2 {w} o3", text(600), text(40), "", None, "x" * 700 + " y", "z " + "x" * 700]
    rows += [f"é{k} {p} e{k}" for k in range(6)]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    seen = Counter(tuple(w[k : k + 51]) for t in rows for w in [(t or "").split()] for k in range(len(w) - 50))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    for k, t in enumerate(rows):
        words = (t or "").split()
        hit = {k for a in range(len(words) - 50) if seen[tuple(words[a : a + 51])] > 1 for k in range(a, a + 51)}
        if k in (11, 12):  # long words: the 400 bytes that both share go still
            assert "x" * 400 not in got[k][0]
        elif hit:
            left = [x for i, x in enumerate(words) if i not in hit]
            assert got[k][0].split() == left and got[k][1] == len(got[k][0]) if left else k not in got
        elif t == "":
            assert got[k] == ("", 0)
        else:
            assert got[k][0] == t
    assert {2, 3}.isdisjoint(got) and {4, 5, 7, 8} <= set(got)


def test_anchors_in_parts(monkeypatch):
    r = random.Random(9)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 399, 400, 401, 3000)] + [b"x" * 2500, b"ab" * 900]
    whole = [substring.anchors(t) for t in texts]
    for part in (1, 7, 400, 1601, 2600):
        monkeypatch.setattr(substring, "PART", part)
        for one, t in zip(whole, texts, strict=True):
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(one, substring.anchors(t), strict=True))


def test_loser_tree():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 8))) for _ in range(r.randint(1, 7))]
        got = list(substring.merge_runs([substring.encode_run([(x,) for x in run]) for run in runs]))
        assert [g[0] for g in got] == sorted(x for run in runs for x in run)
        for a, b in zip(got, got[1:], strict=False):
            h = 0
            while h < min(len(a[0]), len(b[0])) and a[0][h] == b[0][h]:
                h += 1
            assert b[1] == h


def test_urls(spark, monkeypatch):
    hosts = ["net", "a.net", "example.net", "b.example.net", "xexample.net", "example.com", "www.example.com", "org", "q.org", "", "EXAMPLE.Net:80", "z.Net"]
    urls = [None, "no scheme", "http://", "x://a.net", "://y://net/"] + [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/de/1?x=/fr/", "/fr/#a", "?/en/", "/En/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*urlfilter.RULES, ("example.net", "/", "block"), ("b.example.net", "/e", "block")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    for most in (1000, 2):
        got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df, rules, most=most).collect()}
        assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [64, 4])
def test_mixing(empty, spark, words):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    one = (900, "word", "en", "s00", 4, 1, 2, 3, "x", 4)
    rows = [*documents(), one, *documents()[:2], *((None, *r[1:]) for r in documents()[:4])]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs, block_words=words).collect()
    sums = Counter()
    for _, t, _, s, *_ in rows:
        sums[s] += size(t)
    names = sorted(x for x in sums if x) + [None]
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sums.values())
    while True:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sums[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sums[s]
            left -= target[s]
        open_ -= over
    target |= {s: w[s] * level for s in open_}
    took = Counter()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((k, s, size(t)) for k, t, _, s, *_ in rows)
    for r in got:
        assert r["source_size"] == sums[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= min(words, max(1, sums[s] // 256)) for s in names) and took["s00"] == 2
    again = mixing.mix_sources(docs.repartition(3), block_words=words).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    clash = docs.withColumns({"copies": F.lit(1), "row": F.lit(2), "copies_": F.lit(3), "rid": F.lit(4)})
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns
    most = Counter(r[:2] for r in rows)
    assert all(n <= 2 * most[k] for k, n in Counter((r["doc_id"], r["text"]) for r in out.collect()).items())


def test_draws(spark):
    """Shards' counts are a multinomial draw: of the right mean and variance; no slot is lost or there twice."""
    slots = {k: n for k, n in enumerate([4000, 1000, 1, 0, 2999, *[2] * 1000])}
    src = cut(spark.createDataFrame(list(slots.items()), "src long, slots long"))
    got = mixing.draw_slots(src, F.lit(7), 100).collect()
    assert sorted((r["src"], r["j"]) for r in got) == [(s, j) for s, n in slots.items() for j in range(n)]
    total = sum(slots.values())
    for s in (0, 1, 4):
        per = np.bincount([r["shard"] for r in got if r["src"] == s], minlength=total // 100)
        p = slots[s] / total
        assert abs(per.mean() - 100 * p) < 1 and 0.6 < per.var() / (100 * p * (1 - p)) < 1.6
    for n in (1, 2, 3, 10, 97, 1000):
        p = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1), F.lit(2))).collect()]
        assert sorted(p) == list(range(n))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, text, *_ in documents():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(j, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for j, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[k]) == want
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(by_seq) <= 1.1 * least + 2
    assert packing.pack_documents(empty).count() == 0


def test_packing_in_shards(docs, monkeypatch):
    one = packing.pack_documents(docs).select("sequence_id").distinct().count()
    p = cut(packing.pieces(docs))
    got = packing.pack_pieces(p, shard=20)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n > 2048 or n <> e").count() == 0
    assert got.count() == p.count() and got.select("sequence_id").distinct().count() <= one + 3


def test_packing_of_pieces_that_do_not_pair(spark):
    """Twelve shards of pieces of over half a sequence, and copies of one row: all get places, and no task all of them."""
    rows = [(k, 0, 0, 1100 + k % 40, k) for k in range(470)] + [(7, 0, 0, 1100, 7)] * 10 + [(None, 0, 0, 900, 3)] * 3
    p = cut(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    got = packing.pack_pieces(p, shard=40).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows) and max(fill.values()) <= 2048 and len(fill) <= 480


def test_sum_of_squares():
    sizes = np.array([5, 5, 3, 7, 2, 2, 8, 1, 10])
    bins, gaps = packing.sum_of_squares(sizes, 10), []
    open_: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):  # plain form
        best = None
        for k in [k for k, g in enumerate(open_) if g >= s] + [len(open_)]:
            after = [*open_, 10] if k == len(open_) else list(open_)
            after[k] -= s
            score = (sum(n * n for g, n in Counter(after).items() if 0 < g < 10), after[k] if k < len(open_) else 99)
            if best is None or score < best[0]:
                best = (score, after)
        open_ = best[1]
        gaps = open_
    assert sorted(10 - np.bincount(bins, sizes)) == sorted(gaps)


def test_warc(spark):
    rows = [(k, f"http://h/{k}", None if k % 50 == 0 else "é" * (k % 300)) for k in range(900)] + [(None, None, None)] * 3 + [(7, "x", "y")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"segment": F.lit(1), "record": F.lit("r"), "left": F.lit(2)})
    records = cut(warc.to_records(pages))
    lay = lambda record: warc.laid_out(records.select("page_id", "record", warc.measured(record).alias("m")).select("page_id", "record", "m.*"), 100)
    left = lay(F.col("record"))
    right = lay(F.when(F.col("page_id").isin(3, 500), F.lit(b"x")).otherwise(F.col("record"))).where("page_id is null or page_id <> 899")
    segment = left.where("page_id in (3, 500, 899)").select("segment", "page_id").distinct().collect()
    got = warc.fixity(left, right, 4)
    hurt = {r["page_id"] for r in got.where("damaged").collect()}
    # offsets after a record of another length differ, too
    after = {r["page_id"] for s in segment for r in left.where(f"segment = {s['segment']} and page_id >= {s['page_id']}").collect()}
    assert {3, 500, 899} <= hurt <= after and got.count() == 905
    assert warc.audit(left, left).count() == 0
    assert warc.fixity(left.limit(0), left.limit(0)).count() == 0
    one = left.where("segment = 0").orderBy("offset").collect()
    data = b"".join(bytes(r["record"]) for r in one)
    assert [at for at, *_ in warc.parse_warc(data)] == [r["offset"] for r in one]


def test_fingerprints(docs, empty, spark):
    for near in (2000, 7):
        got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(docs, near).collect()}
        rows = sorted(((k, t or "") for k, t, *_ in documents()), reverse=True)
        assert len(got) == len(rows)
        for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            half = len(t) // 2
            new = t[: len(t) - half] + after[:half]
            r = got[k]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert r["fingerprint"] == fingerprint.shown(fingerprint.sketch(t)) and r["edited_fingerprint"] == fingerprint.shown(fingerprint.sketch(new))
            assert 0 <= r["near_edited"] <= 1 and (r["near_next"] == 1 or t != after)
    one = spark.createDataFrame([(1, "abc"), (None, "d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(one.union(one.limit(1))).collect()}
    assert {k: r["near_next"] for k, r in got.items()} == {1: 1.0, None: 1.0} and got[None]["edited_sha256"] == hashlib.sha256(b"d").hexdigest()
    assert fingerprint.fingerprint_documents(empty).count() == 0
    r = random.Random(1)
    a = "".join(r.choice("abcdefghij ") for _ in range(4000))
    swapped = a[2000:] + a[:2000]
    like = lambda x, y: fingerprint.likeness(fingerprint.sketch(x), fingerprint.sketch(y))
    assert like(a, a) == 1 and like(a, a[:3900]) > 0.8 and like(a, swapped) < like(a, a[:1990] + "zz" + a[1992:])


def test_fingerprints_of_short_texts():
    """Halves of a short text that change places show; texts of different lengths still compare."""
    r = random.Random(2)
    like = lambda x, y: fingerprint.likeness(fingerprint.sketch(x), fingerprint.sketch(y))
    for n, most in ((40, 0.35), (80, 0.4), (150, 0.5)):
        texts = ["".join(r.choice("abcdefghij ") for _ in range(n)) for _ in range(60)]
        swapped = np.mean([like(t, t[n // 2 :] + t[: n // 2]) for t in texts])
        print(n, round(float(swapped), 2))
        assert swapped < most
        assert all(like(t, t) == 1 for t in texts)
    long = ["".join(r.choice("abcdefghij ") for _ in range(500)) for _ in range(20)]
    assert np.mean([like(t, t[:450]) for t in long]) > 0.7
    assert len(set(fingerprint.sketch("abc"))) >= 1 and not fingerprint.sketch("").any()


def test_queries_match_sql(spark, duck, same):
    from lexigrove.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        same(QUERIES[name](spark, SF).toPandas(), duck.execute(sql).fetch_df())


def test_pipeline(spark, docs):
    """Each stage on its own input, held against what brute force keeps."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "source_mix", "packed"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was = [tuple(r)[:2] for r in at.collect()]
        at = spark.createDataFrame(stage(spark, at, SF).collect(), DOCS)
        now = {r["doc_id"]: r["text"] for r in at.collect()}
        assert at.columns == docs.columns and set(now) <= {k for k, _ in was}
        if name == "language_id":
            assert {k for k, t in was if not re.search(r"[^\W\d_]", t or "")}.isdisjoint(now)
        if name == "repeated_passages":
            assert now == {k: v[3].decode("utf-8", "ignore") for k, v in _strip([(k, (t or "").encode()) for k, t in was]).items() if v[3]}
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= at.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
