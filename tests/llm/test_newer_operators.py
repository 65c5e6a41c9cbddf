"""Reply trees, filter audits and hard negatives against brute force on small tables."""

import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import audit, negatives, replies, substring

TURNS = "conv_id long, turn long, role string, text string, leaf int, root string, id int, k string, tid int, t int"
MARKS = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>\n", "<", "|", "", "é中𝄞", "\n", "a\\nb"]


def write(turns):
    """The template by hand: text and the spans of what assistants say, in UTF-8 bytes."""
    esc = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t or "")
    out, mask = "", []
    for role, text in turns:
        out += "<|im_start|>" + esc((role or "").replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        if role == "assistant":
            mask.append((len(out.encode()), len(esc(text).encode())))
        out += esc(text) + "<|im_end|>\n"
    return out, mask


def trees(messages, best):
    """What reply_trees() is to give, walked one message at a time."""
    num = lambda s: 0.0 if s is None or s != s else s
    digest = lambda r, t: hashlib.sha256(("{" + ",".join(f'"{k}":"{v}"' for k, v in (("role", r), ("text", t)) if v is not None) + "}").encode()).hexdigest()
    one, alone = {}, []
    for m, up, role, text, score in messages:
        if m is None:
            alone.append((None, None, 1, num(score), [(role, text)]))
            continue
        key = (up is not None, up or 0, num(score), digest(role, text))
        if m not in one or key < one[m][0]:
            one[m] = (key, up, role, text, num(score))
    up = {m: v[1] if v[1] in one and v[1] != m else None for m, v in one.items()}
    for m in sorted(one):  # circles begin at their smallest id
        seen, x = [], m
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is not None:
            up[min(seen[seen.index(x) :])] = None
    paths = defaultdict(list)
    for leaf in set(up) - set(up.values()):
        path = [leaf]
        while up[path[-1]] is not None:
            path.append(up[path[-1]])
        paths[path[-1]].append((-sum(one[m][4] for m in path), leaf, path[::-1]))
    for root, own in paths.items():
        for rank, (score, leaf, path) in enumerate(sorted(own)[:best], 1):
            alone.append((root, leaf, rank, -score, [one[m][2:4] for m in path]))
    return [(root, leaf, rank, score, len(p), *write(p)) for root, leaf, rank, score, p in alone]


def told(r):
    return (r["root"], r["leaf"], r["rank"], r["score"], r["n_turns"], r["formatted"], [tuple(s) for s in r["mask"]])


@pytest.mark.parametrize("best", [2])
def test_reply_trees(spark, best):
    r = random.Random(best)
    rows = [(k, r.choice([None, *range(1, 140)][: k + 3]), r.choice(["user", "assistant", "system"]), r.choice("abcd") * r.randint(0, 5), float(r.randint(-3, 3))) for k in range(1, 120)]
    rows += [(200 + k, 200 + k - 1, "user", f"deep {k}", 1.0) for k in range(1, 70)] + [(199, 500, "user", "no such parent", 0.0)]
    rows += [(300, 302, "user", "a", 1.0), (301, 300, "assistant", "b", 1.0), (302, 301, "user", "c", 1.0), (303, 301, "user", "off the circle", 0.5)]
    rows += [(310, 310, "user", "answers itself", None), (311, 310, "assistant", "x", float("nan"))]
    rows += [(None, 5, "assistant", "alone", 2.0), (None, None, None, None, None), rows[0], rows[0], (5, 4, "user", "says other things", 9.0)]
    messages = spark.createDataFrame([(*x, 1, 2) for x in rows], "message_id long, parent_id long, role string, text string, score double, id int, anc int")
    got = [told(x) for x in replies.reply_trees(messages, best).collect()]
    assert sorted(map(str, got)) == sorted(map(str, trees(rows, best)))
    assert replies.reply_trees(messages.limit(0), best).count() == 0


def conversations():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(MARKS) + r.choice(MARKS)) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(50, 7, "user", "later"), (50, 2, "assistant", "sooner"), (50, None, "assistant", "no turn"), (50, 2, "assistant", "b tie"), (50, 2, "assistant", "sooner")]
    rows += [(None, 0, "assistant", "a"), (None, 0, "assistant", "a"), (None, 1, "user", "b"), (51, 0, "as\\n\nsist<|im_end|>", "odd role"), (52, 0, "assistant", None)]
    rows += [(60, t, ["user", "assistant"][t % 2], "long " * 3000 + MARKS[t % 10]) for t in range(300)] + [(61, 0, "assistant", "x<|" * 200_000)]
    return rows


def test_conversations(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, 1, "r", 2, "k", 3, 4) for x in rows], TURNS)
    said = replies.format_conversations(df)
    back = said.select("*", replies.turns_of(F.col("formatted")).alias("turns"), replies.masked(F.col("formatted"), F.col("mask")).alias("learnt")).collect()
    convs = defaultdict(list)
    for k, (c, t, role, text) in enumerate(dict.fromkeys(x for x in rows if x[0] is not None)):
        convs[c].append((t is None, t or 0, role or "", role is not None, hashlib.sha256((text or "").encode()).hexdigest(), (role, text)))
    want = [(c, [x[-1] for x in sorted(own, key=lambda x: (x[0], x[1], x[3], x[2], x[4]))]) for c, own in convs.items()] + [(None, [x[2:]]) for x in rows if x[0] is None]
    got = [(r["conv_id"], r["n_turns"], r["formatted"], [tuple(s) for s in r["mask"]]) for r in back]
    assert sorted(map(str, got)) == sorted(str((c, len(p), *write(p))) for c, p in want)
    read = sorted(str((r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]], r["learnt"])) for r in back)
    assert read == sorted(str((c, [(a or "", b or "") for a, b in p], [b or "" for a, b in p if a == "assistant"])) for c, p in want)
    assert replies.format_conversations(df.limit(0)).count() == 0


def test_conversations_use_no_python(spark):
    said = replies.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    plan = said.select(replies.turns_of(F.col("formatted")), replies.masked(F.col("formatted"), F.col("mask")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def fails(text, later):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), later)


def test_audit(spark):
    r = random.Random(8)
    some = lambda n, m, extra: " ".join(f"w{r.randrange(m)}" for _ in range(n)) + extra
    texts = [some(r.choice([5, 99, 100, 130]), r.choice([20, 5000]), r.choice(["", " $", " " + "A" * 90])) for _ in range(60)] + [None, "", "\t \n", "ABC", "x" * 200_000, "é" * 9 + "A"]
    rows = [(k, r.choice(texts), r.choice(["en", "fr", "", None])) for k in range(250)]
    rows += [rows[3], rows[3], (None, texts[0], "en"), (None, texts[0], "en"), (-5, texts[1], None)]
    labels = [(r.randrange(-5, 300), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*x, "s", 1, "p", 1, 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, part string, rows int, mask int")
    tags = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = ({k for k, *x in labels if x[c] == 1 and k is not None} for c in (0, 1))
    parts = defaultdict(list)
    for k, t, lang in rows:
        parts[lang or ""].append((fails(t or "", k is not None and k > least[t or ""]), k in good, k in toxic))
    want = []
    for part, own in parts.items():
        mine, share = [], Counter()
        for order in permutations(range(5)):
            left = own
            for step, i in enumerate(order, 1):
                gone, left = [d for d in left if d[0][i]], [d for d in left if not d[0][i]]
                share[i] += len(gone)
                mine.append((i, (part, "".join("ABCDE"[j] for j in order), step, "ABCDE"[i], len(left), len(gone), sum(d[0][i] for d in own) - len(gone), sum(d[0][i] and sum(d[0]) == 1 for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        want += [(*row, share[i]) for i, row in mine]
    got = [tuple(x) for x in audit.audit_filters(docs, tags).collect()]
    assert len(got) == len(parts) * 600 and sorted(got) == sorted(want)
    assert [tuple(x) for x in audit.audit_filters(docs.where("lang = 'en'"), tags.limit(0)).collect()]
    assert audit.audit_filters(docs.limit(0), tags).count() == 0


def test_removals():
    """The polynomial against its own definition: corners by masks, Shapley values by all orders."""
    r = random.Random(4)
    counts = {m: r.randint(0, 50) for m in range(32)}
    p = audit.Removals(counts, 5)
    for s in range(32):
        assert p.corner(s) == sum(n for m, n in counts.items() if m & s)
    for i in range(5):
        by_orders = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            by_orders += p.corner(before | 1 << i) - p.corner(before)
        assert p.value(i) == Fraction(by_orders, math.factorial(5))
    assert audit.Removals({}, 5).corner(31) == 0 and audit.Removals({0: 9}, 5).value(2) == 0


def mined(rows, width):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, label, vector) that take part, by all pairs."""
    top = 1 << 21
    on = [(i, lab, [max(-top, min(top, math.floor(256 * float(x)))) for x in v] + [0] * (width - len(v))) for i, lab, v in rows]
    anchors = {}
    for i, lab, v in on:
        if i % 100 == 0 and (i not in anchors or (lab, v) < anchors[i]):
            anchors[i] = (lab, v)
    out = []
    for a, (label, q) in anchors.items():
        best = {}
        for i, lab, v in on:
            if i != a:
                s = sum(x * y for x, y in zip(q, v, strict=True))
                best[lab == label, i] = max(s, best.get((lab == label, i), s))
        rank = lambda same: sorted((-s, i) for (x, i), s in best.items() if x == same)
        for p, pid in rank(True)[:5]:
            fit = [(-s, i) for s, i in rank(False) if 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, k, i, -p, s) for k, (s, i) in enumerate(fit[:5], 1)]
    return out


def vectors(r, n, dims, labels=4):
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(k * 5, r.randrange(labels), [float(np.float32(x + r.gauss(0, 0.7))) for x in r.choice(middles)]) for k in range(n)]


@pytest.mark.parametrize("shrink", [False, True])
def test_hard_negatives(spark, monkeypatch, shrink):
    if shrink:  # several blocks of anchors, slices of rows and anchors, and bounds that are loose
        for name, value in (("ANCHOR_NUMBERS", 30), ("PAIRS", 60), ("COMPONENTS", 200), ("CENTROIDS", 4), ("FIT", 20)):
            monkeypatch.setattr(negatives, name, value)
    r = random.Random(6)
    rows = vectors(r, 400, 7)
    rows += [(k, r.randrange(4), rows[11][2]) for k in range(5000, 5060)]  # many ties
    rows += [(300, 1, rows[5][2]), (300, 0, rows[6][2]), rows[9], rows[9], (-100, 2, [0.0] * 7), (7000, 1, [9e5, -9e5, 3e38, 0.0, 0.0, 1.0, -1.0]), (7001, 1, [1.0]), (7002, 3, []), (7100, 0, [-1.0, -2.0])]
    out = [(8000, None, [1.0] * 7), (None, 1, [1.0] * 7), (8100, 1, None), (8200, 1, [float("nan")] * 7), (8300, 2, [float("inf")] + [0.0] * 6), (8400, 1, [None, 1.0])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + out], "vec_id long, label int, embedding array<float>, q int, slot int")
    got = [tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(mined(rows, 7)) and len(got) > 100
    for few in (df.limit(0), df.where("vec_id % 100 <> 0"), df.where("vec_id = 300")):
        assert negatives.hard_negatives(few, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    for scale in (1, 300, 2**20):
        q, anchors = np.floor(r.normal(size=(500, 9)) * scale), np.floor(r.normal(size=(40, 9)) * scale)
        books = negatives.codebooks(q[:300])
        low, high = negatives.Bounds(anchors, books).of(*negatives.encode(q, books))
        score = q @ anchors.T
        assert (low <= score).all() and (score <= high).all()
        if scale == 300:  # and leave most of the far ones out
            assert (high - low).mean() < 0.5 * np.abs(score).mean()


def test_one_line_before_many_texts(spark, monkeypatch):
    """Pairs of documents that all begin with one line, just too short for a passage: no bucket holds a tenth of the suffixes, and results are whole."""
    monkeypatch.setattr(substring, "BUCKET_DOCS", 40)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    kind = substring.of_bytes(400)
    lines = (" ".join(word() for _ in range(80))[:385] for _ in range(99))
    line = next(x for x in lines if substring.anchors(kind.raw(x + " " + x[::-1]), kind)[0][0] < 150)  # a suffix lies in it
    texts = [line + " " + " ".join(word() for _ in range(110)) for _ in range(800)]
    df = spark.createDataFrame([(2 * k + c, t) for k, t in enumerate(texts) for c in (0, 1)], "rid long, text string").repartition(8).cache()
    found = substring.repeated_suffixes(df, kind)
    buckets = substring.buckets_for(df, found, kind)
    shared = spark.sparkContext.broadcast(buckets)
    rows = df.join(found, "rid").mapInPandas(lambda f: substring.suffix_rows(f, shared.value), "bucket long, kind int, data binary, rid long, start long, end long")
    sizes = Counter()
    for x in rows.where("kind = 0").collect():
        sizes[x["bucket"]] += len(pickle.loads(zlib.decompress(x["data"])))
    assert sum(sizes.values()) > 5000 and max(sizes.values()) < sum(sizes.values()) / 10
    assert {buckets.level(b) for b in sizes} > {0}  # the line's suffixes go on in too many ways
    got = substring.strip_passages(df.withColumnRenamed("rid", "doc_id")).collect()
    assert {x["n_removed"] - x["n_bytes"] for x in got} == {0}  # each has a copy
    alone = substring.strip_passages(df.where("rid % 2 = 0").withColumnRenamed("rid", "doc_id")).collect()
    assert {x["n_removed"] for x in alone} == {0}


def test_buckets_keep_groups_together():
    """Suffixes that agree in what their passages share meet in one bucket of their level, whatever the bounds."""
    r = random.Random(7)
    kind = substring.of_bytes(40)
    heads = sorted({bytes(r.choice(b"ab") for _ in range(kind.depth)) for _ in range(9)})
    for bounds, n in (([], 5), (heads[:3], 3), (heads, 50)):
        b = substring.Buckets(bounds, n, kind)
        seen = {}
        for _ in range(2000):
            level = r.randrange(3)
            suffix = r.choice(heads) + bytes(r.choice(b"ab") for _ in range(30))
            k = b.of(suffix, level)
            assert b.level(k) == level and seen.setdefault((level, suffix[: kind.deep(level)]), k) == k
        assert len({k for k in seen.values()}) > 2
