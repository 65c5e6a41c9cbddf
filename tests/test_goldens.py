"""Small cases with known answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.functions import text
from lexigrove.operators import hierarchy, index, mapreduce, metrics, search
from lexigrove.sources import html, store

PAGES = [
    (1, "/wiki/Citrus_limon", [("kingdom", "plantae"), ("family", "rutaceae"), ("genus", "citrus"), ("species", "c. limon")], "citrus limon", "citrus " * 4 + "lemon " * 3 + "sour sour leafy water"),
    (2, "/wiki/Citrus_sinensis", [("kingdom", "plantae"), ("family", "rutaceae"), ("genus", "citrus"), ("species", "c. sinensis")], "citrus sinensis", "citrus " * 3 + "orange " * 5 + "sweet sweet rutaceae"),
    (3, "/wiki/Aurelia_aurita", [("kingdom", "animalia"), ("phylum", "cnidaria"), ("class", "scyphozoa"), ("species", "a. aurita")], "aurelia aurita", "water " * 6 + "cnidaria cnidaria medusa medusa medusa sour"),
]
SHAPE = "doc_id long, url string, hierarchy array<struct<rank:string,name:string>>, binomial string, words array<string>"


@pytest.fixture(scope="module")
def postings(spark):
    return index.postings(spark.createDataFrame([(i, u, h, b, w.split()) for i, u, h, b, w in PAGES], SHAPE)).cache()


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("citrus", [(1, 6.180874, 1, 1), (2, 5.794569, 1, 1)]),
        ("sour water", [(3, 13.520662, 2, 2), (1, 4.635655, 2, 2)]),
        ("sour leafy", [(1, 5.122214, 2, 2), (3, 0.321921, 1, 1)]),
        ("cnidaria", [(3, 3.386294, 1, 1)]),
        ("rutaceae plantae", [(2, 1.693147, 1, 1)]),
        ("water sour sour", [(1, 44.811336, 2, 2), (3, 38.630462, 2, 2)]),
        ("unknown water", [(3, 1.931523, 1, 1), (1, 0.257536, 1, 1)]),
        ("water watery", [(3, 11.589139, 2, 1), (1, 1.545218, 2, 1)]),
        ("the of", []),
    ],
)
def test_search(postings, query, expected):
    got = [(r["doc_id"], round(r["score"], 6), r["matched_terms"], r["match_ratio"]) for r in search.search(postings, 3, query).orderBy("rank").collect()]
    assert got == expected


def test_total_results(postings):
    assert search.total_results(postings, "sour water").first()[0] == 4


def test_prefixes_and_terms():
    assert [text.prefix_of(w) for w in ("citrus", "leafy", "sour", "north", "water", "seed", "aquatic", "plantae", "", "x")] == ["cit", "lea", "sou", "nor", "wat", "see", "aq", "pla", "aa", "x"]
    assert text.query_terms("Red-Leaf  TREES the") == ["redleaf", "trees"]


@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=6))
@settings(max_examples=50, deadline=None)
def test_first_term_once_later_ones_more(scores):
    step = scores[0] + sum(2.5 * s for s in scores[1:])
    assert abs(2.5 * sum(scores) - 1.5 * scores[0] - step) < 1e-9


def _edges(spark, pairs):
    return spark.createDataFrame([(p, c, c.startswith("[SPECIES]")) for p, c in pairs], "parent string, child string, is_species boolean")


def test_hierarchy(spark):
    e = _edges(spark, [("plantae", "angiosperms"), ("angiosperms", "rosids"), ("rosids", "citrus"), ("angiosperms", "asterids"), ("asterids", "citrus"), ("citrus", "[SPECIES] /wiki/C1"), ("citrus", "citrus"), ("plantae", "[SPECIES] /wiki/P0")])
    urls = lambda df: sorted(r[0] for r in df.collect())
    assert urls(hierarchy.descendants(e, "plantae")) == ["/wiki/C1", "/wiki/P0"]
    assert urls(hierarchy.descendants(e, " Citrus ")) == ["/wiki/C1"]
    assert urls(hierarchy.descendants(e, "nosuch")) == []
    assert urls(hierarchy.descendants_with_repeats(e, "plantae")) == ["/wiki/C1", "/wiki/C1", "/wiki/P0"]
    assert urls(hierarchy.descendants_with_repeats(e, "citrus")) == ["/wiki/C1", "/wiki/C1"]


def test_edges(spark):
    r = spark.createDataFrame([(u, h) for _, u, h, _, _ in PAGES[:1]] + [("/wiki/One", [("kingdom", "x")])], "url string, hierarchy array<struct<rank:string,name:string>>")
    assert sorted((x["parent"], x["child"]) for x in hierarchy.edges_of(r).collect()) == [("citrus", "[SPECIES] /wiki/Citrus_limon"), ("plantae", "rutaceae"), ("rutaceae", "citrus")]


def test_page(spark):
    page = """<html><body><table class="infobox biota"><tr><th colspan="2">Lemon</th></tr><tr><td>Kingdom:</td><td>Plantae</td></tr>
<tr><td>Genus:</td><td>Citrus</td></tr><tr><td>Species:</td><td>C. limon</td></tr>
<tr><td colspan="2"><span class="binomial">Citrus limon</span></td></tr></table><a href="/wiki/Rosids">r</a><a href="/wiki/Rosids">dup</a>
<a href="/wiki/File:Lemon.jpg">f</a><a href="/wiki/Plant#Uses">u</a><a href="https://example.org/">x</a><a>none</a></body></html>"""
    got = html.parse(page)
    assert [(h["rank"], h["name"]) for h in got["hierarchy"]] == [("kingdom", "plantae"), ("genus", "citrus"), ("species", "c. limon")]
    assert got["binomial"] == "citrus limon"
    pages = spark.createDataFrame([(1, "/wiki/Lemon", page), (2, "/wiki/No", "<a href='/wiki/A'></a>"), (3, "/wiki/Null", None)], "page_id long, url string, html string")
    assert [r["is"] for r in html.records(pages).orderBy("page_id").select(html.is_target(F.col("hierarchy")).alias("is")).collect()] == [True, False, False]
    assert [tuple(r) for r in html.wanted_links(pages, only_targets=True).collect()] == [(1, "/wiki/Rosids")]


def test_growth(spark):
    log = spark.createDataFrame([("q", i, i, float(v)) for i, v in enumerate([5, 5, 3, 9])], "event_type string, ts long, event_id long, value double")
    assert [(r["value"], r["previous_value"]) for r in metrics.growth(log).orderBy("ts").collect()] == [(5, 0), (9, 5)]
    rate = metrics.growth_rate(spark.createDataFrame([("q", 9.0), ("r", 1.0)], "event_type string, current double"), spark.createDataFrame([("q", 5.0), ("r", 0.0)], "event_type string, previous double"))
    assert [tuple(r) for r in rate.collect()] == [("q", 5.0, 9.0, 80.0)]


def test_stats(spark):
    rows = [("crawl", 1, 200.0)] * 10 + [("crawl", 2, 0.0)]
    got = metrics.summary(spark.createDataFrame(rows, "event_type string, user_id long, value double")).first()
    assert got["throughput"] == 5.0 and got["ops"] == 11
    assert metrics.prefix_total(spark.createDataFrame([(4000,), (4000,)], "prefixes long")).first()[0] == 6160


def test_map_reduce(spark):
    def mapper(key, value):
        if value == "bad":
            raise ValueError
        return [{c: 1} for c in value if c.strip()]

    rows = spark.createDataFrame([("1", "ab a"), ("2", "b"), ("3", "bad")], "key string, value string")
    got = {r["key"]: (r["result"], r["error"] is None) for r in mapreduce.map_reduce(rows, mapper, lambda k, v: sum(v)).collect()}
    assert got == {"a": ("2", True), "b": ("2", True), "3": (None, False)}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    store.put(rows, str(tmp_path / "kv"))
    assert [r["v"] for r in store.get(spark, str(tmp_path / "kv"), "b").collect()] == [2]


def test_engine(spark):
    from lexigrove.engine import HELP, Engine

    docs = spark.createDataFrame([(1, "tion ther thering ble shons erer whth extra words", 10)], "doc_id long, text string, n_chars long")
    e = Engine(spark, docs, _edges(spark, [("plantae", "rosids"), ("rosids", "[SPECIES] /wiki/R")]))
    assert e.command("help") == HELP and e.command("exit") is None
    assert [r["doc_id"] for r in e.command("tion ble").collect()] == [1]
    assert e.command("tree plantae --depth=1").count() == 2
    with pytest.raises(ValueError):
        e.command("crawl nowhere")


def test_crawl_of_targets(spark):
    from lexigrove.engine import Engine

    box = '<table class="infobox biota"><tr><td>Kingdom:</td><td>{}</td></tr></table>'
    rows = [(1, "https://host/wiki/A", '<a href="/wiki/B"></a><a href="/wiki/C"></a>'), (2, "https://host/wiki/B", box.format("Plantae") + '<a href="/wiki/D"></a>'), (3, "/wiki/C", box.format("Animalia") + '<a href="/wiki/E"></a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_chars long")
    e = Engine(spark, docs, pages=pages)
    assert {(r["node"], r["depth"]) for r in e.crawl("/wiki/A").collect()} == {("/wiki/A", 0), ("/wiki/B", 1), ("/wiki/C", 1), ("/wiki/D", 2)}
    assert {r["node"] for r in e.crawl("/wiki/A", only_targets=False).collect()} == {f"/wiki/{x}" for x in "ABCDE"}


def test_pause_and_resume(spark, tmp_path):
    """A job that is paused, and one made anew over its checkpoint, handle each document once."""
    from lexigrove.streaming import jobs

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda k: spark.createDataFrame([(k, f"word{'abc'[k]} common")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    put(0)
    start = lambda: jobs.stream_index(jobs.read_documents(spark, src, "doc_id long, text string"), f"{out}/rows", f"{out}/check", interval="1 second")
    job = jobs.Job(start).resume().caught_up()
    assert job.progress() and sum(n for _, n, _ in job.progress()) == 1
    job.pause()
    put(1)
    job.resume().caught_up().pause()
    put(2)
    jobs.Job(start).resume().caught_up().pause()
    got = {r["term"]: r["df"] for r in index.document_frequencies(jobs.current_index(spark, f"{out}/rows")).collect()}
    assert got == {"common": 3, "worda": 1, "wordb": 1, "wordc": 1}


def test_scopes_and_drops(spark, tmp_path):
    """A scope's tables go with it, but for those kept; threads don't see each other's scopes; a kept table can be dropped."""
    import threading
    from pathlib import Path

    from lexigrove.session import Scratch, cut, cut_by, drop

    at = lambda df: Path(df.__dict__["written_at"].removeprefix("file:"))
    ready, go, there = threading.Event(), threading.Event(), []

    def other():
        with Scratch(spark):
            mine = cut(spark.range(3))
            ready.set()
            go.wait(60)
            there.append(at(mine).exists())

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with Scratch(spark) as scratch:
        gone, kept = cut(spark.range(2)), scratch.keep(cut_by(spark.range(5), "id", 2))
    go.set()
    thread.join()
    assert there == [True] and not at(gone).exists() and kept.count() == 5
    assert drop(kept) and not at(kept).exists() and not drop(spark.range(1))


def test_sibling_order(spark):
    e = _edges(spark, [("r", "b"), ("r", "[SPECIES] /wiki/A"), ("r", "a"), ("a", "[SPECIES] /wiki/Z"), ("a", "z"), ("z", "[SPECIES] /wiki/Y")])
    from lexigrove.engine import Engine

    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_chars long")
    names = [r["name"] for r in Engine(spark, docs, e).tree("r").collect()]
    assert names[0] == "r" and names.index("a") < names.index("z") < names.index("b")
    assert {r["line"] for r in hierarchy.lines(hierarchy.tree(e, "r").where("not is_species")).collect()} == {"r", "  - a", "    - z", "  - b"}


def test_growth_log_as_csv(spark, tmp_path):
    store.write_csv(spark.createDataFrame([("q", 1.0)], "query string, pct double"), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "log")).collect()] == [("q", "1.0")]
