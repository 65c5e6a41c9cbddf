"""Text for a user's eyes, and the smaller parts of stores, frontiers and engines."""

import hashlib
import textwrap

from pyspark.sql import functions as F

from lexigrove.functions import display, text
from lexigrove.operators import frontier, hierarchy, index
from lexigrove.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def test_lines_and_figures(spark):
    said = "the quick  brown\nfox jumps over thelazydogthatislong end"
    for width in (5, 10, 16, 80):
        assert one(spark, display.wrapped(F.lit(said), width)) == textwrap.wrap(" ".join(said.split()), width, break_long_words=False, break_on_hyphens=False)
    red = "\x1b[31mred\x1b[0m word"
    assert one(spark, display.without_colours(F.lit(red))) == "red word" and one(spark, display.wrapped(F.lit(red), 8)) == [red]
    assert one(spark, display.wrapped(F.lit(None).cast("string"), 8)) == [] and one(spark, display.wrapped(F.lit(" \n"), 8)) == []
    assert [one(spark, display.shown_time(F.lit(ms))) for ms in (0, 999, 1000, 61_234)] == ["0ms", "999ms", "1.00s", "61.23s"]
    assert one(spark, display.shown_number(F.lit(1234567))) == "1,234,567"
    assert [one(spark, display.bar(F.lit(x), 4)) for x in (0.5, -1.0, 7.0, None)] == ["██░░", "░░░░", "████", "░░░░"]


def test_boxes(spark):
    meta = "struct<taxonomy_level: string, is_binomial: boolean, kingdom: string, family: string, binomial: string>"
    rows = [(1, 2, 1.25, ("genus", True, "plantae", "rutaceae", "citrus  limon"), "/wiki/A", "long text " * 60, [("kingdom", "plantae")]), (2, 1, 0.5, (None, False, None, "", ""), "/wiki/B_b", None, [])]
    df = spark.createDataFrame(rows, f"rank int, matched_terms long, score double, meta {meta}, key string, d string, h array<struct<rank: string, name: string>>")
    first, second = [r["box"].split("\n") for r in display.result_boxes(df, 3, F.col("key"), F.col("d"), F.col("h"), 60).orderBy("rank").collect()]
    assert {len(x) for x in first + second} == {60} and first[0] == "┌" + "─" * 58 + "┐" and first[-1] == "└" + "─" * 58 + "┘"
    told = [x[2:-2].rstrip() for x in first]
    assert told[1] == "1. CITRUS LIMON" and "Score: 1.2500 (matched 2/3 terms)" in told and "  ✓ Taxonomy match: genus" in told and told.count("...") == 1
    assert sum("long text" in x for x in told) == display.LINES and "  kingdom: plantae" in told
    assert [x[2:-2].rstrip() for x in second if not x.startswith(("┌", "├", "└"))] == ["2. B_B", "URL: https://www.wikipedia.org/wiki/B_b", "Score: 0.5000 (matched 1/3 terms)"]


def test_tokens_of_odd_letters(spark):
    assert one(spark, text.tokens(F.lit("TwoKhree İstanbul naïve snake_case A1 WORD abc"))) == ["two", "hree", "stanbul", "word", "abc"]


def test_ids(spark):
    at = F.timestamp_millis(F.lit(5))
    want = hashlib.sha256(b'{"message":"a\\"b","date":5}').hexdigest()
    assert one(spark, text.message_id(F.lit('a"b'), at)) == want != one(spark, text.message_id(F.lit('a"b'), F.timestamp_millis(F.lit(6))))


def test_memory(spark):
    kv = lambda *rows: spark.createDataFrame(list(rows), "key string, v long")
    m = store.Memory(kv(("a", 1), ("b", 2)))
    for k in range(20):  # past the point at which all is written once
        m.put(kv(("a", k), (f"k{k}", k)))
    assert m.get("a").first()["v"] == 19 and m.get().count() == 22 and m.delete("b") and not m.delete("b")
    assert m.get("b").isEmpty() and m.get().count() == 21
    files = kv(("x/.DS_Store", 1), (".DS_Store", 1), ("a.DS_Store", 1), (None, 1))
    assert [r["key"] for r in store.without_system_files(files).collect()] == ["a.DS_Store", None]


def test_seeds(spark):
    links = lambda *own: spark.createDataFrame([(x,) for x in own], "href string")
    status, queue = frontier.insert(links("/wiki/A", "/wiki/B", "/wiki/C", "/wiki/C", "http://x", None), links("/wiki/A"), links("/wiki/B"))
    assert {r["href"]: r["status"] for r in status.collect()} == {"/wiki/A": "already_in_queue", "/wiki/B": "already_crawled", "/wiki/C": "admitted", "http://x": "refused", None: "refused"}
    assert sorted(r["href"] for r in queue.collect()) == ["/wiki/A", "/wiki/C"]


def test_top_terms(spark):
    counts = spark.createDataFrame([(d, t) for t, n in {"aaa": 3, "aab": 3, "aac": 1, "aad": 5, "bbb": 1}.items() for d in range(n)], "doc_id long, term string")
    assert sorted((r["prefix"], r["place"], r["term"], r["df"]) for r in index.top_terms(counts).collect()) == [("aa", 1, "aad", 5), ("aa", 2, "aaa", 3), ("aa", 3, "aab", 3), ("bb", 1, "bbb", 1)]


def test_repeats_of_a_diamond(spark):
    edges = [("r", "a", False), ("r", "b", False), ("a", "x", False), ("b", "x", False), ("x", "[SPECIES] /wiki/S", True), ("x", "r", False), ("r", "[SPECIES] /wiki/T", True)]
    df = spark.createDataFrame(edges, "parent string, child string, is_species boolean")
    got = sorted(r["url"] for r in hierarchy.descendants_with_repeats(df, "R").collect())
    # each path to x meets S, and each goes back to r once, whose children are seen on the way
    assert got.count("/wiki/S") == 2 and got.count("/wiki/T") == 3


def test_engine_writes_its_index_once(spark):
    from lexigrove.engine import Engine

    docs = spark.createDataFrame([(1, "tion ther thering ble shons erer whth extra words", 10)], "doc_id long, text string, n_chars long")
    e = Engine(spark, docs)
    assert e.postings is e.postings and e.postings.inputFiles()
    box = e.boxes("tion ble").first()["box"]
    assert box.split("\n")[1].startswith("│ 1. ERER WHTH") and "Description:" in box
