"""Queries against DuckDB on tables that hold their rows again under other keys."""

import duckdb
import pytest

from lexigrove.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """Pages with each url and text three times."""
    at = tmp_path_factory.mktemp("copies")
    duckdb.execute(f"COPY (SELECT page_id + 100003 * k AS page_id, url, html FROM read_parquet('{SF}/pages.parquet'), range(3) t(k)) TO '{at}/pages.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["fetch_outcomes", "fetch_error_kinds", "summary_join"])
def test_urls_that_come_again(name, spark, same, twice):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{twice}/pages.parquet')")
        same(QUERIES[name](spark, twice).toPandas(), con.execute(SQL[name]).fetch_df())


def test_postings_stay_where_they_are(spark):
    """No shuffle puts a large shard in one task, words are made once, and runs of words and ranks are right for odd names."""
    from lexigrove.operators import index

    text = "aaa bbb ccc ddd eee fff ggg aaa aaab aaab zzz bb"
    docs = spark.createDataFrame([(1, text, 9), (2, None, 0), (3, "too few", 1)], "doc_id long, text string, n_chars int")
    rows = index.in_shards(index.postings(index.species(docs)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all(lower(") == 1
    got = [(r["term"], round(r["tf"] * 9), r["taxonomy_level"], r["kingdom"], r["family"]) for r in rows.collect()]
    ranks = dict(zip(["aaa", "bbb", "ccc", "ddd", "eee", "fff", "ggg"], index.RANKS, strict=True))
    assert got == [(w, n, ranks.get(w), "aaa", "eee") for w, n in {"aaa": 2, "aaab": 2, "bbb": 1, "ccc": 1, "ddd": 1, "eee": 1, "fff": 1, "ggg": 1, "zzz": 1}.items()]
    assert sum(r["leads"] for r in rows.collect()) == 1


def test_newest_in_as_many_tasks_as_rows_take(spark, tmp_path):
    """A task's rows are bounded and nothing is sorted, and columns of one row stay together, nulls among them."""
    from lexigrove.streaming import levels

    runs = levels.index_levels(spark, str(tmp_path / "l"))
    rows = spark.createDataFrame([(1, "a", 1, 0.1, True, 0), (1, "a", None, 0.2, False, 2), (1, "a", 3, None, True, 1), (None, "a", 4, 0.4, None, 5)], runs.schema)
    many = runs.newest(rows, 5 * levels.ROWS_A_TASK)
    assert many.rdd.getNumPartitions() == 6 and "Sort" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect()), key=str) == sorted([(1, "a", None, 0.2, False, 2), (None, "a", 4, 0.4, None, 5)], key=str)
    assert runs.append(rows, 0) and runs.current().count() == 2 and len(list((tmp_path / "l").iterdir())) == 2


def test_crawl_copies_no_links(spark):
    before = spark.catalog.listTables()
    assert QUERIES["stream_crawl"](spark, SF).count() > 0
    assert len(spark.catalog.listTables()) == len(before)


def test_pages_in_small_batches(spark):
    from lexigrove.sources import html

    key, pages = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{SF}/pages.parquet")
    for parse in (html.records, lambda p: html.wanted_links(p, only_targets=True)):
        spark.conf.unset(key)
        parse(pages)
        assert spark.conf.get(key) == "4194304b"


def test_texts_cut_within_a_reference(spark, same, tmp_path):
    """Titles, paragraphs and pages that end anywhere within a reference, and a page without html, against the SQL."""
    from lexigrove.sources import html

    cuts = [r[:k] for r in ("&amp;", "&quot;", "&copy;", "&middot;") for k in range(1, len(r) + 1)]
    cuts += ["&quot=;", "&quotes;", "&ampquot;", "&copy 2020", "&copyright", "&#3", "&#x2", "&#", "&&quot", "\ue000&quot"]
    page = "'<title>a ' || c || '</title><script>var t=\"</p>\";track(1);</script><p class=\"x\">b &amp; ' || c || '</p><!-- ad --><p>' || c"
    rows = ", ".join(f"({k}, '{c}')" for k, c in enumerate(cuts))
    duckdb.execute(f"COPY (SELECT k AS page_id, 'u' AS url, {page} AS html FROM (VALUES {rows}) t(k, c) UNION ALL SELECT -1, 'u', NULL) TO '{tmp_path}/pages.parquet'")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
        same(QUERIES["page_text"](spark, str(tmp_path)).toPandas(), con.execute(SQL["page_text"]).fetch_df())
    assert html.parse("<script>a&quotb</script>\ue000&quot &lt;&#39;", whole=True)["body"] == "a&quotb\ue000&quot <'"
    assert html.parse("<p>&quot")["body"] == '"'
