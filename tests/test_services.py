"""Fetches, throttles, crawls, levels, schedules, recovery and statistics against small known cases."""

import random
import threading
import time
from collections import deque
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import index, querier
from lexigrove.sources import fetch, html, store, summaries
from lexigrove.streaming import crawl, jobs, levels, recovery, schedule

# --- fetches ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, time.monotonic()))
            n = sum(p == self.path for p, _ in seen)
            if self.path == "/slow":
                time.sleep(3)
            if self.path == "/drip":  # the headers come at once, the rest never ends in time
                self.send_response(200)
                self.end_headers()
                try:
                    for _ in range(40):
                        self.wfile.write(b"x")
                        self.wfile.flush()
                        time.sleep(0.1)
                except OSError:
                    pass
                return
            code = 404 if self.path == "/none" else 500 if self.path == "/flaky" and n < 3 else 200
            self.send_response(code)
            self.end_headers()
            try:
                self.wfile.write(f"page {self.path}".encode())
            except OSError:
                pass

        def log_message(self, *_):
            pass

    at = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{at.server_port}", seen
    at.shutdown()


def test_page_source(spark, server):
    base, _ = server
    spark.dataSource.register(fetch.page_source())
    urls = [f"{base}/{p}" for p in ("a", "none", "flaky", "slow", "drip", "a", "b")] + ["http://127.0.0.1:9/refused", "not a url"]
    read = spark.read.format("fetched_pages").option("urls", "\n".join(urls) + "\n\n").options(delay="10", timeout="700", most="100", partitions="3")
    read.load().createOrReplaceTempView("fetched")
    got = {r["url"].replace(base, ""): r for r in spark.sql("SELECT * FROM fetched").collect()}
    assert len(got) == 8  # each url once
    assert {u: (r["status"], r["kind"], r["attempts"]) for u, r in got.items()} == {
        "/a": ("success", None, 1), "/b": ("success", None, 1), "/none": ("failed", "http 404", 3), "/flaky": ("success", None, 3),
        "/slow": ("failed", "timeout", 3), "/drip": ("failed", "timeout", 3), "http://127.0.0.1:9/refused": ("failed", "network", 3), "not a url": ("failed", "ValueError", 3),
    }
    assert got["/a"]["html"] == "page /a" and [t["kind"] for t in got["/flaky"]["tries"]] == ["http 500", "http 500", None]
    kinds = {r["kind"]: r["errors"] for r in fetch.error_kinds(spark.table("fetched").where("url like '%/none' or url like '%refused'")).collect()}
    assert kinds == {"http 404": 3, "network": 3, "all": 6}
    empty = spark.read.format("fetched_pages").load()
    assert empty.count() == 0


def test_fetched_by_host(spark, server):
    """No second holds more than 3 starts at a host, though its urls come from many partitions."""
    base, seen = server
    urls = spark.createDataFrame([(f"{base}/many/{k}",) for k in range(8)], "url string").repartition(8)
    got = fetch.fetched(urls, delay=5).collect()
    assert {r["status"] for r in got} == {"success"} and len(got) == 8 and all(r["html"].startswith("page /many/") for r in got)
    starts = sorted(t["started_ms"] for r in got for t in r["tries"])
    assert all(b - a >= 999 for a, b in zip(starts, starts[3:]))  # of whole ms
    assert sum(p.startswith("/many/") for p, _ in seen) == 8
    assert sum(r["waited_ms"] for r in got) > 0


def test_fetch_deadline_and_delays():
    """On a clock of steps: tries wait 1 s, then 2 s; the throttle's wait counts against the deadline; hosts don't wait for one another."""
    clock = fetch.StepClock()
    starts = []

    def slow(url, left):
        starts.append((url, clock.now(), left))
        clock.sleep(20_000 if "slow" in url else 5)
        if "bad" in url:
            raise ValueError(url)
        return url

    f = fetch.Fetcher(slow, clock)
    assert f.outcome("http://a/bad")[2:6] == ("failed", "ValueError", 3, 3000)
    assert [round(t) for _, t, _ in starts] == [0, 1005, 3010]
    assert f.outcome("http://b/slow")[3] == "timeout" and f.outcome(None)[3] == "no url"
    starts.clear()
    for k in range(5):
        f.outcome(f"http://c/{k}")
    at = [t for _, t, _ in starts]
    assert at[3] - at[0] == 1010 and 14_000 < starts[3][2] < 14_100 and starts[0][2] == 15_000
    f = fetch.Fetcher(lambda u, left: u, fetch.StepClock(), timeout=500)
    assert [f.outcome("http://d/x")[2] for _ in range(3)] == ["success"] * 3 and f.outcome("http://d/x")[3] is None
    assert f.outcome("http://d/x")[6][0][1] is None


def plain_throttle(times, most, window, margin):
    """By hand: one request after the other."""
    out, recent, now = [], deque(), None
    for t in times:
        now = t if now is None else max(now, t)
        live = [s for s in recent if now - s < window]
        if len(live) >= most:
            now = live[0] + window + margin
        recent = deque([s for s in live if now - s < window] + [now])
        out.append(now)
    return out


def test_throttle(spark):
    r = random.Random(3)
    rows = [(k, h, 1_700_000_000_000 + t) for k, (h, t) in enumerate((h, r.randrange(20_000)) for h in ["a", "b", "c", None] for _ in range(60))]
    df = spark.createDataFrame([(k, h, t, 1) for k, h, t in rows], "event_id long, host string, t long, by int").select("event_id", "host", F.timestamp_millis("t").alias("ts"), "by")
    got = {x["event_id"]: x for x in fetch.admitted(df, "host", "ts", "event_id").collect()}
    for h in ["a", "b", "c", None]:
        own = sorted((t, k) for k, x, t in rows if x == h)
        assert [got[k]["start_ms"] for _, k in own] == plain_throttle([t for t, _ in own], 3, 1000, 10)
        starts = sorted(got[k]["start_ms"] for _, k in own)
        assert all(b - a >= 1000 for a, b in zip(starts, starts[3:]))
        assert any(got[k]["wait_ms"] for _, k in own)
    assert fetch.admitted(df.limit(0), "host", "ts", "event_id").count() == 0


# --- crawls ----------------------------------------------------------------------------------------------


def by_hand(links, seeds, rounds):
    """node: (depth, place in its depth), as a first-in-first-out queue gives them."""
    queue, seen, out, n = deque((s, 0) for s in seeds), set(seeds), {}, {}
    while queue:
        node, depth = queue.popleft()
        n[depth] = n.get(depth, 0) + 1
        out[node] = (depth, n[depth])
        if depth < rounds:
            for _, dst in sorted(links.get(node, [])):
                if dst not in seen:
                    seen.add(dst)
                    queue.append((dst, depth + 1))
    return out


def test_crawl_as_stream(spark, tmp_path):
    """Nodes, depths and queue order of a plain queue; stopped in the middle and gone on with; seeds twice."""
    r = random.Random(9)
    links = {f"n{k}": [(p, f"n{r.randrange(60)}") for p in range(r.randint(0, 4))] for k in range(60)}
    table = spark.createDataFrame([(s, d, p) for s, own in links.items() for p, d in own], "src string, dst string, pos int")
    path, seeds, broken = str(tmp_path / "crawl"), ["n7", "n3", "n7"], []
    whole = crawl.over_links(table)

    def expand(new):
        if not broken and new.where("depth = 1").count():
            broken.append(1)
            raise RuntimeError("the crawler is lost")
        return whole(new)

    crawl.seed(spark, seeds, path)
    with pytest.raises(Exception, match="the crawler is lost"):
        crawl.run(spark, expand, path, 4)
    crawl.seed(spark, seeds, path)  # already seen
    crawl.run(spark, expand, path, 4)
    got = crawl.queue_order(crawl.crawled(spark, path)).collect()
    assert {x["node"]: (x["depth"], x["seq"]) for x in got} == by_hand(links, dict.fromkeys(seeds), 4) and len(got) == len({x["node"] for x in got})
    told = {x["status"]: x["n"] for x in crawl.sightings(spark, path).groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert told["admitted"] == len(got) and told["already_crawled"] > 0


# --- an index in levels ------------------------------------------------------------------------------------


def test_levels(spark, tmp_path):
    """20 batches equal one batch of the last versions; runs stay few; replays and readers of old snapshots are safe."""
    r = random.Random(1)
    runs = levels.Levels(spark, str(tmp_path / "l"), spark.createDataFrame([], "doc_id long, term string, n long, version long").schema)
    assert runs.current().count() == 0 and runs.compact() is False
    want, most, rewritten = {}, 0, 0
    for k in range(20):
        rows = {(r.randrange(40), f"t{r.randrange(5)}"): r.randrange(100) for _ in range(30)}
        df = spark.createDataFrame([(d, t, n, k) for (d, t), n in rows.items()] + [(1, "twice", k, k), (1, "twice", k, k)], runs.schema).coalesce(1)
        assert runs.append(df, k) and not runs.append(df, k)
        want |= rows | {(1, "twice"): k}
        most = max(most, len(runs.manifest()["runs"]))
        if k == 9:
            old, then = runs.versions()[-1], {(x["doc_id"], x["term"]): x["n"] for x in runs.current().collect()}
            assert then == want and {(x["doc_id"], x["term"]): x["n"] for x in runs.current(old).collect()} == then
    assert {(x["doc_id"], x["term"]): x["n"] for x in runs.current().collect()} == want
    assert most <= 3 * 3 and len(runs.versions()) <= levels.KEPT
    assert runs.stored() <= 3 * len(want)
    assert runs.compact(everything=True) and runs.stored() == len(want)  # nothing that is read is superseded
    assert {(x["doc_id"], x["term"]): x["n"] for x in runs.current().collect()} == want
    assert not any(w in runs.current()._jdf.queryExecution().toString() for w in ("Exchange", "Aggregate"))
    runs.clean(1)
    names = {p.name for p in (tmp_path / "l").iterdir()}
    assert names == {"manifests", *(x["name"] for x in runs.manifest()["runs"])}


def test_stream_in_levels(spark, tmp_path):
    """A stream of files, one a batch, and the same after a restart that runs the last batch again."""
    src, texts = str(tmp_path / "in"), {k: f"word{'abcdefgh'[k % 8]} common term{'xyz'[k % 3]}" for k in range(5)}
    for k, t in texts.items():
        spark.createDataFrame([(k, t)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    runs = levels.index_levels(spark, str(tmp_path / "l"), fanout=2)
    for check in ("check", "other"):  # a lost checkpoint: all batches come again
        docs = jobs.read_documents(spark, src, "doc_id long, text string", 1)
        levels.stream_levels(docs, runs, str(tmp_path / check)).awaitTermination()
        got = {x["term"]: x["df"] for x in index.document_frequencies(runs.current()).collect()}
        assert got["common"] == 5 and got["worda"] == 1 and got["termx"] == 2
    assert runs.manifest()["batch"] == 4


# --- schedules, recovery, statistics -------------------------------------------------------------------------


def test_tracker(spark, tmp_path):
    counts = {"a": [0, 3, 3, 2, 5], "b": [1, 1, 2, 2, 2]}
    t = schedule.Tracker(spark, lambda q: counts[q].pop(0), ["a", "b"], str(tmp_path / "t"), "n1", lambda: 0)
    for run in range(5):
        t.step(run)
    got = sorted(tuple(x) for x in t.log().select("run", "query", "count", "previous_count", "node", "timestamp").collect())
    at = ("n1", "1970-01-01T00:00:00Z")
    assert got == [(0, "b", 1, 0, *at), (1, "a", 3, 0, *at), (2, "b", 2, 1, *at), (4, "a", 5, 3, *at)]
    counts |= {"a": [9], "b": [2]}
    assert schedule.Tracker(spark, lambda q: counts[q].pop(0), ["a", "b"], str(tmp_path / "t")).step(5)[0][1:] == ("a", 9, "driver", 5)  # another driver goes on
    header = next((tmp_path / "t/log/run=0").glob("*.csv")).read_text().split("\n")[0]
    assert header == "timestamp,query,count,node,previous_count"


def test_tracker_on_schedule(spark, tmp_path):
    asked = []
    t = schedule.Tracker(spark, lambda q: asked.append(q) or len(asked), ["a"], str(tmp_path / "t"))
    t.run_times(3)
    assert len(asked) >= 3 and t.log().count() >= 3


def test_merged_logs(spark):
    rows = [("q", 5, 10.0, "n2"), ("q", 7, 3.0, "n3"), ("q", 7, 4.0, "n1"), ("q", None, 99.0, "n0"), ("r", 1, None, "n1"), (None, 9, 1.0, "n1"), ("q", 7, 3.5, "n1")]
    df = spark.createDataFrame(rows, "query string, t long, count double, node string").withColumn("timestamp", F.timestamp_seconds("t"))
    got = {x["query"]: (x["count"], x["node"]) for x in schedule.merged(df).collect()}
    assert got == {"q": (4.0, "n1"), "r": (None, "n1")} and schedule.merged(df.limit(0)).count() == 0
    maps = spark.createDataFrame([("n1", {"q": (1, 2.0)}), ("n2", {"q": (3, 1.0), "s": (1, 1.0)}), ("n3", None)], "node string, queries map<string, struct<t: long, count: double>>")
    shaped = maps.withColumn("queries", F.transform_values("queries", lambda k, v: F.struct(F.timestamp_seconds(v["t"]).alias("timestamp"), v["count"].alias("count"))))
    assert {x["query"]: (x["count"], x["node"]) for x in schedule.merged(schedule.maps_as_rows(shaped)).collect()} == {"q": (1.0, "n2"), "s": (1.0, "n2")}


def test_recovery(spark, tmp_path):
    """A pause and a crash: latencies, batches and rows of each run, and every row handled once."""
    src, crashed = str(tmp_path / "in"), []
    put = lambda k: spark.createDataFrame([(k,)], "k long").coalesce(1).write.mode("append").parquet(src)

    def start(name):
        def write(batch, number):
            if name == "b" and number == 1 and not crashed:
                crashed.append(1)
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(str(tmp_path / name / f"batch={number}"))

        docs = spark.readStream.schema("k long").parquet(src)
        return lambda: docs.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(processingTime="0 seconds").start()

    put(0)
    during = []
    with recovery.Recovery(spark, {n: jobs.Job(start(n)) for n in "ab"}) as r:
        r.settle()
        r.cycle(lambda: during.append([j.query.isActive for j in r.jobs.values()]))
        put(1)
        r.settle()
        r.cycle(lambda: put(2))
        r.settle()
        got = {(x["cycle"], x["job"]): x for x in r.table().collect()}
    assert during == [[False, False]]
    assert {k: (x["cause"], x["batches"], x["rows"]) for k, x in got.items()} == {(1, "a"): ("pause", 1, 1), (1, "b"): ("pause", 1, 1), (2, "a"): ("pause", 1, 1), (2, "b"): ("crash", 0, 0)}
    assert all((x["paused_ms"] is None) == (x["cause"] == "crash") and x["lag_ms"] >= 0 for x in got.values()) and "lost" in got[2, "b"]["error"]
    for name in "ab":
        assert sorted(x["k"] for x in spark.read.parquet(str(tmp_path / name)).collect()) == [0, 1, 2]


def test_querier(spark, tmp_path):
    def answer(q):
        if q == "bad":
            raise ValueError(q)
        return spark.range(len(q.split()) if q else 0)

    ticks = iter(range(1000))
    q = querier.Querier(spark, str(tmp_path / "asked"), answer, lambda t: spark.range(30), clock=lambda: next(ticks))
    assert [len(q.ask("a b")[0]), q.ask("a b")[1], *q.ask("")] == [2, 2, [], 0]
    rows, n = q.ask("x", "range", 5, "id")
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4] and n == 30
    with pytest.raises(ValueError):
        q.ask("bad")
    got = querier.node_statistics(q.asked()).collect()[0].asDict()
    assert got == {"node": "driver", "queries": 4, "ranges": 1, "total": 5, "failed": 1, "empty": 1, "results": 4, "avg_query_ms": 1000.0, "avg_range_ms": 1000.0, "avg_results": 4 / 3}
    ms, n = q.probe(("citrus", "leafy sour", "north water seed"))
    assert n == 2.0 and ms == 3000.0 and q.probe(("bad", "a"))[1] == 0.5
    assert querier.average([]) == 0.0
    none = querier.node_statistics(q.asked().limit(0))
    assert none.count() == 0 and querier.cluster_statistics(none).first().asDict()["avg_results"] == 0.0
    two = spark.createDataFrame([("a", "query", "q", 10.0, 4, False), ("b", "query", "q", 30.0, 0, False), ("b", "range", "q", 8.0, 2, False), ("c", "query", "q", None, None, True)], querier.ASKED)
    all_ = querier.cluster_statistics(querier.node_statistics(two)).first().asDict()
    assert (all_["nodes"], all_["queries"], all_["empty"], all_["failed"], all_["avg_results"]) == (3, 3, 1, 1, 2.0)
    assert round(all_["avg_query_ms"], 6) == round(40 / 3, 6) and round(all_["avg_range_ms"], 6) == round(8 / 3, 6)


# --- sources ---------------------------------------------------------------------------------------------------


def test_many_keys(spark, tmp_path):
    rows = spark.createDataFrame([(f"/wiki/{k}é", k) for k in range(500)], "key string, v long")
    path = str(tmp_path / "kv")
    store.put_sorted(rows, path, 16)
    told = {r["key"]: r["b"] for r in rows.select("key", store.bucket("key", 16).alias("b")).collect()}
    assert all(store.bucket_of(k, 16) == b for k, b in told.items())
    keys = [f"/wiki/{k}é" for k in (3, 77, 499, 3)]
    got = store.get_many(spark, path, [*keys, "/wiki/none"], rows.schema, 16)
    assert sorted(r["v"] for r in got.collect()) == [3, 77, 499]
    assert len(got.inputFiles()) <= 4 and {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()} <= {str(store.bucket_of(k, 16)) for k in [*keys, "/wiki/none"]}
    assert "PushedFilters: [In(key" in got._jdf.queryExecution().toString()
    assert store.get_many(spark, path, [], rows.schema, 16).count() == 0
    assert sorted(r["v"] for r in store.get_frame(rows, spark.createDataFrame([(k,) for k in keys], "key string")).collect()) == [3, 77, 499]


def test_anchors(spark):
    from html.parser import HTMLParser

    class Hrefs(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                own = [v or "" for k, v in attrs if k == "href"]
                self.found += own[:1]

        handle_startendtag = handle_starttag

    pages = [
        '<a href="/wiki/A">x</a><A HREF=\'/wiki/B\'>y</A><a class=x href=/wiki/C>z</a>',
        '<a title="a > b" data-href="/no" href = "/wiki/D?x=1&amp;y=2">x</a><a href>n</a><a name="n">o</a><a>p</a>',
        "<abbr href=\"/no\">x</abbr><!-- <a href='/no'> --><script>'<a href=\"/no\">'</script><STYLE><a href=/no></STYLE><a\nhref='/wiki/\"E\"'\n>",
        '<a href="/first" href="/second">x</a><a href="">e</a><a/href="/slash"/><a HrEf="/wiki/ü é">u</a>',
        "<a title=don't href=/wiki/F>x</a><a href=/wiki/G/>y</a><a data-x href='&lt;q&gt;&quot;'>z</a>",
        "", None, "no links", '<a ' + " ".join(f'x{k}="{k}"' for k in range(5000)) + ' href="/far">x</a>', "<a href='/unclosed", "<!-- <a href=/no>",
    ]
    df = spark.createDataFrame([(k, p, 1) for k, p in enumerate(pages)], "page_id long, html string, pos int")
    got: dict = {}
    for r in html.anchors(df).orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["href"])
    for k, p in enumerate(pages):
        h = Hrefs()
        h.feed(p or "")
        want = h.found
        assert got.get(k, []) == want, p


def test_summaries(spark):
    records = spark.createDataFrame([(1, "u1", "alpha"), (2, "u2", "beta"), (3, "u3", "gamma"), (4, "u4", None), (5, None, "eta"), (6, "u6", ""), (7, "u7", "theta")], "page_id long, url string, binomial string")
    told = [("u1", '{"title": "lemon", "extract": "a\\u0001b\\nc", "x": [1]}'), ("u2", '{"title": "Not found."}'), ("u3", "<html>"), (None, '{"title": "no"}'), ("u6", None), ("u7", '{"title": "b"}'), ("u7", '{"title": "a"}'), ("u9", "{}")]
    got = {r["page_id"]: (r["title"], r["description"]) for r in summaries.with_summaries(records, spark.createDataFrame(told, "url string, payload string")).collect()}
    assert got == {1: ("Lemon", "a b c"), 2: ("Beta", ""), 3: ("Gamma", ""), 4: ("", ""), 5: ("Eta", ""), 6: ("", ""), 7: ("A", "")}
