"""Pages from elsewhere: fetches with a deadline, retries and a rate limit for each host, as a transformation of a table of
urls and as a data source (`spark.read.format`)."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tries, ms before the second one (doubled each time), ms until a try is aborted.
TRIES, DELAY, TIMEOUT = 3, 1000, 15_000
#: Starts that a host sees in a window of so many ms, and ms that a wait takes beyond the window.
MOST, WINDOW, MARGIN = 3, 1000, 10
#: What a fetch comes to: `tries` has the start of each try and how it failed (null: it didn't).
OUTCOME = "url string, host string, status string, kind string, attempts int, waited_ms long, tries array<struct<started_ms:long,kind:string>>, html string, error string"
#: Hosts that a worker remembers; those whose window has passed go first.
HOSTS = 10_000


class WallClock:
    def now(self) -> float:
        return time.monotonic() * 1000

    def sleep(self, ms: float) -> None:
        time.sleep(ms / 1000)


class StepClock:
    """A clock that only sleeping moves, for tests and for plans that are made ahead."""

    def __init__(self, at: float = 0):
        self.at = at

    def now(self) -> float:
        return self.at

    def sleep(self, ms: float) -> None:
        self.at += ms


class Throttle:
    """Lets at most `most` through in any `window` ms; who comes too early waits until the oldest leaves it, and `margin` ms."""

    def __init__(self, clock, most: int = MOST, window: float = WINDOW, margin: float = MARGIN):
        self.clock, self.most, self.window, self.margin = clock, most, window, margin
        self.starts: deque[float] = deque()

    def idle(self) -> bool:
        return not self.starts or self.clock.now() - self.starts[-1] >= self.window

    def pass_through(self) -> float:
        """Wait if need be; the ms that it took."""
        came = self.clock.now()
        while True:
            now = self.clock.now()
            while self.starts and now - self.starts[0] >= self.window:
                self.starts.popleft()
            if len(self.starts) < self.most:
                self.starts.append(now)
                return now - came
            self.clock.sleep(self.window - (now - self.starts[0]) + self.margin)


def http(url: str, left: float) -> str:
    """The text at a url; reads in small parts, so that it can stop when `left` ms are over."""
    until = time.monotonic() + left / 1000
    with urllib.request.urlopen(url, timeout=max(0.001, left / 1000)) as answer:
        parts = []
        while part := answer.read1(65536):
            parts.append(part)
            if time.monotonic() > until:
                raise TimeoutError(f"{url}: over {left:.0f} ms")
        return b"".join(parts).decode(answer.headers.get_content_charset() or "utf-8", "replace")


def guarded(fetch: Callable[[str, float], str]) -> Callable[[str, float], str]:
    """fetch, given up after its time even if it doesn't stop by itself: it goes on in a thread that nothing waits for."""

    def run(url: str, left: float) -> str:
        got: list = []

        def work() -> None:
            try:
                got.append((fetch(url, left), None))
            except Exception as e:  # noqa: BLE001  handed on below
                got.append((None, e))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(left / 1000)
        if not got:
            raise TimeoutError(f"{url}: over {left:.0f} ms")
        html, error = got[0]
        if error is not None:
            raise error
        return html

    return run


def kind_of(error: Exception) -> str:
    """timeout, http <status>, network, or the error's name."""
    if isinstance(error, urllib.error.HTTPError):
        return f"http {error.code}"
    reason = getattr(error, "reason", error)
    if isinstance(error, TimeoutError) or isinstance(reason, TimeoutError):
        return "timeout"
    return "network" if isinstance(error, OSError) else type(error).__name__


class Fetcher:
    """Fetches urls one after the other, each with its host's Throttle. fetch(url, ms left) gives a text or raises."""

    def __init__(self, fetch, clock=None, tries: int = TRIES, delay: float = DELAY, timeout: float = TIMEOUT, most: int = MOST, window: float = WINDOW):
        self.clock = clock or WallClock()
        self.fetch = fetch if clock else guarded(fetch)  # a clock of one's own stands still in a thread
        self.tries, self.delay, self.timeout, self.most, self.window = tries, delay, timeout, most, window
        self.hosts: dict[str, Throttle] = {}

    def throttle(self, host: str) -> Throttle:
        if host not in self.hosts and len(self.hosts) >= HOSTS:
            self.hosts = {h: t for h, t in self.hosts.items() if not t.idle()}
        return self.hosts.setdefault(host, Throttle(self.clock, self.most, self.window))

    def outcome(self, url: str | None) -> tuple:
        """A row of OUTCOME. The time that a try has also holds the throttle's wait. A null url is an error without a try."""
        if url is None:
            return None, None, "failed", "no url", 0, 0, [], None, "no url"
        host, clock, waited, done = host_name(url), self.clock, 0.0, []
        for k in range(self.tries):
            began = clock.now()
            waited += self.throttle(host).pass_through()
            started = clock.now()
            try:
                left = self.timeout - (started - began)
                if left <= 0:
                    raise TimeoutError(f"{url}: no time left after the throttle")
                html = self.fetch(url, left)
                if clock.now() - began > self.timeout:
                    raise TimeoutError(f"{url}: over {self.timeout:.0f} ms")
                return url, host, "success", None, k + 1, int(waited), [*done, (int(started), None)], html, None
            except Exception as e:  # noqa: BLE001  whatever a fetch may raise becomes a row
                error = e
                done.append((int(started), kind_of(e)))
            if k + 1 < self.tries:
                clock.sleep(self.delay * 2**k)
                waited += self.delay * 2**k
        return url, host, "failed", done[-1][1], self.tries, int(waited), done, None, f"{type(error).__name__}: {error}"


def host_name(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


def host_of(url: Column) -> Column:
    """As host_name(), for dealing out: what lies between // and the path."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def fetched(urls: DataFrame, fetch=http, clock: Callable | None = None, order: str = "url", **limits) -> DataFrame:
    """OUTCOME of each row's url, in a task for each host's urls, so that its limit holds in all the cluster.

    fetch(url, ms left) is called in the workers; clock() makes the clock of a task (that on the wall). Rows go through in batches, in
    the order of `order` for each host; a host is as slow as its limit, and takes no memory but that of a batch.
    """
    cols = list(dict.fromkeys(["url", order]))
    dealt = urls.select(*cols).withColumn("host_", host_of(F.col("url"))).repartition("host_").sortWithinPartitions("host_", order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(fetch, clock() if clock else None, **limits)
        for frame in frames:
            yield pd.DataFrame([fetcher.outcome(u if isinstance(u, str) else None) for u in frame["url"]], columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return dealt.select("url").mapInPandas(run, OUTCOME)


def error_kinds(outcomes: DataFrame) -> DataFrame:
    """kind, errors: all tries that failed, by kind; a row for all fetches (kind `all`) with its tries."""
    each = outcomes.select(F.explode("tries.kind").alias("kind"))
    return each.where("kind is not null").groupBy("kind").agg(F.count("*").alias("errors")).unionByName(each.agg(F.lit("all").alias("kind"), F.count("kind").alias("errors")))


class _Share(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, fetch, options):
        self.fetch, self.options = fetch, options

    def partitions(self) -> list[InputPartition]:
        """The urls by host: all of one host's are in one share."""
        n = int(self.options.get("partitions", "8"))
        shares: list[list[str]] = [[] for _ in range(n)]
        place: dict[str, int] = {}
        for url in dict.fromkeys(u.strip() for u in self.options.get("urls", "").split("\n")):
            if url:
                shares[place.setdefault(host_name(url), min(range(n), key=lambda k: len(shares[k])))].append(url)
        return [_Share(s) for s in shares if s] or [_Share([])]

    def read(self, partition: _Share) -> Iterator[tuple]:
        number = lambda k, v: float(self.options.get(k, v))
        limits = {"tries": int(number("tries", TRIES)), "delay": number("delay", DELAY), "timeout": number("timeout", TIMEOUT), "most": int(number("most", MOST)), "window": number("window", WINDOW)}
        fetcher = Fetcher(self.fetch, None, **limits)
        for url in partition.urls:
            yield fetcher.outcome(url)


def page_source(fetch=http, name: str = "fetched_pages") -> type[DataSource]:
    """A data source over a fetch function: spark.dataSource.register(page_source()), then
    spark.read.format("fetched_pages").option("urls", lines).load() has a row of OUTCOME for each distinct url.

    For lists that a driver holds, such as seeds or a round of a crawl; fetched() takes a table of any size. Options: urls
    (one a line), partitions, tries, delay, timeout, most, window (in ms).
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return OUTCOME

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, dict(self.options))

    return Pages


def admitted(requests: DataFrame, host: str, at: str, by: str, most: int = MOST, window: int = WINDOW, margin: int = MARGIN) -> DataFrame:
    """When each request may start, and how long it waits: `by`, host, came_ms, start_ms, wait_ms.

    Requests of one host are taken one after the other by (at, by), each as Throttle would let it through. A task keeps only
    the last `most` starts of the host that it is at, whatever the host's requests; those without a time aren't asked.
    """
    came = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1000)
    kinds = dict(requests.dtypes)
    rows = requests.where(F.col(at).isNotNull()).select(F.col(host).cast("string").alias("host"), F.col(by).alias("own"), came.alias("came_ms"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    dealt = rows.repartition("host").sortWithinPartitions("host", "us", "own").select("host", F.col("own").cast("string").alias("by"), "came_ms")

    def run(frames):
        last, clock, throttle = object(), StepClock(), None
        for frame in frames:
            starts = []
            for h, t in zip(frame["host"], frame["came_ms"], strict=True):
                if throttle is None or h != last:
                    last, clock = h, StepClock()
                    throttle = Throttle(clock, most, window, margin)
                clock.at = max(clock.at, t) if throttle.starts else t
                throttle.pass_through()
                starts.append(int(clock.at))
            yield frame.assign(start_ms=starts, wait_ms=[s - t for s, t in zip(starts, frame["came_ms"], strict=True)])

    out = dealt.mapInPandas(run, "host string, by string, came_ms long, start_ms long, wait_ms long")
    return out.select(F.col("by").cast(kinds[by]).alias(by), F.col("host").cast(kinds[host]).alias("host"), "came_ms", "start_ms", "wait_ms")
