"""URL rules by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
#: Rules that one sweep holds; more are swept in slices of this many.
MOST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the
    end. Both empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def key(host: str) -> str:
    """Labels last to first, each closed by \\x00: the keys of a host and of its subdomains, and no other,
    start with the host's key, so that they are one interval."""
    return "".join(f"{label}\x00" for label in reversed(host.split(".")))


def sweep(keys: Iterable[tuple[str, str, object]], rules: list[tuple[str, str, str]]):
    """For (host key, path, row) sorted by host key: (row, index of the longest fitting rule or -1).

    Rules open at the start of the interval of keys that begin with theirs, and close after its end. As intervals of
    keys are nested or apart, those open form a stack, innermost last; of these the longest whose path
    starts the url's path is taken (a longer host first, then a longer path).
    """
    order = sorted(range(len(rules)), key=lambda k: (key(rules[k][0]), len(rules[k][1]), rules[k][1], -k))
    starts = [key(rules[k][0]) for k in order]
    stack: list[tuple[str, int]] = []
    nxt = 0
    for at, path, row in keys:
        while nxt < len(order) and starts[nxt] <= at:
            while stack and not starts[nxt].startswith(stack[-1][0]):
                stack.pop()
            stack.append((starts[nxt], order[nxt]))
            nxt += 1
        while stack and not at.startswith(stack[-1][0]):
            stack.pop()
        yield row, next((k for _, k in reversed(stack) if path.startswith(rules[k][1])), -1)


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, most: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row; no shuffle: each partition is sorted by key where it
    is and swept against the sorted rules, of which one sweep holds `most` (a host of any frequency may lie
    in many partitions).

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest wins: by
    host, then path, then the first given. Without one, rule is null and the verdict `default`.
    Cases: null urls and those without :// have an empty host and path and meet no rule; repeated rows and null
    page_ids are kept; an empty table gives no rows; other columns are not read.
    """
    rules = [(h.lower().rstrip("."), p, v) for h, p, v in rules]
    host, path = host_and_path(F.col("url"))
    reverse = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\x00"), F.lit("\x00"))
    none = F.lit(None).cast("string")
    out = pages.select(F.col("page_id").cast("string").alias("id"), host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    for low in range(0, len(rules), most):
        shared = pages.sparkSession.sparkContext.broadcast(rules[low : low + most])

        def run(frames, shared=shared):
            part, held, found = shared.value, [], []

            def keys():
                for frame in frames:
                    held.append(frame)
                    yield from zip(frame["at"], frame["path"], [None] * len(frame), strict=True)

            for _, k in sweep(keys(), part):
                found.append(k)
                if len(found) == len(held[0]):
                    yield _longer(held.pop(0), [part[k] if k >= 0 else None for k in found])
                    found = []

        out = out.withColumn("at", reverse).sortWithinPartitions("at").mapInPandas(run, "id string, host string, path string, rule string, verdict string")
    return out.select(F.col("id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _longer(frame: pd.DataFrame, new: list) -> pd.DataFrame:
    """The rule so far gives way to a longer one: all fit one host, so that more host means a longer rule."""
    size = lambda rule: (len(rule.partition("/")[0]), len(rule))
    rows = zip(frame["rule"], frame["verdict"], new, strict=True)
    got = [(n[0] + n[1], n[2]) if n and (not r or size(n[0] + n[1]) > size(r)) else (r, v) for r, v, n in rows]
    frame["rule"], frame["verdict"] = [r for r, _ in got], [v for _, v in got]
    return frame[["id", "host", "path", "rule", "verdict"]]
