"""Map, group by key, reduce, with functions of the user's own."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(out) -> Iterator[tuple[str, object]]:
    """What a mapper gave: an object or a list of them, of each of which the first key counts."""
    for item in out if isinstance(out, list) else [out]:
        if isinstance(item, dict) and item:
            k = next(iter(item))
            yield str(k), item[k]


def map_reduce(rows: DataFrame, mapper: Callable, reducer: Callable, combiner: Callable | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """key, result (JSON), error of reducer(key, values) over what mapper(key, value) emits.

    A mapper or reducer that raises loses its key alone: the row says why, in `error`. A combiner(key, values)
    -> value works within each batch, before the shuffle. Keys come sorted to the reducer, which reads its
    values as an iterator, so that a large group is not held.
    """

    def mapped(frames):
        for frame in frames:
            out, groups = [], {}
            for k, v in zip(frame[key], frame[value], strict=True):
                try:
                    for a, b in _pairs(mapper(k, v)):
                        groups.setdefault(a, []).append(b)
                except Exception as e:  # noqa: BLE001  a user's function may raise anything
                    out.append((str(k), None, f"map {type(e).__name__}: {e}"))
            for a, values in groups.items():
                out += [(a, json.dumps(v), None) for v in ([combiner(a, values)] if combiner else values)]
            yield pd.DataFrame(out, columns=["key", "value", "error"], dtype=object)

    def reduced(frames):
        items = ((k, v, e) for f in frames for k, v, e in zip(f["key"], f["value"], f["error"], strict=True))
        for k, group in itertools.groupby(items, key=lambda x: x[0]):
            errors: list[str] = []
            some = []

            def values(group=group, errors=errors, some=some):
                for _, v, e in group:
                    if v is None:
                        errors.append(e)
                    else:
                        some.append(1) if not some else None
                        yield json.loads(v)

            result = None
            it = values()
            try:
                first = next(it, None)
                if some:
                    result = json.dumps(reducer(k, itertools.chain([first], it)))
            except Exception as e:  # noqa: BLE001
                errors.append(f"reduce {type(e).__name__}: {e}")
            for _ in it:
                pass
            yield pd.DataFrame([(k, result, "; ".join(errors) or None)], columns=["key", "result", "error"], dtype=object)

    pairs = rows.select(F.col(key).cast("string").alias(key), value).mapInPandas(mapped, "key string, value string, error string")
    dealt = pairs.repartition("key").sortWithinPartitions("key", "error")
    return dealt.mapInPandas(reduced, "key string, result string, error string")
