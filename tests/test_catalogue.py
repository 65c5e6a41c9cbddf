"""Queries against DuckDB on the smallest tables."""

import pytest

from lexigrove.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_diamond_repeats(spark, duck):
    from collections import Counter

    from lexigrove.plans.catalogue import EDGES, ROOT

    e = duck.execute(f"{EDGES} SELECT * FROM edges").fetchall()
    nations = sorted(c for p, c, _ in e if p == ROOT)
    shared = min(c for p, c, _ in e if p == nations[-1])
    twice = {c[10:] for p, c, _ in e if p == shared}
    once = Counter(r["url"] for r in QUERIES["range_flat_multiset"](spark, SF).collect())
    got = Counter(r["url"] for r in QUERIES["range_flat_multiset_diamond"](spark, SF).collect())
    assert twice and got == once + Counter(twice)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
