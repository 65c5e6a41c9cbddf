"""Interaction of filters: what each removes in every order, through the multilinear extension of a part's removals."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import attach
from lexigrove.session import Scratch, cut

#: Limits of the filters A to D.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
NAMES = "ABCDE"
COUNTS = ["n", "good", "toxic"]
ROWS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Removals:
    """The removal polynomial of a part: over x in [0, 1]^k, the documents expected to go if filter i applies with
    probability x_i. counts: how many documents fail exactly the filters of a mask (bit i for filter i).

    It is the sum over masks of count * (1 - the product of (1 - x_i) over the mask's filters): linear in each x_i, and at the
    corners of the cube the number that a set of filters removes.
    """

    def __init__(self, counts: dict[int, int], k: int):
        self.k = k
        self.at = [0] * (1 << k)  # by the product of the (1 - x_i) of a mask
        for mask, n in counts.items():
            if mask:
                self.at[0] += n
                self.at[mask] -= n

    def corner(self, applied: int) -> int:
        """Documents that go if exactly the filters of `applied` do: products of a zero factor vanish."""
        return sum(c for mask, c in enumerate(self.at) if not mask & applied)

    def derivative(self, i: int) -> list[int]:
        """Of x_i, by the product of the other (1 - x_j): a product with (1 - x_i) loses that factor and its sign."""
        out = [0] * (1 << self.k)
        for mask, c in enumerate(self.at):
            if mask >> i & 1:
                out[mask ^ (1 << i)] -= c
        return out

    def value(self, i: int) -> Fraction:
        """The Shapley value of filter i: its partial derivative integrated along the diagonal, where a product of m
        factors is (1 - t)^m, with the integral 1 / (m + 1)."""
        return sum((Fraction(c, mask.bit_count() + 1) for mask, c in enumerate(self.derivative(i))), Fraction(0))


def interactions(counts: pd.DataFrame, names: str = NAMES) -> pd.DataFrame:
    """A row for each order of the filters and step of it, from a part's rows (part, mask, n, good, toxic)."""
    k = len(names)
    n, good, toxic = (Removals(dict(zip(counts["mask"].astype(int), counts[c].astype(int), strict=True)), k) for c in COUNTS)
    total = int(counts["n"].sum())
    corners = [[p.corner(s) for s in range(1 << k)] for p in (n, good, toxic)]
    orders = math.factorial(k)
    values = [n.value(i) * orders for i in range(k)]
    fails, only = [n.corner(1 << i) for i in range(k)], [n.corner((1 << k) - 1) - n.corner((1 << k) - 1 ^ 1 << i) for i in range(k)]
    part, rows = counts["part"].iat[0], []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, lost, hate = (c[after] - c[before] for c in corners)
            assert values[i].denominator == 1
            rows.append((part, "".join(names[j] for j in order), step, names[i], total - corners[0][after], removed, fails[i] - removed, only[i], lost, hate, int(values[i])))
            before = after
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])


def own_filters(text: Column) -> list[Column]:
    """Failure conditions A to D of a text, as booleans."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < LEAST_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"), 100 * upper.cast("long") > UPPER_PERCENT * F.length(text).cast("long"), text.rlike(SIGNS)]


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): which filters each document fails, bit i for the i-th of NAMES.

    Texts are read once, where they are; only their digests are shuffled, and digests of one text only stay behind.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(own_filters(text))), F.lit(0))
    told = cut(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), bits.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")))
    same = cut(told.groupBy("digest").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")).where("rows > 1"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return attach(told, "digest", same, "rows").select("doc_id", "part", (F.col("own") + F.when(later, 1 << 4).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): 32 rows for each part at most, counted before they are shuffled."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return masks(docs).join(told, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, in each part (lang): columns of ROWS.

    Documents are reduced to counts of masks; each part's removal polynomial is formed from its 32 counts. Its
    corners tell what stays after each step, the integrals of its partial derivatives, in exact rationals, the Shapley values.
    Good and toxic documents have polynomials of their own.
    Cases: null text is empty (and so fails A, as 0 < 100, but not B or C); null lang is the part ''; E compares digests
    (SHA-256) of whole texts: rows without a doc_id are never later nor earlier than others, rows of one doc_id and text
    don't make each other fail; each repeated row counts; a document is good or toxic if any label of its id says so; no documents
    give no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = mask_counts(docs, labels)
        return scratch.keep(cut(counts.groupBy("part").applyInPandas(lambda own: interactions(own), ROWS)))
