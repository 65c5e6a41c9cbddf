"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import batches, release

#: The model learns from at most TRAIN_DOCS labelled documents (those with the smallest hashes), all their words and
#: all n-grams of up to LONGEST characters of these.
TRAIN_DOCS, LONGEST = 10_000, 5
#: Below this score a document counts as rejected.
LEAST_SCORE = 0.5
#: So does one whose share of words known in the language told, with SLACK more words counted as known, is below
#: LEAST_KNOWN times the median of the held-out labelled documents, to PLACES digits.
#: The score is near 1 for any text of some words; the share does not grow with length.
LEAST_KNOWN, SLACK, PLACES = 0.45, 2, 4
#: Words whose n-grams are counted at a time.
STEP = 5_000
#: Characters of texts whose words are held at a time; longer texts are taken in portions, cut at white space.
SLICE = 2_000_000
SPACE = regex.compile(r"\s")
U = np.uint64


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of letters as code points, each with ^ before and $ after it, one after the other."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        self.n, self.size = len(size), size + 2
        self.start = np.cumsum(self.size) - self.size
        self.points = np.zeros(int(self.size.sum()), np.uint64)
        self.points[self.start], self.points[self.start + self.size - 1] = ord("^"), ord("$")
        inner = np.ones(len(self.points), bool)
        inner[self.start] = inner[self.start + self.size - 1] = False
        self.points[inner] = letters

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        if not self.n:
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.points)) - np.repeat(self.start, self.size)
        each = _mix(self.points + place.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return _mix(np.add.reduceat(each, self.start) + self.size.astype(np.uint64))

    def grams(self, n: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each n-gram of the words `of`, and its word's place in `of`. ^ and $ alone are none."""
        count = np.maximum(self.size[of] - n + 1, 0)
        who = np.repeat(np.arange(len(of)), count)
        at = np.repeat(self.start[of] - (np.cumsum(count) - count), count) + np.arange(len(who))
        h = np.full(len(at), U(n))
        for k in range(n):
            h = _mix((h * U(0x9E3779B97F4A7C15)) ^ self.points[at + k])
        if n == 1:
            letter = (self.points[at] != ord("^")) & (self.points[at] != ord("$"))
            h, who = h[letter], who[letter]
        return h, who


class Model:
    """Log-frequencies by language: words, and for each n the n-grams of words with ^ and $ around them.

    Tables are sorted 64-bit hashes and, for each, a row of log-frequencies (counts plus one half)."""

    def __init__(self, lang: pa.Array, word: pa.Array, n: np.ndarray):
        langs, words = lang.dictionary_encode(), word.dictionary_encode()
        self.langs = sorted(langs.dictionary.to_pylist())
        order = np.array([self.langs.index(x) for x in langs.dictionary.to_pylist()], dtype=np.int64)
        width = len(self.langs)
        by = np.zeros((len(words.dictionary), width))
        np.add.at(by, (words.indices.to_numpy(zero_copy_only=False), order[langs.indices.to_numpy(zero_copy_only=False)]), n)
        found: list[list] = [[] for _ in range(LONGEST + 1)]
        for at in range(0, len(by), STEP):  # n-grams of some words at a time
            some, own = Words(words.dictionary.slice(at, STEP)), by[at : at + STEP]
            for size in range(LONGEST + 1):
                h, who = some.grams(size, np.arange(some.n)) if size else (some.hashes(), np.arange(some.n))
                keys, place = np.unique(h, return_inverse=True)
                found[size].append((keys, np.stack([np.bincount(place, own[who, k], len(keys)) for k in range(width)], axis=1)))
        self.tables = []
        for size, some in enumerate(found):
            keys, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in some)]), return_inverse=True)
            counts = np.zeros((len(keys), width))
            np.add.at(counts, place, np.concatenate([np.zeros((0, width)), *(c for _, c in some)]))
            if not size:
                self.seen = counts > 0
            counts += 0.5
            self.tables.append((keys, np.log(counts / counts.sum(axis=0))))

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word its log-frequencies by language, and which languages have it. A word that isn't known takes
        the mean over its known n-grams of the largest n that has any; one of unknown characters says nothing."""
        width = len(self.langs)
        out = np.full((words.n, width), -math.log(max(2, width)))
        seen = np.zeros((words.n, width), bool)
        open_ = np.arange(words.n)
        for size in [0, *range(LONGEST, 0, -1)]:
            keys, values = self.tables[size]
            if not len(open_) or not len(keys):
                break
            h, who = words.grams(size, open_) if size else (words.hashes(), open_)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            at, who = at[hit], who[hit]
            if not size:
                out[who], seen[who] = values[at], self.seen[at]
                found = np.zeros(words.n, bool)
                found[who] = True
            else:
                count = np.bincount(who, minlength=len(open_))
                found = count > 0
                sums = np.stack([np.bincount(who, values[at, k], len(open_)) for k in range(width)], axis=1)
                out[open_[found]] = sums[found] / count[found, None]
            open_ = open_[~found]
        return out, seen


def train(docs: DataFrame, folds: int = 5) -> Model:
    """Learn from text and lang of a bounded sample of rows with a language outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    words = (
        rows.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("word", "lang")
        .agg(F.count("*").alias("n"))
        .toArrow()
    )
    model = Model(words["lang"].combine_chunks(), words["word"].combine_chunks(), words["n"].to_numpy())
    del words
    release()
    return model


def portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with their places, SLICE characters or so at a time; a longer text comes in pieces."""
    at, held, size = [], [], 0
    for k, text in enumerate(texts):
        start = 0
        while True:
            room = SLICE - size
            m = SPACE.search(text, start + room) if len(text) - start > room else None
            end = m.start() if m else len(text)
            at.append(k)
            held.append(text[start:end])
            size += end - start
            start = end
            if size >= SLICE or m:
                yield at, held
                at, held, size = [], [], 0
            if not m:
                break
    if at:
        yield at, held


def tell(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, the posterior of it, and the share of its words that the language has, with SLACK more."""
    width = len(model.langs)
    total, hits, count = np.zeros((len(texts), max(1, width))), np.zeros((len(texts), max(1, width))), np.zeros(len(texts))
    for at, held in portions(texts) if width else ():
        chunks = pc.utf8_split_whitespace(pa.array(held, pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        words = pc.split_pattern_regex(pc.utf8_lower(coded.dictionary), r"\P{L}+")
        flat, sizes = words.flatten(), np.diff(np.asarray(words.offsets))
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        flat, chunk = flat.filter(pa.array(some)).dictionary_encode(), chunk[some]
        score, seen = model.scores(Words(flat.dictionary))
        place = flat.indices.to_numpy(zero_copy_only=False)
        token = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.asarray(at), np.diff(np.asarray(chunks.offsets)))
        sums = lambda x: np.bincount(doc, np.bincount(chunk, x, len(sizes))[token], len(texts))  # noqa: E731, B023
        count += sums(np.ones(len(place)))
        for k in range(width):
            total[:, k] += sums(score[place, k])
            hits[:, k] += sums(seen[place, k])
    best = total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    has = count > 0
    known = np.where(has, (hits[np.arange(len(texts)), best] + SLACK) / (count + SLACK), 0.0)
    return [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, p.max(axis=1) / p.sum(axis=1), 0.0), known


def detector(spark, model: Model):
    """A column function from text to struct(lang_pred, score, known)."""
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            lang, score, known = tell(shared.value, pc.fill_null(texts, "").to_pylist())
            release()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(known)], ["lang_pred", "score", "known"])

    batches(spark)
    return F.arrow_udf(run, "lang_pred string, score double, known double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learnt outside the held-out fold.

    Cases: null text, and text without a letter, are `und` with score 0; a null doc_id is never learnt
    from and is not held out; without any labelled row everything is `und`; repeated rows get equal results;
    ties go to the language first in code-point order; texts of any length are taken in portions; an empty table gives
    no rows; other columns are not read.
    """
    told = detector(docs.sparkSession, train(docs, folds))
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), told("text").alias("told")).select("doc_id", "held_out", "told.lang_pred", "told.score")


def least_known(docs: DataFrame, model: Model, folds: int = 5) -> float:
    """The share of known words below which a text is in no known language, by all of the held-out fold, of which the model
    has learnt nothing; 0 without a labelled document there. The median is that of shares of PLACES digits, so that one
    aggregate holds few values, whatever the number of documents."""
    rows = docs.where(F.col("lang").isin(model.langs) & (fold(F.col("doc_id"), folds) == 0))
    told = detector(docs.sparkSession, model)
    shares = rows.select(told("text").alias("told")).select("told.known").where("known > 0")
    return LEAST_KNOWN * (shares.agg(F.median(F.round("known", PLACES))).first()[0] or 0.0)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told with a score of `least` or more and whose words that language has, as far
    as the share of them tells; all columns stay, under whatever names.

    Cases: null text and text without a letter go, and everything where no row is labelled; rows with a null doc_id or
    lang are judged as all others; repeated rows stay or go together; an empty table gives no rows.
    """
    model = train(docs)
    told = detector(docs.sparkSession, model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), told("text").alias("told"))
    good = (F.col("told.lang_pred") != "und") & (F.col("told.score") >= least) & (F.col("told.known") >= least_known(docs, model))
    return rows.where(good).select(*(F.col("row")[c].alias(c) for c in docs.columns))
