"""Results as text: wrapped lines, boxes, times and numbers, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text

#: Columns of a box, lines of a description that it shows, and the start of a result's url.
WIDTH, LINES, BASE = 80, 5, "https://www.wikipedia.org"


def without_colours(line: Column) -> Column:
    """The text without terminal colour codes."""
    return F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")


def shown_time(ms: Column) -> Column:
    """Whole milliseconds below a second, else seconds with two decimals, halves upwards."""
    n = F.floor((ms + 5) / 10).cast("long")
    seconds = F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).otherwise(seconds)


def shown_number(n: Column) -> Column:
    """A whole number with a comma for each three digits."""
    return F.format_number(n.cast("long"), 0)


def bar(share: Column, width: int = 20) -> Column:
    """A share from 0 to 1 as filled and empty places; others count as the nearer of both, null as 0."""
    n = F.round(F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def wrapped(value: Column, width: int) -> Column:
    """Lines of whole words, each as long as fits, as an array; colours have no width. A longer word has a line by itself."""
    words = F.filter(F.split(text.squeeze(F.coalesce(value, F.lit(""))), " "), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(at, word):
        longer = F.concat(at["line"], F.lit(" "), word)
        first, fits = at["line"] == "", F.length(without_colours(longer)) <= width
        lines = F.when(first | fits, at["lines"]).otherwise(F.concat(at["lines"], F.array(at["line"])))
        return F.struct(lines.alias("lines"), F.when(first, word).when(fits, longer).otherwise(word).alias("line"))

    return F.aggregate(words, start, add, lambda at: F.when(at["line"] == "", at["lines"]).otherwise(F.concat(at["lines"], F.array(at["line"]))))


def boxed(lines: Column, width: int = WIDTH) -> Column:
    """An array of lines in a frame; a null line is a rule. Longer lines stick out, as nothing is cut."""
    rule = lambda a, b: F.lit(a + "─" * (width - 2) + b)
    pad = lambda line: F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width - 4) - F.length(without_colours(line))))
    inner = F.transform(lines, lambda x: F.when(x.isNull(), rule("├", "┤")).otherwise(F.concat(F.lit("│ "), x, pad(x), F.lit(" │"))))
    return F.array_join(F.concat(F.array(rule("┌", "┐")), inner, F.array(rule("└", "┘"))), "\n")


def result_boxes(results: DataFrame, n_terms: int, key: Column, description: Column | None = None, hierarchy: Column | None = None, width: int = WIDTH) -> DataFrame:
    """rank, box of search results (rank, matched_terms, score, meta): name, address, score, kingdom and family, what raised the
    score and, if given, LINES lines of a description and the ranks (array of (rank, name)).

    A result is named by its binomial, or by its key without /wiki/ if it has none; parts that are null or empty are left out.
    """
    m, no = F.col("meta"), F.array().cast("array<string>")
    own = lambda c: F.coalesce(text.squeeze(c), F.lit(""))
    line = lambda label, c: F.when(own(c) != "", F.array(F.concat(F.lit(label), own(c)))).otherwise(no)
    name = F.when(own(m["binomial"]) != "", own(m["binomial"])).otherwise(own(text.page_path(key)))
    rule = F.array(F.lit(None).cast("string"))
    head = F.array(F.concat(F.col("rank").cast("string"), F.lit(". "), F.upper(name)))
    score = F.concat(F.lit("Score: "), F.format_string("%.4f", F.col("score")), F.lit(" (matched "), F.col("matched_terms").cast("string"), F.lit(f"/{n_terms} terms)"))
    why = F.concat(line("  ✓ Taxonomy match: ", m["taxonomy_level"]), F.when(m["is_binomial"], F.array(F.lit("  ✓ Term appears in binomial name"))).otherwise(no))
    parts = [head, rule, F.array(F.concat(F.lit("URL: " + BASE), key), score), line("Kingdom: ", m["kingdom"]), line("Family: ", m["family"])]
    parts.append(F.when(F.size(why) > 0, F.concat(rule, F.array(F.lit("Relevance Boosters:")), why)).otherwise(no))
    if description is not None:
        lines = wrapped(description, width - 6)
        more = F.when(F.size(lines) > LINES, F.array(F.lit("..."))).otherwise(no)
        parts.append(F.when(F.size(lines) > 0, F.concat(rule, F.array(F.lit("Description:")), F.slice(lines, 1, LINES), more)).otherwise(no))
    if hierarchy is not None:
        ranks = F.transform(hierarchy, lambda r: F.concat(F.lit("  "), own(r["rank"]), F.lit(": "), own(r["name"])))
        parts.append(F.when(F.size(hierarchy) > 0, F.concat(rule, F.array(F.lit("Taxonomic Classification:")), ranks)).otherwise(no))
    return results.select("rank", boxed(F.concat(*parts), width).alias("box"))
