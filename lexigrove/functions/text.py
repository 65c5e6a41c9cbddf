"""Text functions of the index: tokens, stop words, prefixes, query terms, names and titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Two-letter prefixes with so many terms that their shards are split by a third letter.
COMMON_PREFIXES = """
ab ac ad ae af ag ai ak al am an ap ar as at au av ay az ba be bh bi bl bo br bu ca ce ch ci cl co cr cu cy
da de dh di do dr du dy ea ec ed ef eg ei el em en ep eq er es et eu ev ex fa fe fi fl fo fr fu ga ge gh gi
gl go gr gu gy ha he hi ho hu hy ic id il im in ir is it ja je ji jo ju ka ke kh ki kl kn ko kr ku la le li
ll lo lu ly ma mc me mi mo mu my na ne ng ni nl no nu ny ob oc od oe ok ol om on op or os ot ou ov ox pa pe
ph pi pl po pr ps pt pu py qu ra rb re rh ri ro ru sa sc se sh si sk sl sm sn so sp sr st su sw sy ta te th
ti to tr ts tu ty ul um un up ur us ut va ve vi vo vt wa we wh wi wo xa xi ya ye yi yo yu za ze zh zi zo zu
""".split()

# Stop words. A corpus's own list, of any length, is a parameter wherever these are used.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very can will just should now
""".split()


def load_stopwords(spark: SparkSession, path: str) -> list[str]:
    """A stop list from a text file of one word a line."""
    return sorted({r[0].strip().lower() for r in spark.read.text(path).collect()} - {""})


def tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, lower-cased; only those of over two letters a-z stay."""
    # all at once, without a function for each word; two signs whose lower case is a Latin letter are none here
    small = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")))
    return F.regexp_extract_all(small, F.lit("(?<![a-z0-9_])[a-z]{3,}+(?![a-z0-9_])"), F.lit(0))


def kept(text: Column, stopwords=None) -> Column:
    """tokens() without stop words, in order."""
    stop = list(STOPWORDS if stopwords is None else stopwords)
    return F.filter(tokens(text), lambda w: ~w.isin(stop)) if stop else tokens(text)


def without_stopwords(words: DataFrame, column: str = "term", stopwords=None) -> DataFrame:
    """Rows whose word is no stop word, by a broadcast anti-join; the list's length is what its caller gave."""
    stop = words.sparkSession.createDataFrame([(w,) for w in (STOPWORDS if stopwords is None else stopwords)], f"{column} string")
    return words.join(F.broadcast(stop), column, "left_anti")


def smart_prefix(term: Column, common=None) -> Column:
    """The shard of a term: `aa` for none, else its first two letters, or three where two are common."""
    t = F.lower(term)
    two = F.substring(t, 1, 2)
    three = two.isin(list(COMMON_PREFIXES if common is None else common)) & (F.length(t) >= 3)
    return F.when(t == "", F.lit("aa")).when(three, F.substring(t, 1, 3)).otherwise(two)


def prefix_of(term: str, common=None) -> str:
    """smart_prefix() of one string."""
    t = term.lower()
    return "aa" if not t else t[:3] if t[:2] in (COMMON_PREFIXES if common is None else common) and len(t) >= 3 else t[:2]


def query_terms(query: str, stopwords=None) -> list[str]:
    """A query's terms in order, with repeats: all but word characters and space is deleted."""
    stop = set(STOPWORDS if stopwords is None else stopwords)
    return [t for t in re.sub(r"[^a-z0-9_\s]", "", query.lower().strip()).split() if t not in stop]


def query_groups(terms: list[str], common=None) -> list[tuple[int, str, int, str]]:
    """(group_ord, prefix, pos, term): groups of one prefix, in the order in which they first occur."""
    order: dict[str, int] = {}
    return [(order.setdefault(p, len(order)), p, k, t) for k, t in enumerate(terms) for p in [prefix_of(t, common)]]


def title_of(title: Column, binomial: Column) -> Column:
    """The title, unless it was not found the binomial; with an upper-case first letter."""
    t = F.when(title.isNull() | (title == "Not found."), binomial).otherwise(title)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def scrub(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x1F]", " ")


def sanitize_key(key: Column) -> Column:
    return F.regexp_replace(key, "[^a-zA-Z0-9_.-]", "_")


def file_name(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\s+", "_"), "[^a-z._]", "")


def clean_taxon(name: Column) -> Column:
    """The first line of a name; any space, and any zero-width character, becomes one blank."""
    return F.regexp_replace(F.split(name, "\n")[0], "[\\p{Zs}\\x{200B}\\x{FEFF}\\x{200C}\\x{200D}]", " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_path(url: Column) -> Column:
    """The url without its first /wiki/."""
    return F.when(F.contains(url, F.lit("/wiki/")), F.concat(F.substring_index(url, "/wiki/", 1), F.substring(url, F.instr(url, "/wiki/") + 6, F.length(url)))).otherwise(url)


def hash_id(key: Column) -> Column:
    """SHA-256 of the key's JSON text."""
    escaped = F.regexp_replace(F.regexp_replace(key, r"\\", r"\\\\"), '"', r'\\"')
    return F.sha2(F.concat(F.lit('"'), escaped, F.lit('"')), 256)


def message_id(key: Column, at: Column) -> Column:
    """As hash_id(), of the key's JSON text with the time of the message in ms: the same key has another id at another time."""
    return F.sha2(F.to_json(F.struct(F.coalesce(key, F.lit("")).alias("message"), F.unix_millis(at).alias("date"))), 256)
