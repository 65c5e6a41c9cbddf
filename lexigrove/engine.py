"""One object for a user's commands, and a command line over it."""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions import display, text
from lexigrove.operators import frontier, hierarchy, index, metrics, search
from lexigrove.session import cut
from lexigrove.sources import html

#: Documents whose postings of one prefix go to one file.
DOCS_A_FILE = 1_000_000
HELP = "<query> [-d] | crawl /wiki/PAGE | tree TERM [--collapse|-c] [--depth=N|-d=N] | stats | save PATH | help | exit"


class Engine:
    """Search, trees, crawls and figures over documents (doc_id, text, ...), edges and pages."""

    def __init__(self, spark: SparkSession, documents: DataFrame, edges: DataFrame | None = None, pages: DataFrame | None = None, events: DataFrame | None = None, stopwords=None):
        self.spark, self.documents, self.edges, self.pages, self.events, self.stopwords = spark, documents, edges, pages, events, stopwords
        self._postings: DataFrame | None = None
        self._n: int | None = None

    @property
    def postings(self) -> DataFrame:
        """The index, written once at its first use in the order of prefixes and terms, so that a search reads the pages of its own."""
        if self._postings is None:
            records = index.species(index.dealt(self.documents, self.documents.count()), self.stopwords)
            self._postings = cut(index.in_shards(index.postings(records)))
        return self._postings

    def load(self, path: str) -> Engine:
        """Use the index that save() wrote."""
        self._postings = index.read_shards(self.spark, path)
        self._n = None
        return self

    @property
    def n_docs(self) -> int:
        if self._n is None:
            self._n = index.n_documents(self.postings)
        return self._n

    def search(self, query: str, limit: int | None = search.TOP) -> DataFrame:
        return search.search(self.postings, self.n_docs, query, limit, self.stopwords)

    def details(self, query: str, top: int = 5) -> DataFrame:
        return self.search(query, top).join(self.documents, "doc_id", "left")

    def tree(self, taxon: str, depth: int = 10, collapse: bool = False) -> DataFrame:
        """Taxa before species, each by name."""
        nodes = hierarchy.tree(self.edges, taxon).where(F.col("depth") <= depth)
        if collapse:
            return hierarchy.collapsed(nodes, depth)
        return nodes.orderBy(hierarchy.sibling_order(F.col("path")), "is_species", "name")

    def range(self, taxon: str) -> DataFrame:
        return hierarchy.descendants(self.edges, taxon)

    def crawl(self, link: str, rounds: int = 3, only_targets: bool = True) -> DataFrame:
        """Breadth-first over the pages' links, from a link that starts with /wiki/; only pages of the target class,
        and the first one, are gone on from."""
        if not link.startswith("/wiki/"):
            raise ValueError("a link starts with /wiki/")
        at = F.regexp_extract("url", r"^(?:[^/?#]*://[^/?#]*)?(/wiki/[^?#]*)", 1)
        pages = self.pages.select("page_id", "html", at.alias("src")).where("src <> ''")
        found = html.wanted_links(pages.where(F.col("src") == link))
        found = found.union(html.wanted_links(pages.where(F.col("src") != link), only_targets=only_targets))
        seed = self.spark.createDataFrame([(link,)], "node string")
        steps = found.join(pages.select("page_id", "src"), "page_id")
        return frontier.breadth_first(steps.select("src", F.col("href").alias("dst")), seed, rounds)

    def stats(self) -> DataFrame:
        return metrics.summary(self.events)

    def save(self, path: str, docs_a_file: int = DOCS_A_FILE) -> None:
        index.write_index(self.postings, path, salts=1 + self.n_docs // docs_a_file)

    def boxes(self, query: str, top: int = 5) -> DataFrame:
        """rank, box: the first results as framed text, with descriptions."""
        found = self.search(query, top).join(self.documents.select("doc_id", "text"), "doc_id", "left").orderBy("rank")
        key = F.concat(F.lit("/wiki/doc_"), F.col("doc_id").cast("string"))
        return display.result_boxes(found, len(text.query_terms(query, self.stopwords)), key, F.col("text"))

    def command(self, line: str) -> DataFrame | str | None:
        """One line of the command language; None ends."""
        word, _, rest = line.strip().partition(" ")
        if word in ("exit", "quit"):
            return None
        if word == "help" or not word:
            return HELP
        if word == "crawl":
            return self.crawl(rest.strip())
        if word in ("tree", "taxonomy"):
            depth = re.search(r"(?:--depth|-d)=(\d+)", rest)
            term = re.sub(r"--collapse|-c\b|(?:--depth|-d)=\d+", "", rest).strip()
            return self.tree(term, int(depth[1]) if depth else 10, bool(re.search(r"--collapse|-c\b", rest)))
        if word == "stats":
            return self.stats()
        if word == "save":
            self.save(rest.strip())
            return "saved"
        if re.search(r"(^|\s)-d(\s|$)", line):
            return self.details(re.sub(r"(^|\s)-d(\s|$)", " ", line))
        return self.search(line)


def main(sf_dir: str) -> None:
    from lexigrove.plans.catalogue import edges
    from lexigrove.session import local_session, table

    spark = local_session()
    engine = Engine(spark, *(table(spark, sf_dir, "documents"), edges(spark, sf_dir), table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")))
    for line in sys.stdin:
        got = engine.command(line)
        if got is None:
            break
        print(got) if isinstance(got, str) else got.show(20, truncate=60)


if __name__ == "__main__":
    main(sys.argv[1])
