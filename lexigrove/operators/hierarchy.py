"""Parent-child classification edges and descendant queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text
from lexigrove.session import cut, cut_by

MARK = "[SPECIES] "
#: Levels that a walk goes down at most; any tree ends earlier, a graph with cycles too as names come once.
MOST_ROUNDS = 10_000


def edges_of(records: DataFrame) -> DataFrame:
    """Edges of (url, hierarchy): neighbours in the hierarchy; its last row gives way to the species itself.

    A hierarchy of one row has no edge. No shuffle: each row's array is zipped with itself.
    """
    h = F.transform("hierarchy", lambda r: F.struct(r["rank"].alias("rank"), text.clean_taxon(r["name"]).alias("name")))
    r = records.select("url", h.alias("h")).where(F.size("h") > 1)
    pair = F.transform(
        F.sequence(F.lit(1), F.size("h") - 1),
        lambda i: F.struct(
            F.element_at("h", i)["name"].alias("parent"),
            F.when(i == F.size("h") - 1, F.concat(F.lit(MARK), F.col("url"))).otherwise(F.element_at("h", i + 1)["name"]).alias("child"),
            F.element_at("h", i)["rank"].alias("parent_rank"),
        ),
    )
    e = r.select(F.explode(pair).alias("e")).select("e.*")
    return e.withColumn("is_species", F.startswith("child", F.lit(MARK))).withColumn("prefix2", F.substring("parent", 1, 2))


def deduplicated(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["parent", "child"])


def children(edges: DataFrame, taxon: str) -> DataFrame:
    """Direct children; the filter on prefix2, where there is such a column, prunes folders."""
    name = taxon.strip().lower()
    got = edges.where(F.col("parent") == name)
    if "prefix2" in edges.columns:
        got = got.where(F.col("prefix2") == name[:2])
    return got.select("parent", "child", "is_species")


def reachable(edges: DataFrame, roots: list[str]) -> DataFrame:
    """(root, name, depth): taxa below each root, each once, at its least depth. Every round is one join of the newest
    names with the edges and an anti-join with those seen; lineage is cut each time."""
    e = cut_by(edges.where(~F.col("is_species")).select("parent", "child").distinct(), "parent", 1)
    names = sorted({r.strip().lower() for r in roots})
    new = edges.sparkSession.createDataFrame([(r, r, 0) for r in names], "root string, name string, depth int")
    seen = new = cut(new)
    for _ in range(MOST_ROUNDS):
        step = new.join(e, F.col("name") == F.col("parent")).select("root", F.col("child").alias("name"), (F.col("depth") + 1).alias("depth")).distinct()
        new = cut(step.join(seen.select("root", "name"), ["root", "name"], "left_anti").select("root", "name", "depth"))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def descendants(edges: DataFrame, taxon: str) -> DataFrame:
    """url of each species below a taxon, once; of an unknown one none."""
    taxa = reachable(edges, [taxon]).select(F.col("name").alias("parent"))
    found = edges.where("is_species").join(taxa, "parent", "left_semi")
    return found.select(F.substring("child", F.lit(len(MARK) + 1), F.length("child")).alias("url")).distinct()


def tree(edges: DataFrame, taxon: str) -> DataFrame:
    """path, depth, name, is_species of each node below a taxon, with it. A node with several parents is there
    once for each path; a path goes round no cycle."""
    e = cut_by(deduplicated(edges).select("parent", "child", "is_species"), "parent", 1)
    root = taxon.strip().lower()
    known = edges.where(F.col("parent") == root).limit(1).select(F.lit(root).alias("name"))
    new = known.select("name", F.array("name").alias("steps"), F.lit(0).alias("depth"), F.lit(False).alias("is_species"))
    out = new = cut(new)
    for _ in range(MOST_ROUNDS):
        step = new.where(~F.col("is_species")).drop("is_species").join(e, F.col("name") == F.col("parent"))
        step = step.where(~F.array_contains("steps", F.col("child")))
        new = cut(step.select(F.col("child").alias("name"), F.concat("steps", F.array("child")).alias("steps"), (F.col("depth") + 1).alias("depth"), "is_species"))
        if new.isEmpty():
            break
        out = out.union(new)
    return out.select(F.concat_ws("/", "steps").alias("path"), "depth", "name", "is_species")


def append_edges(edges: DataFrame, path: str) -> None:
    """Add edges to those at `path`, in folders by the parent's first two letters; readers drop repeats."""
    edges.select("parent", "child", "is_species", F.substring("parent", 1, 2).alias("prefix2")).repartition("prefix2").write.mode("append").partitionBy("prefix2").parquet(path)


def read_edges(spark, path: str) -> DataFrame:
    return deduplicated(spark.read.parquet(path))


def union_of(groups: list[DataFrame]) -> DataFrame:
    """The edges of several groups of nodes, each once."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return deduplicated(out)


def lines(nodes: DataFrame) -> DataFrame:
    """path, line: a tree as text, in the order of `path`: below each parent taxa come before species, each by name."""
    depth = F.size(F.split("path", "/")) - 1
    count = F.col("species_count") if "species_count" in nodes.columns else F.lit(0)
    tail = F.when(count > 0, F.concat(F.lit(" ("), count.cast("string"), F.lit(" species)"))).otherwise("")
    return nodes.select("path", F.concat(F.repeat(F.lit("  "), depth.cast("int")), F.when(depth > 0, "- ").otherwise(""), "name", tail).alias("line"))


def sibling_order(path: Column) -> Column:
    """A sort key of a tree's paths: a parent, then its taxa by name with what is below them, then its species."""
    return F.transform(F.split(F.regexp_replace(path, r"/\[SPECIES\] .*$", ""), "/"), lambda n: F.concat(F.lit("0"), n))


def collapsed(nodes: DataFrame, depth: int = 10) -> DataFrame:
    """name, depth, species_count of taxa down to a depth; species are counted at their parent."""
    parent = F.regexp_replace("path", r"/\[SPECIES\].*$", "")
    n = nodes.where("is_species").groupBy(parent.alias("path")).agg(F.count("*").alias("species_count"))
    taxa = nodes.where(~F.col("is_species") & (F.col("depth") <= depth))
    return taxa.join(n, "path", "left").select("name", "depth", F.coalesce("species_count", F.lit(0)).alias("species_count"))


def counts(edges: DataFrame, roots: list[str]) -> DataFrame:
    """root, taxa, species: distinct ones below each root, without it."""
    taxa = reachable(edges, roots)
    found = edges.where("is_species").select("parent", "child").join(taxa, F.col("parent") == F.col("name")).select("root", "child").distinct()
    a = taxa.where("depth > 0").groupBy("root").agg(F.count("*").alias("taxa"))
    b = found.groupBy("root").agg(F.count("*").alias("species"))
    return a.join(b, "root", "full").select("root", F.coalesce("taxa", F.lit(0)).alias("taxa"), F.coalesce("species", F.lit(0)).alias("species"))


def descendants_with_repeats(edges: DataFrame, taxon: str) -> DataFrame:
    """Species urls as often as a walk meets them that only remembers its own path's names and their
    siblings: a call for a name drops children seen on its way, then remembers all that are left."""
    e = deduplicated(edges).select("parent", "child", "is_species")
    kids = cut(e.where("not is_species").groupBy("parent").agg(F.sort_array(F.collect_list("child")).alias("taxa")))
    species = cut(e.where("is_species").select(F.col("parent").alias("name"), "child"))  # these may be many of one taxon, and stay rows
    new = edges.sparkSession.createDataFrame([(taxon.strip().lower(), [])], "name string, visited array<string>")
    out = None
    for _ in range(MOST_ROUNDS):
        taxa = F.coalesce("taxa", F.array().cast("array<string>"))
        calls = cut(new.join(kids, F.col("name") == F.col("parent"), "left").withColumn("go", F.array_except(taxa, "visited")))
        if calls.isEmpty():
            break
        got = calls.select("name").join(species, "name").select("child")
        out = got if out is None else out.union(got)
        new = calls.select(F.explode("go").alias("name"), F.array_union("visited", "go").alias("visited"))
    if out is None:
        return edges.select(F.col("child").alias("url")).limit(0)
    return out.select(F.substring("child", F.lit(len(MARK) + 1), F.length("child")).alias("url"))
