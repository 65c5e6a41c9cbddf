"""An index that stays current as runs in levels: batches are added as runs, runs of a level are merged into one of the next, and
readers follow a manifest that names the runs of a snapshot."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators import index
from lexigrove.session import remove

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Manifests that are kept, for readers that began with them.
KEPT = 3
#: A row's key, and what tells the later of two.
KEY, AT = ["term", "doc_id"], "version"
#: Rows of which a task tells the newest.
ROWS_A_TASK = 500_000


class Levels:
    """Rows (term, doc_id, ..., version) at `path`, of each (term, doc_id) the one of the last version.

    append() writes a batch as a run of level 0; as soon as a level has `fanout` runs they are merged into one run of the next level, in which
    no row is superseded, so that n batches lie in at most (fanout - 1) * log(n) runs and each row is rewritten log(n) times. A manifest,
    a small file that is written whole under a new number, names the runs and the last batch; readers take the newest one, and its runs don't
    change. There is one writer at a time; a batch that is added again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema, fanout: int = FANOUT, by: list[str] = KEY, at: str = AT):
        self.spark, self.path, self.schema, self.fanout, self.by, self.at = spark, path.rstrip("/"), schema, fanout, by, at

    # manifests

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdecimal())

    def manifest(self, version: int | None = None) -> dict:
        """{"batch": last batch, "runs": [{"name", "level", "batch"}, ...]}, the newer runs later."""
        known = self.versions()
        if not known:
            return {"batch": -1, "runs": []}
        text = self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """The next manifest: written under another name and renamed, so that it is whole or not there."""
        number = (self.versions() or [-1])[-1] + 1
        draft, fs = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/manifests/{number:012d}.json")[0]):
            raise RuntimeError(f"{self.path}: another writer committed manifest {number}")

    # runs

    def _write(self, rows: DataFrame, level: int, batch: int) -> dict:
        name = f"run-{level}-{batch}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "batch": batch}

    def read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r['name']}" for r in runs])

    def newest(self, rows: DataFrame, n: int) -> DataFrame:
        """Of each key the row of the last version, of n rows. Rows are dealt out by key to tasks of about ROWS_A_TASK, however many there are;
        each column has its own aggregate of plain values, all of which decide alike, so that nothing is sorted."""
        dealt = rows.repartition(1 + n // ROWS_A_TASK, *self.by)
        others = [c for c in rows.columns if c not in self.by]
        return dealt.groupBy(*self.by).agg(*[(F.max(c) if c == self.at else F.max_by(c, self.at)).alias(c) for c in others]).select(*rows.columns)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch's rows; False if it is in already."""
        now = self.manifest()
        if batch <= now["batch"]:
            return False
        draft = self._write(rows.select(*self.schema.names), 0, batch)  # as it comes, so that it is made once, and counted
        run = self._write(self.current_of([draft]), 0, batch)
        remove(self.spark, f"{self.path}/{draft['name']}")
        self._commit({"batch": batch, "runs": [*now["runs"], run]})
        while self.compact():
            pass
        return True

    def compact(self, everything: bool = False) -> bool:
        """Merge the runs of the lowest full level, or all runs; False if there is nothing to merge."""
        now = self.manifest()
        runs = now["runs"]
        levels = sorted({r["level"] for r in runs})
        full = [level for level in levels if sum(r["level"] == level for r in runs) >= self.fanout]
        some = runs if everything and len(runs) > 1 else [r for r in runs if full and r["level"] == full[0]]
        if not some:
            return False
        merged = self._write(self.current_of(some), max(r["level"] for r in some) + 1, max(r["batch"] for r in some))
        names = {r["name"] for r in some}
        # merged runs are older than those of lower levels
        self._commit({"batch": now["batch"], "runs": sorted([*(r for r in runs if r["name"] not in names), merged], key=lambda r: (-r["level"], r["batch"]))})
        self.clean()
        return True

    def clean(self, kept: int = KEPT) -> None:
        """Delete all but the newest manifests, and the runs that none of those names."""
        known = self.versions()
        named = {r["name"] for v in known[-kept:] for r in self.manifest(v)["runs"]}
        old = {r["name"] for v in known[:-kept] for r in self.manifest(v)["runs"]}
        for name in old - named:
            remove(self.spark, f"{self.path}/{name}")
        for v in known[:-kept]:
            remove(self.spark, f"{self.path}/manifests/{v:012d}.json")

    def current(self, version: int | None = None) -> DataFrame:
        """The rows as of a manifest, the newest if none is named. With one run nothing is superseded and nothing shuffled."""
        runs = self.manifest(version)["runs"]
        return self.read(runs) if len(runs) < 2 else self.current_of(runs)

    def current_of(self, runs: list[dict]) -> DataFrame:
        rows = self.read(runs)
        return self.newest(rows, rows.count())

    def stored(self) -> int:
        """Rows that current() reads."""
        return self.read(self.manifest()["runs"]).count()


def stream_levels(docs: DataFrame, levels: Levels, checkpoint: str, stopwords=None, interval: str | None = None):
    """Keep an index of a stream of documents in levels. A micro-batch that is run again is in already, so that each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        levels.append(index.document_terms(batch, stopwords).withColumn("version", F.lit(number).cast("long")), number)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def index_levels(spark: SparkSession, path: str, id_type: str = "long", fanout: int = FANOUT) -> Levels:
    """Levels for what stream_levels() writes."""
    shape = spark.createDataFrame([], f"doc_id {id_type}, term string, n long, tf double, leads boolean, version long").schema
    return Levels(spark, path, shape, fanout)
