"""Sharding (operator 4): size-tiered compaction of immutable shards under versioned manifests.

Native: rows are touched by DataFrame functions only; the driver handles file names, sizes and manifests through Hadoop's
file-system interface, so a store may lie in any of Spark's file systems.

Each arrival is written as small shards that never change. A shard's tier is the power of FANOUT that its size is above
SMALLEST. A tier with FANOUT shards or more is merged, in order of arrival, WIDEST shards or TARGET bytes at a time, until no
tier is that full; shards of half of TARGET or more are done. A task reads a run's shards and writes one file, so nothing is shuffled; a job has
RUNS tasks or as many as the cluster runs at once.
A manifest lists the shards of a version. Its number is claimed by creating a file that may not exist before, and it is
renamed into place when complete; readers see whole versions only. A writer changes the version that it has read: if another
one has committed since, it reads again and puts its change on top, so that nothing committed is lost. A claim older than
LEASE seconds without a manifest is a dead writer's and is taken over. Compaction drops nothing; vacuum() drops shards that no
kept version lists, once no reader needs them.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, scratch, table

SMALLEST, FANOUT, WIDEST, TARGET, RUNS, LEASE = 256 << 10, 4, 64, 64 << 20, 256, 600
UNION = "spark.sql.unionOutputPartitioning"
#: Arrivals that the query makes of a table, by hash of the id.
ARRIVALS = 8


@dataclass
class Shard:
    file: str
    bytes: int
    arrival: int


def tier(size: int) -> int:
    return max(0, int(math.log(max(size, 1) / SMALLEST, FANOUT) + 1e-9)) if size > SMALLEST else 0


def plan(shards: list[Shard]) -> list[list[Shard]]:
    """Runs of shards to merge now, each into one file."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < TARGET // 2:
            tiers.setdefault(tier(s.bytes), []).append(s)
    out = []
    for k in sorted(tiers):
        own = sorted(tiers[k], key=lambda s: (s.arrival, s.file))
        if len(own) < FANOUT:
            continue
        run: list[Shard] = []
        for s in own:
            if run and (len(run) >= WIDEST or sum(x.bytes for x in run) + s.bytes > TARGET * 5 // 4):
                out.append(run)
                run = []
            run.append(s)
        if len(run) > 1:
            out.append(run)
    return [r for r in out if len(r) > 1]


class Conflict(RuntimeError):
    """Another writer has made the version."""


class ShardStore:
    """Shards and manifests below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifests"))

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(self._path("manifests")) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the last by default."""
        return self.state()[1] if version is None else self._manifest(version)

    def state(self) -> tuple[int, list[Shard]]:
        """Number and shards of the last version; 0 and none before the first."""
        known = self.versions()
        return (known[-1], self._manifest(known[-1])) if known else (0, [])

    def _manifest(self, version: int) -> list[Shard]:
        stream = self._fs.open(self._path(f"manifests/v{version:08d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], parent: int) -> int:
        """Makes the shards version parent + 1; Conflict if another writer has made or claimed that."""
        version = parent + 1
        self._claim(version)
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps({"version": version, "parent": parent, "bytes": sum(s.bytes for s in shards), "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        if not self._fs.rename(draft, self._path(f"manifests/v{version:08d}.json")):
            raise RuntimeError(f"version {version} can't be put in place")
        return version

    def _claim(self, version: int) -> None:
        claim, done = self._path(f"manifests/v{version:08d}.claim"), self._path(f"manifests/v{version:08d}.json")
        if self._fs.createNewFile(claim):
            return
        if not self._fs.exists(done) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > LEASE:
            if self._fs.rename(claim, self._path(f"manifests/.dead-{uuid.uuid4().hex}")) and self._fs.createNewFile(claim):  # one writer can rename it
                return
        raise Conflict(f"version {version} is another writer's")

    def change(self, drop: set[str], add: list[Shard]) -> int:
        """Commits the last version without some shards and with others, on top of whatever is the last version then."""
        until = time.time() + 2 * LEASE
        while True:
            version, now = self.state()
            if drop - {s.file for s in now}:
                raise Conflict("shards to be replaced are gone")
            try:
                return self.commit([s for s in now if s.file not in drop] + add, version)
            except Conflict:
                if time.time() > until:
                    raise
                time.sleep(0.2)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        out, found = [], self._fs.listFiles(self._path(folder), True)
        while found.hasNext():
            s = found.next()
            if s.getPath().getName().endswith(".parquet"):
                name = s.getPath().toUri().getPath()
                out.append((name[name.index(f"/{folder}/") + 1 :], s.getLen()))
        return sorted(out)

    def append(self, rows: DataFrame, arrival: Column) -> None:
        """Writes rows in one job and commits each arrival's shards as a version of its own, ascending; null arrivals come first, as -1."""
        name = "arrival"
        while name in rows.columns:
            name += "_"
        folder = f"shards/{uuid.uuid4().hex}"
        rows.withColumn(name, F.coalesce(arrival.cast("long"), F.lit(-1))).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        own: dict[int, list[Shard]] = {}
        for file, size in self._files(folder):
            at = int(file.split(f"/{name}=")[1].split("/")[0])
            own.setdefault(at, []).append(Shard(file, size, at))
        if not own:  # no rows: one empty shard, for the schema
            rows.limit(0).write.parquet(f"{self.path}/{folder}-empty")
            own[-1] = [Shard(f, n, -1) for f, n in self._files(f"{folder}-empty")]
        for at in sorted(own):
            self.change(set(), own[at])

    def compact(self, alone: bool = False) -> int:
        """Merges until no tier is full; returns the number of rounds. Every round is a job of RUNS tasks or more, and a version.

        alone says that nobody else reads or writes the store: shards are then dropped as soon as they are merged.
        """
        rounds = 0
        while runs := plan(self.shards()):
            merged = []
            width = max(RUNS, self.spark.sparkContext.defaultParallelism)
            for at in range(0, len(runs), width):
                now, folder = runs[at : at + width], f"shards/{uuid.uuid4().hex}"
                parts = [self.read([s.file for s in run]).coalesce(1) for run in now]
                before_conf = self.spark.conf.get(UNION, None)
                self.spark.conf.set(UNION, "false")  # else the union of one-task reads is one task
                reduce(DataFrame.union, parts).write.parquet(f"{self.path}/{folder}")
                self.spark.conf.unset(UNION) if before_conf is None else self.spark.conf.set(UNION, before_conf)
                merged += [Shard(f, n, max(s.arrival for s in now[int(f.rsplit("part-", 1)[1][:5])])) for f, n in self._files(folder)]
            gone = {s.file for run in runs for s in run}
            self.change(gone, merged)
            if alone:
                self.vacuum(keep=1)
            rounds += 1
        return rounds

    def vacuum(self, keep: int = 1) -> None:
        """Drops manifests but the last keep, and the shards that only they list."""
        known = self.versions()
        live = {s.file for v in known[-keep:] for s in self.shards(v)}
        for v in known[:-keep]:
            for s in self.shards(v):
                if s.file not in live:
                    self._fs.delete(self._path(s.file), False)
            self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)

    def read(self, files: list[str] | None = None) -> DataFrame:
        """The rows of the last version, or of some of its shards."""
        files = [s.file for s in self.shards()] if files is None else files
        return self.spark.read.option("basePath", self.path).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in files))


def compacted(docs: DataFrame, arrivals: int = ARRIVALS, path: str | None = None) -> ShardStore:
    """A store with all rows of docs, any columns, which came in arrivals batches by hash of doc_id; nulls and repeated rows as they are."""
    spark = docs.sparkSession
    prepare(spark)
    store = ShardStore(spark, path or scratch(spark, "shards"))
    store.append(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals)))
    store.compact(alone=path is None)
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compacted(table(spark, sf_dir, "documents")).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
