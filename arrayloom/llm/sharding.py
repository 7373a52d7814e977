"""Sharding by size-tiered compaction, with DataFrame functions only.

A store is a folder of immutable runs (Parquet files) and numbered manifests. `append` writes what has arrived as small
runs, one for each task, without a shuffle. `compact` looks at the manifest only: a tier holds runs whose sizes are within a
factor of `FANOUT`; a tier under the target size with `FANOUT` runs or more is merged, similar sizes together, into runs of
the next tier (coalesced reads, no shuffle), until no tier qualifies. A change becomes visible when its manifest is
renamed into place, which fails where another writer has taken the version.

Writers may run at the same time. A writer that loses a version reads the newest manifest and commits on top of it: an append
adds its runs, a merge takes the place of the runs it read if all of them are still there, and is given up if not. Nothing
that a reader or writer may still need is deleted by either: runs that no manifest of the last `keep` versions names, and that
are older than a grace period (longer than any job), are deleted by `vacuum` alone, which is called apart.

The manifest holds one line for each run, never one for each row.

Defined cases: every row and column is kept as it is (nulls, repeated rows and ids and long texts too, columns named like
those of the result included); an empty table gives no runs; a failed commit raises and leaves the store as it was; a job
that dies midway leaves runs that no manifest names.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir, ship

TARGET_BYTES = 256 << 20
SMALL_BYTES = 4 << 20  #: the lowest tier holds all runs under this times the fan-out
FANOUT = 4
ARRIVALS = 8  #: parts in which the query lets its table arrive
GRACE_S = 7 * 24 * 3600
TRIES = 50
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class VersionTaken(RuntimeError):
    """Another writer has committed that version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.small, self.fanout = spark, root.rstrip("/"), target, small, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ------------------------------------------------------------ manifests
    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[dict]]:
        """A version (the newest by default) and its runs: path under the root, bytes, rows."""
        known = self.versions()
        if not known:
            return 0, []
        version = known[-1] if version is None else version
        rows = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json").collect()
        return version, [json.loads(r["value"]) for r in rows if r["value"]]

    def commit(self, after: int, runs: list[dict]) -> int:
        """Makes the runs version after + 1, or raises VersionTaken where that exists already."""
        version = after + 1
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray("".join(json.dumps(r, sort_keys=True) + "\n" for r in runs).encode()))
        out.close()
        final = self._path(f"{self.root}/manifest/v{version:08d}.json")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        full = lambda p: p.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
        try:  # FileContext.rename without OVERWRITE is atomic and refuses an existing target
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(full(temporary), full(final), none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if version in self.versions():
                raise VersionTaken(f"version {version} is another writer's") from e
            raise
        return version

    # ------------------------------------------------------------ runs
    def _files(self, folder: str) -> list:
        found, each = [], self._fs.listFiles(self._path(folder), True)
        while each.hasNext():
            found.append(each.next())
        return found

    def _relative(self, path: str) -> str:
        return path[path.rindex("/runs/") + 1 :]

    def _write(self, df: DataFrame, parts: int = 0) -> list[list[dict]]:
        """Writes the rows once; the runs by arrival: one, or `parts` to which the rows are dealt."""
        folder, schema = f"{self.root}/runs/{uuid.uuid4().hex}", df.schema
        if parts:
            tag, before = f"arrival_{uuid.uuid4().hex}", self.spark.conf.get(_WRITERS)
            self.spark.conf.set(_WRITERS, str(parts))  # a file open for each part, so that rows aren't sorted by part
            try:
                df.withColumn(tag, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))).write.partitionBy(tag).option("compression", "snappy").parquet(folder)
            finally:
                self.spark.conf.set(_WRITERS, before)
        else:
            df.write.option("compression", "snappy").parquet(folder)
        sizes = {self._relative(x.getPath().toString()): x.getLen() for x in self._files(folder) if x.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        held = self.read([{"path": p} for p in sizes], schema)
        counts = {self._relative(r["path"]): r["count"] for r in held.groupBy(F.col("_metadata.file_path").alias("path")).count().collect()}
        arrivals: dict[str, list[dict]] = {}
        for p in sorted(sizes):
            if counts.get(p):
                arrivals.setdefault(p.rsplit("/", 1)[0], []).append({"path": p, "bytes": sizes[p], "rows": counts[p]})
        return list(arrivals.values())

    def tier(self, run: dict) -> int:
        return 0 if run["bytes"] < self.small * self.fanout else int(math.log(run["bytes"] / self.small, self.fanout) + 1e-9)

    def read(self, runs: list[dict], schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def _add(self, new: list[dict]) -> int:
        for _ in range(TRIES):
            version, runs = self.manifest()
            try:
                return self.commit(version, runs + new)
            except VersionTaken:
                continue
        raise VersionTaken(f"lost {TRIES} versions to other writers")

    def append(self, arrivals: DataFrame) -> int:
        """Adds the rows; the version that has them."""
        return self._add([r for part in self._write(arrivals) for r in part])

    def compact(self) -> int:
        """Merges until no tier under the target has as many runs as the fan-out; a version for each merge."""
        while True:
            version, runs = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in runs:
                if r["bytes"] < self.target / 2:
                    tiers.setdefault(self.tier(r), []).append(r)
            ready = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not ready:
                return version
            chosen = sorted(tiers[ready[0]], key=lambda r: (r["bytes"], r["path"]))
            total = sum(r["bytes"] for r in chosen)
            size = min(self.target, max(self.fanout * total / len(chosen), self.small * self.fanout))
            parts = max(1, min(len(chosen) // self.fanout, round(total / size)))
            try:
                merged = [r for part in self._write(self.read(chosen).coalesce(parts)) for r in part]
            except Exception:
                if self._without(self.manifest()[1], chosen) is None:  # another merge took them, and a vacuum came
                    continue
                raise
            if sum(r["rows"] for r in merged) != sum(r["rows"] for r in chosen):
                raise RuntimeError("a merge changed the number of rows")
            done = self._replace(chosen, merged)
            if done and len(merged) >= len(chosen):  # nothing can be gained here
                return done

    def _without(self, runs: list[dict], gone: list[dict]) -> list[dict] | None:
        """The runs but those gone; none if any of these isn't there."""
        paths = {r["path"] for r in gone}
        rest = [r for r in runs if r["path"] not in paths]
        return rest if len(rest) + len(paths) == len(runs) else None

    def _replace(self, chosen: list[dict], merged: list[dict]) -> int:
        """Commits merged runs in the place of the chosen ones; 0 if another writer has merged any of these."""
        for _ in range(TRIES):
            version, runs = self.manifest()
            rest = self._without(runs, chosen)
            if rest is None:
                return 0
            try:
                return self.commit(version, rest + merged)
            except VersionTaken:
                continue
        raise VersionTaken(f"lost {TRIES} versions to other writers")

    def vacuum(self, grace_s: float = GRACE_S, keep: int = 2) -> int:
        """Deletes runs that are older than the grace period and that none of the last `keep` manifests names; how many.

        The grace period must be longer than any append, merge or read of this store takes.
        """
        named = {r["path"] for v in self.versions()[-keep:] for r in self.manifest(v)[1]}
        base, deleted = self._path(f"{self.root}/runs"), 0
        if self._fs.exists(base):
            before = (time.time() - grace_s) * 1000
            for x in self._files(f"{self.root}/runs"):
                if x.getPath().getName().endswith(".parquet") and x.getModificationTime() <= before and self._relative(x.getPath().toString()) not in named:
                    deleted += bool(self._fs.delete(x.getPath(), False))
        return deleted

    def shards(self) -> DataFrame:
        """One row for each run of the newest version."""
        version, runs = self.manifest()
        rows = [(r["path"], self.tier(r), r["rows"], r["bytes"], version) for r in runs]
        return self.spark.createDataFrame(rows, "shard string, tier int, shard_rows long, shard_bytes long, version int")


def shard(docs: DataFrame, target: int = TARGET_BYTES, small: int = SMALL_BYTES, arrivals: int = ARRIVALS) -> tuple[ShardStore, DataFrame]:
    """A store into which the rows have arrived in parts, compacted after each, and for each row its doc_id with the shard that holds it.

    The table is written once; each part becomes visible as an append of its own. Nobody else knows this store yet, so what
    a merge has replaced is deleted at once.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target, small)
    waiting = store._write(docs, arrivals)
    while waiting:
        store._add(waiting.pop(0))
        before = store.versions()[-1]
        if store.compact() != before:
            named = {r["path"] for r in store.manifest()[1]} | {r["path"] for part in waiting for r in part}
            for path in {r["path"] for v in store.versions() if v >= before for r in store.manifest(v)[1]} - named:
                store._fs.delete(store._path(f"{store.root}/{path}"), False)
    _, runs = store.manifest()
    shards = store.shards()
    if not runs:
        empty = "doc_id long, shard string, tier int, shard_rows long, shard_bytes long, version int"
        return store, spark.createDataFrame([], empty)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, "^.*/(runs/.*)$", 1)
    held = store.read(runs, docs.schema).select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("shard"))
    return store, held.join(shards, "shard").select("doc_id", "shard", "tier", "shard_rows", "shard_bytes", "version")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return shard(read_table(spark, sf_dir, "documents"))[1]
