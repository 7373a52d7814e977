"""What the text operators share: shared-folder tables, byte hashing, fixed-size filters, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import shared_folder

WHITE = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  #: of an Arrow batch: long texts come in batches of fewer rows


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    found = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds the session's Arrow batches."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='arrayloom-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    spark.sparkContext.addPyFile(path)


class Scratch:
    """Tables of one call in the shared folder. Written tables cut lineage: a lost executor re-reads them."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and reads them back. Nothing reuses a finished write's shuffle files, so they go at once."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def row_per_id(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("doc_id is null or count > 1").limit(1).count() == 0


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row, doc_id, text, and the table's own columns as c0, c1, ...; written, so that row numbers stay."""
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *own)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = scratch.table(rows, "numbered")
    return rows.select("row", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).cast("string").alias("text"), *at.values())


def own_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(columns: dict):
    """A pandas frame whose list columns keep their type where a batch is empty."""
    import pandas as pd

    return pd.DataFrame({k: pd.Series(v, dtype=object) if isinstance(v, list) else v for k, v in columns.items()})


# ---------------------------------------------------------------- state of worker processes
_state: dict[str, tuple] = {}


def worker_state(owner: str, key, make):
    """What an operator keeps from task to task in a reused worker process: one value, dropped as soon as another operator keeps one."""
    held = _state.get(owner)
    if held is None or held[0] != key:
        _state.clear()
        held = _state[owner] = (key, make())
    return held[1]


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain murmur3 constants), element by element."""
    x = x ^ (x >> np.uint64(33))
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        x *= factor
        x ^= x >> np.uint64(33)
    return x


class ByteHasher:
    """Fingerprints of byte substrings from prefix sums modulo 2**64 over random byte values."""

    def __init__(self, seed: int = 20240229):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size = 0
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = 1 << int(n).bit_length()
        for name, b in (("power", self.base), ("unpower", self.inverse)):
            a = np.full(self.size, b, dtype=np.uint64)
            a[0] = 1
            setattr(self, name, np.cumprod(a))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprint of data[start:stop], the same wherever these bytes stand."""
        return mix((sums[stop] - sums[start]) * self.unpower[start] + (stop - start).astype(np.uint64))

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        """The fingerprints of all substrings of that length, in order."""
        x = sums[length:] - sums[:-length]
        x *= self.unpower[: len(x)]
        x += np.uint64(length)
        return mix(x)


def hasher() -> ByteHasher:
    """One hasher for each worker process."""
    return worker_state("hasher", None, ByteHasher)


# ---------------------------------------------------------------- fixed-size filters
BLOOM_BITS = 1 << 24  #: bits of a membership filter: 2 MB, whatever the input


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bit table (2 MB) that holds every id of the column; it may let others through, so an exact join follows."""

    def words(batches):
        import pandas as pd

        for pdf in batches:
            s = _slots(pdf[column].to_numpy())
            yield pd.DataFrame({"w": s >> 5, "b": np.int64(1) << (s & 31)}).groupby("w", as_index=False)["b"].agg(lambda x: int(np.bitwise_or.reduce(x.to_numpy())))

    rows = ids.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInPandas(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(BLOOM_BITS // 32, dtype=np.int64)
    table[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return table.astype(np.uint32)


def in_filter(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    s = _slots(ids)
    return (table[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1) == 1


# ---------------------------------------------------------------- connected components
def _contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars: every vertex with the least vertex that the partition joins it to."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        out = [(v, find(v)) for v in list(root)]
        yield frame({"a": [v for v, r in out if v != r], "b": [r for v, r in out if v != r]})

    return edges.mapInPandas(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60, partial: bool = False) -> DataFrame:
    """(v, root) for the vertices of links(a, b): root is the least vertex reachable.

    Partitions first join what they can see into stars. Then large-star and small-star steps alternate until the edges
    are a forest of stars. Each step is grouped minima and a join on a vertex (adaptive execution splits hot
    vertices); each round's edges are written to the shared folder. With partial=True it stops after `rounds` rounds, with
    roots that may be joined further.
    """
    edges = scratch.table(_contract(links.select("a", "b")), f"{name}-0")
    for i in range(1, rounds + 1):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least-{i}")
        large = scratch.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), f"{name}-large-{i}")
        low = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low-{i}")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        edges = scratch.table(_contract(small), f"{name}-{i}")
        scratch.drop(f"{name}-least-{i}", f"{name}-large-{i}", f"{name}-low-{i}", f"{name}-{i - 1}")
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("k")), F.struct(F.col("b").alias("v"), F.lit(0).alias("k")))).alias("e"))
        ends = ends.groupBy("e.v").agg(F.sum("e.k").alias("ups"), F.min("e.k").alias("k"))
        if partial and i == rounds or ends.where("ups > 1 or ups = 1 and k = 0").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    low, roots = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root")), edges.select(F.col("b").alias("v")).distinct()
    if partial:
        roots = roots.join(low, "v", "left_anti")
    return low.union(roots.select("v", F.col("v").alias("root")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
