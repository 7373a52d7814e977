"""Benchmark analytics over records (method, matrix, time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import geometric_mean
from ..plans.lineage import cut


def load_results(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """JSON arrays of records, one after another (records that were nested in lists count too), or one record a line."""
    return spark.read.option("multiLine", not lines).json(list(paths))


def save_results(records: DataFrame, path: str) -> None:
    """A folder of files with one record a line, written in parallel."""
    records.write.mode("overwrite").json(path)


def clean_name(c: Column) -> Column:
    """What follows the last slash, without a trailing .jl."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.jl$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def best_times(records: DataFrame) -> DataFrame:
    return records.groupBy("method", "matrix").agg(F.min("time").alias("time"))


def speedup_over(records: DataFrame, baseline: str) -> DataFrame:
    """(method, matrix, speedup) against one method."""
    base = records.where(F.col("method") == baseline).select("matrix", F.col("time").alias("base"))
    return records.join(base, "matrix").select("method", "matrix", (F.col("base") / F.col("time")).alias("speedup"))


def speedup_all_pairs(records: DataFrame) -> DataFrame:
    """(method, other, geomean, n) of every ordered pair of methods. The join is on matrix; the number of pairs is methods squared."""
    other = records.select("matrix", F.col("method").alias("other"), F.col("time").alias("t2"))
    pairs = records.join(other, "matrix").where("method <> other").withColumn("s", F.col("t2") / F.col("time"))
    return pairs.groupBy("method", "other").agg(geometric_mean(F.col("s")).alias("geomean"), F.count(F.lit(1)).alias("n"))


def speedup_summary(records: DataFrame, baseline: str) -> DataFrame:
    s = speedup_over(records, baseline)
    return s.groupBy("method").agg(F.max("speedup").alias("best"), geometric_mean(F.col("speedup")).alias("geomean"), F.avg("speedup").alias("mean"))


def best_of_families(records: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """The records and, for each family, a virtual method: its best time on each matrix, among methods with the prefix."""
    out = records.select("method", "matrix", "time")
    for name, prefix in prefixes.items():
        family = records.where(F.col("method").startswith(prefix)).groupBy("matrix").agg(F.min("time").alias("time"))
        out = out.unionByName(family.select(F.lit(name).alias("method"), "matrix", "time"))
    return out


def best_method(records: DataFrame) -> DataFrame:
    """(matrix, method, time): the fastest; ties to the least name."""
    return records.groupBy("matrix").agg(F.min(F.struct("time", "method")).alias("b")).select("matrix", F.col("b.method").alias("method"), F.col("b.time").alias("time"))


def ranked(records: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Records of the ranked methods with their rank, and their place by rank and falling time."""
    spark = records.sparkSession
    dim = spark.createDataFrame(list(ranks.items()), "method string, rank int")
    w = Window.partitionBy("rank").orderBy(F.desc("time"), "matrix")
    return records.join(F.broadcast(dim), "method").select("method", "matrix", "time", "rank", F.row_number().over(w).alias("place"))


def pivot_methods(records: DataFrame, methods: list[str]) -> DataFrame:
    """matrix and a column of times for each method; 0 where there is none."""
    return records.groupBy("matrix").pivot("method", methods).agg(F.min("time")).fillna(0.0)


def against_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean ratio of the reference's time (matrix, ref) by method; records and references without partner count as null."""
    return records.join(reference, "matrix", "outer").groupBy("method").agg(F.avg(F.col("ref") / F.col("time")).alias("mean_ratio"), F.count(F.lit(1)).alias("n"))


def batch(items: DataFrame, batches: int, order: str) -> DataFrame:
    """A batch number for each item: contiguous slices of ceil(n / batches) in the given order.

    Positions come from counts of ranges of the order key, so no single task sorts all items.
    """
    n = items.count()
    size = -(-n // batches) if n else 1
    parts = cut(items.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))  # both uses see the same parts
    w = Window.partitionBy("_part").orderBy(order)
    counts = parts.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    at = parts.withColumn("_r", F.row_number().over(w)).join(before, "_part")
    return at.withColumn("batch", F.floor((F.col("_before") + F.col("_r") - 1) / size)).drop("_part", "_r", "_before")


def sample(items: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n items, the same on every run: those with the least mixed keys."""
    mixed = (F.col(key).cast("long") * 7919 + seed * 104729) % 1000003
    return items.orderBy(mixed, key).limit(n)
