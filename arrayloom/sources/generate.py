"""Structured and random matrices, images and vectors made from ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from ..tensor import SparseTensor


def _grid(spark: SparkSession, n: int, m: int) -> DataFrame:
    """All (i, j): each row number is exploded, so nothing is joined."""
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("j"))


def random_sparse(spark: SparkSession, n: int, m: int, density: float, seed: int = 0) -> SparseTensor:
    cells = _grid(spark, n, m).where(uniform(F.col("i"), F.col("j"), seed=seed) < density)
    return SparseTensor(cells.withColumn("v", F.lit(1.0)), ("i", "j"), (n, m))


def random_dense(spark: SparkSession, n: int, m: int, seed: int = 0) -> SparseTensor:
    return SparseTensor(_grid(spark, n, m).withColumn("v", uniform(F.col("i"), F.col("j"), seed=seed)), ("i", "j"), (n, m))


def permutation(spark: SparkSession, n: int, seed: int = 0, blocks: int = 64) -> SparseTensor:
    """A random permutation matrix. Ranks come from counts of key ranges and ranks inside them, so no task sorts all rows."""
    keyed = spark.range(n).select(F.col("id").alias("j"), uniform(F.col("id"), seed=seed).alias("u"))
    keyed = keyed.withColumn("b", F.floor(F.col("u") * blocks))
    w = Window.partitionBy("b").orderBy("u", "j")
    sizes = keyed.groupBy("b").count()
    before = sizes.select("b", (F.sum("count").over(Window.orderBy("b")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(w)).join(before, "b")
    return SparseTensor(ranked.select((F.col("before") + F.col("r") - 1).alias("i"), "j", F.lit(1.0).alias("v")), ("i", "j"), (n, n))


def reverse_permutation(spark: SparkSession, n: int) -> SparseTensor:
    return SparseTensor(spark.range(n).select(F.col("id").alias("i"), (n - 1 - F.col("id")).alias("j"), F.lit(1.0).alias("v")), ("i", "j"), (n, n))


def banded(spark: SparkSession, n: int, b: int) -> SparseTensor:
    """Toeplitz with v = j - i + 1 for |i - j| <= b; zeros aren't stored."""
    lo, hi = F.greatest(F.col("id") - b, F.lit(0)), F.least(F.col("id") + b, F.lit(n - 1))
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(lo, hi)).alias("j"))
    return SparseTensor(cells.withColumn("v", (F.col("j") - F.col("i") + 1).cast("double")).where("v <> 0"), ("i", "j"), (n, n))


def upper_triangle(spark: SparkSession, n: int, seed: int = 0) -> SparseTensor:
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(n - 1).cast("long"))).alias("j"))
    return SparseTensor(cells.withColumn("v", uniform(F.col("i"), F.col("j"), seed=seed)), ("i", "j"), (n, n))


def kron_ones(t: SparseTensor, b: int) -> SparseTensor:
    """Kronecker product with a b x b matrix of ones: every entry becomes a dense block."""
    i, j = t.axes
    each = F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))
    df = t.df.withColumn("_p", F.explode(each)).withColumn("_q", F.explode(each))
    df = df.select((F.col(i) * b + F.col("_p")).alias(i), (F.col(j) * b + F.col("_q")).alias(j), "v")
    return SparseTensor(df, t.axes, tuple(n * b for n in t.shape) if t.shape else None, t.fill)


def disc(spark: SparkSession, n: int) -> DataFrame:
    """(y, x, p): 1 inside the circle of radius n / 4 round the middle."""
    cells = _grid(spark, n, n).select(F.col("i").alias("y"), F.col("j").alias("x"))
    inside = 16 * ((2 * F.col("y") - n) * (2 * F.col("y") - n) + (2 * F.col("x") - n) * (2 * F.col("x") - n)) < 4 * n * n
    return cells.withColumn("p", inside.cast("long"))
