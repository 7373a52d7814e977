"""The matrices, graphs, images and timing records that the registered queries work on, derived from the star-schema tables.

Each has the same definition in SQL next to it, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import SparseTensor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """customers (mod 500) by suppliers, summed quantities."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("j"), "l_quantity")  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 500).alias("i"))
    return SparseTensor(l.join(o, "l_orderkey").groupBy("i", "j").agg(F.sum("l_quantity").alias("v")), ("i", "j"))


MATRIX_SQL = """f1 AS (SELECT o_custkey % 500 AS i, l_suppkey AS j, SUM(l_quantity) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts of consecutive order lines, both directions, least weight: (src, dst, w)."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # noqa: E741
    nxt = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("q"))
    pairs = l.join(nxt, ["l_orderkey", "l_linenumber"]).where("l_partkey <> b")
    both = F.explode(F.array(F.struct(F.col("l_partkey").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("l_partkey").alias("dst"))))
    return pairs.select(both.alias("e"), F.least("l_quantity", "q").alias("w")).groupBy("e.src", "e.dst").agg(F.min("w").alias("w"))


GRAPH_SQL = """p AS (SELECT a.l_partkey AS s, b.l_partkey AS t, LEAST(a.l_quantity, b.l_quantity) AS w
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_partkey <> b.l_partkey),
  g AS (SELECT src, dst, MIN(w) AS w FROM (SELECT s AS src, t AS dst, w FROM p UNION ALL SELECT t, s, w FROM p) GROUP BY 1, 2)"""


def graph_tensor(spark: SparkSession, sf_dir: str) -> SparseTensor:
    return SparseTensor(graph(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v")), ("i", "j"))


def vector(spark: SparkSession, sf_dir: str) -> SparseTensor:
    """a value for each supplier."""
    return SparseTensor(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("j"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("v")), ("j",))


VECTOR_SQL = "x AS (SELECT s_suppkey AS j, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS v FROM supplier)"


def dense_rows(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """(i, row) of whole-number embeddings."""
    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    e = e if most is None else e.where(F.col("vec_id") < most)
    return e.select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("row"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, p, m): gray values and a mask from the embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "e"))
    d = F.col("e").cast("double")
    return e.select("y", F.col("x").cast("long").alias("x"), (F.floor(d * 128) + 128).cast("long").alias("p"), (d > -0.1).alias("m"))


IMAGE_SQL = """e0 AS (SELECT vec_id AS y, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings),
  img AS (SELECT y, x, CAST(floor(CAST(e AS DOUBLE) * 128) AS BIGINT) + 128 AS p, CAST(e AS DOUBLE) > -0.1 AS m FROM e0),
  bin AS (SELECT y, x, CAST(m AS BIGINT) AS p FROM img)"""


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select("y", "x", F.col("m").cast("long").alias("p"))


def second_image(img: DataFrame) -> DataFrame:
    """another gray image on the same grid."""
    return img.select("y", "x", ((F.col("x") * 73 + F.col("y") * 151) % 256).alias("p"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """least positive value by event type and user, as timing records."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.groupBy(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("matrix")).agg(F.min("value").alias("time"))


RECORDS_SQL = """r AS (SELECT event_type AS method, CAST(user_id AS VARCHAR) AS matrix, MIN(value) AS time
    FROM events WHERE value > 0 GROUP BY 1, 2)"""
