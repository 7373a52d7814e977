"""MatrixMarket coordinate files: text in, text out, both distributed.

Files are 1-based, tensors 0-based. Qualifiers: `symmetric` and `hermitian` mirror every entry off the diagonal,
`skew-symmetric` mirrors it negated, `pattern` stores no value (1.0), `complex` keeps the real part. Repeated entries are summed, or one is
kept with duplicates="first" (the least value, so the answer doesn't depend on order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.encodings import encode
from ..operators.raster import rle_encode
from ..tensor import SparseTensor


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line"), "_metadata.file_path").where("line <> ''")


def read_matrix(spark: SparkSession, path: str, duplicates: str = "sum", encoding: str | None = None) -> SparseTensor | DataFrame:
    """The matrix; with an encoding (csr, dcsr, dense or any other of operators.encodings) its encoded rows."""
    if encoding:
        return encode(read_matrix(spark, path, duplicates), encoding)
    lines = _lines(spark, path)
    header = lines.where(F.lower("line").startswith("%%matrixmarket")).first()
    words = set(header["line"].lower().split()) if header else set()
    plain = ~F.col("line").startswith("%")
    size = _lines(spark, header["file_path"] if header else path).where(plain).first()["line"]
    rows, columns = (int(x) for x in size.split()[:2])
    body = lines.where(plain).select("line")
    # The size line may look like an entry: exactly one copy of it is taken away.
    copies = body.where(F.col("line") == size).count() - 1
    body = body.where(F.col("line") != size)
    if copies:
        body = body.unionByName(spark.range(copies).select(F.lit(size).alias("line")))
    w = F.split("line", r"\s+")
    value = F.lit(1.0) if "pattern" in words else w[2].cast("double")
    entries = body.select((w[0].cast("long") - 1).alias("i"), (w[1].cast("long") - 1).alias("j"), value.alias("v"))
    if entries.where(f"i < 0 or j < 0 or i >= {rows} or j >= {columns}").limit(1).count():
        raise ValueError("an entry is outside the matrix")
    if {"symmetric", "hermitian", "skew-symmetric"} & words:
        sign = -1.0 if "skew-symmetric" in words else 1.0
        entries = entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    kept = F.sum("v") if duplicates == "sum" else F.min("v")
    return SparseTensor(entries.groupBy("i", "j").agg(kept.alias("v")), ("i", "j"), (rows, columns))


def read_vector(spark: SparkSession, path: str) -> SparseTensor:
    """Lines `n` and then `index value`."""
    words = _lines(spark, path).where(~F.col("line").startswith("%")).select(F.split("line", r"\s+").alias("w"))
    n = int(words.where("size(w) = 1").first()["w"][0])
    rows = words.where("size(w) >= 2").select((F.col("w")[0].cast("long") - 1).alias("i"), F.col("w")[1].cast("double").alias("v"))
    return SparseTensor(rows, ("i",), (n,))


def write_matrix(t: SparseTensor, path: str) -> None:
    """A folder of text parts: the first holds the header and size, each other a part of the entries."""
    spark = t.df.sparkSession
    stored = t.df.count()
    shape = t.shape or tuple(int(x) + 1 for x in t.df.agg(*[F.max(a) for a in t.axes]).first())
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{shape[0]} {shape[1]} {stored}",)], "value string").coalesce(1)
    body = t.df.select(F.concat_ws(" ", *[(F.col(a) + 1).cast("string") for a in t.axes], F.col("v").cast("string")).alias("value"))
    head.unionAll(body).write.mode("overwrite").text(path)


def write_vector(t: SparseTensor, path: str) -> None:
    spark = t.df.sparkSession
    head = spark.createDataFrame([(str(t.shape[0]),)], "value string").coalesce(1)
    head.unionAll(t.df.select(F.concat_ws(" ", (F.col(t.axes[0]) + 1).cast("string"), F.col("v").cast("string")).alias("value"))).write.mode("overwrite").text(path)


def write_runs(img: DataFrame, path: str) -> None:
    """An image (y, x, p) as the starts of its runs: a row, column and value wherever a row's value changes, 1-based."""
    runs = rle_encode(img)
    size = img.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    write_matrix(SparseTensor(runs.select(F.col("y").alias("i"), F.col("x0").alias("j"), F.col("p").alias("v")), ("i", "j"), (size["y"] + 1, size["x"] + 1)), path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, p): the complete image of run starts."""
    t = read_matrix(spark, path)
    end = F.coalesce(F.lead("j").over(Window.partitionBy("i").orderBy("j")), F.lit(t.shape[1])) - 1
    runs = t.df.select(F.col("i").alias("y"), F.col("j").alias("x0"), end.alias("x1"), F.col("v").alias("p"))
    return runs.select("y", F.explode(F.sequence("x0", F.col("x1"))).alias("x"), F.col("p").cast("long").alias("p"))
