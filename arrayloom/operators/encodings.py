"""Physical encodings of a matrix: other rows, same answers. `encode` and `decode` go there and back.

coo            one row for each entry
csc            (j, idx, val): a column's sorted entries as arrays
csr, dcsr      (i, idx, val): the same of rows; csr has every row of the shape, dcsr those with entries
dense          (i, val): every row of the shape, in full
vbl            (j, i_start, val): runs of neighbouring stored rows of a column
vbl_pattern    (j, i_start, n): the runs' places only
band           (j, i_lo, val): one range for each column (or each column and strip of rows), gaps filled with 0
point          (j, i, v): at most one entry for each column (raises otherwise)
point_pattern  (j, i): the same without values
blocked        (bi, bj, val): dense b x b blocks
pattern        (i, j): stored positions only

A fibre or block is one row, so a row must fit a task; `coo` has no such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tensor import SparseTensor

FORMATS = ("coo", "csc", "csr", "dcsr", "dense", "vbl", "vbl_pattern", "band", "point", "point_pattern", "blocked", "pattern")
PATTERNS = ("vbl_pattern", "point_pattern", "pattern")


def _spread(entries, first) -> Column:
    """Values of sorted entries (i, v) from index `first` on, with zeros in the gaps; linear in the span."""

    def part(e, k):
        before = F.when(k == 0, first).otherwise(F.try_element_at(entries, k)["i"] + 1)
        return F.concat(F.array_repeat(F.lit(0).cast("double"), (e["i"] - before).cast("int")), F.array(e["v"].cast("double")))

    return F.flatten(F.transform(entries, part))


def _shape(t: SparseTensor) -> tuple[int, int]:
    return t.shape or tuple(int(x if x is not None else -1) + 1 for x in t.df.agg(*[F.max(a) for a in t.axes]).first())


def encode(t: SparseTensor, fmt: str, block: int = 10, strip: int | None = None) -> DataFrame:
    """strip: a band has a range for each column and that many rows, so that long gaps aren't filled."""
    i, j = t.axes
    df = t.df.select(F.col(i).alias("i"), F.col(j).alias("j"), "v")
    pairs = F.array_sort(F.collect_list(F.struct("i", "v")))
    if fmt == "coo":
        return df
    if fmt == "pattern":
        return df.select("i", "j").distinct()
    if fmt == "csc":
        return df.groupBy("j").agg(pairs.alias("e")).select("j", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))
    if fmt in ("csr", "dcsr", "dense"):
        rows = df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("i"), "v"))).alias("e"))
        if fmt != "dcsr":
            n, m = _shape(t)
            none = F.array().cast(rows.schema["e"].dataType)
            rows = df.sparkSession.range(n).withColumnRenamed("id", "i").join(rows, "i", "left").select("i", F.coalesce("e", none).alias("e"))
        if fmt == "dense":
            tail = F.array_repeat(F.lit(0).cast("double"), (m - 1 - F.coalesce(F.try_element_at("e", F.lit(-1))["i"], F.lit(-1))).cast("int"))
            return rows.select("i", F.concat(_spread(F.col("e"), F.lit(0)), tail).alias("val"))
        return rows.select("i", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))
    if fmt in ("vbl", "vbl_pattern"):
        w = Window.partitionBy("j").orderBy("i")
        runs = df.withColumn("r", F.col("i") - F.row_number().over(w)).groupBy("j", "r")
        if fmt == "vbl_pattern":
            return runs.agg(F.min("i").alias("i_start"), F.count(F.lit(1)).alias("n")).select("j", "i_start", "n")
        return runs.agg(pairs.alias("e")).select("j", F.col("e")[0]["i"].alias("i_start"), F.col("e.v").alias("val"))
    if fmt == "band":
        cols = df.groupBy("j", *([] if strip is None else [F.floor(F.col("i") / strip).alias("strip")])).agg(pairs.alias("e"))
        return cols.select("j", F.col("e")[0]["i"].alias("i_lo"), _spread(F.col("e"), F.col("e")[0]["i"]).alias("val"))
    if fmt == "point_pattern":
        return encode(t, "point").select("j", "i")
    if fmt == "point":
        one = df.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min("v").alias("v"))
        return one.select("j", F.when(F.col("n") == 1, F.col("i")).otherwise(F.raise_error(F.lit("a column has several entries")).cast("long")).alias("i"), "v")
    if fmt == "blocked":
        cell = (F.pmod("i", F.lit(block)) * block + F.pmod("j", F.lit(block))).cast("long")
        b = df.groupBy(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct(cell.alias("c"), "v"))).alias("m"))
        cells = F.sequence(F.lit(0).cast("long"), F.lit(block * block - 1).cast("long"))
        return b.select("bi", "bj", F.transform(cells, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("val"))
    raise ValueError(f"no such format: {fmt}")


def decode(df: DataFrame, fmt: str, shape: tuple[int, int] | None = None, block: int = 10) -> SparseTensor:
    """The entries again. Filled zeros of bands, blocks and dense rows are dropped: they equal the fill."""
    if fmt in ("pattern", "point_pattern"):
        df = df.select("i", "j", F.lit(1.0).alias("v"))
    elif fmt == "vbl_pattern":
        df = df.select(F.explode(F.sequence("i_start", F.col("i_start") + F.col("n") - 1)).alias("i"), "j", F.lit(1.0).alias("v"))
    elif fmt in ("csr", "dcsr"):
        df = df.select("i", F.explode(F.arrays_zip("idx", "val")).alias("e")).select("i", F.col("e.idx").alias("j"), F.col("e.val").alias("v"))
    elif fmt == "dense":
        df = df.select("i", F.posexplode("val").alias("j", "v")).where("v <> 0").select("i", F.col("j").cast("long").alias("j"), "v")
    elif fmt == "csc":
        df = df.select("j", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(F.col("e.idx").alias("i"), "j", F.col("e.val").alias("v"))
    elif fmt in ("vbl", "band"):
        start = "i_start" if fmt == "vbl" else "i_lo"
        df = df.select("j", start, F.posexplode("val").alias("k", "v")).select((F.col(start) + F.col("k")).alias("i"), "j", "v")
        df = df.where("v <> 0") if fmt == "band" else df
    elif fmt == "blocked":
        df = df.select("bi", "bj", F.posexplode("val").alias("k", "v")).where("v <> 0")
        df = df.select((F.col("bi") * block + F.floor(F.col("k") / block)).alias("i"), (F.col("bj") * block + F.col("k") % block).alias("j"), "v")
    elif fmt not in ("coo", "point"):
        raise ValueError(f"no such format: {fmt}")
    return SparseTensor(df.select("i", "j", "v"), ("i", "j"), shape)


def sizes(t: SparseTensor, block: int = 10) -> DataFrame:
    """Rows and stored values of each encoding: what a format costs on this matrix."""
    out = None
    for fmt in ("coo", "csc", "vbl", "band", "blocked"):
        e = encode(t, fmt, block)
        values = F.lit(1) if fmt == "coo" else F.size("val")
        one = e.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(values), F.lit(0)).cast("long").alias("n_values")).select(F.lit(fmt).alias("format"), "n_rows", "n_values")
        out = one if out is None else out.unionAll(one)
    return out
