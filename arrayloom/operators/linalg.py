"""Sparse matrix-vector and matrix-matrix products, sampled products and triangle counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import blocks
from ..plans.einsum import einsum
from ..plans.lineage import cut
from ..tensor import SparseTensor
from .encodings import decode, encode


def spmv(a: SparseTensor, x: SparseTensor, encoding: str = "coo", row_major: bool = False, block: int = 10) -> SparseTensor:
    """y = A x. The encoded forms multiply on their arrays where that saves rows."""
    if a.shape and x.shape and a.shape[1] != x.shape[0]:
        raise ValueError("dimensions differ")
    n = a.shape[:1] if a.shape else None
    vec = x.df.select(F.col(x.axes[0]).alias("j"), F.col("v").alias("xv"))
    if encoding == "blocked":
        e = encode(a, "blocked", block)
        chunks = vec.groupBy(F.floor(F.col("j") / block).alias("bj")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("j") % block).alias("k"), "xv"))).alias("m"))
        chunks = chunks.select("bj", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("xs"))
        rows = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda r: F.aggregate(F.zip_with(F.slice("val", r * block + 1, block), F.col("xs"), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z))
        each = e.join(chunks, "bj").select("bi", F.posexplode(rows).alias("k", "y"))
        return SparseTensor(each.groupBy((F.col("bi") * block + F.col("k")).alias("i")).agg(F.sum("y").alias("v")), ("i",), n)
    if row_major:  # fibres of the transpose: each belongs to one row of the result
        t = decode(encode(a.transpose(), encoding, block), encoding, None, block).df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return SparseTensor(t.join(vec, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v")), ("i",), n)
    if encoding in ("csr", "dcsr", "dense", "pattern"):
        products = decode(encode(a, encoding), encoding).df.join(vec, "j").select("i", (F.col("v") * F.col("xv")).alias("v"))
    else:
        products = scaled(encode(a, encoding) if encoding != "coo" else a.rename("i", "j").df, encoding, vec)
    return SparseTensor(products.groupBy("i").agg(F.sum("v").alias("v")), ("i",), n)


def scaled(fibres: DataFrame, encoding: str, vec: DataFrame) -> DataFrame:
    """(i, v): the entries of encoded columns times x(j). A fibre meets its x value once, before it is unrolled."""
    rows = fibres.join(vec, "j")
    if encoding in ("coo", "point"):
        return rows.select("i", (F.col("v") * F.col("xv")).alias("v"))
    if encoding == "point_pattern":
        return rows.select("i", F.col("xv").alias("v"))
    if encoding == "csc":
        return rows.select(F.explode(F.arrays_zip("idx", "val")).alias("e"), "xv").select(F.col("e.idx").alias("i"), (F.col("e.val") * F.col("xv")).alias("v"))
    if encoding == "vbl_pattern":
        return rows.select(F.explode(F.sequence("i_start", F.col("i_start") + F.col("n") - 1)).alias("i"), F.col("xv").alias("v"))
    if encoding in ("vbl", "band"):
        start = F.col("i_start" if encoding == "vbl" else "i_lo")
        each = rows.select(start.alias("s"), F.posexplode("val").alias("k", "w"), "xv")
        return (each.where("w <> 0") if encoding == "band" else each).select((F.col("s") + F.col("k")).alias("i"), (F.col("w") * F.col("xv")).alias("v"))
    raise ValueError(f"no such encoding: {encoding}")


STRIP = 64  #: rows of a band's piece


def spmv_symmetric(upper: SparseTensor, diagonal: SparseTensor, x: SparseTensor, encoding: str = "coo") -> SparseTensor:
    """y = (U + U' + D) x from the stored triangle: half of the matrix is read, each entry contributes twice.

    Bands are cut into strips of `STRIP` rows: a triangle's column may reach over all rows and store few of them.
    Encoded columns meet x(j) as wholes for y(i) += U(i, j) x(j), and are unrolled to meet x(i) for y(j) += U(i, j) x(i).
    """
    i, j = upper.axes
    vec = x.df.select(F.col(x.axes[0]).alias("k"), F.col("v").alias("xv"))
    d = diagonal.df.select(F.col(diagonal.axes[0]).alias("o"), F.col(diagonal.axes[0]).alias("k"), "v")
    if encoding != "coo":
        fibres = encode(upper, encoding, strip=STRIP)
        down = scaled(fibres, encoding, vec.withColumnRenamed("k", "j")).select(F.col("i").alias("o"), "v")
        back = decode(fibres, encoding).df.select(F.col("j").alias("o"), F.col("i").alias("k"), "v").unionByName(d)
        back = back.join(vec, "k").select("o", (F.col("v") * F.col("xv")).alias("v"))
        return SparseTensor(down.unionByName(back).groupBy(F.col("o").alias("i")).agg(F.sum("v").alias("v")), ("i",), x.shape)
    twice = F.explode(F.array(F.struct(F.col(i).alias("o"), F.col(j).alias("k")), F.struct(F.col(j).alias("o"), F.col(i).alias("k"))))
    parts = upper.df.select(twice.alias("e"), "v").select("e.o", "e.k", "v").unionByName(d)
    return SparseTensor(parts.join(vec, "k").groupBy(F.col("o").alias("i")).agg(F.sum(F.col("v") * F.col("xv")).alias("v")), ("i",), x.shape)


PIECE = 32  #: contracted indices in a piece of a fibre


def _pieces(fibres: DataFrame, outer: str) -> DataFrame:
    """(outer, piece, val): a fibre's entries by ranges of PIECE indices; val has a place for each index, null where nothing is stored."""
    places = [F.max(F.when(F.col("k") % PIECE == p, F.col("v").cast("double"))) for p in range(PIECE)]
    return fibres.groupBy(outer, F.floor(F.col("k") / PIECE).alias("piece")).agg(F.array(*places).alias("val"))


def spgemm(a: SparseTensor, b: SparseTensor, method: str = "outer") -> SparseTensor:
    """C = A B.

    outer      contracted index by index, the outer product of A's column and B's row is added to a block of the result
    gustavson  B as sorted rows; an entry of A meets a whole row of B (of a block of B's columns), row by row of A
    inner      rows of A and columns of B in pieces of `PIECE` contracted indices; pieces with the same range are intersected
               entry by entry, and a pair's partial dot products are summed
    """
    if a.shape and b.shape and a.shape[1] != b.shape[0]:
        raise ValueError("dimensions differ")
    shape = (a.shape[0], b.shape[1]) if a.shape and b.shape else None
    left = a.rename("i", "k")
    right = b.rename("k", "j")
    if method == "outer":
        c = einsum("ik,kj->ij", a, b, blocked=True)
        return SparseTensor(c.df, ("i", "j"), shape)
    if method == "gustavson" and blocks.supported(a, b, "sum_product"):
        return SparseTensor(blocks.product(a, b, order="i"), ("i", "j"), shape)
    if method == "gustavson":
        rows = right.df.groupBy("k").agg(F.collect_list(F.struct("j", F.col("v").alias("w"))).alias("row"))
        products = left.df.join(rows, "k").select("i", "v", F.explode("row").alias("e")).select("i", F.col("e.j").alias("j"), (F.col("v") * F.col("e.w")).alias("v"))
        return SparseTensor(products.groupBy("i", "j").agg(F.sum("v").alias("v")), ("i", "j"), shape)
    if method == "inner":
        rows = _pieces(left.df.select("i", "k", "v"), "i").withColumnRenamed("val", "ra")
        cols = _pieces(right.df.select("k", "j", "v"), "j").withColumnRenamed("val", "cb")
        shared = F.filter(F.zip_with("ra", "cb", lambda x, y: x * y), lambda z: z.isNotNull())
        parts = rows.join(cols, "piece").select("i", "j", shared.alias("z")).where(F.size("z") > 0)
        dot = F.aggregate("z", F.lit(0.0), lambda s, z: s + z)
        return SparseTensor(parts.groupBy("i", "j").agg(F.sum(dot).alias("v")), ("i", "j"), shape)
    raise ValueError(f"no such method: {method}")


def sddmm(sample: SparseTensor, a: DataFrame, b: DataFrame) -> SparseTensor:
    """sample(i, k) * sum over j of A(i, j) B(j, k), with dense rows of A as (i, row) and columns of B as (k, col) arrays."""
    dot = F.aggregate(F.zip_with("row", "col", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    i, k = sample.axes
    c = sample.df.select(F.col(i).alias("i"), F.col(k).alias("k"), "v")
    return SparseTensor(c.join(a, "i").join(b, "k").select("i", "k", (F.col("v") * dot).alias("v")), ("i", "k"), sample.shape)


def triangle_count(a: SparseTensor, b: SparseTensor | None = None, c: SparseTensor | None = None) -> DataFrame:
    """Sum over i, j, k of A(i,j) B(j,k) C(i,k)."""
    b, c = b or a, c or a
    return einsum("ij,jk,ik->", a, b, c).df


def oriented(a: SparseTensor) -> DataFrame:
    """(i, j, v): each edge of a symmetric matrix without loops once, from the end with fewer neighbours."""
    e = a.rename("i", "j").df
    degree = e.groupBy(F.col("i").alias("u")).agg(F.count(F.lit(1)).alias("d"))
    ends = e.join(degree.select(F.col("u").alias("i"), F.col("d").alias("di")), "i").join(degree.select(F.col("u").alias("j"), F.col("d").alias("dj")), "j")
    return ends.where(F.struct("di", "i") < F.struct("dj", "j")).select("i", "j", "v")


def triangle_intersect(a: SparseTensor) -> DataFrame:
    """n: how many ordered triangles a symmetric matrix without loops has, by intersecting the neighbour lists of each edge's ends.

    Lists hold the better connected neighbours only, so that of m edges no list is longer than sqrt(2 m), hubs' included.
    """
    e = cut(oriented(a).select("i", "j"))
    near = e.groupBy("i").agg(F.collect_list("j").alias("near"))
    both = e.join(near, "i").join(near.select(F.col("i").alias("j"), F.col("near").alias("far")), "j")
    return both.agg((F.coalesce(F.sum(F.size(F.array_intersect("near", "far"))), F.lit(0)) * 6).cast("long").alias("n"))


def triangle_count_oriented(a: SparseTensor) -> DataFrame:
    """The same for a symmetric matrix without loops: each triangle once, edges from the end with fewer neighbours, times 6.

    Wedges start at the less connected vertex, so a hub doesn't square its neighbours.
    """
    out = cut(oriented(a))
    first, second = out.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("v").alias("v1")), out.select(F.col("i").alias("a"), F.col("j").alias("c"), F.col("v").alias("v2"))
    third = out.select(F.col("i").alias("b"), F.col("j").alias("c"), F.col("v").alias("v3"))
    wedge = first.join(second, "a").where("b <> c")
    return wedge.join(third, ["b", "c"]).agg((F.coalesce(F.sum(F.col("v1") * F.col("v2") * F.col("v3")), F.lit(0.0)) * 6).alias("v"))
