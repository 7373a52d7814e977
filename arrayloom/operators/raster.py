"""Rasters: erosion, histograms, blur, stencils, flood fill, alpha blending; dense, bit-packed and run-length forms.

A dense image is complete: a row (y, x, p) for every pixel. Windows are always partitioned by a row or column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..plans.lineage import cut
from .graph import components

BITS = 32  #: pixels in a word


# ---------------------------------------------------------------- encodings
def rle_encode(img: DataFrame, fill: int | None = None) -> DataFrame:
    """(y, x0, x1, p): maximal runs of equal values in a row; runs of the fill are left out."""
    w = Window.partitionBy("y").orderBy("x")
    new = F.coalesce(((F.lag("p").over(w) != F.col("p")) | (F.lag("x").over(w) != F.col("x") - 1)).cast("int"), F.lit(1))
    runs = img.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w)).groupBy("y", "_r").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("p").alias("p"))
    runs = runs.select("y", "x0", "x1", "p")
    return runs if fill is None else runs.where(F.col("p") != fill)


def rle_decode(runs: DataFrame) -> DataFrame:
    return runs.select("y", F.explode(F.sequence("x0", "x1")).alias("x"), "p")


def bit_pack(img: DataFrame, bits: int = BITS) -> DataFrame:
    """(y, xb, word): `bits` pixels of a row in a long."""
    word = F.bit_or(F.when(F.col("p") != 0, F.expr(f"shiftleft(1L, cast(x % {bits} AS int))")).otherwise(F.lit(0).cast("long")))
    return img.groupBy("y", F.floor(F.col("x") / bits).alias("xb")).agg(word.alias("word"))


def bit_unpack(words: DataFrame, width: int, bits: int = BITS) -> DataFrame:
    each = words.select("y", "xb", "word", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    out = each.select("y", (F.col("xb") * bits + F.col("k")).alias("x"), F.expr("shiftright(word, k) & 1").cast("long").alias("p"))
    return out.where(F.col("x") < width)


# ---------------------------------------------------------------- erosion
def erode(img: DataFrame, times: int = 1) -> DataFrame:
    """3 x 3 minimum, `times` times; beyond the border counts as set. n times is one minimum over 2n + 1, so two window passes do."""
    wy = Window.partitionBy("x").orderBy("y").rowsBetween(-times, times)
    wx = Window.partitionBy("y").orderBy("x").rowsBetween(-times, times)
    return img.withColumn("_m", F.min("p").over(wy)).select("y", "x", F.min("_m").over(wx).alias("p"))


def erode_bits(words: DataFrame, width: int, times: int = 1, bits: int = BITS, skip_empty: bool = False) -> DataFrame:
    """The same on packed words: and of three rows, then shifts with carries from the neighbour words.

    With skip_empty words of value 0 are dropped between rounds (absent words are empty) and restored at the end.
    """
    last, full = (width - 1) // bits, (1 << bits) - 1
    pad = (full >> (width - last * bits)) << (width - last * bits) if width % bits else 0
    grid = words.select("y", "xb")
    height = words.agg(F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
    one = lambda c, d: F.shiftleft(c, d)
    for _ in range(times):
        wy, wx = Window.partitionBy("xb").orderBy("y"), Window.partitionBy("y").orderBy("xb")
        t = F.when(F.col("xb") == last, F.col("word").bitwiseOR(F.lit(pad).cast("long"))).otherwise(F.col("word"))
        rows = words.where("word <> 0") if skip_empty else words
        rows = rows.withColumn("t", t)

        def beside(column, w, step, key, rows=rows):
            """The neighbour's word: all ones beyond the border, 0 where a word inside is absent."""
            at = (F.lag if step < 0 else F.lead)
            there = at(key).over(w) == F.col(key) + step
            return F.when(there, at(column).over(w))

        if skip_empty:
            rows = rows.crossJoin(F.broadcast(height))  # one row
            up = F.coalesce(beside("t", wy, -1, "y"), F.when(F.col("y") == F.col("y_lo"), F.lit(full).cast("long")).otherwise(F.lit(0).cast("long")))
            down = F.coalesce(beside("t", wy, 1, "y"), F.when(F.col("y") == F.col("y_hi"), F.lit(full).cast("long")).otherwise(F.lit(0).cast("long")))
        else:
            up, down = F.coalesce(beside("t", wy, -1, "y"), F.lit(full).cast("long")), F.coalesce(beside("t", wy, 1, "y"), F.lit(full).cast("long"))
        rows = rows.withColumn("m", F.col("t").bitwiseAND(up).bitwiseAND(down))
        before = F.coalesce(beside("m", wx, -1, "xb"), F.when(F.col("xb") == 0, F.lit(full).cast("long")).otherwise(F.lit(0).cast("long")))
        after = F.coalesce(beside("m", wx, 1, "xb"), F.when(F.col("xb") == last, F.lit(full).cast("long")).otherwise(F.lit(0).cast("long")))
        low = one(F.col("m"), 1).bitwiseAND(F.lit(full).cast("long")).bitwiseOR(F.shiftright(before, bits - 1))
        high = F.shiftright(F.col("m"), 1).bitwiseOR(one(after.bitwiseAND(F.lit(1).cast("long")), bits - 1))
        word = F.col("m").bitwiseAND(low).bitwiseAND(high)
        if pad:
            word = F.when(F.col("xb") == last, word.bitwiseAND(F.lit(full ^ pad).cast("long"))).otherwise(word)
        words = rows.select("y", "xb", word.alias("word"))
    if skip_empty:
        words = grid.join(words, ["y", "xb"], "left").select("y", "xb", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return words


def erode_runs(runs: DataFrame, width: int, height: int, times: int = 1) -> DataFrame:
    """The same on runs of set pixels (y, x0, x1): three rows' runs are intersected, then shrunk by one where they don't touch the border.

    Rows are an equi key, so the interval join stays within a row.
    """
    for _ in range(times):
        mid = runs.select("y", "x0", "x1")
        for step in (-1, 1):
            border = mid.where(F.col("y") == (0 if step < 0 else height - 1))
            other = runs.select((F.col("y") - step).alias("y"), F.col("x0").alias("o0"), F.col("x1").alias("o1"))
            inner = mid.where(F.col("y") != (0 if step < 0 else height - 1)).join(other, "y").where("o0 <= x1 and x0 <= o1")
            mid = inner.select("y", F.greatest("x0", "o0").alias("x0"), F.least("x1", "o1").alias("x1")).unionByName(border)
        runs = mid.select("y", F.when(F.col("x0") == 0, 0).otherwise(F.col("x0") + 1).alias("x0"), F.when(F.col("x1") == width - 1, width - 1).otherwise(F.col("x1") - 1).alias("x1")).where("x0 <= x1")
    return runs


# ---------------------------------------------------------------- histogram, blur, stencils
def histogram(img: DataFrame, mask: DataFrame | None = None, runs: DataFrame | None = None, bins: int = 16, span: int = 16) -> DataFrame:
    """(bin, n) for all bins: pixels under the mask (y, x) or under runs (y, x0, x1)."""
    if mask is not None:
        img = img.join(mask.select("y", "x"), ["y", "x"], "left_semi")
    if runs is not None:
        img = img.join(rle_decode(runs.select("y", "x0", "x1", F.lit(1).alias("p"))).select("y", "x"), ["y", "x"], "left_semi")
    counts = img.groupBy(F.floor(F.col("p") / span).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    domain = img.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return domain.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def blur(img: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """3 x 3 mean with a border of zeros, rounded half to even; only where the mask is set."""
    wy = Window.partitionBy("x").orderBy("y").rowsBetween(-1, 1)
    wx = Window.partitionBy("y").orderBy("x").rowsBetween(-1, 1)
    out = img.withColumn("_s", F.sum("p").over(wy)).select("y", "x", half_even(F.sum("_s").over(wx) / 9).cast("long").alias("p"))
    return out if mask is None else out.join(mask.select("y", "x"), ["y", "x"], "left_semi")


def blur_histogram(img: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    return histogram(blur(img, mask))


def stencil(img: DataFrame, mask: list[list[int]]) -> DataFrame:
    """Hit or miss with a 3 x 3 mask: 1 must be set, -1 must not, 0 is free; beyond the border is not set."""
    set_ = img.where("p <> 0").select("y", "x")
    offsets = [(dy, dx, mask[dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if mask[dy + 1][dx + 1]]
    near = F.explode(F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(s).alias("s")) for dy, dx, s in offsets]))
    votes = set_.select("y", "x", near.alias("o")).groupBy((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.sum(F.when(F.col("o.s") > 0, 1).otherwise(0)).alias("hit"), F.sum(F.when(F.col("o.s") < 0, 1).otherwise(0)).alias("miss"))
    needed = sum(s > 0 for _, _, s in offsets)
    ok = (F.coalesce("hit", F.lit(0)) == needed) & (F.coalesce("miss", F.lit(0)) == 0)
    return img.select("y", "x").join(votes, ["y", "x"], "left").select("y", "x", ok.cast("long").alias("p"))


def sobel(img: DataFrame) -> DataFrame:
    """|Gx| + |Gy| with a border of zeros."""
    near = F.explode(F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(dx * (2 - abs(dy))).alias("gx"), F.lit(dy * (2 - abs(dx))).alias("gy")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]))
    parts = img.where("p <> 0").select("y", "x", "p", near.alias("o")).groupBy((F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.sum(F.col("p") * F.col("o.gx")).alias("gx"), F.sum(F.col("p") * F.col("o.gy")).alias("gy"))
    return img.select("y", "x").join(parts, ["y", "x"], "left").select("y", "x", (F.abs(F.coalesce("gx", F.lit(0))) + F.abs(F.coalesce("gy", F.lit(0)))).cast("long").alias("p"))


# ---------------------------------------------------------------- flood fill
def flood_fill(img: DataFrame, seed: tuple[int, int], method: str = "runs", steps: int = 4) -> DataFrame:
    """(y, x) of the set pixels joined to the seed by edges.

    runs      runs of set pixels that touch in neighbouring rows are joined; the seed's component, in a logarithmic number of rounds
    frontier  the frontier grows by `steps` pixels between checkpoints: as many rounds as the fill is long
    """
    if method == "frontier":
        return _fill_frontier(img, seed, steps)
    if method != "runs":
        raise ValueError(f"no such method: {method}")
    runs = rle_encode(img.select("y", "x", (F.col("p") != 0).cast("int").alias("p")), fill=0)
    runs = cut(runs.select("y", "x0", "x1", F.monotonically_increasing_id().alias("run")))
    above = runs.select((F.col("y") + 1).alias("y"), F.col("x0").alias("o0"), F.col("x1").alias("o1"), F.col("run").alias("b"))
    touch = runs.join(above, "y").where("o0 <= x1 and x0 <= o1").select(F.col("run").alias("a"), "b")
    comp = cut(components(touch.unionAll(runs.select(F.col("run").alias("a"), F.col("run").alias("b")))))
    y, x = seed
    first = runs.where((F.col("y") == y) & (F.col("x0") <= x) & (F.col("x1") >= x)).join(comp, runs["run"] == comp["v"]).select("root")
    inside = comp.join(first, "root", "left_semi").select(F.col("v").alias("run"))
    return rle_decode(runs.join(inside, "run", "left_semi").select("y", "x0", "x1", F.lit(1).alias("p"))).select("y", "x")


def _fill_frontier(img: DataFrame, seed: tuple[int, int], steps: int) -> DataFrame:
    spark = img.sparkSession
    free = img.where("p <> 0").select("y", "x").persist()
    try:
        frontier = filled = spark.createDataFrame([seed], "y long, x long").join(free, ["y", "x"], "left_semi")
        near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
        while True:
            grown = frontier
            for _ in range(steps):
                grown = grown.unionByName(grown.select(near.alias("n")).select("n.y", "n.x").join(free, ["y", "x"], "left_semi")).distinct()
            frontier = cut(grown.join(filled, ["y", "x"], "left_anti"))
            if frontier.isEmpty():
                return filled
            filled = cut(filled.unionByName(frontier))
    finally:
        free.unpersist()


# ---------------------------------------------------------------- blending, transforms
def _blend(b: Column, c: Column, alpha: float) -> Column:
    return half_even(F.lit(alpha) * b + F.lit(1 - alpha) * c).cast("long").bitwiseAND(F.lit(255).cast("long"))


def alpha_blend(b: DataFrame, c: DataFrame, alpha: float = 0.5, fill: int = 255) -> DataFrame:
    """round(alpha B + (1 - alpha) C) over the union of stored pixels; a pixel one side lacks is the fill."""
    left, right = b.select("y", "x", F.col("p").alias("bp")), c.select("y", "x", F.col("p").alias("cp"))
    out = left.join(right, ["y", "x"], "full_outer")
    return out.select("y", "x", _blend(F.coalesce("bp", F.lit(fill)), F.coalesce("cp", F.lit(fill)), alpha).alias("p"))


def alpha_blend_runs(b: DataFrame, c: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The same on complete run-length images: overlapping runs of a row are blended, equal neighbours merged."""
    right = c.select("y", F.col("x0").alias("o0"), F.col("x1").alias("o1"), F.col("p").alias("cp"))
    parts = b.join(right, "y").where("o0 <= x1 and x0 <= o1").select("y", F.greatest("x0", "o0").alias("x0"), F.least("x1", "o1").alias("x1"), _blend(F.col("p"), F.col("cp"), alpha).alias("p"))
    w = Window.partitionBy("y").orderBy("x0")
    new = F.coalesce(((F.lag("p").over(w) != F.col("p")) | (F.lag("x1").over(w) != F.col("x0") - 1)).cast("int"), F.lit(1))
    return parts.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w)).groupBy("y", "_r").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("p").alias("p")).select("y", "x0", "x1", "p")


def threshold(img: DataFrame, over: float) -> DataFrame:
    return img.withColumn("p", (F.col("p") > over).cast("long"))


def flip_majority(img: DataFrame) -> DataFrame:
    """The complement if more than half of the pixels are set."""
    most = img.agg((F.sum(F.when(F.col("p") != 0, 1).otherwise(0)) * 2 > F.count(F.lit(1))).alias("_f"))
    return img.crossJoin(F.broadcast(most)).select("y", "x", F.when(F.col("_f"), F.when(F.col("p") != 0, 0).otherwise(1)).otherwise(F.col("p")).cast("long").alias("p"))


def magnify(img: DataFrame, k: int) -> DataFrame:
    """Every pixel k x k times (nearest neighbour)."""
    each = F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    df = img.withColumn("_a", F.explode(each)).withColumn("_b", F.explode(each))
    return df.select((F.col("y") * k + F.col("_a")).alias("y"), (F.col("x") * k + F.col("_b")).alias("x"), "p")


def magnify_cubic(img: DataFrame, k: int, a: float = -0.75) -> DataFrame:
    """Every pixel k x k times by bicubic convolution (coefficient a), borders repeated, rounded half to even and kept within 0..255.

    Separable: along x, then along y. Each pixel is sent to the outputs whose four neighbours it is among, so nothing but a grouped sum moves.
    """
    top = img.agg(F.max("y").alias("_ym"), F.max("x").alias("_xm"))
    out = img.select("y", "x", F.col("p").cast("double").alias("p")).crossJoin(F.broadcast(top))  # one row
    for axis, last in (("x", "_xm"), ("y", "_ym")):
        other = "y" if axis == "x" else "x"
        # output o lies at (o + 1/2) / k - 1/2; neighbours floor - 1 .. floor + 2, those beyond the border count for the border's pixel
        reach = F.sequence((F.col(axis) - 2) * k - k, (F.col(axis) + 3) * k)
        rows = out.withColumn("_o", F.explode(reach)).where((F.col("_o") >= 0) & (F.col("_o") < (F.col(last) + 1) * k))
        at = (F.col("_o") + 0.5) / k - 0.5
        each = rows.withColumn("_f", F.floor(at)).withColumn("_n", F.explode(F.sequence(F.col("_f") - 1, F.col("_f") + 2)))
        each = each.where(F.greatest(F.lit(0), F.least(F.col("_n"), F.col(last))) == F.col(axis))
        d = F.abs(at - F.col("_n"))
        w = F.when(d <= 1, (a + 2) * d * d * d - (a + 3) * d * d + 1).when(d < 2, a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a).otherwise(0.0)
        out = each.groupBy(F.col("_o").alias(axis), other, "_ym", "_xm").agg(F.sum(w * F.col("p")).alias("p"))
    return out.select("y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(F.round("p", 6), 0))).cast("long").alias("p"))


def sparse_masks(runs: DataFrame, pixels: DataFrame, most: float = 0.004) -> DataFrame:
    """Images (img, runs stored) whose runs are at most that share of their pixels (img, n)."""
    counts = runs.groupBy("img").agg(F.count(F.lit(1)).alias("n_runs"))
    return counts.join(pixels, "img").where(F.col("n_runs") <= F.col("n") * most).select("img", "n_runs")
