"""A sparse tensor as a relation: one row for each stored entry, plus shape and fill value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "v"


@dataclass(frozen=True)
class SparseTensor:
    """Coordinates (0-based long columns, one for each axis) and a value column `v`; entries not stored equal `fill`."""

    df: DataFrame
    axes: tuple[str, ...]
    shape: tuple[int, ...] | None = None
    fill: float = 0.0

    def __post_init__(self):
        missing = {*self.axes, VALUE} - set(self.df.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        if self.shape is not None and len(self.shape) != len(self.axes):
            raise ValueError("shape and axes differ in length")

    # ------------------------------------------------------------ structure
    def coo(self) -> DataFrame:
        return self.df.select(*self.axes, VALUE)

    def rename(self, *axes: str) -> SparseTensor:
        """The same entries under other axis names: how operands are aligned for a contraction."""
        if len(axes) != len(self.axes):
            raise ValueError("one name for each axis is needed")
        return replace(self, df=self.df.select(*[F.col(a).alias(b) for a, b in zip(self.axes, axes)], VALUE), axes=tuple(axes))

    def transpose(self, *order: int) -> SparseTensor:
        """Axes in another order; the names stay in place."""
        order = order or tuple(reversed(range(len(self.axes))))
        df = self.df.select(*[F.col(self.axes[o]).alias(a) for o, a in zip(order, self.axes)], VALUE)
        return replace(self, df=df, shape=tuple(self.shape[o] for o in order) if self.shape else None)

    def _square(self):
        if len(self.axes) != 2 or self.shape and self.shape[0] != self.shape[1]:
            raise ValueError("a square matrix is needed")
        return self.axes

    def upper(self) -> SparseTensor:
        i, j = self._square()
        return replace(self, df=self.df.where(F.col(i) < F.col(j)))

    def diagonal(self) -> SparseTensor:
        i, j = self._square()
        n = self.shape[:1] if self.shape else None
        return SparseTensor(self.df.where(F.col(i) == F.col(j)).select(i, VALUE), (i,), n, self.fill)

    def symmetrise(self) -> SparseTensor:
        """A + transpose(A): stored diagonal entries count twice."""
        self._square()
        both = self.coo().unionByName(self.transpose().coo())
        return replace(self, df=both.groupBy(*self.axes).agg(F.sum(VALUE).alias(VALUE)))

    # ------------------------------------------------------------ values
    def pattern(self) -> SparseTensor:
        return replace(self, df=self.df.select(*self.axes).distinct().withColumn(VALUE, F.lit(1.0)), fill=0.0)

    def redefault(self, fill: float) -> SparseTensor:
        """Another fill value; stored entries stay as they are."""
        return replace(self, fill=fill)

    def drop_defaults(self) -> SparseTensor:
        return replace(self, df=self.df.where(~F.col(VALUE).eqNullSafe(F.lit(self.fill))))

    def map(self, f) -> SparseTensor:
        return replace(self, df=self.df.withColumn(VALUE, f(F.col(VALUE))))

    def _same(self, other: SparseTensor):
        if self.axes != other.axes or self.shape and other.shape and self.shape != other.shape:
            raise ValueError("operands differ in axes or shape")

    def add(self, other: SparseTensor) -> SparseTensor:
        """Union of supports. With fill 0 on both sides it is one grouped sum over the union (map-side combined), no outer join."""
        self._same(other)
        if self.fill == other.fill == 0:
            both = self.coo().unionByName(other.coo())
            return replace(self, df=both.groupBy(*self.axes).agg(F.sum(VALUE).alias(VALUE)))
        return self.combine(other, lambda a, b: a + b)

    def mul(self, other: SparseTensor) -> SparseTensor:
        """Intersection of supports where 0 annihilates, else the union."""
        self._same(other)
        if self.fill == other.fill == 0:
            b = other.df.select(*self.axes, F.col(VALUE).alias("_b"))
            return replace(self, df=self.coo().join(b, list(self.axes)).select(*self.axes, (F.col(VALUE) * F.col("_b")).alias(VALUE)))
        return self.combine(other, lambda a, b: a * b)

    def combine(self, other: SparseTensor, f, fill: float | None = None) -> SparseTensor:
        """f over the union of supports; the entry a side lacks is its fill."""
        self._same(other)
        b = other.df.select(*self.axes, F.col(VALUE).alias("_b"))
        joined = self.coo().join(b, list(self.axes), "full_outer")
        value = f(F.coalesce(VALUE, F.lit(self.fill)), F.coalesce("_b", F.lit(other.fill)))
        return replace(self, df=joined.select(*self.axes, value.alias(VALUE)), fill=self.fill if fill is None else fill)

    # ------------------------------------------------------------ reductions
    def sum(self, *kept: str) -> SparseTensor | DataFrame:
        """Sum over the axes not kept; without any a one-row frame (an empty sum is 0)."""
        if not kept:
            return self.df.agg(F.coalesce(F.sum(VALUE), F.lit(0.0)).alias(VALUE))
        shape = tuple(self.shape[self.axes.index(a)] for a in kept) if self.shape else None
        return SparseTensor(self.df.groupBy(*kept).agg(F.sum(VALUE).alias(VALUE)), tuple(kept), shape)

    def stored(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("nnz"))

    def norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col(VALUE) * F.col(VALUE)), F.lit(0.0))).alias("norm"))

    def dense(self, n: int | None = None) -> SparseTensor:
        """A vector with every coordinate present."""
        (axis,), n = self.axes, n if n is not None else self.shape[0]
        domain = self.df.sparkSession.range(n).withColumnRenamed("id", axis)
        return replace(self, df=domain.join(self.coo(), axis, "left").select(axis, F.coalesce(VALUE, F.lit(self.fill)).alias(VALUE)), shape=(n,))

    def view(self, name: str) -> SparseTensor:
        """Registers the entries as a temporary view for SQL."""
        self.coo().createOrReplaceTempView(name)
        return self


def difference_norm(a: SparseTensor, b: SparseTensor) -> DataFrame:
    """|a - b| / |b| in the Frobenius norm, in one outer join."""
    y = b.df.select(*a.axes, F.col(VALUE).alias("_b"))
    x, y_ = F.coalesce(VALUE, F.lit(a.fill)), F.coalesce("_b", F.lit(b.fill))
    sums = a.coo().join(y, list(a.axes), "full_outer").agg(F.sum((x - y_) * (x - y_)).alias("d"), F.sum(y_ * y_).alias("r"))
    return sums.select(F.sqrt(F.coalesce("d", F.lit(0.0)) / F.col("r")).alias("rel_norm"))


def equal(a: SparseTensor, b: SparseTensor) -> DataFrame:
    """Whether all entries are equal, fills included."""
    y = b.df.select(*a.axes, F.col(VALUE).alias("_b"))
    same: Column = F.coalesce(VALUE, F.lit(a.fill)) == F.coalesce("_b", F.lit(b.fill))
    return a.coo().join(y, list(a.axes), "full_outer").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))
