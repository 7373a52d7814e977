"""Matrix products whose result outgrows a task's memory, in blocks of columns.

The right operand is cut into ranges of its columns with about `ENTRIES` entries each; a task holds one of them. Entries (i, k)
of the left operand go to the blocks that store something in row k, and to no others. There they pass by in groups of rows, and
a group's part of the result is added up in the worker and handed on complete. So no product of two entries is ever shuffled:
what moves is the right operand once and the left one as often as there are blocks that need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VALUE, SparseTensor
from .lineage import stored

ENTRIES = 1 << 20  #: of the right operand in a block
LEAST = 1 << 15  #: entries for which another block pays, if there are cores without one
CELLS = 1 << 22  #: places of a group's part of the result, by which rows are grouped
MOST_CELLS = 1 << 25  #: beyond these an accumulator stays sparse
PRODUCTS = 1 << 18  #: at a time

#: multiplication; addition into places; the value of a place before the first addition
KERNELS = {
    "sum_product": (np.multiply, np.add, 0.0),
    "min_plus": (np.add, np.fmin, np.nan),  # as in SQL NaN is the greatest
    "or_and": (np.minimum, np.maximum, 0.0),  # 0 false, 1 true, 0.5 null
}


def _tree(column: str, bounds: list[int], first: int = 0) -> str:
    """SQL for the number of bounds below a value."""
    if not bounds:
        return str(first)
    m = len(bounds) // 2
    return f"CASE WHEN {column} <= {bounds[m]} THEN {_tree(column, bounds[:m], first)} ELSE {_tree(column, bounds[m + 1 :], first + m + 1)} END"


def supported(a: SparseTensor, b: SparseTensor, kernel: str | None) -> bool:
    """Whether values and coordinates are of types that blocks carry without loss."""
    types = [dict(t.df.dtypes) for t in (a, b)]
    value = "boolean" if kernel == "or_and" else "double"
    whole = {"tinyint", "smallint", "int", "bigint"}
    return kernel in KERNELS and all(d[VALUE] == value and {d[x] for x in t.axes} <= whole for d, t in zip(types, (a, b)))


def product(a: SparseTensor, b: SparseTensor, kernel: str = "sum_product", order: str = "k", sampled: bool = False) -> DataFrame:
    """(i, j, v): A B over a semiring of `KERNELS`.

    order    "k": each contracted index adds the outer product of its column of A and its row of B to a group of rows;
             "i": row after row, each entry of A with the row of B that it meets (Gustavson)
    sampled  each place of the finished product only where B stores it, times that entry: (A B) * B
    """
    left = stored(a.df)
    right = left if b.df is a.df else stored(b.df)
    value = F.coalesce(F.col(VALUE).cast("double"), F.lit(0.5)) if kernel == "or_and" else F.col(VALUE)

    def entries(t, df, first, second):
        return df.select(F.col(t.axes[0]).cast("long").alias(first), F.col(t.axes[1]).cast("long").alias(second), value.alias("v"))

    left, right = entries(a, left, "i", "k").where("k IS NOT NULL"), entries(b, right, "k", "j").where("k IS NOT NULL")
    found = right.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("j").alias("width")).first()
    cores = right.sparkSession.sparkContext.defaultParallelism
    n = max(-(-found["n"] // ENTRIES), min(cores, -(-found["n"] // LEAST)), 1)
    bounds = []
    if n > 1:
        cuts = right.agg(F.percentile_approx("j", [x / n for x in range(1, n)], max(10_000, 20 * n))).first()[0]
        bounds = sorted(set(cuts or []))
    rows = min(4096, max(64, CELLS * n // max(found["width"], 1)))
    bits = rows.bit_length() - 1
    right = right.withColumn("block", F.expr(f"CASE WHEN j IS NULL THEN 0 ELSE {_tree('j', bounds)} END").cast("int"))
    sent = left.join(right.select("k", "block").distinct(), "k")
    group = F.shiftright("i", bits)
    both = right.select("block", F.lit(0).alias("side"), F.lit(0).cast("long").alias("g"), F.col("k").alias("x"), F.col("j").alias("y"), "v").unionByName(
        sent.select("block", F.lit(1).alias("side"), group.alias("g"), F.col("k").alias("x"), F.col("i").alias("y"), "v")
    )
    placed = both.repartitionById(len(bounds) + 1, F.col("block")).sortWithinPartitions("block", "side", "g", *(("x", "y") if order == "k" else ("y", "x")))
    out = placed.mapInArrow(lambda batches: _multiply(batches, kernel, bits, sampled), "i long, j long, v double")
    return out.withColumn("v", F.col("v") == 1) if kernel == "or_and" else out


def _multiply(batches, kernel: str, bits: int, sampled: bool) -> Iterator:
    """Blocks one after the other, each with the right operand's entries first."""
    import pyarrow as pa

    block, held, state = None, [], None
    for batch in batches:
        names = batch.schema.names
        at = np.asarray(batch["block"])
        for lo, hi in _runs(at):
            if at[lo] != block:
                if state is not None:
                    yield from state.finish()
                block, held, state = at[lo], [], None
            part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
            split = int(np.searchsorted(np.asarray(part["side"]), 1))
            if split:
                held.append(part.slice(0, split))
            if split < part.num_rows:
                state = state or Block(pa.concat_tables(held).select(names), kernel, bits, sampled)
                held = []
                yield from state.stream(part.slice(split))
    if state is not None:
        yield from state.finish()


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of equal neighbours."""
    ends = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(x)])) if len(x) else []


def _long(column) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0)), np.asarray(column.is_null())


class Block:
    """A range of the right operand's columns, and the group of result rows that is being added up."""

    def __init__(self, right, kernel: str, bits: int, sampled: bool):
        self.kernel, self.bits, self.sampled = kernel, bits, sampled
        self.mul, self.add, self.empty = KERNELS[kernel]
        k = _long(right["x"])[0]
        j, none = _long(right["y"])
        order = np.argsort(k, kind="stable")  # by k already unless rows came first
        self.k, j, none = k[order], j[order], none[order]
        self.w, self.w_null = (x[order] for x in self._values(right["v"]))
        self.columns, code = np.unique(j[~none], return_inverse=True)
        self.col = np.full(len(j), len(self.columns))
        self.col[~none] = code
        self.keys, self.start = np.unique(self.k, return_index=True)
        self.count = np.diff(np.append(self.start, len(self.k)))
        self.width = len(self.columns) + 1
        self.cells = self.width << bits
        self.group = None
        self.dense, self.sparse, self.pending, self.merged = None, [], 0, 0

    def _values(self, column):
        if self.kernel == "or_and":
            v = np.asarray(column)
            return v, v == 0.5
        return np.asarray(column.fill_null(0.0)), np.asarray(column.is_null())

    def stream(self, left) -> Iterator:
        g, g_null = _long(left["g"])
        i, _ = _long(left["y"])
        k, _ = _long(left["x"])
        v, v_null = self._values(left["v"])
        at = np.searchsorted(self.keys, k)
        start, count = self.start[at], self.count[at]
        for lo, hi in _runs(g * 2 + g_null if not g_null.any() else np.where(g_null, 1, g * 2)):
            group = (bool(g_null[lo]), int(g[lo]))
            if group != self.group:
                yield from self.finish()
                self.group = group
            row = i[lo:hi] - (group[1] << self.bits)
            total = np.cumsum(count[lo:hi])
            x = 0
            while x < hi - lo:
                upto = (total[x - 1] if x else 0) + PRODUCTS
                to = max(x + 1, int(np.searchsorted(total, upto, side="right")))
                s = slice(lo + x, lo + to)
                self._add(row[x:to], start[s], count[s], v[s], v_null[s])
                x = to

    def _add(self, row, start, count, v, v_null):
        n = int(count.sum())
        each = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(n)
        p = self.mul(np.repeat(v, count), self.w[each])
        slot = np.repeat(row * self.width, count) + self.col[each]
        good = None
        if v_null.any() or self.w_null.any():
            good = p != 0.5 if self.kernel == "or_and" else ~(np.repeat(v_null, count) | self.w_null[each])
        if self.dense is None:
            if self.cells > MOST_CELLS or self.pending + n < self.cells // 16:
                self.sparse.append((slot, p, good))
                self.pending += n
                if self.pending > max(CELLS, 2 * self.merged):
                    self.sparse = [self._merge(self.sparse)]
                    self.pending = self.merged = len(self.sparse[0][0])
                return
            self.dense = np.full(self.cells, self.empty), np.zeros(self.cells, bool), np.zeros(self.cells, bool)
            for part in self.sparse:
                self._put(*part)
            self.sparse, self.pending, self.merged = [], 0, 0
        self._put(slot, p, good)

    def _put(self, slot, p, good):
        acc, seen, some = self.dense
        seen[slot] = True
        if good is not None:
            slot, p = slot[good], p[good]
        some[slot] = True
        self.add.at(acc, slot, p)

    def _merge(self, parts):
        """(places, values, whether not null) with each place once."""
        slot = np.concatenate([x[0] for x in parts])
        p = np.concatenate([x[1] for x in parts])
        good = np.concatenate([np.ones(len(x[0]), bool) if x[2] is None else x[2] for x in parts])
        place, inverse = np.unique(slot, return_inverse=True)
        acc, ok = np.full(len(place), self.empty), np.zeros(len(place), bool)
        self.add.at(acc, inverse[good], p[good])
        ok[inverse[good]] = True
        return place, acc, ok

    def finish(self) -> Iterator:
        """The group's rows of the result, complete."""
        if self.dense is None and not self.sparse:
            return
        null, g = self.group
        if self.dense is not None:
            acc, seen, some = self.dense
        if self.sampled:
            lo, hi = np.searchsorted(self.k, [g << self.bits, (g + 1) << self.bits])
            place = (self.k[lo:hi] - (g << self.bits)) * self.width + self.col[lo:hi]
            w, w_null = self.w[lo:hi], self.w_null[lo:hi]
            if self.dense is not None:
                hit = seen[place]
                place, w, w_null = place[hit], w[hit], w_null[hit]
                value, ok = acc[place], some[place]
            else:
                places, values, oks = self._merge(self.sparse)
                at = np.minimum(np.searchsorted(places, place), len(places) - 1)
                hit = places[at] == place
                place, w, w_null = place[hit], w[hit], w_null[hit]
                value, ok = values[at[hit]], oks[at[hit]]
            value, ok = self.mul(value, w), ok & ~w_null
        elif self.dense is not None:
            place = np.flatnonzero(seen)
            value, ok = acc[place], some[place]
        else:
            place, value, ok = self._merge(self.sparse)
        self.dense, self.sparse, self.pending, self.merged = None, [], 0, 0
        yield from self._out(place, value, ok, null, g)

    def _out(self, place, value, ok, null, g) -> Iterator:
        import pyarrow as pa

        for x in range(0, len(place), PRODUCTS):
            s = slice(x, x + PRODUCTS)
            row, col = np.divmod(place[s], self.width)
            j_null = col == len(self.columns)
            j = self.columns[np.minimum(col, len(self.columns) - 1)] if len(self.columns) else np.zeros(len(col), np.int64)
            i = pa.nulls(len(row), pa.int64()) if null else pa.array((g << self.bits) + row)
            yield pa.RecordBatch.from_arrays([i, pa.array(j, mask=j_null), pa.array(value[s], mask=~ok[s])], names=["i", "j", "v"])
