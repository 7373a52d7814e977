"""Contractions over a semiring, planned as joins and grouped aggregations.

Planning does what the optimiser doesn't: an index that only one operand has and that isn't asked for is summed out below
the join (sum of A(i,j) B(j,k) becomes joined column and row sums), operands are joined along shared indices first, and
indices are aggregated away after the last join. The physical joins are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tensor import VALUE, SparseTensor
from . import blocks


@dataclass(frozen=True)
class Semiring:
    add: object
    mul: object
    zero: float
    kernel: str | None = None  # its name in blocks

    def reduce(self, column: str) -> Column:
        return self.add(column)


SUM_PRODUCT = Semiring(F.sum, lambda a, b: a * b, 0.0, "sum_product")
MIN_PLUS = Semiring(F.min, lambda a, b: a + b, float("inf"), "min_plus")
MAX_MIN = Semiring(F.max, lambda a, b: F.least(a, b), 0.0)
OR_AND = Semiring(F.bool_or, lambda a, b: a & b, False, "or_and")


def einsum(spec: str, *operands: SparseTensor, semiring: Semiring = SUM_PRODUCT, preaggregate: bool = True, blocked: bool = False) -> SparseTensor:
    """`einsum("ij,jk->ik", a, b)`. A scalar result has no axes and one row.

    blocked: a matrix product whose result outgrows a task's memory is made in blocks (`plans.blocks`), not by joined and grouped rows.
    """
    left, _, out = spec.replace(" ", "").partition("->")
    terms = left.split(",")
    if len(terms) != len(operands):
        raise ValueError("the number of operands and terms differ")
    sizes: dict[str, int] = {}
    parts: list[tuple[set[str], object]] = []
    for term, t in zip(terms, operands):
        if len(set(term)) != len(term) or len(term) != len(t.axes):
            raise ValueError(f"term {term!r} doesn't fit axes {t.axes}")
        for axis, n in zip(term, t.shape or ()):
            if sizes.setdefault(axis, n) != n:
                raise ValueError(f"dimension {axis!r} differs: {sizes[axis]} and {n}")
        parts.append((set(term), t.rename(*term).coo()))
    if set(out) - set().union(*(p[0] for p in parts)):
        raise ValueError("an output index is in no operand")

    if blocked and len(terms) == 2 and terms[0][1:] == terms[1][:1] and out == terms[0][0] + terms[1][1] and blocks.supported(*operands, semiring.kernel):
        df = blocks.product(*operands, semiring.kernel).toDF(*out, VALUE)
        return SparseTensor(df, tuple(out), tuple(sizes[a] for a in out) if all(a in sizes for a in out) else None, semiring.zero)

    def reduce(part, others):
        axes, df = part
        wanted = set(out).union(*(o[0] for o in others)) if others else set(out)
        if axes <= wanted or not preaggregate and others:
            return part
        kept = sorted(axes & wanted)
        agg = semiring.reduce(VALUE).alias(VALUE)
        return set(kept), (df.groupBy(*kept).agg(agg) if kept else df.agg(agg))

    parts = [reduce(p, parts[:i] + parts[i + 1 :]) for i, p in enumerate(parts)]
    axes, df = parts.pop(0)
    while parts:
        # the operand with most shared indices, then the first
        k = max(range(len(parts)), key=lambda x: (len(axes & parts[x][0]), -x))
        other, right = parts.pop(k)
        shared = sorted(axes & other)
        right = right.withColumnRenamed(VALUE, "_r")
        joined = df.join(right, shared) if shared else df.crossJoin(right)
        axes = axes | other
        df = joined.select(*sorted(axes), semiring.mul(F.col(VALUE), F.col("_r")).alias(VALUE))
        if not parts:
            axes, df = reduce((axes, df), [])
    if not out:
        df = df.agg(F.coalesce(semiring.reduce(VALUE), F.lit(semiring.zero)).alias(VALUE)) if axes else df.select(F.coalesce(VALUE, F.lit(semiring.zero)).alias(VALUE))
    elif axes != set(out):
        df = df.groupBy(*out).agg(semiring.reduce(VALUE).alias(VALUE))
    return SparseTensor(df.select(*out, VALUE), tuple(out), tuple(sizes[a] for a in out) if all(a in sizes for a in out) else None, semiring.zero)
