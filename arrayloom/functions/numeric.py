"""Column functions that kernels share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Rounds to whole numbers, halves to even ones."""
    return F.bround(x, 0)


def wrap_int8(x: Column) -> Column:
    """The value modulo 256 as a signed byte."""
    return (F.pmod(F.floor(x).cast("long") + 128, F.lit(256)) - 128).cast("long")


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def uniform(*coordinates: Column, seed: int = 0, modulus: int = 1_000_003) -> Column:
    """A number in [0, 1) from whole coordinates: the same on every run and engine."""
    mixed = F.lit(seed * 7919 + 17).cast("long")
    for k, c in enumerate(coordinates):
        mixed = (mixed * 48271 + c.cast("long") * (73856 + 19349 * k) + 12345) % modulus
    mixed = (mixed * mixed + 48271 * mixed) % modulus
    return mixed / F.lit(float(modulus))


def uniform_sql(*coordinates: str, seed: int = 0, modulus: int = 1_000_003) -> str:
    mixed = f"CAST({seed * 7919 + 17} AS BIGINT)"
    for k, c in enumerate(coordinates):
        mixed = f"(({mixed} * 48271 + CAST({c} AS BIGINT) * {73856 + 19349 * k} + 12345) % {modulus})"
    return f"((({mixed} * {mixed} + 48271 * {mixed}) % {modulus}) / {float(modulus)})"
