"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo, hi) -> Column:
    """Limit to [lo, hi]; unlike ``greatest``/``least`` alone, NULL stays NULL."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def finite(c: Column) -> Column:
    """NaN and infinities are missing values: turn them into NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """Coerce to double; text that is no number becomes NULL."""
    return finite(c.try_cast("double"))


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Value at ``x`` on the line through two knots; one knot alone is held constant."""
    return (
        F.when(x0.isNull(), y1)
        .when(x1.isNull() | (x0 == x1), y0)
        .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    )


def row_key(row_id: Column) -> Column:
    """Key part of ``<key>_<row>``, split at the last underscore."""
    return F.nullif(F.regexp_extract(row_id, r"^(.+)_(\d+)$", 1), F.lit(""))


def row_number_of(row_id: Column) -> Column:
    return F.nullif(F.regexp_extract(row_id, r"^(.+)_(\d+)$", 2), F.lit("")).cast("bigint")


def make_row_id(key: Column, row: Column) -> Column:
    return F.concat_ws("_", key, row.cast("string"))


def stable_seed(key: Column, base: int = 0) -> Column:
    """Seed that depends on the key text alone: first 8 hex digits of its md5."""
    head = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head + F.lit(base), F.lit(2147483647).cast("bigint"))


def bin_of(x: Column, cuts: list[float]) -> Column:
    """Number of cuts that are <= x."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= x))
