"""Ordered work on keyed sequences, cut into blocks of bounded size.

One key may hold a large share of all rows, so no window here is partitioned by
the key alone. A key is cut into blocks along its order; windows run on
``(key, block)`` and whatever must cross a block border travels another way:

* ``framed`` gives every block copies of the few neighbouring rows a ROWS frame
  can reach, and drops the copies afterwards;
* ``scan`` reduces each block to one summary row, runs over the summaries of a
  key, and joins the carried values back on ``(key, block)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

BLOCK = "_block"
BLOCK_ROWS = 1 << 16
AXIS_ROWS = 1 << 14
BACK = (W.unboundedPreceding, W.currentRow)


@dataclass(frozen=True)
class Seq:
    """Where the order of a keyed log lives: ``pos`` counts 0..n-1 inside ``key``."""

    key: str = "well_id"
    pos: str = "row_idx"
    rows: int = BLOCK_ROWS

    def block(self) -> Column:
        return F.expr(f"`{self.pos}` div {self.rows}")


SEQ = Seq()


def framed(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    seq: Seq = SEQ,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Add the columns ``build(w)`` whose frames look at most ``before`` rows back and
    ``after`` rows ahead. One exchange, whatever the number of columns. ``beside`` has one row
    per (key, ``BLOCK``), see ``per_block``; it is joined where the rows lie, without another exchange of them."""
    if max(before, after) > seq.rows:
        raise ValueError("a frame may not be longer than a block")
    own, offset = seq.block(), F.col(seq.pos) % seq.rows
    homes = [own]
    if before:
        homes.append(F.when(offset >= seq.rows - before, own + 1))
    if after:
        homes.append(F.when((offset < after) & (own > 0), own - 1))
    spread = df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*homes))) if len(homes) > 1 else own)
    w = W.partitionBy(seq.key, BLOCK).orderBy(seq.pos)
    made = build(w)
    kept = [c for c in df.columns if c not in made]
    out = spread.select(*kept, BLOCK, *[c.alias(name) for name, c in made.items()])
    out = out.where(F.col(BLOCK) == own)
    if beside is not None:
        out = out.join(beside, [seq.key, BLOCK])
    return out.drop(BLOCK)


def per_block(df: DataFrame, keys: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """A table of one row per key, repeated for every block the key has in ``df``."""
    return df.select(seq.key, seq.block().alias(BLOCK)).distinct().join(keys, seq.key)


def axis_block(df: DataFrame, key: str, axis: str, rows: int | None = None) -> Column:
    """Block number along a numeric axis, for logs that have no row number yet.

    The width comes from a scalar subquery over the data (largest key, range of
    the axis), so every branch of a plan computes the same blocks.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n"), F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    s = sizes.agg(
        F.struct(
            F.ceil(F.max("n") / (rows or AXIS_ROWS)).alias("blocks"),
            F.min("lo").cast("double").alias("lo"),
            (F.max("hi") - F.min("lo")).cast("double").alias("span"),
        ).alias("s")
    ).scalar()
    at = F.floor((F.col(axis) - s["lo"]) / F.nullif(s["span"], F.lit(0.0)) * s["blocks"])
    return F.coalesce(F.least(at, s["blocks"] - 1), F.lit(0)).cast("bigint")


def dealt(df: DataFrame, key: str, axis: str) -> DataFrame:
    """``df`` written once in ranges of (key, axis) of about equal counts, numbered by ``BLOCK``.

    Spark draws the limits from a sample, so a key with a narrow range, or with most rows, is cut where its rows are. Rows of one
    (key, axis) stay together: bring each pair once or a few times (see ``curves.found_at``)."""
    from loomlog.plans.stage import staged

    return staged(df.repartitionByRange(key, axis).withColumn(BLOCK, F.spark_partition_id().cast("bigint")))


def _by(value: Column, order: Column, last: bool) -> Column:
    at = F.when(value.isNotNull(), order)
    return F.max_by(value, at) if last else F.min_by(value, at)


def scan(
    df: DataFrame,
    *,
    run: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    total: dict[str, tuple[str, Column]] | None = None,
    seq: Seq = SEQ,
    order: list[str] | None = None,
    block: Column | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Add order-dependent columns that look over a whole key.

    run        inclusive running sum (NULL counts as 0)
    last       last non-NULL value at or before the row
    following  first non-NULL value at or after the row
    total      value of the whole key: sum, min, max, last or first non-NULL
    beside     a table of one row per key, whose columns come with the carried values
    """
    run, last, following, total = run or {}, last or {}, following or {}, total or {}
    order = order or [seq.pos]
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    d = df.withColumn(BLOCK, seq.block() if block is None else block)

    parts = [F.count(F.lit(1)).alias("_rows")]
    parts += [F.sum(c).alias(f"_run_{n}") for n, c in run.items()]
    parts += [_by(c, at, True).alias(f"_last_{n}") for n, c in last.items()]
    parts += [_by(c, at, False).alias(f"_next_{n}") for n, c in following.items()]
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    for n, (kind, c) in total.items():
        part = kinds[kind](c) if kind in kinds else _by(c, at, kind == "last")
        parts.append(part.alias(f"_tot_{n}"))

    by_key = W.partitionBy(seq.key)
    up, down = by_key.orderBy(BLOCK), by_key.orderBy(F.desc(BLOCK))
    before = (W.unboundedPreceding, -1)
    carried = [F.sum(f"_run_{n}").over(up.rowsBetween(*before)).alias(f"_run_{n}") for n in run]
    carried += [F.last(f"_last_{n}", True).over(up.rowsBetween(*before)).alias(f"_last_{n}") for n in last]
    carried += [F.last(f"_next_{n}", True).over(down.rowsBetween(*before)).alias(f"_next_{n}") for n in following]
    for n, (kind, _) in total.items():
        c = f"_tot_{n}"
        if kind in kinds:
            whole = kinds[kind](c).over(by_key)
        else:
            ends = (up if kind == "last" else down).rowsBetween(*BACK)
            # the last row of this running value is the value of the whole key
            whole = F.last(c, True).over(ends)
            whole = F.struct(whole.alias("v"))
        carried.append(whole.alias(c))
    table = d.groupBy(seq.key, BLOCK).agg(*parts).select(seq.key, BLOCK, *carried)
    ends_at = [n for n, (kind, _) in total.items() if kind not in kinds]
    if ends_at:
        picks = []
        for n in ends_at:
            kind = total[n][0]
            pick = F.max_by(f"_tot_{n}", BLOCK) if kind == "last" else F.min_by(f"_tot_{n}", BLOCK)
            picks.append(pick.over(by_key)["v"].alias(f"_tot_{n}"))
        rest = [c for c in table.columns if c not in {f"_tot_{n}" for n in ends_at}]
        table = table.select(*rest, *picks)

    if beside is not None:
        table = table.join(beside, seq.key)

    inside = W.partitionBy(seq.key, BLOCK)
    fwd = inside.orderBy(*order).rowsBetween(*BACK)
    rev = inside.orderBy(*[F.desc(c) for c in order]).rowsBetween(*BACK)
    local = [F.sum(c).over(fwd).alias(f"_in_run_{n}") for n, c in run.items()]
    local += [F.last(c, True).over(fwd).alias(f"_in_last_{n}") for n, c in last.items()]
    local += [F.last(c, True).over(rev).alias(f"_in_next_{n}") for n, c in following.items()]
    rows = d.select("*", *local) if local else d
    joined = rows.join(table, [seq.key, BLOCK])

    zero = F.lit(0)
    made = {n: F.coalesce(F.col(f"_run_{n}"), zero) + F.coalesce(F.col(f"_in_run_{n}"), zero) for n in run}
    made |= {n: F.coalesce(F.col(f"_in_last_{n}"), F.col(f"_last_{n}")) for n in last}
    made |= {n: F.coalesce(F.col(f"_in_next_{n}"), F.col(f"_next_{n}")) for n in following}
    made |= {n: F.col(f"_tot_{n}") for n in total}
    kept = [c for c in df.columns if c not in made and c != BLOCK]
    own = [c for c in beside.columns if c != seq.key] if beside is not None else []
    return joined.select(*kept, *[c.alias(n) for n, c in made.items()], *own)
