"""Exact grouped quantiles that never gather a whole group.

Every value falls into a fixed, order-preserving bin. Bin counts (combined before
the shuffle) tell which bins hold the wanted ranks; only the values of those bins
are ranked, each distinct value once. The result equals the linearly interpolated
``percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS_PER_UNIT = 1 << 14


def _bin(v: Column) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS_PER_UNIT)


def _position(p, n: Column) -> Column:
    return p(n) if callable(p) else F.lit(float(p)) * (n - 1)


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """``wanted`` maps an output name to (value, probability); a function of the group size
    in place of the probability gives the zero-based position itself. NULL and NaN values are
    left out; a group without values gets NULL. ``keys`` may be empty (one row)."""
    df = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    out = _quantiles(df, by, by, lambda counts, *more: counts, wanted)
    return out if keys else out.drop("_all")


def quantiles_held_out(df: DataFrame, fold: str, folds: int, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row per ``held`` fold: the quantiles of all rows of other folds. Rows are counted once, by their own fold; counts are summed
    over the folds that a held one leaves, and single values are read in the few bins that hold a wanted rank."""

    def left(counts: DataFrame, *more: str) -> DataFrame:
        each = counts.withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(folds)]))).where(F.col(fold) != F.col("held"))
        return each.groupBy("held", "_s", "_b", *more).agg(F.sum("_c").alias("_c"))

    return _quantiles(df, [fold], ["held"], left, wanted, few=True)


def quantile_grid(df: DataFrame, fold: str, folds: int, columns: list[str], counts: tuple[int, ...]) -> DataFrame:
    """``quantiles_held_out`` of several columns at every i / n for the ``counts`` n, in long form: (held, column, p, value). The work
    per row does not grow with the probabilities."""
    wanted = F.array(*[F.lit(p) for p in sorted({i / n for n in counts for i in range(1, n)})])
    long = df.select(fold, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])))
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", _bin(F.col("_v")))

    def left(counts: DataFrame, *by: str) -> DataFrame:
        each = counts.withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(folds)]))).where(F.col(fold) != F.col("held"))
        return each.groupBy("held", *by).agg(F.sum("_c").alias("_c"))

    def covered(start: Column, end: Column) -> Column:
        at = lambda p: p * (F.col("_n") - 1)
        return F.filter(wanted, lambda p: ((F.ceil(at(p)) >= start) & (F.ceil(at(p)) < end)) | ((F.floor(at(p)) >= start) & (F.floor(at(p)) < end)))

    def near(start: Column, end: Column) -> Column:
        """A cheap sieve before ``covered``: some i / n of the last rank is at most two ranks off."""
        steps = [F.lit(float(n)) / F.greatest(F.col("_n") - 1, F.lit(1)) for n in counts]
        return F.greatest(*[F.floor((end + 2) * s) - F.ceil((start - 2) * s) for s in steps], F.lit(-1)) >= 0

    group = W.partitionBy("held", "column")
    hist = left(long.groupBy(fold, "column", "_b").agg(F.count("*").alias("_c")), "column", "_b")
    hist = hist.select("held", "column", "_b", (F.sum("_c").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_base"), "_c", F.sum("_c").over(group).alias("_n"))
    base, top = F.col("_base"), F.col("_base") + F.col("_c")
    bins = hist.where(near(base, top)).where(F.size(covered(base, top)) > 0).drop("_c")
    few = long.join(F.broadcast(bins.select("column", "_b").distinct()), ["column", "_b"])  # two bins per held fold and probability
    values = left(few.groupBy(fold, "column", "_b", "_v").agg(F.count("*").alias("_c")), "column", "_b", "_v").join(bins, ["held", "column", "_b"])
    before = W.partitionBy("held", "column", "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = values.withColumn("_end", F.col("_base") + F.sum("_c").over(before)).withColumn("_start", F.col("_end") - F.col("_c"))
    start, end = F.col("_start"), F.col("_end")
    ranked = ranked.where(near(start, end)).withColumn("p", F.explode(covered(start, end)))
    at = F.col("p") * (F.col("_n") - 1)
    frac = at - F.floor(at)
    has_lo, has_hi = ((r >= start) & (r < end) for r in (F.floor(at), F.ceil(at)))
    part = F.when(has_lo & has_hi, F.col("_v")).when(has_lo, F.col("_v") * (1 - frac)).otherwise(F.col("_v") * frac)
    return ranked.groupBy("held", "column", "p").agg(F.sum(part).alias("value"))


def _quantiles(df: DataFrame, own: list[str], by: list[str], regroup, wanted: dict, few: bool = False) -> DataFrame:
    """``regroup`` turns counts by ``own`` into counts by ``by``. With ``few`` groups their wanted bins are broadcast and sift the rows."""
    texts = list(dict.fromkeys(str(c) for c, _ in wanted.values()))
    exprs = {str(c): c for c, _ in wanted.values()}
    slot = {t: i for i, t in enumerate(texts)}
    pairs = [F.struct(F.lit(i).alias("_s"), exprs[t].cast("double").alias("_v")) for t, i in slot.items()]
    long = df.select(*own, F.inline(F.array(*pairs)))
    long = long.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", _bin(F.col("_v")))

    probs = {i: list(dict.fromkeys(p for c, p in wanted.values() if slot[str(c)] == i)) for i in slot.values()}
    group = W.partitionBy(*by, "_s")
    hist = regroup(long.groupBy(*own, "_s", "_b").agg(F.count("*").alias("_c")))
    hist = hist.select(
        *by, "_s", "_b", "_c",
        F.sum("_c").over(group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)).alias("_top"),
        F.sum("_c").over(group).alias("_n"),
    )
    hits = None
    for i, ps in probs.items():
        for p in ps:
            at = _position(p, F.col("_n"))
            base = F.col("_top") - F.col("_c")
            hit = (F.col("_s") == i) & (F.ceil(at) >= base) & (F.floor(at) < F.col("_top"))
            hits = hit if hits is None else hits | hit
    bins = hist.where(hits).select(*by, "_s", "_b", (F.col("_top") - F.col("_c")).alias("_base"), "_n")

    if few:
        long = long.join(F.broadcast(bins.select("_s", "_b").distinct()), ["_s", "_b"])  # two bins per group and rank
    values = regroup(long.groupBy(*own, "_s", "_b", "_v").agg(F.count("*").alias("_c")), "_v").join(bins, [*by, "_s", "_b"])
    ranked = values.withColumn(
        "_end",
        F.col("_base")
        + F.sum("_c").over(W.partitionBy(*by, "_s", "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)),
    )
    start = F.col("_end") - F.col("_c")
    outs = []
    for name, (c, p) in wanted.items():
        at = _position(p, F.col("_n"))
        lo, hi = F.floor(at), F.ceil(at)
        frac = at - lo
        mine = F.col("_s") == slot[str(c)]

        def covers(rank: Column) -> Column:
            return mine & (rank >= start) & (rank < F.col("_end"))

        part = F.when(covers(lo) & covers(hi), F.col("_v"))
        part = part.when(covers(lo), F.col("_v") * (1 - frac)).when(covers(hi), F.col("_v") * frac)
        outs.append(F.sum(part).alias(name))
    return ranked.groupBy(*by).agg(*outs)
