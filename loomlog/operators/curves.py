"""Look-ups on reference curves.

The different values that rows of a key ask for and the curve's knots are merged along the value
axis and cut into ranges of equal counts; each value then sees the knot before and after it, and the
answers are joined back. There is no range join and no packed curve, so neither long curves, hot keys
nor hot values gather in one place.
"""

from __future__ import annotations

from decimal import Decimal
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.exprs import clip, lerp
from loomlog.plans.blocks import BLOCK, Seq, dealt, framed, scan
from loomlog.plans.stage import staged

STEP_OFFSETS = [float(o) for o in range(-60, 61, 5)]
ENDPOINTS = [-60.0, -40.0, -25.0, -15.0, -8.0, 0.0, 8.0, 15.0, 25.0, 40.0, 60.0]


def in_order(knots: DataFrame) -> list[Column]:
    """What orders knots at one place: their row number, where they have one."""
    return [F.col("row_idx")] if "row_idx" in knots.columns else []


def found_at(asked: DataFrame, knots: DataFrame, x: str, carry: list[str], key: str = "well_id") -> DataFrame:
    """For every different (key, _x) of ``asked``: ``_lo`` the last knot with x <= _x, ``_hi`` the first with x > _x (structs of x
    and the carried columns), ``_below`` how many knots are <= _x, ``_n`` all knots of the key.

    Equal questions are asked once and equal knots counted into one, so one value over most rows is one row here, and ranges of
    equal counts are blocks of bounded size. Where the knots have a column ``row_idx`` it orders those at one x: the first of
    them ends the piece before it, the last begins the piece behind it. Without one they go by their carried columns."""
    asked = asked.where(F.col("_x").isNotNull()).select(key, "_x").distinct().withColumn("_kind", F.lit(1))
    knot = F.struct(F.col(x).alias("x"), *carry)
    given = knots.where(F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.struct(*in_order(knots), knot.alias("k")).alias("_k"))
    given = given.groupBy(key, "_x").agg(F.min("_k")["k"].alias("_first"), F.max("_k")["k"].alias("_last"), F.count("*").alias("_c")).withColumn("_kind", F.lit(0))
    both = dealt(asked.unionByName(given, allowMissingColumns=True), key, "_x")
    many = F.coalesce(F.col("_c"), F.lit(0).cast("bigint"))
    found = scan(
        both,
        run={"_below": many},
        last={"_lo": F.col("_last")},
        following={"_hi": F.col("_first")},
        total={"_n": ("sum", many)},
        seq=Seq(key=key),
        order=["_x", "_kind"],
        block=F.col(BLOCK),
    )
    return found.where("_kind = 1").select(key, "_x", "_lo", "_hi", "_below", "_n")


def joined_at(rows: DataFrame, found: DataFrame, q: str, key: str = "well_id", suffix: str = "") -> DataFrame:
    """The answers of ``found_at`` beside the rows that asked with column ``q``; NULL where q or the key's curve is missing."""
    own = [c for c in found.columns if c not in (key, "_x")]
    answers = found.select(F.col(key).alias("_key_"), F.col("_x").alias("_x_"), *[F.col(c).alias(f"{c}{suffix}") for c in own])
    return rows.join(answers, (F.col(key) == F.col("_key_")) & (F.col(q).cast("double") == F.col("_x_")), "left").drop("_key_", "_x_")


def locate(rows: DataFrame, knots: DataFrame, q: str, x: str, carry: list[str], key: str = "well_id", cheap: bool = False) -> DataFrame:
    """Add to every row what ``found_at`` says of its q. The rows are read twice, so they are written once before, unless they are ``cheap`` to make again."""
    rows = rows if cheap or hasattr(rows, "_stage_path") else staged(rows)
    found = found_at(rows.select(key, F.col(q).cast("double").alias("_x")), knots, x, carry, key)
    return joined_at(rows, found, q, key)


def curve_interp(
    rows: DataFrame, curve: DataFrame, q: str, out: str = "ref_gr", x: str = "tvt", y: str = "gr", outside: str = "hold", key: str = "well_id", cheap: bool = False
) -> DataFrame:
    """Linear interpolation of the key's curve at ``q``. Outside the curve the end values
    hold, or the result is NULL (``outside="null"``). Curves of one point give NULL."""
    got = locate(rows, curve.where(F.col(y).isNotNull()), q, x, [y], key, cheap)
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col(q)
    value = lerp(at, lo["x"], lo[y], hi["x"], hi[y])
    ok = at.isNotNull() & (F.col("_n") >= 2)
    if outside == "null":
        ok = ok & lo.isNotNull() & (hi.isNotNull() | (lo["x"] == at))
    return got.withColumn(out, F.when(ok, value)).drop("_lo", "_hi", "_below", "_n")


def curve_bounds(curve: DataFrame, x: str = "tvt", key: str = "well_id") -> DataFrame:
    return curve.groupBy(key).agg(F.min(x).alias("curve_min"), F.max(x).alias("curve_max"))


def curve_bounds_clip(rows: DataFrame, curve: DataFrame, col: str, key: str = "well_id") -> DataFrame:
    return rows.join(curve_bounds(curve, key=key), key, "left").withColumn(f"{col}_clipped", held_in_bounds(F.col(col)))


def held_in_bounds(value: Column) -> Column:
    """``value`` between the key's ``curve_min`` and ``curve_max``; as it is where the key has no curve."""
    return F.when(F.col("curve_min").isNull(), value).otherwise(clip(value, F.col("curve_min"), F.col("curve_max")))


def curve_grid(curve: DataFrame, step: float = 0.2, x: str = "tvt", y: str = "gr", key: str = "well_id") -> DataFrame:
    """Curve resampled on a uniform grid from its minimum. Multiples of the step are decimals, so a cell that falls on a knot meets it."""
    ends = curve_bounds(curve.where(F.col(y).isNotNull()), x, key)
    n = F.floor((F.col("curve_max") - F.col("curve_min")) / step).cast("bigint") + 1
    grid = ends.select(key, "curve_min", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("cell"))
    way = (F.col("cell").cast("decimal(19,0)") * F.lit(Decimal(str(step)))).cast("double")
    grid = grid.select(key, "cell", (F.col("curve_min") + way).alias("grid_x"))
    return curve_interp(grid, curve, "grid_x", "grid_y", x, y, key=key)


def nearest_knot(rows: DataFrame, curve: DataFrame, q: str, x: str = "tvt", key: str = "well_id") -> DataFrame:
    """Zero-based index and position of the nearest knot; the lower one on a tie."""
    got = locate(rows, curve, q, x, [], key)
    lo, hi, at = F.col("_lo")["x"], F.col("_hi")["x"], F.col(q)
    take_lo = hi.isNull() | (lo.isNotNull() & (F.abs(at - lo) <= F.abs(hi - at)))
    index = F.when(take_lo, F.col("_below") - 1).otherwise(F.col("_below"))
    ok = at.isNotNull() & (F.col("_n") > 0)
    got = got.withColumns({"knot_idx": F.when(ok, index), "knot_x": F.when(ok, F.when(take_lo, lo).otherwise(hi))})
    return got.drop("_lo", "_hi", "_below", "_n")


def asof_transfer_md(rows: DataFrame, donor: DataFrame, value: str = "tvt", md: str = "md", out: str = "copy", key: str = "well_id") -> DataFrame:
    """Value of another log of the same key on this log's md; NULL outside its range."""
    return curve_interp(rows, donor, md, out, md, value, "null", key)


def asof_transfer_all(rows: DataFrame, donor: DataFrame, values: list[str], md: str = "md", key: str = "well_id") -> DataFrame:
    """``asof_transfer_md`` of several values of one donor at once, as columns ``copy_<value>``: rows and donors are merged once, and each
    value is interpolated between the donor's rows that have it."""
    rows = rows if hasattr(rows, "_stage_path") else staged(rows)
    asked = rows.where(F.col(md).isNotNull()).select(key, F.col(md).cast("double").alias("_x")).distinct().withColumn("_kind", F.lit(1))
    own = [F.when(F.col(v).isNotNull(), F.struct(*in_order(donor), F.col(v).cast("double").alias("v"))) for v in values]
    given = donor.where(F.col(md).isNotNull()).select(key, F.col(md).cast("double").alias("_x"), *[c.alias(f"_v{i}") for i, c in enumerate(own)])
    ends = [agg(f"_v{i}")["v"].alias(f"_{end}{i}") for i in range(len(values)) for end, agg in (("first", F.min), ("last", F.max))]
    counts = [F.count(f"_v{i}").alias(f"_c{i}") for i in range(len(values))]
    given = given.groupBy(key, "_x").agg(*ends, *counts).withColumn("_kind", F.lit(0))

    def knot(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(name).alias("v")))

    found = scan(
        dealt(asked.unionByName(given, allowMissingColumns=True), key, "_x"),
        last={f"_lo{i}": knot(f"_last{i}") for i in range(len(values))},
        following={f"_hi{i}": knot(f"_first{i}") for i in range(len(values))},
        total={f"_n{i}": ("sum", F.coalesce(F.col(f"_c{i}"), F.lit(0).cast("bigint"))) for i in range(len(values))},
        seq=Seq(key=key), order=["_x", "_kind"], block=F.col(BLOCK),
    ).where("_kind = 1")
    at, made = F.col("_x"), []
    for i, v in enumerate(values):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        ok = (F.col(f"_n{i}") >= 2) & lo.isNotNull() & (hi.isNotNull() | (lo["x"] == at))
        made.append(F.when(ok, lerp(at, lo["x"], lo["v"], hi["x"], hi["v"])).alias(f"copy_{v}"))
    return joined_at(rows, found.select(key, "_x", *made), md, key)


def at_offsets(rows: DataFrame, curve: DataFrame, anchor: Column, offsets: list[float], scale: Column | None = None, key: str = "well_id") -> DataFrame:
    """Long form: one row per (row, offset) with the curve's value at anchor + offset.
    ``scale`` maps the curve value to the signal (affine calibration)."""
    rows = rows if hasattr(rows, "_stage_path") else staged(rows)
    wide = rows.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("_q", anchor + F.col("offset"))
    got = curve_interp(wide, curve, "_q", "cand_gr", key=key, cheap=True)
    return got if scale is None else got.withColumn("cand_gr", scale)


def values_at_offsets(rows: DataFrame, curve: DataFrame, anchor: Column, offsets: list[float], out: str = "cands", key: str = "well_id") -> DataFrame:
    """Wide form: an array of (offset, value) in the order of ``offsets`` beside every row. Only the different (key, anchor) pairs are
    multiplied by the offsets and looked up; rows get their array by one join."""
    rows = staged(rows.withColumn("_anchor", anchor.cast("double")))
    points = rows.where(F.col("_anchor").isNotNull()).select(key, "_anchor").distinct()
    points = points.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(o)).alias("offset")) for i, o in enumerate(offsets)])))
    points = curve_interp(points.withColumn("_q", F.col("_anchor") + F.col("_o")["offset"]), curve, "_q", "_v", key=key)
    arrays = points.groupBy(key, "_anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("_o")["i"].alias("i"), F.col("_o")["offset"].alias("offset"), F.col("_v").alias("value")))).alias("_all"))
    arrays = arrays.select(F.col(key).alias("_key_"), F.col("_anchor").alias("_at_"), F.transform("_all", lambda c: F.struct(c["offset"].alias("offset"), c["value"].alias("value"))).alias(out))
    return rows.join(arrays, (F.col(key) == F.col("_key_")) & (F.col("_anchor") == F.col("_at_")), "left").drop("_key_", "_at_", "_anchor")


def offset_residual_family(
    rows: DataFrame, curve: DataFrame, anchors: dict[str, tuple[Column, list[float]]], signal: str = "gr", ids=("well_id", "row_idx"), key: str = "well_id"
) -> DataFrame:
    """Signal minus curve at fixed offsets around several anchors, one column per pair."""
    pairs = [
        F.struct(F.lit(f"{name}_{'m' if o < 0 else 'p'}{abs(int(o))}").alias("_name"), (a + F.lit(float(o))).alias("_q"))
        for name, (a, offs) in anchors.items()
        for o in offs
    ]
    names = [f"{name}_{'m' if o < 0 else 'p'}{abs(int(o))}" for name, (_, offs) in anchors.items() for o in offs]
    long = curve_interp(rows.select(*ids, signal, F.inline(F.array(*pairs))), curve, "_q", "_ref", key=key)
    resid = F.col(signal) - F.col("_ref")
    return long.groupBy(*ids).agg(*[F.max(F.when(F.col("_name") == n, resid)).alias(n) for n in names])


def _best_of(long: DataFrame, ids, choice: str, gap: Column, score_scale: float) -> DataFrame:
    """Best candidate per row (first on a tie), gap to the second, soft mean. The groups are
    as large as the fixed candidate list."""
    pair = F.struct(gap.alias("r"), F.col("_rank"), F.col(choice).alias("c"), F.col("cand_gr").alias("g"))
    weight = F.exp(-gap / score_scale)
    agg = long.groupBy(*ids).agg(
        F.min(F.when(gap.isNotNull(), pair)).alias("_best"),
        F.slice(F.array_sort(F.collect_list(gap)), 1, 2).alias("_two"),
        (F.sum(weight * F.col(choice)) / F.sum(weight)).alias("soft_mean"),
        F.max(F.when(F.col(choice) == 0, gap)).alias("zero_abs"),
    )
    return agg.select(
        *ids,
        F.col("_best")["c"].alias("best"), F.col("_best")["r"].alias("best_abs"), "zero_abs",
        (F.try_element_at("_two", F.lit(2)) - F.try_element_at("_two", F.lit(1))).alias("top2_gap"),
        "soft_mean", F.col("_best")["g"].alias("best_gr"),
    )


def local_offset_search(rows: DataFrame, curve: DataFrame, anchor: Column, offsets=STEP_OFFSETS, signal: str = "gr", score_scale: float = 20.0,
                        ids=("well_id", "row_idx"), key: str = "well_id", scale: Column | None = None) -> DataFrame:
    if scale is not None:
        long = at_offsets(rows, curve, anchor, offsets, scale, key).withColumn("_rank", F.col("offset"))
        return _best_of(long, list(ids), "offset", F.abs(F.col(signal) - F.col("cand_gr")), score_scale)
    kept = list(dict.fromkeys([*ids, key]))
    got = values_at_offsets(rows.select(*kept, F.col(signal).cast("double").alias("_signal"), anchor.alias("_from")), curve, F.col("_from"), offsets, key=key)
    scored = F.transform("cands", lambda c: F.struct(F.abs(F.col("_signal") - c["value"]).alias("r"), c["offset"].alias("c"), c["value"].alias("g")))
    got = got.withColumn("_c", F.filter(scored, lambda c: c["r"].isNotNull()))
    two = F.slice(F.sort_array(F.transform("_c", lambda c: c["r"])), 1, 2)
    none = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("o"))
    sums = F.aggregate("_c", none, lambda s, c: F.struct((s["w"] + F.exp(-c["r"] / score_scale)).alias("w"), (s["o"] + F.exp(-c["r"] / score_scale) * c["c"]).alias("o")))
    got = got.withColumns({"_best": F.array_min("_c"), "_two": two, "_sums": sums})
    zero = F.filter("_c", lambda c: c["c"] == 0)
    return got.select(
        *ids,
        F.col("_best")["c"].alias("best"), F.col("_best")["r"].alias("best_abs"), F.try_element_at(zero, F.lit(1))["r"].alias("zero_abs"),
        (F.try_element_at("_two", F.lit(2)) - F.try_element_at("_two", F.lit(1))).alias("top2_gap"),
        F.when(F.size("_c") > 0, F.col("_sums")["o"] / F.nullif(F.col("_sums")["w"], F.lit(0.0))).alias("soft_mean"), F.col("_best")["g"].alias("best_gr"),
    )


def curve_boundaries(curve: DataFrame, x: str = "tvt", label: str = "geology", key: str = "well_id", bounds: bool = False) -> DataFrame:
    """Positions along the sorted curve where the label differs from the knot before;
    with ``bounds`` also both ends of the curve. Each position once."""
    clean = curve.where(F.col(x).isNotNull() & F.col(label).isNotNull())
    seq = Seq(key=key, pos="_i")
    given = dealt(clean.select(key, x, label).distinct(), key, x)  # equal knots change nothing
    ranked = scan(given, run={"_i": F.lit(1).cast("bigint")}, seq=seq, order=[x, label], block=F.col(BLOCK))
    ranked = ranked.withColumn("_i", F.col("_i") - 1)
    marked = framed(ranked, lambda w: {"_prev": F.lag(label).over(w)}, 1, 0, seq)
    out = marked.where(F.col("_prev") != F.col(label)).select(key, F.col(x).alias("boundary"))
    if bounds:
        ends = curve_bounds(curve, x, key).where("curve_max > curve_min")
        out = out.union(ends.select(key, "curve_min")).union(ends.select(key, "curve_max")).distinct()
    return out


def interval_context(rows: DataFrame, bounds: DataFrame, q: str, key: str = "well_id") -> DataFrame:
    """Interval of ``bounds`` that holds q (values outside use the end intervals), distances
    to both ends, thickness, phase and derived measures."""
    seq = Seq(key=key, pos="_i")
    ranked = scan(dealt(bounds, key, "boundary"), run={"_i": F.lit(1).cast("bigint")}, total={"_nb": ("sum", F.lit(1).cast("bigint"))}, seq=seq, order=["boundary"], block=F.col(BLOCK))
    ranked = ranked.withColumn("_i", F.col("_i") - 1)
    spans = framed(ranked, lambda w: {"_base": F.lead("boundary").over(w)}, 0, 1, seq).where(F.col("_base").isNotNull())
    got = locate(rows, spans, q, "boundary", ["_base"], key)
    # below the first interval there is no knot before q: use the one after it
    at, span = F.col(q), F.coalesce("_lo", "_hi")
    top, thick = span["x"], span["_base"] - span["x"]
    ok = at.isNotNull() & (F.abs(thick) > 1e-9)
    prev, succ = at - top, span["_base"] - at
    phase = prev / thick
    made = {
        "prev_dist": prev, "next_dist": succ, "thickness": thick, "phase": phase,
        "phase_sin": F.sin(phase * pi), "phase_cos": F.cos(phase * pi),
        "balance": (succ - prev) / (thick + 1e-6), "proximity": F.least(prev, succ) / (thick + 1e-6),
    }
    return got.withColumns({n: F.when(ok, c) for n, c in made.items()}).drop("_lo", "_hi", "_below", "_n")


def boundary_counts(rows: DataFrame, boundaries: DataFrame, a: str, b: str, key: str = "well_id") -> DataFrame:
    """Boundaries between two values, open below and closed above, and the distance of ``b``
    to the nearest one. Counts are differences of ranks, so nothing is paired."""
    rows = rows if hasattr(rows, "_stage_path") else staged(rows)
    asked = rows.select(key, F.explode(F.array(F.col(a).cast("double"), F.col(b).cast("double"))).alias("_x"))
    found = staged(found_at(asked, boundaries, "boundary", [], key))
    got = joined_at(joined_at(rows, found.select(key, "_x", F.col("_below").alias("_ra")), a, key), found, b, key)
    lo, hi, at = F.col("_lo")["x"], F.col("_hi")["x"], F.col(b)
    some = F.col("_n") > 0
    near = F.least(F.abs(at - lo), F.abs(hi - at))
    return got.withColumns(
        {
            "crossed": F.when(some & F.col(a).isNotNull() & at.isNotNull(), F.abs(F.col("_below") - F.col("_ra"))),
            "nearest": F.when(some & at.isNotNull(), near),
        }
    ).drop("_lo", "_hi", "_below", "_n", "_ra")


def candidate_paths(rows: DataFrame, curve: DataFrame, boundaries: DataFrame, start: str, frac: Column, endpoints=ENDPOINTS, signal: str = "gr",
                    score_scale: float = 20.0, ids=("well_id", "row_idx"), key: str = "well_id") -> tuple[DataFrame, DataFrame]:
    """Straight drifts from the anchor to several endpoints: (long scores per endpoint, best per row)."""
    wide = rows.select(*ids, signal, start, frac.alias("_f")).withColumn("endpoint", F.explode(F.array(*[F.lit(float(e)) for e in endpoints])))
    wide = wide.withColumn("cand", F.col(start) + F.col("_f") * F.col("endpoint"))
    long = curve_interp(wide, curve, "cand", "cand_gr", key=key)
    diff = F.col(signal) - F.col("cand_gr")
    long = boundary_counts(long, boundaries, start, "cand", key).withColumns({"diff": diff, "absdiff": F.abs(diff), "_rank": F.col("endpoint")})
    return long.drop("_rank"), _best_of(long, list(ids), "endpoint", F.abs(diff), score_scale)


def contact_reconstruction(rows: DataFrame, curve: DataFrame, surfaces: dict[str, str] | str, label: str, x: str = "tvt", key: str = "well_id") -> DataFrame:
    """Target rebuilt from a surface: reference position of ``label`` on the curve, minus height over the label's surface, plus the
    mean offset to the known target. A curve without ``label`` takes its first label, going by ``x``, with that label's
    position and surface (of labels at one place the first by ``row_idx``, where the curve has it). ``surfaces`` names a column of ``rows`` for every label; a label without one gives NULL.
    One column name in place of the dict serves all labels."""
    named = curve.where(F.col("geology").isNotNull())
    hit = F.min(F.when(F.col("geology") == label, F.col(x)))
    ref = named.groupBy(key).agg(F.coalesce(hit, F.min(x)).alias("ref_tvt"), F.when(hit.isNotNull(), F.lit(label)).otherwise(F.min_by("geology", F.struct(x, *in_order(curve)))).alias("_label"))
    height = F.col(surfaces) if isinstance(surfaces, str) else F.coalesce(*[F.when(F.col("_label") == name, F.col(c)) for name, c in surfaces.items()])
    raw = rows.join(ref, key).withColumn("_raw", F.col("ref_tvt") - (F.col("z") - height))
    shift = raw.groupBy(key).agg(F.avg(F.col("tvt_input") - F.col("_raw")).alias("_shift"))
    return raw.join(shift, key).withColumn("contact_tvt", F.col("_raw") + F.coalesce(F.col("_shift"), F.lit(0.0))).drop("_raw", "_shift", "_label")
