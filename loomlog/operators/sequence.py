"""Features of keyed, ordered logs. The block plans live in ``plans.blocks``."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from loomlog.functions.exprs import lerp
from loomlog.plans.blocks import SEQ, Seq, framed, scan
from loomlog.plans.quantiles import quantiles


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _first_row(c: str, seq: Seq) -> tuple[str, Column]:
    """Value of the key's first row, NULL when that row has none."""
    return "max", F.when(F.col(seq.pos) == 0, F.col(c))


def key_start(df: DataFrame, md: str = "md", cols=("x", "y", "z"), seq: Seq = SEQ) -> DataFrame:
    """One row per key: how many rows, the least md, and the first row's values as ``_<c>0``."""
    first = [F.max(_first_row(c, seq)[1]).alias(f"_{c}0") for c in cols]
    return df.groupBy(seq.key).agg(F.count("*").alias("n_rows"), F.min(md).alias("md0"), *first)


def position_columns(md: str = "md", seq: Seq = SEQ) -> dict[str, Column]:
    frac = F.col(seq.pos) / F.greatest(F.col("n_rows") - 1, F.lit(1))
    return {"row_frac": frac, "md_from_start": F.col(md) - F.col("md0")}


def row_position(df: DataFrame, md: str = "md", seq: Seq = SEQ) -> DataFrame:
    rows = scan(df, total={"n_rows": ("sum", _one()), "md0": ("min", F.col(md))}, seq=seq)
    return rows.withColumns(position_columns(md, seq)).drop("md0")


def delta_columns(cols=("x", "y", "z")) -> dict[str, Column]:
    return {f"{c}_from_start": F.col(c) - F.col(f"_{c}0") for c in cols}


def from_start_deltas(df: DataFrame, cols=("x", "y", "z"), seq: Seq = SEQ) -> DataFrame:
    rows = scan(df, total={f"_{c}0": _first_row(c, seq) for c in cols}, seq=seq)
    return rows.withColumns(delta_columns(cols)).drop(*[f"_{c}0" for c in cols])


def geometry_columns(x: str = "x", y: str = "y") -> dict[str, Column]:
    dx, dy = F.col(x) - F.col(f"_{x}0"), F.col(y) - F.col(f"_{y}0")
    az = F.atan2(dy, dx)
    return {"xy_dist_from_start": F.sqrt(dx * dx + dy * dy), "azimuth_sin": F.sin(az), "azimuth_cos": F.cos(az)}


def xy_geometry(df: DataFrame, x: str = "x", y: str = "y", seq: Seq = SEQ) -> DataFrame:
    rows = scan(df, total={f"_{c}0": _first_row(c, seq) for c in (x, y)}, seq=seq)
    return rows.withColumns(geometry_columns(x, y)).drop(f"_{x}0", f"_{y}0")


def gap_parts(cols: dict[str, str], fallback: float | None = None, seq: Seq = SEQ) -> tuple[dict, dict, dict]:
    """What a scan must carry to fill gaps by row position (last, following), and the filled columns."""
    pos = F.col(seq.pos)
    last, following = {}, {}
    for c in cols:
        known_at = F.when(F.col(c).isNotNull(), pos)
        last |= {f"_{c}v0": F.col(c), f"_{c}p0": known_at}
        following |= {f"_{c}v1": F.col(c), f"_{c}p1": known_at}
    made = {}
    for c, out in cols.items():
        made[out] = lerp(pos, *[F.col(f"_{c}{k}") for k in ("p0", "v0", "p1", "v1")])
        if fallback is not None:
            made[out] = F.coalesce(made[out], F.lit(float(fallback)))
    return last, following, made


def interpolate_linear(df: DataFrame, cols: dict[str, str], fallback: float | None = None, seq: Seq = SEQ) -> DataFrame:
    """Fill gaps by row position, ends with the nearest value. ``cols``: source -> output."""
    last, following, made = gap_parts(cols, fallback, seq)
    return scan(df, last=last, following=following, seq=seq).withColumns(made).drop(*last, *following)


def fill_parts(cols: dict[str, str]) -> tuple[dict, dict, dict]:
    """What a scan must carry to fill forward, then back (last, following), and the filled columns."""
    last = {f"_{c}b": F.col(c) for c in cols}
    following = {f"_{c}f": F.col(c) for c in cols}
    return last, following, {out: F.coalesce(F.col(f"_{c}b"), F.col(f"_{c}f")) for c, out in cols.items()}


def ffill_bfill(df: DataFrame, cols: dict[str, str], seq: Seq = SEQ) -> DataFrame:
    last, following, made = fill_parts(cols)
    return scan(df, last=last, following=following, seq=seq).withColumns(made).drop(*last, *following)


def _stats(x: Column, frame, floor: int, std_floor: int) -> dict[str, Column]:
    n = F.count(x).over(frame)

    def held(c: Column, least: int) -> Column:
        return c if least <= 1 else F.when(n >= least, c)

    lo, hi = F.min(x).over(frame), F.max(x).over(frame)
    return {
        "mean": held(F.avg(x).over(frame), floor),
        "std": F.coalesce(held(F.stddev_samp(x).over(frame), std_floor), F.lit(0.0)),
        "min": held(lo, floor),
        "max": held(hi, floor),
        "range": held(hi - lo, floor),
        "energy": held(F.sqrt(F.avg(x * x).over(frame)), floor),
    }


CENTERED = (5, 25, 101)


def centered_columns(w: WindowSpec, col: str, windows=CENTERED, stats=("mean", "std")) -> dict[str, Column]:
    made = {}
    for n in windows:
        s = _stats(F.col(col), w.rowsBetween(-(n // 2), n // 2), 1, 2)
        made |= {f"{col}_{k}_{n}": s[k] for k in stats}
    return made


def rolling_centered(df: DataFrame, col: str, windows=CENTERED, stats=("mean", "std"), seq: Seq = SEQ) -> DataFrame:
    """Centred windows of odd length; mean needs 1 value, sample std 2 (else 0)."""
    h = max(windows) // 2
    return framed(df, lambda w: centered_columns(w, col, windows, stats), h, h, seq)


def rolling_trailing(
    df: DataFrame, col: str, windows=(25, 100, 300), stats=("mean", "std", "min", "max", "range"), seq: Seq = SEQ
) -> DataFrame:
    """Causal windows; a value needs ``max(5, w // 5)`` non-NULL rows."""

    def build(w):
        made = {}
        for n in windows:
            floor = max(5, n // 5)
            s = _stats(F.col(col), w.rowsBetween(-(n - 1), 0), floor, floor)
            made |= {f"{col}_t{k}_{n}": s[k] for k in stats}
        return made

    return framed(df, build, max(windows) - 1, 0, seq)


def shift_columns(w: WindowSpec, col: str, lags=(1, 5, 15, 30), diffs=(1, 2, 5)) -> dict[str, Column]:
    x = F.col(col)
    made = {f"{col}_lag_{k}": F.first(x).over(w.rowsBetween(-k, 0)) for k in lags}
    made |= {f"{col}_lead_{k}": F.last(x).over(w.rowsBetween(0, k)) for k in lags}
    made |= {f"{col}_diff_{k}": x - F.lag(x, k).over(w) for k in diffs}
    made[f"{col}_diff2"] = x - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)
    return made


def lag_lead_diff(df: DataFrame, col: str, lags=(1, 5, 15, 30), diffs=(1, 2, 5), seq: Seq = SEQ) -> DataFrame:
    """Shifts hold the end value where the log is too short; differences do not."""

    def build(w):
        return shift_columns(w, col, lags, diffs)

    return framed(df, build, max(*lags, *diffs, 2), max(lags), seq)


def cumsum_since_anchor(df: DataFrame, col: str, known: Column, out: str = "cumsum_anchor", seq: Seq = SEQ) -> DataFrame:
    """Running sum minus its value at the last known row (0 when nothing is known)."""
    pos = F.col(seq.pos)
    rows = scan(df, run={"_run": F.col(col)}, total={"_at": ("max", F.when(known, pos))}, seq=seq)
    # running sum at the anchor: the largest position is known now, pick its row's value
    again = scan(rows, total={"_base": ("max", F.when(pos == F.col("_at"), F.col("_run")))}, seq=seq)
    return again.withColumn(out, F.col("_run") - F.coalesce(F.col("_base"), F.lit(0.0))).drop("_run", "_at", "_base")


def moves(w: WindowSpec, md: str = "md") -> Column:
    around = w.rowsBetween(-1, 1)
    return F.max(md).over(around) != F.min(md).over(around)


def moving_keys(df: DataFrame, md: str = "md", seq: Seq = SEQ) -> DataFrame:
    """One row per key: ``_any``, whether ``md`` moves between neighbouring rows."""
    rows = framed(df.select(seq.key, seq.pos, md), lambda w: {"_moves": moves(w, md)}, 1, 1, seq)
    return rows.groupBy(seq.key).agg(F.max("_moves").alias("_any"))


def gradient_columns(w: WindowSpec, cols: dict[str, str], md: str = "md") -> dict[str, Column]:
    m = F.col(md)
    hs, hd = m - F.lag(m).over(w), F.lead(m).over(w) - m
    made = {}
    for c, out in cols.items():
        y = F.col(c)
        prev, succ = F.lag(y).over(w), F.lead(y).over(w)
        mid = (hs * hs * succ + (hd * hd - hs * hs) * y - hd * hd * prev) / F.nullif(hs * hd * (hd + hs), F.lit(0.0))
        g = F.when(hs.isNull() & hd.isNull(), F.lit(0.0)).when(hs.isNull(), (succ - y) / F.nullif(hd, F.lit(0.0)))
        made[out] = g.when(hd.isNull(), (y - prev) / F.nullif(hs, F.lit(0.0))).otherwise(mid)
    return made


def flat_columns(cols: dict[str, str]) -> dict[str, Column]:
    """Gradients of keys whose ``md`` does not move are 0."""
    return {o: F.when(F.col("_any"), F.col(o)).otherwise(F.lit(0.0)) for o in cols.values()}


def gradient_md(df: DataFrame, cols: dict[str, str], md: str = "md", seq: Seq = SEQ) -> DataFrame:
    """Second-order gradient on uneven spacing, one-sided at both ends. Inputs must be gap-free.
    Logs of one row or of constant ``md`` give 0."""
    made = framed(df, lambda w: {"_moves": moves(w, md), **gradient_columns(w, cols, md)}, 1, 1, seq)
    out = scan(made, total={"_any": ("max", F.col("_moves"))}, seq=seq)
    return out.withColumns(flat_columns(cols)).drop("_moves", "_any")


def step_columns(w: WindowSpec, cols=("x", "y", "z"), md: str = "md") -> dict[str, Column]:
    step = F.nullif(F.col(md) - F.lag(md).over(w), F.lit(0.0))
    return {f"d{c}_dmd": (F.col(c) - F.lag(c).over(w)) / step for c in cols}


def step_derivatives(df: DataFrame, cols=("x", "y", "z"), md: str = "md", seq: Seq = SEQ) -> DataFrame:
    return framed(df, lambda w: step_columns(w, cols, md), 1, 0, seq)


def detrend_linear(df: DataFrame, col: str, md: str = "md", out: str | None = None, min_rows: int = 5, key: str = "well_id"):
    """Remove the key's least-squares slope on ``md``; short logs stay as they are."""
    fit = df.groupBy(key).agg(
        F.regr_slope(F.col(col), F.col(md)).alias("_b"), F.regr_count(F.col(col), F.col(md)).alias("_n")
    )
    slope = F.when(F.col("_n") >= min_rows, F.coalesce(F.col("_b"), F.lit(0.0))).otherwise(F.lit(0.0))
    return df.join(fit, key).withColumn(out or f"{col}_detrended", F.col(col) - slope * F.col(md)).drop("_b", "_n")


def tortuosity(df: DataFrame, windows=(25, 75), reach: int = 10, smooth: int = 31, seq: Seq = SEQ) -> DataFrame:
    """Arc over chord minus one on trailing windows, turning angle of the smoothed direction
    per unit of md (centred mean), and the trend of the shortest arc/chord window."""
    xyz = ("x", "y", "z")
    tiny = 1e-6

    def steps(w):
        d2 = sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in xyz)
        around = w.rowsBetween(-reach, reach)
        ahead = {f"_d{c}": F.last(c).over(around) - F.first(c).over(around) for c in xyz}
        near = w.rowsBetween(-1, 1)
        ends = F.last("md").over(near) - F.first("md").over(near)
        return {"_step": F.coalesce(F.sqrt(d2), F.lit(0.0)), "_dmd": ends / (F.count("*").over(near) - 1), **ahead}

    def shape(w):
        made = {}
        for n in windows:
            back = w.rowsBetween(-n, 0)
            arc = F.sum("_step").over(w.rowsBetween(-(n - 1), 0))
            chord = F.sqrt(sum((F.col(c) - F.first(c).over(back)) ** 2 for c in xyz))
            made[f"tort_{n}"] = F.greatest(arc / (chord + tiny) - 1, F.lit(0.0))
        b = [F.col(f"_d{c}") for c in xyz]
        a = [F.lag(f"_d{c}").over(w) for c in xyz]
        dot = sum(p * q for p, q in zip(a, b))
        cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        turn = F.coalesce(F.atan2(F.sqrt(sum(c * c for c in cross)), dot), F.lit(0.0))
        made["_turn"] = turn / (F.abs(F.coalesce(F.col("_dmd"), F.lit(0.0))) + tiny)
        return made

    def smoothed(w):
        around = w.rowsBetween(-(smooth // 2), smooth // 2)
        return {"dogleg": F.avg("_turn").over(around), "_rise": F.col(first) - F.lag(first).over(w)}

    def trend(w):
        around = w.rowsBetween(-(smooth // 2), smooth // 2)
        return {f"{first}_slope": F.coalesce(F.avg("_rise").over(around), F.lit(0.0))}

    first, h = f"tort_{windows[0]}", smooth // 2
    rows = framed(df, steps, reach, reach, seq)
    rows = framed(rows, shape, max(windows), 0, seq)
    rows = framed(rows, smoothed, h, h, seq)
    return framed(rows, trend, h, h, seq).drop("_step", "_dmd", "_turn", "_rise", *[f"_d{c}" for c in xyz])


def curvature(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Size of the change of direction per row; NULL on the first two rows."""
    xyz = ("x", "y", "z")

    def second(w):
        return {f"_c{c}": F.col(f"d{c}_dmd") - F.lag(f"d{c}_dmd").over(w) for c in xyz}

    rows = framed(step_derivatives(df, xyz, seq=seq), second, 1, 0, seq)
    return rows.withColumn("curvature", F.sqrt(sum(F.col(f"_c{c}") ** 2 for c in xyz))).drop(*[f"_c{c}" for c in xyz])


def curvature_summary(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    c = F.col("curvature")
    return quantiles(curvature(df, seq), [seq.key], {"curvature_median": (c, 0.5), "curvature_p95": (c, 0.95)})


def tail_position(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Position of every hidden row relative to the last known one."""
    pos, known = F.col(seq.pos), F.col("tvt_input").isNotNull()
    rows = scan(
        df,
        run={"_i": F.when(~known, 1).otherwise(0).cast("bigint")},
        last={f"_{c}0": F.when(known, F.col(c)) for c in ("md", "x", "y", "z")},
        total={"n_eval": ("sum", F.when(~known, 1).otherwise(0).cast("bigint"))},
        seq=seq,
    ).where(~known)
    frac = (F.col("_i") - 1) / F.greatest(F.col("n_eval") - 1, F.lit(1))
    since = F.col("md") - F.col("_md0")
    off = {c: F.col(c) - F.col(f"_{c}0") for c in "xyz"}
    return rows.withColumns(
        {
            "md_since": since,
            "frac": frac,
            "frac2": frac * frac,
            "frac3": frac * frac * frac,
            "sqrt_frac": F.sqrt(frac),
            "log_md": F.log1p(F.greatest(since, F.lit(0.0))),
            "frac_sin": F.sin(frac * pi),
            "frac_cos": F.cos(frac * pi),
            "dx_ps": off["x"],
            "dy_ps": off["y"],
            "dz_ps": off["z"],
            "dxy_ps": F.sqrt(off["x"] ** 2 + off["y"] ** 2),
        }
    ).drop("_i", "_md0", "_x0", "_y0", "_z0")


def gap_summary(df: DataFrame, col: str = "gr", seq: Seq = SEQ) -> DataFrame:
    """Geometry and signal of each key's hidden interval, one row per key."""
    tail = df.where(F.col("tvt_input").isNull())
    pos = F.col(seq.pos)
    x = F.col(col)
    ends = [(F.max_by(c, pos) - F.min_by(c, pos)).alias(f"{c}_delta") for c in ("x", "y", "z")]
    spans = [(F.max(c) - F.min(c)).alias(f"{c}_span") for c in ("x", "y", "z", "md")]
    agg = tail.groupBy(seq.key).agg(
        F.count("*").alias("n_eval"), *ends, *spans,
        F.avg(x).alias(f"{col}_mean"), F.stddev_pop(x).alias(f"{col}_std"), F.min(x).alias(f"{col}_min"), F.max(x).alias(f"{col}_max"),
    )
    pct = quantiles(tail, [seq.key], {f"{col}_p{int(p * 100):02d}": (x, p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)})
    ratio = F.col("z_span") / F.nullif(F.col("md_span"), F.lit(0.0))
    return agg.join(pct, seq.key, "left").withColumn("z_per_md", ratio)


def window_signature(df: DataFrame, col: str, half: int = 15, seq: Seq = SEQ) -> DataFrame:
    """Mean, std, range, mean step and centre of a centred window, as one array.
    ``col`` must be gap-free; a statistic needs ``max(3, w // 3)`` values."""
    floor = max(3, (2 * half + 1) // 3)
    x, zero = F.col(col), F.lit(0.0)

    def build(w):
        around = w.rowsBetween(-half, half)
        held = F.count(x).over(around) >= floor
        # the sum of steps inside the window telescopes to its ends
        back = w.rowsBetween(-half - 1, 0)
        lead_in = F.when(F.count("*").over(back) == half + 2, F.first(x).over(back)).otherwise(F.first(x).over(around))
        n_steps = F.count(x).over(around) - F.when(F.count("*").over(back) == half + 2, 0).otherwise(1)
        mean_step = F.when(n_steps >= floor, (F.last(x).over(around) - lead_in) / n_steps)
        return {
            "signature": F.array(
                F.when(held, F.avg(x).over(around)),
                F.coalesce(F.when(held, F.stddev_samp(x).over(around)), zero),
                F.coalesce(F.when(held, F.max(x).over(around) - F.min(x).over(around)), zero),
                F.coalesce(mean_step, zero),
                x,
            )
        }

    return framed(df, build, half + 1, half, seq)
