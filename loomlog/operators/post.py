"""Post-processing of predictions: fades, clips, gates, smoothing and projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.exprs import bin_of, clip
from loomlog.operators.joins import grid_scores
from loomlog.plans.blocks import SEQ, Seq, framed, scan
from loomlog.plans.quantiles import quantiles
from loomlog.plans.stage import staged


def faded(since: Column, parts: list[tuple[Column, Column | float]], alpha=1.0, tau: Column | float | None = None) -> Column:
    """alpha * fade * weighted mix of deltas; the fade 1 - exp(-max(since, 0) / tau) starts at
    the last known row. ``parts``: (delta, weight)."""
    mix = sum(d * w for d, w in parts) * alpha
    return mix if tau is None else mix * (1 - F.exp(-F.greatest(since, F.lit(0.0)) / tau))


def delta_postprocess(df: DataFrame, since: str, model: str, tracker: str, w: float = 0.09, alpha: float = 1.0, tau: float | None = 85.0, third: tuple[str, float] | None = None) -> DataFrame:
    w3 = third[1] if third else 0.0
    parts = [(F.col(model), 1 - w - w3), (F.col(tracker), w)] + ([(F.col(third[0]), w3)] if third else [])
    return df.withColumn("delta", faded(F.col(since), parts, alpha, tau))


def quantile_clip(df: DataFrame, train: DataFrame, col: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    q = quantiles(train, [], {"lo": (F.col(col), low), "hi": (F.col(col), high)}).select(F.struct("lo", "hi").alias("q")).scalar()
    return df.withColumn("_q", q).withColumn(f"{col}_clipped", clip(F.col(col), F.col("_q")["lo"], F.col("_q")["hi"])).drop("_q")


def global_alpha(df: DataFrame, target: str, delta: str, top: float = 1.5, points: int = 61) -> DataFrame:
    """Best factor on a delta: closed form, and the best of an even grid, from three sums."""
    y, d = F.col(target), F.col(delta)
    s = df.agg(F.sum(y * d).alias("yd"), F.sum(d * d).alias("dd"), F.sum(y * y).alias("yy"), F.count(y * d).alias("n"))
    grid = F.array(*[F.lit(top * i / (points - 1)) for i in range(points)])

    def sse(a: Column) -> Column:
        return F.col("yy") - 2 * a * F.col("yd") + a * a * F.col("dd")

    best = F.array_min(F.transform(grid, lambda a: F.struct(sse(a).alias("e"), a.alias("a"))))
    return s.select(
        clip(F.coalesce(F.col("yd") / F.nullif(F.col("dd"), F.lit(0.0)), F.lit(0.0)), 0.0, top).alias("alpha"), best["a"].alias("grid_alpha"),
        F.sqrt(best["e"] / F.col("n")).alias("grid_rmse"),
    )


def policy_grid(df: DataFrame, target: str, since: str, model: str, tracker: str, alphas: list[float], taus: list[float], weights: list[float]) -> DataFrame:
    """Error of every (alpha, tau, w) policy in one pass over the rows."""
    grid = [(float(a), float(t), float(w)) for a in alphas for t in taus for w in weights]
    w = F.col("w")
    pred = faded(F.col(since), [(F.col(model), 1 - w), (F.col(tracker), w)], F.col("alpha"), F.col("tau"))
    return grid_scores(df, grid, ["alpha", "tau", "w"], F.col(target) - pred)


def best_policy(scores: DataFrame, names=("alpha", "tau", "w")) -> DataFrame:
    best = scores.agg(F.min(F.struct("rmse", *names)).alias("b"))
    return best.select("b.*")


SLOPE_PROBS = (0.9, 0.95, 0.975, 0.99, 0.995)


def slope_quantiles(df: DataFrame, probs=SLOPE_PROBS, seq: Seq = SEQ) -> DataFrame:
    def build(w):
        return {"_s": F.abs((F.col("tvt") - F.lag("tvt").over(w)) / F.nullif(F.col("md") - F.lag("md").over(w), F.lit(0.0)))}

    rows = framed(df, build, 1, 0, seq)
    return quantiles(rows, [], {f"q{str(p)[2:]}": (F.col("_s"), p) for p in probs})


def causal_slope_clip(df: DataFrame, value: str, start: str, start_md: str, limit: float, md: str = "md", out: str = "limited", seq: Seq = SEQ) -> DataFrame:
    """Each value may leave the limited value before it by at most ``limit`` per md. The
    recursion keeps two numbers per key and reads the sorted rows batch by batch, so no key
    is ever held in memory as a whole. A limit of 0 or less turns the clip off."""
    if limit <= 0:
        return df.withColumn(out, F.col(value).cast("double"))
    cols = list(df.columns)
    schema = df.schema.add(out, "double")
    key = seq.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev, prev_md = None, 0.0, 0.0
        for pdf in batches:
            k, x, m = pdf[key].to_numpy(), pdf[value].to_numpy(float), pdf[md].to_numpy(float)
            s, s_md = pdf[start].to_numpy(float), pdf[start_md].to_numpy(float)
            res = np.empty(len(pdf))
            for i in range(len(pdf)):
                if k[i] != now:
                    now, prev, prev_md = k[i], s[i], s_md[i]
                reach = limit * max(abs(m[i] - prev_md), 1e-6)
                prev = min(max(x[i], prev - reach), prev + reach)
                prev_md = m[i]
                res[i] = prev
            yield pdf.assign(**{out: res})[[*cols, out]]

    return df.repartition(key).sortWithinPartitions(key, seq.pos).mapInPandas(run, schema)


def savgol_matrix(window: int, degree: int) -> list[list[float]]:
    """Row i: weights that give the least-squares polynomial of ``window`` points at point i."""
    x = np.arange(window, dtype=float) - (window - 1) / 2
    basis = np.linalg.qr(np.vander(x / max(abs(x[0]), 1.0), degree + 1))[0]
    return (basis @ basis.T).tolist()


def savgol_smooth(df: DataFrame, col: str, window: int = 17, degree: int = 3, out: str = "smooth", seq: Seq = SEQ) -> DataFrame:
    """Savitzky-Golay smoothing; the first and last half window take the polynomial of the end
    window. Short logs use the largest odd window that fits, or stay as they are."""
    rows = scan(df, total={"_n": ("sum", F.lit(1).cast("bigint"))}, seq=seq)
    sizes = [s for s in range(degree + 2 + (degree + 1) % 2, window + 1, 2)]
    weights = F.create_map(*[v for s in sizes for v in (F.lit(s), F.array(*[F.array(*[F.lit(c) for c in r]) for r in savgol_matrix(s, degree)]))])
    reach = window - 1
    n, pos = F.col("_n"), F.col(seq.pos)
    size = F.least(F.lit(window).cast("bigint"), n - F.when(n % 2 == 0, 1).otherwise(0)).cast("int")

    def build(w):
        return {"_near": F.collect_list(col).over(w.rowsBetween(-reach, reach))}  # at most 2 * window - 1 values

    rows = framed(rows, build, reach, reach, seq).withColumn("_size", size)
    half = F.floor(F.col("_size") / 2)
    first = F.greatest(F.lit(0), F.least(pos - half, n - F.col("_size")))
    part = F.slice("_near", (first - F.greatest(F.lit(0), pos - reach) + 1).cast("int"), F.col("_size"))
    row = F.element_at(F.element_at(weights, F.col("_size")), (pos - first + 1).cast("int"))
    fit = F.aggregate(F.zip_with(part, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn(out, F.when(F.col("_size") >= sizes[0], fit).otherwise(F.col(col))).drop("_n", "_near", "_size")


def _solve(products: pd.Series, moments: pd.Series) -> pd.Series:
    """Coefficients from packed normal equations; one small system per key."""
    out = []
    for p, m in zip(products, moments):
        k = len(m)
        a = np.asarray(p, float).reshape(k, k)
        out.append(np.linalg.lstsq(a, np.asarray(m, float), rcond=1e-12)[0].tolist())
    return pd.Series(out)


def robust_projection(rows: DataFrame, value: str, s: str, degree: int = 5, rounds: int = 4, keep: float = 1.0, least_known: int = 5, known: str = "n_known",
                      key: str = "well_id", out: str = "projected") -> DataFrame:
    """Robust polynomial of ``value`` over ``s`` in [0, 1] per key: reweighted least squares with
    weight 1 / (1 + (r / (2 * 1.4826 * MAD))^2). Every round is two aggregations over all rows
    (normal equations, exact MAD); only the coefficients, one row per key, move between rounds.
    Keys with too few rows or too short a prefix pass through."""
    rows = staged(rows)
    basis = [F.lit(1.0)]
    t = 2 * F.col(s) - 1  # centred: better conditioned
    for _ in range(degree):
        basis.append(basis[-1] * t)
    k = degree + 1

    def fit(df: DataFrame, w: Column) -> DataFrame:
        moments = [F.sum(w * b * F.col(value)) for b in basis]
        powers = [basis[0]]
        for _ in range(2 * degree):
            powers.append(powers[-1] * t)
        sums = df.groupBy(key).agg(*[F.sum(w * p).alias(f"_p{i}") for i, p in enumerate(powers)], *[m.alias(f"_m{i}") for i, m in enumerate(moments)], F.count("*").alias("_n"))
        packed = F.array(*[F.col(f"_p{i + j}") for i in range(k) for j in range(k)])
        return sums.select(key, "_n", F.pandas_udf(_solve, "array<double>")(packed, F.array(*[F.col(f"_m{i}") for i in range(k)])).alias("_coef"))

    value_at = sum(F.col("_coef")[i] * b for i, b in enumerate(basis))
    usable = rows.where(F.col(value).isNotNull())
    coef = staged(fit(usable, F.lit(1.0)))
    for _ in range(rounds):
        left = usable.join(coef.select(key, "_coef"), key).withColumn("_r", F.col(value) - value_at).drop("_coef")
        med = quantiles(left, [key], {"_med": (F.col("_r"), 0.5)})
        dev = left.join(med, key).withColumn("_dev", F.abs(F.col("_r") - F.col("_med")))
        mad = quantiles(dev, [key], {"_mad": (F.col("_dev"), 0.5)})
        scale = F.greatest(2 * 1.4826 * F.col("_mad"), F.lit(1e-6))
        coef = staged(fit(left.join(mad, key), 1 / (1 + (F.col("_r") / scale) ** 2)))
    got = rows.join(coef, key, "left")
    ok = (F.col("_n") >= degree + 2) & (F.col(known) >= least_known)
    return got.withColumn(out, F.when(ok, (1 - keep) * F.col(value) + keep * value_at).otherwise(F.col(value))).drop("_n", "_coef")


def prefix_gate(score: Column, known: Column, std: Column) -> Column:
    return clip((score - 0.58) / 0.22, 0.0, 1.0) * clip(known / 260.0, 0.0, 1.0) * clip(18.0 / (F.abs(std) + 18.0), 0.0, 1.0)


def formation_gate(score: Column, known: Column, dense_std: Column, form_std: Column, dist: Column) -> Column:
    spread = clip(1 - F.abs(dense_std) / 90.0, 0.0, 1.0) * clip(1 - F.abs(form_std) / 140.0, 0.0, 1.0)
    return clip((score - 0.58) / 0.22, 0.0, 1.0) * clip(known / 260.0, 0.0, 1.0) * spread / (1 + F.abs(dist) / 6.0)


def gated(base: Column, side: Column, confidence: Column, max_weight: float) -> Column:
    w = F.coalesce(confidence, F.lit(0.0)) * max_weight
    return F.when(side.isNull(), base).otherwise((1 - w) * base + w * side)


def disagreement_weight(a: Column, b: Column, c: Column, base: Column) -> Column:
    apart = clip((F.abs(a - b) - 6.0) / 24.0, 0.0, 1.0)
    return clip(0.06 + 0.08 * apart * F.exp(-((F.abs(c - base) / 28.0) ** 2)), 0.04, 0.14)


def cauchy_gate(df: DataFrame, base: str, side: str, w_max: float, scale: float, mean_limit: float, p95_limit: float, out: str = "gated") -> DataFrame:
    """Weight falls with the distance of the side vector; the gate is off altogether when the
    mean or the 95th percentile of the distance exceeds its limit."""
    d = F.abs(F.col(side) - F.col(base))
    mean = df.agg(F.avg(d)).scalar()
    p95 = quantiles(df, [], {"p": (d, 0.95)}).select("p").scalar()
    on = (F.col("_mean") <= mean_limit) & (F.col("_p95") <= p95_limit)
    w = F.when(F.coalesce(on, F.lit(False)), w_max / (1 + (d / scale) ** 2)).otherwise(F.lit(0.0))
    rows = df.withColumns({"_mean": mean, "_p95": p95}).withColumn("weight", F.coalesce(w, F.lit(0.0)))
    return rows.withColumn(out, F.col(base) + F.col("weight") * (F.coalesce(F.col(side), F.col(base)) - F.col(base))).drop("_mean", "_p95")


# fixed values: limits of tail length and z span, and the recipe of each regime code
LONG_TAIL = 4840.0
Z_SPANS = [136.73000000000016, 185.5133333333342]
RECIPES = [
    "pf_scale_5_hold_0.2",
    "pf_scale_3_hold_0.15",
    "pf_scale_12_beam_0.2_hold_0.15",
    "pf_scale_5_hold_0.15",
    "pf_scale_5_beam_0.05_hold_0.05",
    "pf_scale_12_beam_0.2_hold_0.05",
]
OTHER_RECIPE = "pf_scale_8_hold_0.2"


def regime_selector(df: DataFrame, recipes=tuple(RECIPES), long_tail: float = LONG_TAIL, spans=tuple(Z_SPANS), key: str = "well_id") -> DataFrame:
    """Regime code of each key (long tail + 2 * z-span bin) and the recipe's parameters,
    parsed from its text."""
    tail = df.where("tvt_input IS NULL").groupBy(key).agg(F.count("*").alias("n_eval"), (F.max("z") - F.min("z")).alias("z_span"))
    code = F.when(F.col("n_eval") > long_tail, 1).otherwise(0) + 2 * bin_of(F.col("z_span"), list(spans))
    recipe = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in recipes]), F.col("code") + 1), F.lit(OTHER_RECIPE))
    out = tail.withColumn("code", code).withColumn("recipe", recipe)

    def part(tag: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract("recipe", tag + r"_([0-9.]+)", 1), F.lit("")).cast("double"), F.lit(0.0))

    return out.withColumns({"scale": part("scale"), "beam_weight": part("beam"), "hold_weight": part("hold")})


def regime_mix(tracker: Column, beam: Column, last: Column) -> Column:
    b, h = F.col("beam_weight"), F.col("hold_weight")
    return (1 - h) * ((1 - b) * tracker + b * beam) + h * last
