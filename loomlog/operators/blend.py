"""Blend algebra over prediction vectors: sums of products in Spark, then closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.functions.exprs import clip
from loomlog.plans.quantiles import quantiles, quantiles_held_out
from loomlog.plans.stage import staged


def blend_fixed(df: DataFrame, weights: dict[str, float], base: str, out: str = "blend") -> DataFrame:
    """Weighted sum; weights may be negative, a missing component counts as the base."""
    total = sum(F.lit(float(w)) * F.coalesce(F.col(c), F.col(base)) for c, w in weights.items())
    return df.withColumn(out, total)


def error_sums(y: str, r: str, s: str) -> list[Column]:
    """Sums from which the squared error of ``w * r + (1 - w) * s`` follows for every w."""
    e, f = F.col(y) - F.col(r), F.col(y) - F.col(s)
    return [F.sum(e * e).alias("s11"), F.sum(e * f).alias("s12"), F.sum(f * f).alias("s22"), F.count(e * f).alias("n")]


def _sse(w: Column) -> Column:
    return w * w * F.col("s11") + 2 * w * (1 - w) * F.col("s12") + (1 - w) * (1 - w) * F.col("s22")


def _weight(s11="s11", s12="s12", s22="s22") -> Column:
    """Least-squares weight of r, in [0, 1]; 0.5 when r and s agree everywhere."""
    num, den = F.col(s22) - F.col(s12), F.col(s11) - 2 * F.col(s12) + F.col(s22)
    return F.when(den <= 1e-12, F.lit(0.5)).otherwise(clip(num / den, 0.0, 1.0))


def blend_weight_ls(df: DataFrame, y: str, r: str, s: str, by: list[str] | None = None) -> DataFrame:
    """w = <y-s, r-s> / <r-s, r-s>, clipped to [0, 1]."""
    d = F.col(r) - F.col(s)
    agg = df.groupBy(*(by or [])).agg(F.sum((F.col(y) - F.col(s)) * d).alias("_num"), F.sum(d * d).alias("_den"), F.count(d).alias("rows"))
    w = F.when(F.col("_den") <= 1e-12, F.lit(0.5)).otherwise(clip(F.col("_num") / F.col("_den"), 0.0, 1.0))
    return agg.withColumn("weight", w).drop("_num", "_den")


def blend_sweep(df: DataFrame, y: str, r: str, s: str, weights: list[float]) -> DataFrame:
    """RMSE for every weight from one pass over the rows."""
    sums = df.agg(*error_sums(y, r, s))
    grid = sums.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return grid.select("weight", F.sqrt(_sse(F.col("weight")) / F.col("n")).alias("rmse"))


def blend_cv_global(df: DataFrame, y: str, r: str, s: str, fold: str) -> DataFrame:
    """Weight from the other folds, error on the own fold; one row per fold."""
    sums = df.groupBy(fold).agg(*error_sums(y, r, s))
    w = W.partitionBy()  # one row per fold
    for c in ("s11", "s12", "s22"):
        sums = sums.withColumn(f"t{c}", F.sum(c).over(w) - F.col(c))
    sums = sums.withColumn("weight", _weight("ts11", "ts12", "ts22"))
    return sums.select(fold, "n", "weight", F.sqrt(_sse(F.col("weight")) / F.col("n")).alias("rmse"))


def _cut_bins(x: Column, cuts: Column) -> Column:
    """Number of distinct cuts <= x."""
    return F.size(F.filter(F.array_distinct(cuts), lambda c: c <= x))


def _cuts(df: DataFrame, x: str, bins: int, fold: str | None = None, folds: int = 0) -> DataFrame:
    """The bins' limits: of all rows, or for each held-out fold those of the other folds."""
    wanted = {f"_q{i}": (F.col(x), i / bins) for i in range(1, bins)}
    q = quantiles(df, [], wanted) if fold is None else quantiles_held_out(df, fold, folds, wanted)
    return q.select(*([] if fold is None else ["held"]), F.array(*wanted).alias("cuts"))


def _binned_cv(cells: DataFrame, fold: str, folds: int, least: int, each: tuple[str, ...] = ()) -> DataFrame:
    """``cells``: sums per (held, bin, fold). Weight per bin from the training folds, the
    fold's global weight where a bin has too few rows. One row per held-out fold, and per value of the columns ``each``."""
    train, test = cells.where(F.col(fold) != F.col("held")), cells.where(F.col(fold) == F.col("held"))

    def sums(df, *by):
        return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("s11", "s12", "s22", "n")])

    per_bin = sums(train, *each, "held", "bin").select(*each, "held", "bin", _weight().alias("_w"), F.col("n").alias("_tn"))
    fallback = sums(train, *each, "held").select(*each, "held", _weight().alias("_w0"))
    got = test.join(per_bin, [*each, "held", "bin"], "left").join(fallback, [*each, "held"])
    w = F.when(F.col("_tn") >= least, F.col("_w")).otherwise(F.col("_w0"))
    return got.groupBy(*each, "held").agg((F.sum(_sse(w))).alias("sse"), F.sum("n").alias("n")).select(
        *each, F.col("held").alias(fold), "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse")
    )


def _held(folds: int) -> Column:
    return F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("held")


def blend_cv_key_bins(df: DataFrame, y: str, r: str, s: str, feature: str, key: str, fold: str, folds: int = 5, bins: int = 3, least: int = 100) -> DataFrame:
    """Bins over each key's median feature. After one aggregation the work is per key."""
    per_key = df.groupBy(key, fold).agg(*error_sums(y, r, s)).join(quantiles(df, [key], {"_f": (F.col(feature), 0.5)}), key)
    wide = per_key.select("*", _held(folds))
    cuts = _cuts(per_key, "_f", bins, fold, folds)
    cells = wide.join(F.broadcast(cuts), "held").withColumn("bin", _cut_bins(F.col("_f"), F.col("cuts")))  # one row per fold
    return _binned_cv(cells.drop("cuts"), fold, folds, least)


def blend_cv_row_bins(df: DataFrame, y: str, r: str, s: str, feature: str, fold: str, folds: int = 5, bins: int = 6, least: int = 500) -> DataFrame:
    """Bins over a row feature. Rows are reduced once to sums per fold and piece between neighbouring limits of any held-out fold;
    each held-out fold's bins are made of whole pieces."""
    cuts = staged(_cuts(df, feature, bins, fold, folds))
    limits = cuts.agg(F.struct(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("cuts"))))).alias("all")).alias("l")).scalar()["all"]  # one row per fold
    below = F.array_max(F.filter(F.col("_limits"), lambda c: c <= F.col(feature)))
    pieces = df.withColumn("_limits", limits).select(y, r, s, fold, below.alias("_from")).groupBy(fold, "_from").agg(*error_sums(y, r, s))
    cells = pieces.select("*", _held(folds)).join(F.broadcast(cuts), "held").withColumn("bin", _cut_bins(F.col("_from"), F.col("cuts")))
    return _binned_cv(cells.drop("cuts", "_from"), fold, folds, least)


KEY_BINS, ROW_BINS = (2, 3, 4), (2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20)


def _piece_sums(rows: DataFrame, fold: str, limits: dict[str, list[float]]) -> DataFrame:
    """Sums by fold and by piece between neighbouring limits of each feature, added up in the tasks: (feature, fold, _from, s11, s12, s22, n).
    A missing value lies below all limits, NaN above them."""
    import numpy as np
    import pyarrow as pa

    names, edges = list(limits), [np.array(v, dtype=float) for v in limits.values()]
    sums = ["s11", "s12", "s22", "n"]

    def run(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            folds = b.column(0).to_numpy(zero_copy_only=False)
            vals = np.column_stack([b.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(sums))])
            for i, edge in enumerate(edges):
                col = b.column(1 + len(sums) + i)
                piece = np.searchsorted(edge, col.to_numpy(zero_copy_only=False).astype(float), side="right")
                piece[col.is_null().to_numpy(zero_copy_only=False)] = 0
                for f in np.unique(folds):
                    at = folds == f
                    got = np.column_stack([np.bincount(piece[at], weights=vals[at, j], minlength=len(edge) + 1) for j in range(len(sums))])
                    found[i, int(f)] = found[i, int(f)] + got if (i, int(f)) in found else got
        for (i, f), got in found.items():
            some = np.flatnonzero(got.any(axis=1))
            at = pa.array([None if k == 0 else float(edges[i][k - 1]) for k in some], pa.float64())
            cols = [pa.array([names[i]] * len(some), pa.string()), pa.array([f] * len(some), pa.int32()), at, *[pa.array(got[some, j], pa.float64()) for j in range(len(sums))]]
            yield pa.RecordBatch.from_arrays(cols, names=["feature", "fold", "_from", *sums])

    given = rows.select(F.col(fold).cast("int"), *sums, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(names)]).where(F.col(fold).isNotNull())
    parts = given.mapInArrow(run, "feature string, fold int, _from double, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("feature", "fold", "_from").agg(*[F.sum(c).alias(c) for c in sums]).withColumnRenamed("fold", fold)


def _grid_cv(rows: DataFrame, features: list[str], fold: str, folds: int, counts: tuple[int, ...], least: int) -> DataFrame:
    """``rows``: sums per row or key beside the features. Every feature cut into every number of bins: (feature, bins, fold, n, rmse)."""
    from loomlog.plans.quantiles import quantile_grid

    at: dict[tuple[str, int], dict[float, float]] = {}
    for r in quantile_grid(rows, fold, folds, features, counts).collect():  # folds x features x probabilities, whatever the rows
        at.setdefault((r.column, r.held), {})[r.p] = r.value
    cuts = [(f, held, n, sorted({v[i / n] for i in range(1, n)})) for (f, held), v in at.items() for n in counts]
    cuts += [(f, held, n, []) for f in features for held in range(folds) if (f, held) not in at for n in counts]
    limits = {f: sorted({c for (g, _), v in at.items() if g == f for c in v.values()}) for f in features}
    table = rows.sparkSession.createDataFrame(cuts, "feature string, held int, bins int, cuts array<double>")
    pieces = staged(_piece_sums(rows, fold, limits))
    cells = pieces.select("*", _held(folds)).join(F.broadcast(table), ["feature", "held"]).withColumn("bin", _cut_bins(F.col("_from"), F.col("cuts")))
    return _binned_cv(cells.drop("cuts", "_from"), fold, folds, least, ("feature", "bins"))


def blend_cv_grid(df: DataFrame, y: str, r: str, s: str, features: list[str], key: str, fold: str, folds: int = 5, key_bins=KEY_BINS, row_bins=ROW_BINS,
                  key_least: int = 100, row_least: int = 500) -> DataFrame:
    """``blend_cv_key_bins`` and ``blend_cv_row_bins`` of all features and numbers of bins at once: (kind, feature, bins, fold, n, rmse).
    Rows are read for the limits, for the sums between them and for the medians of keys, however many bins are tried."""
    per_key = df.groupBy(key, fold).agg(*error_sums(y, r, s)).join(quantiles(df, [key], {f"_m{i}": (F.col(f), 0.5) for i, f in enumerate(features)}), key)
    zero = F.lit(0.0)
    per_key = staged(per_key.select(fold, *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("s11", "s12", "s22", "n")], *[F.col(f"_m{i}").alias(f) for i, f in enumerate(features)]))
    e, f = F.col(y) - F.col(r), F.col(y) - F.col(s)
    rows = df.select(fold, F.coalesce(e * e, zero).alias("s11"), F.coalesce(e * f, zero).alias("s12"), F.coalesce(f * f, zero).alias("s22"), (e * f).isNotNull().cast("double").alias("n"), *features)
    parts = [_grid_cv(t, features, fold, folds, counts, least).withColumn("kind", F.lit(kind)) for kind, t, counts, least in (("key", per_key, key_bins, key_least), ("row", rows, row_bins, row_least)) if counts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def bins_spec(df: DataFrame, y: str, r: str, s: str, feature: str, bins: int = 12, shrink: float = 1000.0) -> DataFrame:
    """Weight per quantile bin, pulled towards the global weight by ``shrink`` rows:
    one row per bin with its weight, row count, the cuts and the fallback weight."""
    cuts = _cuts(df, feature, bins).select(F.struct("cuts").alias("c")).scalar()["cuts"]
    w0 = blend_weight_ls(df, y, r, s).select("weight").scalar()
    rows = df.where(F.col(feature).isNotNull()).withColumn("_cuts", cuts).withColumn("bin", _cut_bins(F.col(feature), F.col("_cuts")))
    per_bin = blend_weight_ls(rows, y, r, s, ["bin"])
    n = F.col("rows")
    return per_bin.withColumn("fallback", w0).select(
        "bin", "rows", clip((n * F.col("weight") + shrink * F.col("fallback")) / (n + shrink), 0.0, 1.0).alias("weight"), "fallback"
    ).withColumn("cuts", cuts)


def apply_bins(df: DataFrame, spec: DataFrame, r: str, s: str, feature: str, out: str = "blend") -> DataFrame:
    """Blend with the spec's weights; a missing feature or an unseen bin takes the fallback."""
    head = spec.agg(F.struct(F.first("cuts").alias("cuts"), F.first("fallback").alias("w0")).alias("h")).scalar()
    rows = df.withColumn("_h", head).withColumn("bin", F.when(F.col(feature).isNotNull(), _cut_bins(F.col(feature), F.col("_h")["cuts"])))
    got = rows.join(F.broadcast(spec.select("bin", "weight")), "bin", "left")  # one row per bin
    w = F.coalesce("weight", F.col("_h")["w0"])
    return got.withColumn("weight", w).withColumn(out, w * F.col(r) + (1 - w) * F.col(s)).drop("_h", "bin")


def gram(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """Mean products of the errors of every pair of models, one pass: (m1, m2, c)."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    sums = df.agg(*[F.avg((F.col(y) - F.col(a)) * (F.col(y) - F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.col(f"_{i}").alias("c")) for i, (a, b) in enumerate(pairs)])))


def gram_matrix(df: DataFrame, y: str, models: list[str]):
    """The p x p matrix on the driver; p is the number of models, whatever the row count."""
    import numpy as np

    at = {m: i for i, m in enumerate(models)}
    c = np.zeros((len(models), len(models)))
    for r in gram(df, y, models).collect():
        c[at[r.m1], at[r.m2]] = c[at[r.m2], at[r.m1]] = r.c
    return c


HILL_WEIGHTS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def hill_climb(df: DataFrame, y: str, models: list[str], rounds: int = 6, weights=HILL_WEIGHTS, least_gain: float = 1e-7) -> DataFrame:
    """Greedy forward blend: from the best single model, mix in one model at a time. Every
    candidate's error follows from the error products, so the rows are read once."""
    import numpy as np

    c = gram_matrix(df, y, models)
    mix = np.eye(len(models))[int(np.argmin(np.diag(c)))]
    best = float(np.sqrt(mix @ c @ mix))
    for _ in range(rounds):
        options = [((1 - w) * mix + w * np.eye(len(models))[i]) for i in range(len(models)) for w in weights]
        errors = [float(np.sqrt(max(o @ c @ o, 0.0))) for o in options]
        pick = int(np.argmin(errors))
        if best - errors[pick] <= least_gain:
            break
        mix, best = options[pick], errors[pick]
    rows = [(m, float(w), best) for m, w in zip(models, mix)]
    return df.sparkSession.createDataFrame(rows, "model string, weight double, rmse double")


def stack_choice(df: DataFrame, y: str, models: list[str], fitted: dict[str, str] | None = None) -> DataFrame:
    """Best of the single models, their mean and further fitted columns, by RMSE."""
    from loomlog.operators.metrics import stage_report

    mean = sum(F.col(m) for m in models) / len(models)
    rows = df.withColumn("mean", mean)
    cols = [*models, "mean"] + list((fitted or {}).values())
    return stage_report(rows, cols, models[0], y).agg(F.min_by("stage", F.struct("rmse", "stage")).alias("choice"), F.min("rmse").alias("rmse"))


def gram_from_scores(df: DataFrame, y: str, models: list[str]) -> DataFrame:
    """Error products rebuilt from scores and pairwise distances, C = (mse_i + mse_j - msd) / 2,
    and the best two-vector mix with its predicted RMSE."""
    from loomlog.operators.joins import pair_sums

    mse = df.agg(F.struct(*[F.avg((F.col(y) - F.col(m)) ** 2).alias(m) for m in models]).alias("s")).scalar()
    pick = {n: F.coalesce(*[F.when(F.col(n) == m, F.col("_s")[m]) for m in models]) for n in ("m1", "m2")}
    p = pair_sums(df, models).withColumn("_s", mse).withColumns({"mse1": pick["m1"], "mse2": pick["m2"]})
    p = p.withColumn("c12", (F.col("mse1") + F.col("mse2") - F.col("msd")) / 2)
    a = clip((F.col("mse2") - F.col("c12")) / F.nullif(F.col("msd"), F.lit(0.0)), 0.0, 1.0)
    p = p.withColumn("alpha", a)
    w = F.col("alpha")
    pred = w * w * F.col("mse1") + 2 * w * (1 - w) * F.col("c12") + (1 - w) * (1 - w) * F.col("mse2")
    return p.select("m1", "m2", "c12", "alpha", F.sqrt(pred).alias("rmse"))


def simplex_blend(df: DataFrame, y: str, models: list[str], steps: int = 20, ridge: float = 0.0) -> DataFrame:
    """Lattice of non-negative weights with sum 1 for three models, evaluated on the error
    products: (w1, w2, w3, rmse)."""
    a, b, c = models
    g = df.agg(F.struct(*[F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(q))).alias(p + q) for p, q in [(a, a), (a, b), (a, c), (b, b), (b, c), (c, c)]]).alias("g"))
    grid = [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]
    points = F.array(*[F.struct(F.lit(p).alias("w1"), F.lit(q).alias("w2"), F.lit(r).alias("w3")) for p, q, r in grid])
    rows = g.select("g", F.inline(points))
    w1, w2, w3, gg = F.col("w1"), F.col("w2"), F.col("w3"), F.col("g")
    q = (w1 * w1 * (gg[a + a] + ridge) + w2 * w2 * (gg[b + b] + ridge) + w3 * w3 * (gg[c + c] + ridge)
         + 2 * w1 * w2 * gg[a + b] + 2 * w1 * w3 * gg[a + c] + 2 * w2 * w3 * gg[b + c])
    return rows.select("w1", "w2", "w3", F.sqrt(q).alias("rmse"))


def bag_replicates(long: DataFrame, replicates: int, row_id: str = "id", value: str = "pred") -> DataFrame:
    """Row mean over replicate runs, and whether every run had the row."""
    return long.groupBy(row_id).agg(F.avg(value).alias("bag"), (F.count(value) == replicates).alias("complete"))


def extrapolate_from(df: DataFrame, p: str, anchor: str, beta: float, fallbacks: list[str], out: str = "moved") -> DataFrame:
    """p + beta * (p - anchor); without an anchor the fallbacks in order, then the median of p."""
    med = quantiles(df, [], {"m": (F.col(p), 0.5)}).select("m").scalar()
    moved = F.col(p) + beta * (F.col(p) - F.col(anchor))
    return df.withColumn("_m", med).withColumn(out, F.coalesce(moved, *[F.col(f) for f in fallbacks], "_m")).drop("_m")


def shift_probe(df: DataFrame, y: str, p: str, key: str, shift: float = 1.0) -> DataFrame:
    """Mean residual of every key recovered from two scores alone: that of the vector and
    that of the vector with this key's rows moved by ``shift``."""
    e = F.col(p) - F.col(y)
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), F.sum((e + shift) ** 2).alias("sse_moved"))
    whole = sums.agg(F.struct(F.sum("n").alias("n"), F.sum("sse").alias("sse")).alias("s")).scalar()
    sums = sums.withColumn("_w", whole)
    mse = F.col("_w")["sse"] / F.col("_w")["n"]
    moved = (F.col("_w")["sse"] - F.col("sse") + F.col("sse_moved")) / F.col("_w")["n"]
    resid = (F.col("_w")["n"] * (moved - mse) - F.col("n") * shift * shift) / (2 * shift * F.col("n"))
    return sums.select(key, "n", resid.alias("mean_residual"))


def hedge_parabola(df: DataFrame, y: str, a: str, b: str, at=(0.0, 0.5, 1.0)) -> DataFrame:
    """Quadratic through the errors at three weights of b, its minimum and the RMSE there."""
    mses = [F.avg((F.col(y) - (1 - w) * F.col(a) - w * F.col(b)) ** 2).alias(f"m{i}") for i, w in enumerate(at)]
    (x0, x1, x2), (m0, m1, m2) = at, (F.col("m0"), F.col("m1"), F.col("m2"))
    d0, d1, d2 = (x0 - x1) * (x0 - x2), (x1 - x0) * (x1 - x2), (x2 - x0) * (x2 - x1)
    q2 = m0 / d0 + m1 / d1 + m2 / d2
    q1 = -(m0 * (x1 + x2) / d0 + m1 * (x0 + x2) / d1 + m2 * (x0 + x1) / d2)
    q0 = m0 * x1 * x2 / d0 + m1 * x0 * x2 / d1 + m2 * x0 * x1 / d2
    fit = df.agg(*mses).select("m0", "m1", "m2", q2.alias("q2"), q1.alias("q1"), q0.alias("q0")).withColumn("w_best", -F.col("q1") / (2 * F.col("q2")))
    w = F.col("w_best")
    return fit.select("w_best", F.sqrt(F.col("q2") * w * w + F.col("q1") * w + F.col("q0")).alias("rmse_best"))


def gate_features(df: DataFrame, r: str, s: str, scores: list[str] | None = None) -> DataFrame:
    """Signed and absolute disagreement of two predictions and the best of the match scores, beside the columns there are."""
    new = {"signed_gap": F.col(r) - F.col(s), "abs_gap": F.abs(F.col(r) - F.col(s))}
    if scores:
        new["best_score"] = F.greatest(*[F.col(c) for c in scores]) if len(scores) > 1 else F.col(scores[0])
    return df.withColumns(new)


def mean_cv_weight(df: DataFrame, y: str, r: str, s: str, fold: str = "fold") -> float:
    """Mean of the folds' cross-validated weights, the weight of the base blend."""
    return float(blend_cv_global(df, y, r, s, fold).agg(F.avg("weight").alias("w")).first().w)


RESIDUAL_ALPHA, DIRECT_ALPHA = 80.0, 40.0


def residual_model(df: DataFrame, y: str, r: str, s: str, features: list[str], fold: str = "fold", folds: int = 5, base_weight: float | None = None, kind: str = "ridge_residual", out: str = "pred", **trees) -> DataFrame:
    """Out-of-fold predictions by a model on gate features that corrects a base blend (``ridge_residual``, ``trees_residual``) or predicts
    the target itself (``ridge_direct``). Gaps and infinite values are filled with the training folds' medians. Keys belong to folds as a whole."""
    from loomlog.operators import models

    if kind not in ("ridge_residual", "ridge_direct", "trees_residual"):
        raise ValueError(f"no model {kind}")
    weight = mean_cv_weight(df, y, r, s, fold) if base_weight is None else base_weight
    base = F.lit(0.0) if kind == "ridge_direct" else F.lit(weight) * F.col(r) + F.lit(1 - weight) * F.col(s)
    rows = df.withColumn("_base", base).withColumn("_target", F.col(y) - F.col("_base"))
    if kind == "trees_residual":
        finite = rows.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")), F.col(f).cast("double")) for f in features})
        filled = staged(models.impute_median(finite, features, fold, folds))
        return models.gbt_oof(filled, features, "_target", fold, folds, "_fix", **trees).withColumn(out, F.col("_base") + F.col("_fix")).drop("_base", "_target", "_fix")
    fits = models.scaled_ridge_cv(rows, features, "_target", DIRECT_ALPHA if kind == "ridge_direct" else RESIDUAL_ALPHA, fold, folds)
    fits = F.broadcast(fits.drop("rows", "sse").withColumnRenamed("held", "_held"))  # one row per fold
    got = rows.join(fits, F.col(fold) == F.col("_held"))
    return got.withColumn(out, F.col("_base") + models.scaled_ridge_value(features)).drop("_base", "_target", "_held", "fill", "mean", "scale", "coef", "intercept")


def residual_model_report(df: DataFrame, y: str, r: str, s: str, features: list[str], fold: str = "fold", folds: int = 5, base_weight: float | None = None) -> DataFrame:
    """RMSE of both ridge models per fold and pooled (fold -1), from sums alone: (model, fold, rows, rmse)."""
    from loomlog.operators import models

    weight = mean_cv_weight(df, y, r, s, fold) if base_weight is None else base_weight
    parts = None
    for kind, base, alpha in (("ridge_residual", F.lit(weight) * F.col(r) + F.lit(1 - weight) * F.col(s), RESIDUAL_ALPHA), ("ridge_direct", F.lit(0.0), DIRECT_ALPHA)):
        per = models.scaled_ridge_cv(df.withColumn("_target", F.col(y) - base), features, "_target", alpha, fold, folds).select(F.col("held").alias("fold"), "rows", "sse")
        both = per.union(per.agg(F.lit(-1).alias("fold"), F.sum("rows").alias("rows"), F.sum("sse").alias("sse")))
        part = both.select(F.lit(kind).alias("model"), "fold", "rows", F.sqrt(F.col("sse") / F.col("rows")).alias("rmse"))
        parts = part if parts is None else parts.union(part)
    return parts
