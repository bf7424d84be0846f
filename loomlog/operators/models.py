"""Folds, linear and tree models, and their training frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlog.plans.quantiles import _bin, quantiles, quantiles_held_out
from loomlog.plans.ranks import global_rank
from loomlog.plans.stage import staged


def _deal_sizes(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Largest-to-lightest dealing of whole size classes (size, keys), largest first: (size, first rank, folds in turn).

    Within a class the lightest fold takes the next key, the lowest-numbered on a tie. Folds come in as the others reach their
    load, and from there on they take turns, so a class of any number of keys is at most ``k`` runs of turns."""
    loads, out = [0] * k, []
    for size, keys in classes:
        at, given = 0, [0] * k
        level = {f: loads[f] // size for f in range(k)}
        stops = sorted(set(level.values()))
        for i, now in enumerate(stops):
            turn = sorted((f for f in range(k) if level[f] <= now), key=lambda f: (loads[f] % size, f))
            rounds = stops[i + 1] - now if i + 1 < len(stops) else keys
            n = min(keys - at, rounds * len(turn))
            if not n:
                break
            out.append((size, at, turn))
            for j, f in enumerate(turn):
                given[f] += n // len(turn) + (j < n % len(turn))
            at += n
        loads = [w + size * g for w, g in zip(loads, given)]
    return out


def group_kfold(df: DataFrame, k: int = 5, key: str = "well_id") -> DataFrame:
    """Whole keys to folds, the largest first and always to the lightest fold: (key, rows, fold); equal sizes in the order of hash and key.

    Only the number of keys of every distinct size goes through the driver (there are fewer distinct sizes than the root of twice
    the rows); keys find their fold by their rank among those of one size."""
    sizes = staged(df.groupBy(key).agg(F.count("*").alias("rows")).withColumn("_h", F.md5(F.col(key).cast("string"))))
    classes = sorted(((r.rows, r.n) for r in sizes.groupBy("rows").agg(F.count("*").alias("n")).collect()), reverse=True)
    turns = df.sparkSession.createDataFrame(_deal_sizes(classes, k), "rows long, first long, turn array<int>")
    turns = turns.withColumn("next", F.coalesce(F.lead("first").over(W.partitionBy("rows").orderBy("first")), F.lit(1 << 62)))
    ranked = global_rank(sizes, F.substring("_h", 1, 3), ["_h", key], by=["rows"])
    own = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("next"))
    got = ranked.join(turns.withColumnRenamed("rows", "_rows"), (F.col("rows") == F.col("_rows")) & own)
    return got.select(key, "rows", F.element_at("turn", ((F.col("rank") - F.col("first")) % F.size("turn") + 1).cast("int")).alias("fold"))


def seeded_kfold(keys: DataFrame, k: int = 5, seed: int = 204, repeats: int = 1, key: str = "well_id") -> DataFrame:
    """Keys shuffled by seed (a new seed for every repeat) and dealt to folds: (repeat, key, fold)."""
    wide = keys.select(key).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    text = F.concat(F.col(key).cast("string"), (F.lit(seed) + 1009 * F.col("repeat")).cast("string"))
    wide = wide.withColumn("_h", F.md5(text))
    ranked = global_rank(wide, F.substring("_h", 1, 3), ["_h", key], by=["repeat"])
    return ranked.select("repeat", key, (F.col("rank") % k).cast("int").alias("fold"))


def strata(df: DataFrame, features: list[str], key: str = "well_id", rare_below: int = 2) -> DataFrame:
    """Label of each key from the terciles of its median features; rare labels are merged.
    Ties go by key order; edges lie at 1 + (n-1)/3 and 1 + 2(n-1)/3 of the rank."""
    med = quantiles(df, [key], {f: (F.col(f), 0.5) for f in features})
    n = med.agg(F.count("*")).scalar()
    out = staged(med.withColumn("_n", n))
    for f in features:
        ranked = global_rank(out.select(key, f), _bin(F.col(f)), [f, key], f"_r_{f}").select(key, f"_r_{f}")
        out = out.join(ranked, key)
    third = (F.col("_n") - 1) / 3
    label = [F.when(F.col(f"_r_{f}") <= third, "0").when(F.col(f"_r_{f}") <= 2 * third, "1").otherwise("2") for f in features]
    out = out.withColumn("stratum", F.concat_ws("_", *label))
    counts = out.groupBy("stratum").agg(F.count("*").alias("_c"))
    out = out.join(counts, "stratum").withColumn("stratum", F.when(F.col("_c") < rare_below, "rare").otherwise(F.col("stratum")))
    return out.select(key, "stratum")


def _held_out(df: DataFrame, fold: str, folds: int) -> DataFrame:
    return df.withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(folds)])))


def impute_median(df: DataFrame, cols: list[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """Per held-out fold: rows of that fold with gaps filled by the training folds' medians."""
    med = quantiles_held_out(df, fold, folds, {f"_{c}": (F.col(c), 0.5) for c in cols})
    rows = df.join(F.broadcast(med.withColumnRenamed("held", fold)), fold)  # one row per fold
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in cols}).drop(*[f"_{c}" for c in cols])


def standardize(df: DataFrame, cols: list[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """Scale by mean and population std of the training folds; a constant column stays centred."""
    st = _held_out(df, fold, folds).where(F.col(fold) != F.col("held")).groupBy(F.col("held").alias(fold)).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    rows = df.join(F.broadcast(st), fold)  # one row per fold
    out = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in cols}
    return rows.withColumns(out).drop(*[f"_{t}_{c}" for t in "ms" for c in cols])


def _ridge_solver(alpha: float, positive: bool):
    def solve(cov: pd.Series, cross: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for c, v, m in zip(cov, cross, n):
            v = np.asarray(v, float) * m
            a = np.asarray(c, float).reshape(len(v), len(v)) * m + alpha * np.eye(len(v))
            if not positive:
                out.append(np.linalg.solve(a, v).tolist())
                continue
            w = np.zeros(len(v))  # coordinate descent with w >= 0
            for _ in range(2000):
                before = w.copy()
                for i in range(len(v)):
                    w[i] = max(0.0, (v[i] - a[i] @ w + a[i, i] * w[i]) / a[i, i])
                if np.abs(w - before).max() < 1e-13:
                    break
            out.append(w.tolist())
        return pd.Series(out)

    return F.pandas_udf(solve, "array<double>")


def ridge_fit(df: DataFrame, features: list[str], y: str, alpha: float, by: list[str] | None = None, positive: bool = False) -> DataFrame:
    """min |y - b - Xw|^2 + alpha |w|^2 per group: covariances in Spark, a p x p solve per
    group. Rows: (by..., coef array, intercept)."""
    by = by or []
    xs = [F.col(f) for f in features]
    clean = df.dropna(subset=[*features, y])
    g = clean.groupBy(*by).agg(
        F.count("*").cast("double").alias("_n"),
        F.array(*[F.covar_pop(a, b) for a in xs for b in xs]).alias("_c"),
        F.array(*[F.covar_pop(a, F.col(y)) for a in xs]).alias("_v"),
        F.array(*[F.avg(a) for a in xs]).alias("_mx"), F.avg(y).alias("_my"),
    )
    g = g.withColumn("coef", _ridge_solver(alpha, positive)("_c", "_v", "_n"))
    dot = F.aggregate(F.zip_with("_mx", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return g.select(*by, "coef", (F.col("_my") - dot).alias("intercept"))


def linear_value(features: list[str]) -> Column:
    return F.col("intercept") + sum(F.col("coef")[i] * F.col(f) for i, f in enumerate(features))


def ridge_oof(df: DataFrame, features: list[str], y: str, alpha: float, fold: str = "fold", folds: int = 5, positive: bool = False, clip_to_target: bool = False, out: str = "oof") -> DataFrame:
    """Out-of-fold ridge predictions; every row is predicted by the model without its fold."""
    train = _held_out(df, fold, folds).where(F.col(fold) != F.col("held"))
    fits = ridge_fit(train, features, y, alpha, ["held"], positive).withColumnRenamed("held", fold)
    rows = df.join(F.broadcast(fits), fold).withColumn(out, linear_value(features)).drop("coef", "intercept")  # one row per fold
    if clip_to_target:
        ends = df.agg(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi")).alias("e")).scalar()
        rows = rows.withColumn("_e", ends).withColumn(out, F.least(F.greatest(F.col(out), F.col("_e")["lo"]), F.col("_e")["hi"])).drop("_e")
    return rows


def oof_report(rows: DataFrame, y: str, pred: str, fold: str = "fold") -> DataFrame:
    """RMSE per fold and pooled over all folds (fold -1)."""
    e = F.col(y) - F.col(pred)
    per = rows.groupBy(fold).agg(F.sum(e * e).alias("sse"), F.count(e).alias("rows"))
    pooled = per.agg(F.lit(-1).alias(fold), F.sum("sse").alias("sse"), F.sum("rows").alias("rows"))
    return per.select(F.col(fold).cast("int").alias(fold), "sse", "rows").union(pooled).select(fold, "rows", F.sqrt(F.col("sse") / F.col("rows")).alias("rmse"))


def gbt_fit(df: DataFrame, features: list[str], y: str, trees: int = 20, depth: int = 4, seed: int = 204):
    """Boosted trees on a (residual) target; NULL features must be imputed before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assemble = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    trees_ = GBTRegressor(featuresCol="_features", labelCol=y, predictionCol="_pred", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[assemble, trees_]).fit(df)


def gbt_oof(df: DataFrame, features: list[str], y: str, fold: str = "fold", folds: int = 3, out: str = "oof", **kw) -> DataFrame:
    """One model per fold (few by design), predictions of all held-out folds united."""
    parts = None
    for f in range(folds):
        model = gbt_fit(df.where(F.col(fold) != f), features, y, **kw)
        part = model.transform(df.where(F.col(fold) == f)).withColumnRenamed("_pred", out).drop("_features")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def predict_to_contract(pred: DataFrame, contract: DataFrame, anchor: str, delta: str, key: str = "id", examples: int = 5) -> DataFrame:
    """anchor + predicted delta for every contract id; raises with the first missing ids."""
    got = contract.join(pred.select(key, (F.col(anchor) + F.col(delta)).alias("tvt")), key, "left")
    missing = [r[key] for r in got.where(F.col("tvt").isNull()).orderBy("pos").limit(examples).collect()]
    if missing:
        raise ValueError(f"no prediction for {missing}")
    return got.select(key, "pos", "tvt")


def training_frame(features: DataFrame, log: DataFrame, curve: DataFrame, key: str = "well_id", least_known: int = 10, least_curve: int = 3) -> DataFrame:
    """Feature rows to learn from: hidden rows with a target, of keys with enough prefix and curve."""
    ok = log.groupBy(key).agg(F.count("tvt_input").alias("_k")).where(F.col("_k") >= least_known)
    points = curve.groupBy(key, "tvt").agg(F.lit(1).alias("_1")).groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") >= least_curve)
    return features.where("tvt_input IS NULL AND tvt IS NOT NULL").join(ok, key, "left_semi").join(points, key, "left_semi")


def prefix_cut_augment(df: DataFrame, cuts: int = 3, least_known: int = 25, key: str = "well_id", pos: str = "row_idx") -> DataFrame:
    """More training logs by hiding the prefix earlier: at known row k (evenly spaced from 20 to
    n_known - 2) the rest becomes unknown. Tag ``aug_k`` is -1 for the original; ``new_eval``
    marks the newly hidden rows. Later features are partitioned by (key, aug_k)."""
    from loomlog.plans.blocks import Seq, scan

    one = F.when(F.col("tvt_input").isNotNull(), 1).otherwise(0).cast("bigint")
    rows = scan(df, run={"_i": one}, total={"_n": ("sum", one)}, seq=Seq(key=key, pos=pos))
    span = F.col("_n") - 2 - 20
    spots = F.array_distinct(F.array(*[F.floor(20 + span * (i / max(cuts - 1, 1))) for i in range(cuts)]))
    ks = F.when(F.col("_n") >= least_known, F.concat(F.array(F.lit(-1).cast("bigint")), spots)).otherwise(F.array(F.lit(-1).cast("bigint")))
    wide = rows.withColumn("aug_k", F.explode(ks))
    hidden = (F.col("aug_k") >= 0) & (F.col("_i") > F.col("aug_k"))
    fresh = hidden & F.col("tvt_input").isNotNull()
    return wide.withColumns({"new_eval": fresh, "tvt_input": F.when(~hidden, F.col("tvt_input"))}).drop("_i", "_n")


def row_subsample(df: DataFrame, n: int, row_id: str, seed: str = "0", key: str = "well_id") -> DataFrame:
    """At most ``n`` seeded-random rows per key (a sampling operator); the rank filter runs
    before the shuffle too."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.md5(F.concat(F.col(row_id).cast("string"), F.lit(seed))), row_id)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def feature_set_select(scores: DataFrame, policies: dict[str, str], allowed: list[str]) -> DataFrame:
    """Best feature set by RMSE among those whose policy is allowed."""
    tag = F.coalesce(*[F.when(F.col("model") == m, F.lit(p)) for m, p in policies.items()])
    ok = scores.withColumn("policy", tag).where(F.col("policy").isin(allowed))
    return ok.agg(F.min(F.struct("rmse", "model", "policy")).alias("b")).select("b.*")


def fold_moments(df: DataFrame, features: list[str], y: str, fold: str = "fold") -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Cross products of (1, features, which are missing, y) for every fold from one pass, and the shifts they were taken about.

    A missing value enters as 0 beside its indicator, so that gaps can be filled with any number afterwards. A task adds up its
    batches and sends one matrix per fold; the columns are shifted by their means, so that large values lose no digits."""
    p = len(features)
    cols = [*features, y]
    clean = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")).alias(c) for c in cols]
    rows = df.select(F.col(fold).cast("int").alias("_fold"), *clean).where(F.col(y).isNotNull())
    means = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = np.array([means[c] or 0.0 for c in cols])
    size = 2 * p + 2

    def products(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]).astype(float) - shift
            gone = np.isnan(own[:, :p])
            z = np.column_stack([np.ones(len(own)), np.where(gone, 0.0, own[:, :p]), gone, own[:, p]])
            which = batch.column("_fold").to_numpy()
            for f in np.unique(which):
                part = z[which == f]
                sums[int(f)] = sums.get(int(f), 0.0) + part.T @ part
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, f, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.reshape(-1))], names=["fold", "cell", "value"])

    cells = rows.mapInArrow(products, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).toArrow()
    out: dict[int, np.ndarray] = {}
    for f, cell, value in zip(*(cells.column(c).to_pylist() for c in ("fold", "cell", "value")), strict=True):
        out.setdefault(f, np.zeros((size, size)))[cell // size, cell % size] = value
    return out, shift


def _filled(moments: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Cross products of (1, features, y) once gaps are filled with ``fill`` (about the same shifts)."""
    p = len(fill)
    turn = np.zeros((p + 2, 2 * p + 2))
    turn[0, 0] = turn[p + 1, 2 * p + 1] = 1.0
    turn[1 : p + 1, 1 : p + 1] = np.eye(p)
    turn[1 : p + 1, p + 1 : 2 * p + 1] = np.diag(fill)
    return turn @ moments @ turn.T


def scaled_ridge_cv(df: DataFrame, features: list[str], y: str, alpha: float, fold: str = "fold", folds: int = 5) -> DataFrame:
    """One row per held-out fold: the model of median fill, scaling and ridge that the other folds give, and its error on the fold.

    The rows are read for their medians and once for the cross products; training sums are the sum over all folds less
    the held-out one, and the held-out error is a quadratic form in the held-out sums. ``coef`` belongs to (filled x - mean) / scale."""
    moments, shift = fold_moments(df, features, y, fold)
    p = len(features)
    finite = {f: F.when(F.abs(F.col(f).cast("double")) != float("inf"), F.col(f).cast("double")) for f in features}
    medians = {r.held: [r[f] for f in features] for r in quantiles_held_out(df.where(F.col(y).isNotNull()), fold, folds, {f: (c, 0.5) for f, c in finite.items()}).collect()}  # one row per fold
    total = sum(moments.values()) if moments else 0.0
    out = []
    for h in sorted(moments):
        fill = np.array([v if v is not None else s for v, s in zip(medians.get(h, [None] * p), shift)]) - shift[:p]
        rest, own = _filled(total - moments[h], fill), _filled(moments[h], fill)
        n = rest[0, 0]
        if n < 1:
            continue
        mean = rest[0, 1:] / n
        cov = rest[1:, 1:] / n - np.outer(mean, mean)
        spread = np.diag(cov)[:p]
        scale = np.sqrt(np.where(spread > 1e-24 * np.maximum(np.diag(rest)[1 : p + 1] / n, 1e-300), spread, 1.0))
        a = n * cov[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p)
        coef = np.linalg.solve(a, n * cov[:p, p] / scale)
        line = np.concatenate([[-(mean[p] - (coef / scale) @ mean[:p])], -coef / scale, [1.0]])  # y less the prediction, about the shifts
        sse = max(float(line @ own @ line), 0.0)
        out.append((h, int(own[0, 0]), sse, (fill + shift[:p]).tolist(), (mean[:p] + shift[:p]).tolist(), scale.tolist(), coef.tolist(), float(mean[p] + shift[p])))
    return df.sparkSession.createDataFrame(out, "held int, rows long, sse double, fill array<double>, mean array<double>, scale array<double>, coef array<double>, intercept double")


def scaled_ridge_value(features: list[str]) -> Column:
    """Prediction of a row that carries the columns of its ``scaled_ridge_cv`` model."""
    terms = [F.col("coef")[i] * (F.coalesce(F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) != float("inf")), F.col(f).cast("double")), F.col("fill")[i]) - F.col("mean")[i]) / F.col("scale")[i] for i, f in enumerate(features)]
    return F.col("intercept") + sum(terms)
