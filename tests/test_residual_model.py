"""Ridge on gate features from fold sums against NumPy, row by row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomlog.operators import blend, models


def frame(n=400, seed=1):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"id": np.arange(n), "fold": rng.integers(0, 4, n), "r": rng.normal(12000, 40, n)})
    df["s"] = df.r + rng.normal(0, 15, n)
    df["y"] = 0.6 * df.r + 0.4 * df.s + rng.normal(0, 3, n)
    for i in range(5):
        df[f"x{i}"] = rng.normal(10.0**i, 1 + i, n) + 0.2 * (df.r - df.s) * (i % 2)
    df["flat"] = 7.0
    df["twice"] = 2 * df.x1
    df.loc[rng.random(n) < 0.2, "x2"] = np.nan
    df.loc[rng.random(n) < 0.1, "x3"] = np.inf
    df["gone"] = np.nan
    return df


FEATURES = ["x0", "x1", "x2", "x3", "x4", "flat", "twice", "gone"]


def brute(df, target, alpha):
    """Median fill, scaling and ridge on the other folds; a column without values is filled with 0."""
    pred = np.zeros(len(df))
    x = df[FEATURES].replace([np.inf, -np.inf], np.nan)
    for h in sorted(df.fold.unique()):
        train, own = (df.fold != h).to_numpy(), (df.fold == h).to_numpy()
        full = x.fillna(x[train].median()).fillna(0.0).to_numpy()
        mean, scale = full[train].mean(0), full[train].std(0)
        z = (full - mean) / np.where(scale > 1e-9, scale, 1)
        t = target[train]
        w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(z.shape[1]), z[train].T @ (t - t.mean()))
        pred[own] = t.mean() + z[own] @ w
    return pred


@pytest.mark.parametrize("kind", ["ridge_residual", "ridge_direct"])
def test_against_numpy(spark, kind):
    df = frame()
    rows = spark.createDataFrame(df).repartition(5)
    base = 0.0 * df.y if kind == "ridge_direct" else 0.3 * df.r + 0.7 * df.s
    want = (base + brute(df, (df.y - base).to_numpy(), 40.0 if kind == "ridge_direct" else 80.0)).to_numpy()
    got = blend.residual_model(rows, "y", "r", "s", FEATURES, folds=4, base_weight=0.3, kind=kind)
    assert got.columns == [*df.columns, "pred"]
    pred = got.toPandas().sort_values("id").pred.to_numpy()
    assert np.allclose(pred, want, atol=1e-5)
    report = blend.residual_model_report(rows, "y", "r", "s", FEATURES, folds=4, base_weight=0.3).where(f"model = '{kind}'").toPandas().set_index("fold").rmse
    error = (df.y.to_numpy() - want) ** 2
    assert np.isclose(report[-1], np.sqrt(error.mean()), rtol=1e-6)
    assert all(np.isclose(report[h], np.sqrt(error[df.fold == h].mean()), rtol=1e-6) for h in range(4))


def test_one_matrix_per_task_and_fold(spark):
    """However the rows are dealt out, the sums are the same; a fold that holds most rows adds nothing to what is sent."""
    df = frame(3000)
    df.loc[df.id > 500, "fold"] = 1
    one, _ = models.fold_moments(spark.createDataFrame(df).coalesce(1), FEATURES, "y")
    many, _ = models.fold_moments(spark.createDataFrame(df).repartition(17), FEATURES, "y")
    assert one.keys() == many.keys() == {0, 1, 2, 3}
    assert all(np.allclose(one[f], many[f], rtol=1e-9, atol=1e-4) for f in one)


def test_trees_and_odd_tables(spark):
    df = frame()
    rows = spark.createDataFrame(df)
    got = blend.residual_model(rows, "y", "r", "s", ["x0", "x2", "x3"], folds=4, kind="trees_residual", trees=3, depth=2).toPandas()
    assert len(got) == len(df) and got.pred.notna().all()
    with pytest.raises(ValueError):
        blend.residual_model(rows, "y", "r", "s", ["x0"], kind="forest")
    none = rows.where("id < 0")
    assert models.scaled_ridge_cv(none, FEATURES, "y", 1.0, folds=4).count() == 0
    gone = rows.withColumn("y", F.when(F.col("id") % 2 == 1, F.col("y")))  # rows without a target are left out of the sums
    fits = models.scaled_ridge_cv(gone, ["x0"], "y", 1.0, folds=4)
    assert fits.agg({"rows": "sum"}).first()[0] == (df.id % 2 == 1).sum()
