"""Held-out quantiles and bins count rows once."""

import math
import random

from pyspark.sql import functions as F

from loomlog.operators import blend
from loomlog.plans.quantiles import quantiles, quantiles_held_out


def frame(spark):
    rng = random.Random(7)
    odd = [None, math.nan, math.inf, 0.0, -3.0]
    rows = [(i, i % 5, rng.gauss(0, 3), rng.gauss(0, 3), rng.gauss(0, 3), rng.choice(odd) if i % 9 == 0 else round(rng.gauss(0, 2), 1)) for i in range(4000)]
    return spark.createDataFrame(rows, "id long, fold int, truth double, a double, b double, z double")


def test_quantiles_without_a_fold(spark):
    df = frame(spark).where("fold < 4 OR id % 2 = 0")
    wanted = {"q1": (F.col("z"), 0.25), "m": (F.col("z"), 0.5), "a": (F.col("a"), 0.9)}
    got = {r.held: tuple(r)[1:] for r in quantiles_held_out(df, "fold", 5, wanted).select("held", *wanted).collect()}
    for held in range(5):
        assert got[held] == tuple(quantiles(df.where(F.col("fold") != held), [], wanted).first())


def test_row_bins_are_those_of_every_fold_apart(spark):
    df = frame(spark)
    got = {r.fold: (r.n, r.rmse) for r in blend.blend_cv_row_bins(df, "truth", "a", "b", "z", "fold", least=50).collect()}
    cells = None
    for held in range(5):
        cuts = blend._cuts(df.where(F.col("fold") != held), "z", 6).first()["cuts"]
        own = df.withColumn("bin", blend._cut_bins(F.col("z"), F.array(*map(F.lit, cuts)))).withColumn("held", F.lit(held))
        own = own.groupBy("held", "bin", "fold").agg(*blend.error_sums("truth", "a", "b"))
        cells = own if cells is None else cells.union(own)
    want = {r.fold: (r.n, r.rmse) for r in blend._binned_cv(cells, "fold", 5, 50).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_rows_are_not_multiplied_by_the_folds(spark):
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in (quantiles_held_out(frame(spark), "fold", 5, {"m": (F.col("z"), 0.5)}), blend.blend_cv_row_bins(frame(spark), "truth", "a", "b", "z", "fold"))]
    for plan in plans:  # what is multiplied by the folds are counts and sums: an aggregate stands below
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Generate explode([0,1,2,3,4])" in line:
                assert any("Aggregate" in below for below in lines[i + 1 : i + 3])
