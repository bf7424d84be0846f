"""A blend search tries every feature in every number of bins."""

import math
import random

from loomlog.operators import blend
from loomlog.workflows import blend_search


def frame(spark):
    rng = random.Random(11)
    odd = [None, math.nan, 0.0, 0.0, -3.0]
    rows = [(i % 37, i % 37 % 5, rng.gauss(0, 3), rng.gauss(0, 3), rng.gauss(0, 3), rng.choice(odd) if i % 9 == 0 else round(rng.gauss(0, 2), 1)) for i in range(4000)]
    return spark.createDataFrame(rows, "grp long, fold int, truth double, a double, b double, z double")


def test_search_lists_every_number_of_bins(spark):
    got = [r.formula for r in blend_search(frame(spark).fillna(0.0), "truth", "a", "b", "grp", ["signed_gap", "z"]).collect()]
    want = {f"key_bins_{f}_q{n}" for f in ("signed_gap", "z") for n in (2, 3, 4)} | {f"row_bins_{f}_q{n}" for f in ("signed_gap", "z") for n in blend.ROW_BINS}
    want |= {f"fixed_0.{i}0" for i in range(2, 9)} | {"global_cv", "ridge_residual", "ridge_direct"}
    assert len(blend.ROW_BINS) == 17 and len(got) == len(set(got)) and set(got) == want


def test_grid_equals_each_validation_apart(spark):
    df = blend.gate_features(frame(spark), "a", "b")
    got = {(r.kind, r.feature, r.bins, r.fold): (r.n, r.rmse) for r in blend.blend_cv_grid(df, "truth", "a", "b", ["signed_gap", "z"], "grp", "fold", key_bins=(2, 4), row_bins=(5, 20), row_least=50).collect()}
    want = {}
    for f in ("signed_gap", "z"):
        want |= {("key", f, n, r.fold): (r.n, r.rmse) for n in (2, 4) for r in blend.blend_cv_key_bins(df, "truth", "a", "b", f, "grp", "fold", bins=n).collect()}
        want |= {("row", f, n, r.fold): (r.n, r.rmse) for n in (5, 20) for r in blend.blend_cv_row_bins(df, "truth", "a", "b", f, "fold", bins=n, least=50).collect()}
    assert got.keys() == want.keys() and len(got) == 40
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
