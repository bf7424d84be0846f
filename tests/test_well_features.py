"""Well features hold every step of the method."""

import numpy as np
import pandas as pd
from logs import curve_of, hot_log, to_spark
from pyspark.sql import functions as F

from loomlog import workflows as wf
from loomlog.operators import align, curves, prefix, sequence, spatial
from loomlog.plans.stage import staged

IDS = ["well_id", "row_idx"]


def test_residuals_are_those_of_the_curve_look_up(spark):
    pdf = curve_of(keys=3)
    pdf["row_idx"] = pdf.groupby("well_id").cumcount()
    pdf.loc[pdf["row_idx"] == 20, "tvt"] = pdf.loc[pdf["row_idx"] == 19, "tvt"].to_numpy()  # equal knots
    pdf = pd.concat([pdf, pd.DataFrame([("k3", 1000.0, 5.0, "a", 0)], columns=["well_id", "tvt", "gr", "geology", "row_idx"])])  # one knot
    curve = staged(spark.createDataFrame(pdf))
    at_knots = pdf[pdf["well_id"] == "k0"]["tvt"].tolist()
    rows = pd.DataFrame({"well_id": np.repeat(["k0", "k1", "k3", "k4"], 60), "row_idx": list(range(60)) * 4, "a": np.tile([*at_knots, *np.linspace(980, 1060, 60 - len(at_knots))], 4), "grf": 7.0})
    rows.loc[rows["row_idx"] == 5, "a"] = np.nan
    log = staged(to_spark(spark, rows.assign(_i=rows["row_idx"])))
    got = align.residuals_at(log, curve, {"n": ("a", (-2.0, 0.0, 3.0))}, chunk=25).toPandas().set_index(IDS).sort_index()
    want = curves.offset_residual_family(log, curve, {"n": (F.col("a"), [-2.0, 0.0, 3.0])}, "grf").toPandas().set_index(IDS).sort_index()
    assert len(got) == 240 and got[["n_m2", "n_p0", "n_p3"]].notna().sum().min() == 118
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=0, atol=1e-9)


def test_every_step_is_there(spark):
    pdf = hot_log(keys=3, small=60)
    pdf["flat"] = pdf["md"] * 0.3
    log, curve = staged(to_spark(spark, pdf)), staged(spark.createDataFrame(curve_of(keys=4, n=80)))
    hidden = prefix.linear_prior(log).where("tvt_input IS NULL")
    tracked = staged(hidden.select(*IDS, F.col("linear_prior").alias("pf_mean"), F.col("last_tvt").alias("beam")))
    scales, paths = staged(align.prefix_ncc(log, (2, 4))), staged(align.beam_align(log, curve))
    out = staged(wf.build_well_features(log, curve, tracked, ["y", "flat"], scales=scales, paths=paths, dense="flat"))
    got = out.toPandas().set_index(IDS).sort_index()
    assert len(got) == hidden.count() and got.index.is_unique
    ncc = align.ncc_ensemble(scales, prefix.last_known(log)).toPandas().set_index(IDS)["tvt_ensemble"]
    windows = sequence.rolling_centered(sequence.interpolate_linear(log, {"gr": "grf"}), "grf", (21,)).toPandas().set_index(IDS)["grf_mean_21"]
    beams = paths.groupBy(*IDS).agg(F.stddev_pop("tvt").alias("s")).toPandas().set_index(IDS)["s"]
    priors = spatial.surface_prior(log, ["flat"])
    surface = priors.toPandas().set_index(IDS)["pred"]
    fit = spatial.prefix_fit(priors).toPandas().set_index("well_id")["prefix_rmse"]
    for name, want in (("sc_ens", ncc), ("grf_mean_21", windows), ("beam_std", beams), ("surf_flat", surface)):
        assert np.allclose(got[name], want.loc[got.index], atol=1e-9), name
    assert np.allclose(got["surf_flat_rmse"], fit.loc[got.index.get_level_values(0)], atol=1e-9)
    # the dense surface: twenty nearest rows of other keys on scaled axes
    points = pdf.groupby("well_id", group_keys=False).apply(lambda g: g.iloc[np.unique(np.floor(np.ceil(np.arange(len(g)) * (min(60, len(g)) - 1) / (len(g) - 1)) * (len(g) - 1) / (min(60, len(g)) - 1)).astype(int))].assign(key=g.name), include_groups=False)
    sx, sy = points["x"].std(ddof=0), points["y"].std(ddof=0)
    for (key, row), r in list(got.iterrows())[::17]:
        others = points[points["key"] != key]
        d = np.sort(np.hypot((others["x"] - r["x"]) / sx, (others["y"] - r["y"]) / sy))
        assert abs(d[0] - r["dense_dist"]) < 1e-9
    for families in ("tda", "tdb", "tds", "tdp"):
        assert sum(c.startswith(families) for c in got.columns) == 11
    assert {"hyb_ref", "cal_a", "cal_b", "pfx_rmse", "slope_all", "slope_z", "tw_range", "surf_dense", "surf_flat_bias_weighted", "grf_lag_15", "dz_dmd", "sc2_score", "selfcorr_tvt", "surf_std"} <= set(got.columns)
