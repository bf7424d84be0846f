"""Block plans: results must not depend on where a key is cut."""

import numpy as np
import pytest
from logs import curve_of, hot_log, to_spark
from pyspark.sql import functions as F

from loomlog.operators import curves, profile, sequence
from loomlog.plans import blocks
from loomlog.plans.blocks import Seq, scan
from loomlog.plans.quantiles import quantiles

CUT = Seq(rows=7)


@pytest.fixture(scope="module")
def log(spark):
    return hot_log()


def frame(df):
    return df.toPandas().sort_values(["well_id", "row_idx"], ignore_index=True)


def test_scan_matches_pandas(spark, log):
    df = scan(to_spark(spark, log), run={"run": F.col("md")}, last={"prev": F.col("gr")}, following={"succ": F.col("gr")},
              total={"n": ("sum", F.lit(1)), "lo": ("min", F.col("gr")), "end": ("last", F.col("gr")), "begin": ("first", F.col("gr"))}, seq=CUT)
    got, g = frame(df), log.groupby("well_id")
    np.testing.assert_allclose(got["run"], g["md"].cumsum())
    np.testing.assert_allclose(got["prev"], g["gr"].ffill())
    np.testing.assert_allclose(got["succ"], g["gr"].bfill())
    np.testing.assert_allclose(got["n"], g["gr"].transform("size"))
    np.testing.assert_allclose(got["lo"], g["gr"].transform("min"))
    np.testing.assert_allclose(got["end"], g["gr"].transform("last"))
    np.testing.assert_allclose(got["begin"], g["gr"].transform("first"))


def test_interpolation_and_windows_match_pandas(spark, log):
    filled = sequence.interpolate_linear(to_spark(spark, log), {"gr": "grf"}, seq=CUT)
    got = frame(sequence.rolling_centered(filled, "grf", (5, 13), seq=CUT))
    want = log.groupby("well_id")["gr"].transform(lambda s: s.interpolate(limit_direction="both"))
    np.testing.assert_allclose(got["grf"], want)
    for n in (5, 13):
        roll = want.groupby(log["well_id"]).rolling(n, center=True, min_periods=1).mean().to_numpy()
        np.testing.assert_allclose(got[f"grf_mean_{n}"], roll)
        std = want.groupby(log["well_id"]).rolling(n, center=True, min_periods=2).std().fillna(0).to_numpy()
        np.testing.assert_allclose(got[f"grf_std_{n}"], std, atol=1e-9)


def test_gradient_matches_numpy(spark, log):
    got = frame(sequence.gradient_md(to_spark(spark, log), {"z": "g"}, seq=CUT))
    want = np.concatenate([np.gradient(p["z"], p["md"]) for _, p in log.groupby("well_id")])
    np.testing.assert_allclose(got["g"], want)


@pytest.mark.parametrize("op", ["lag_lead_diff", "rolling_trailing", "tortuosity", "tail_position", "window_signature"])
def test_cut_equals_whole(spark, log, op):
    pdf = log.assign(gr=log["gr"].fillna(50.0))
    args = {"lag_lead_diff": ("gr", (1, 5), (1, 2)), "rolling_trailing": ("gr", (6,)), "tortuosity": ((3, 6), 2, 5), "tail_position": (), "window_signature": ("gr", 3)}[op]
    a, b = (frame(getattr(sequence, op)(to_spark(spark, pdf), *args, seq=s)) for s in (CUT, Seq()))
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        if c == "signature":
            np.testing.assert_allclose(np.stack(a[c]).astype(float), np.stack(b[c]).astype(float))
        elif a[c].dtype == object:
            assert (a[c] == b[c]).all()
        else:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-12)


def test_longest_run_over_block_borders(spark, log):
    got = profile.longest_run(to_spark(spark, log), F.col("gr").isNull(), seq=CUT).toPandas().set_index("well_id")["longest"]
    for k, p in log.groupby("well_id"):
        best = run = 0
        for v in p["gr"].isna():
            run = run + 1 if v else 0
            best = max(best, run)
        assert got[k] == best


@pytest.mark.parametrize("parts", ["1", "23"])
def test_curve_interp_matches_numpy(spark, log, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        interp_matches_numpy(spark, log)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def interp_matches_numpy(spark, log):
    curve = curve_of()
    got = frame(curves.curve_interp(to_spark(spark, log), to_spark(spark, curve), "tvt", "c"))
    inside = frame(curves.curve_interp(to_spark(spark, log), to_spark(spark, curve), "tvt", "c", outside="null"))
    for k, p in log.groupby("well_id"):
        c = curve[curve.well_id == k]
        np.testing.assert_allclose(got[got.well_id == k]["c"], np.interp(p["tvt"], c["tvt"], c["gr"]))
        np.testing.assert_allclose(inside[inside.well_id == k]["c"].astype(float), np.interp(p["tvt"], c["tvt"], c["gr"], np.nan, np.nan))


def test_one_value_over_most_rows_gives_bounded_blocks(spark, monkeypatch):
    """A hot key whose rows ask for one value nearly all, beside a key with a range a million times as wide."""
    import pandas as pd

    rng = np.random.default_rng(5)
    ask = pd.DataFrame({"well_id": "hot", "row_idx": np.arange(12_000), "q": 5.0})
    ask["q"] = np.where(rng.random(len(ask)) < 0.1, 5 + rng.random(len(ask)) * 1e-3, 5.0)
    ask = pd.concat([ask, pd.DataFrame({"well_id": "wide", "row_idx": np.arange(100), "q": rng.uniform(0, 1e6, 100)}), pd.DataFrame({"well_id": ["hot", "none"], "row_idx": [-1, 0], "q": [np.nan, 1.0]})])
    curve = pd.DataFrame({"well_id": "hot", "tvt": np.sort(5 + rng.random(3000) * 1e-3), "gr": rng.normal(0, 1, 3000)})
    curve = pd.concat([curve, curve.iloc[:500], pd.DataFrame({"well_id": "wide", "tvt": [0.0, 1e6], "gr": [0.0, 1.0]})])  # repeated knots
    seen = []
    dealt = curves.dealt
    monkeypatch.setattr(curves, "dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    for name, value in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(name, value)
    try:
        rows = spark.createDataFrame(ask).withColumn("q", F.when(~F.isnan("q"), F.col("q")))
        got = curves.curve_interp(rows, spark.createDataFrame(curve), "q", "c").toPandas()
        sizes = seen[0].groupBy(blocks.BLOCK).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes.sum() < 4500 and len(sizes) >= 12 and sizes.max() < 3 * sizes.sum() / 16
    assert len(got) == len(ask) and got[(got.well_id == "none") | got.q.isna()]["c"].isna().all()
    for k in ("hot", "wide"):
        own, c = got[(got.well_id == k) & got.q.notna()], curve[curve.well_id == k].drop_duplicates()
        np.testing.assert_allclose(own["c"].astype(float), np.interp(own["q"].astype(float), c["tvt"], c["gr"]), atol=1e-9)


def test_single_point_curve_gives_null(spark, log):
    curve = curve_of(n=1)
    assert curves.curve_interp(to_spark(spark, log), to_spark(spark, curve), "tvt", "c").where("c IS NOT NULL").count() == 0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    import pandas as pd

    v = np.concatenate([rng.normal(0, 1e-3, 400), rng.normal(1e6, 1, 400), np.repeat(7.0, 300), [-1e12, 1e12]])
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "cold"], len(v)), "v": v})
    probs = (0.0, 0.005, 0.25, 0.5, 0.9, 1.0)
    got = quantiles(spark.createDataFrame(pdf), ["k"], {f"q{i}": (F.col("v"), p) for i, p in enumerate(probs)}).toPandas().set_index("k")
    for k, p in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].astype(float), np.quantile(p["v"], probs), rtol=1e-12)
