"""Literal cases: ids, masks, priors, metrics, gates, sources."""

import math

import numpy as np
import pandas as pd
import pytest
from logs import to_spark
from pyspark.sql import functions as F

from loomlog.functions import exprs
from loomlog.operators import align, contract, metrics, models, post, prefix, spatial
from loomlog.operators.ids import fingerprint
from loomlog.sources import files


def test_row_id_splits_at_the_last_underscore(spark):
    df = spark.createDataFrame([("000d7d20_1442",), ("a_b_7",), ("none",)], "id string")
    rows = df.select(exprs.row_key(F.col("id")), exprs.row_number_of(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [("000d7d20", 1442), ("a_b", 7), (None, None)]


def test_mask_and_linear_prior(spark):
    pdf = pd.DataFrame({"well_id": "w", "row_idx": range(4), "md": [0.0, 1, 2, 3], "z": 0.0, "gr": [80.0, 82, 84, 85], "tvt": [10.0, 11, 12, 13], "tvt_input": [10.0, 11, np.nan, np.nan]})
    df = to_spark(spark, pdf)
    assert [r.is_eval for r in prefix.prediction_mask(df, True).orderBy("row_idx").collect()] == [False, False, True, True]
    assert all(r.is_eval for r in prefix.prediction_mask(df.drop("tvt_input")).collect())
    assert not any(r.is_eval for r in prefix.prediction_mask(df.drop("tvt"), True).collect())
    assert [r.linear_prior for r in prefix.linear_prior(df).orderBy("row_idx").collect()] == pytest.approx([10, 11, 12, 13])


def test_no_prefix_and_constant_md(spark):
    pdf = pd.DataFrame({"well_id": ["a", "a", "b"], "row_idx": [0, 1, 0], "md": [3.0, 3.0, 5.0], "z": 1.0, "tvt_input": [4.0, 5.0, np.nan]})
    got = {r.well_id: r for r in prefix.last_known(to_spark(spark, pdf)).collect()}
    assert (got["b"].last_tvt, got["b"].ps_md, got["b"].ps_row, got["b"].n_known) == (0.0, 5.0, 0, 0)
    assert {r.slope for r in prefix.last_known_slope(to_spark(spark, pdf)).collect()} == {0.0}


def test_rmse_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (3.0, 5.0)], "truth double, pred double")
    assert df.select(metrics.rmse().alias("r")).first().r == pytest.approx(math.sqrt(2.5))


def test_contract_guard_reasons(spark):
    contract_df = spark.createDataFrame([("a_0", 0), ("a_1", 1)], "id string, pos bigint")

    def reason(rows):
        return contract.contract_guard(spark.createDataFrame(rows, "id string, tvt double"), contract_df).first().reason

    assert reason([("a_0", 1.0), ("a_1", 2.0)]) == "ok"
    assert reason([("a_0", 1.0)]) == "missing"
    assert reason([("a_0", 1.0), ("a_1", 2.0), ("b_0", 1.0)]) == "extra"
    assert reason([("a_0", 1.0), ("a_1", 2.0), ("a_1", 2.0)]) == "duplicates"
    assert reason([("a_0", float("nan")), ("a_1", 2.0)]) == "not_finite"
    assert reason([("a_0", float("inf")), ("a_1", 2.0)]) == "not_finite"


def test_fingerprint_ignores_order(spark):
    rows = [("g", f"i{n}", float(n)) for n in range(20)]
    a, b = (fingerprint(spark.createDataFrame(r, "grp string, id string, pred double")).collect() for r in (rows, rows[::-1]))
    assert a == b
    rows[3] = ("g", "i3", 3.1)
    assert fingerprint(spark.createDataFrame(rows, "grp string, id string, pred double")).collect() != a


def test_ridge_positive_and_plain(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"]))
    fit = models.ridge_fit(df, ["a", "b", "c"], "y", 20.0).first()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 20 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(fit.coef, want)
    assert fit.intercept == pytest.approx(y.mean() - x.mean(0) @ want)
    pos = models.ridge_fit(df, ["a", "b", "c"], "y", 20.0, positive=True).first().coef
    assert pos[1] == 0.0 and min(pos) >= 0.0


def test_savgol_equals_local_polynomials(spark):
    rng = np.random.default_rng(4)
    parts = []
    for k, n in (("long", 60), ("mid", 12), ("short", 3)):
        parts.append(pd.DataFrame({"well_id": k, "row_idx": range(n), "v": rng.normal(size=n)}))
    pdf = pd.concat(parts, ignore_index=True)
    from loomlog.plans.blocks import Seq

    got = post.savgol_smooth(spark.createDataFrame(pdf), "v", 9, 3, seq=Seq(rows=20)).toPandas().sort_values(["well_id", "row_idx"])
    for k, p in pdf.groupby("well_id"):
        v, n = p["v"].to_numpy(), len(p)
        w = min(9, n if n % 2 else n - 1)
        want = v.copy()
        if w >= 5:
            for i in range(n):
                s = max(0, min(i - w // 2, n - w))
                want[i] = np.polyval(np.polyfit(np.arange(w), v[s:s + w], 3), i - s)
        np.testing.assert_allclose(got[got.well_id == k]["smooth"], want, atol=1e-8)


def test_robust_projection_equals_plain_loop(spark):
    rng = np.random.default_rng(5)
    s = np.linspace(0, 1, 80)
    u = 3 + 2 * s - 4 * s**2 + rng.normal(0, 0.05, 80)
    u[10] += 9
    pdf = pd.DataFrame({"well_id": "w", "row_idx": range(80), "s": s, "u": u, "n_known": 30})
    got = post.robust_projection(spark.createDataFrame(pdf), "u", "s", 3).toPandas().sort_values("row_idx")["projected"]
    w = np.ones(80)
    a = np.vander(2 * s - 1, 4)
    for r in range(5):
        c = np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ u)
        res = u - a @ c
        mad = np.median(np.abs(res - np.median(res)))
        w = 1 / (1 + (res / max(2 * 1.4826 * mad, 1e-6)) ** 2)
    np.testing.assert_allclose(got, a @ c, rtol=1e-6)


def test_knn_equals_brute_force_with_a_crowded_place(spark):
    rng = np.random.default_rng(6)
    xy = np.vstack([rng.normal(0, 1e-3, (150, 2)), rng.uniform(-50, 50, (250, 2)), np.zeros((50, 2))])
    pdf = pd.DataFrame({"id": range(len(xy)), "grp": rng.integers(0, 6, len(xy)), "x": xy[:, 0], "y": xy[:, 1]})
    got = spatial.knn(spark.createDataFrame(pdf), spark.createDataFrame(pdf), 4).toPandas().sort_values(["id", "rank"])
    z = xy / xy.std(axis=0)
    assert len(got) == 4 * len(pdf)
    for i, p in got.groupby("id"):
        d = np.sqrt(((z - z[i]) ** 2).sum(1))
        d[pdf["grp"] == pdf["grp"][i]] = np.inf
        np.testing.assert_allclose(p["dist"], np.sort(d)[:4], atol=1e-12)


def nearest(pdf, k):
    out = []
    for r in pdf.itertuples():
        other = pdf[pdf.grp != r.grp]
        d = np.hypot(other.x - r.x, other.y - r.y).to_numpy()
        order = np.lexsort((other.id, d))[:k]
        out += [(r.id, i + 1, int(other.id.iloc[j]), f"{d[j]:.9g}") for i, j in enumerate(order)]
    return out


@pytest.mark.parametrize("kind", ["tight groups", "far outlier", "one crowded group", "one line"])
def test_knn_pairs_stay_bounded(spark, kind, monkeypatch):
    """Wherever the points lie, a query meets the points of a few tiles, and the result is that of all pairs."""
    monkeypatch.setattr(spatial, "TOP", 4)  # several levels on few points
    monkeypatch.setattr(spatial, "FAN", 1)
    rng = np.random.default_rng(8)
    n, k, crowd = 1500, 4, 8
    x, y, grp = rng.normal(0, 1, n), rng.normal(0, 1, n), rng.integers(0, 30, n)
    if kind == "tight groups":  # each within a millionth of the extent
        cx, cy = rng.uniform(-1, 1, 30), rng.uniform(-1, 1, 30)
        x, y = cx[grp] + rng.normal(0, 1e-6, n), cy[grp] + rng.normal(0, 1e-6, n)
    elif kind == "far outlier":
        x[0], y[0] = 1e9, -1e9
    elif kind == "one crowded group":  # a third of all, and in the midst of the others
        grp[: n // 3], x[: n // 3], y[: n // 3] = 99, x[: n // 3] * 1e-3, y[: n // 3] * 1e-3
    else:
        y[:] = 2.0
    pdf = pd.DataFrame({"id": np.arange(n), "grp": grp, "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    got = spatial.knn(df, df, k, scaled=False, crowd=crowd).toPandas()
    assert sorted(zip(got.id, got["rank"], got.p_id, (f"{d:.9g}" for d in got.dist))) == sorted(nearest(pdf, k))
    asked = df.select(F.col("id").alias("q_id"), "grp", F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    points = df.select(F.col("id").alias("p_id"), F.col("grp").alias("p_grp"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    per = spatial.near_pairs(asked, points, k, "grp", crowd).groupBy("q_id").count().toPandas()["count"]
    assert per.mean() < 12 * crowd and per.max() < n / 5


def test_knn_leaves_out_what_has_no_place(spark):
    pdf = pd.DataFrame({"id": [1, 2, 3, 4, 5], "grp": [0.0, 1.0, np.nan, 1.0, 2.0], "x": [0.0, 1.0, 0.5, np.nan, 9.0], "y": [0.0] * 5})
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("grp", "x")})
    got = spatial.knn(df, df, 2, scaled=False).collect()
    assert sorted((r.id, r.rank, r.p_id) for r in got) == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)]
    assert spatial.knn(df.where("id < 0"), df, 2, scaled=False).count() == spatial.knn(df, df.where("id < 0"), 2, scaled=False).count() == 0
    free = spatial.knn(df, df, 1, exclude=None, scaled=False).collect()
    assert sorted((r.id, r.p_id) for r in free) == [(1, 1), (2, 2), (3, 3), (5, 5)]


def test_knn_with_fewer_than_k_points(spark):
    pdf = pd.DataFrame({"id": [1, 2, 3], "grp": [0, 1, 1], "x": [0.0, 1.0, 5.0], "y": [0.0, 0.0, 0.0]})
    got = spatial.knn(spark.createDataFrame(pdf), spark.createDataFrame(pdf), 5, scaled=False).toPandas()
    assert sorted(zip(got["id"], got["p_id"])) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_fold_sizes_and_whole_keys(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(23) for _ in range(i + 1)], "well_id string")
    folds = models.group_kfold(df, 5).toPandas()
    assert len(folds) == 23 and set(folds["fold"]) == set(range(5))
    rows = folds.groupby("fold")["rows"].sum()
    assert rows.max() - rows.min() <= 23


def greedy(sizes, k):
    """Largest first, each to the lightest fold, the lowest-numbered on a tie: folds in the order of ``sizes``."""
    loads, out = [0] * k, []
    for n in sizes:
        f = min(range(k), key=lambda i: (loads[i], i))
        loads[f] += n
        out.append(f)
    return out


def test_size_classes_are_dealt_like_single_keys():
    rng = np.random.default_rng(6)
    for k in (1, 2, 3, 5, 8):
        for most in (1, 3, 40, 1000):
            for n in (1, 7, 300):
                sizes = sorted(rng.integers(1, most + 1, n).tolist() + [9000] * (n % 2), reverse=True)
                classes = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
                runs, got = models._deal_sizes(classes, k), []
                for s, c in classes:
                    own = [r for r in runs if r[0] == s]
                    got += [next(t[(m - first) % len(t)] for _, first, t in reversed(own) if first <= m) for m in range(c)]
                assert got == greedy(sizes, k)
                assert len(runs) <= k * len(classes)


def test_folds_equal_the_greedy_ones(spark):
    import hashlib

    rng = np.random.default_rng(7)
    rows = {f"k{i}": int(rng.integers(1, 12)) for i in range(200)} | {"huge": 700}
    df = spark.createDataFrame([(key,) for key, n in rows.items() for _ in range(n)], "well_id string")
    order = sorted(rows, key=lambda key: (-rows[key], hashlib.md5(key.encode()).hexdigest(), key))
    want = dict(zip(order, greedy([rows[key] for key in order], 4)))
    assert {r.well_id: r.fold for r in models.group_kfold(df, 4).collect()} == want
    assert models.group_kfold(df.where("well_id = 'none'"), 4).count() == 0


def test_files_round_trip(spark, tmp_path):
    for split in ("train", "test"):
        d = tmp_path / split
        d.mkdir()
        pd.DataFrame({"MD": [2.0, 1.0, 3.0], "X": 0.0, "Y": 0.0, "Z": [5.0, 4.0, 6.0], "GR": [1.0, np.nan, 2.0], "TVT": [1.0, 2, 3], "TVT_input": [1.0, 2, np.nan]}).to_csv(d / "ab12__horizontal_well.csv", index=False)
        pd.DataFrame({"TVT": [1.0, 2.0], "GR": [3.0, 4.0], "Geology": ["a", "b"]}).to_csv(d / ("ab12__typewell.csv" if split == "train" else "ab12__typewell__zz.csv"), index=False)
    logs = files.scan_logs(spark, str(tmp_path)).orderBy("split", "row_idx").collect()
    assert [(r.split, r.well_id, r.row_idx, r.md) for r in logs][:3] == [("test", "ab12", 0, 1.0), ("test", "ab12", 1, 2.0), ("test", "ab12", 2, 3.0)]
    curves = {(r.split, r.well_id, r.curve_id) for r in files.scan_curves(spark, str(tmp_path)).collect()}
    assert curves == {("train", "ab12", "ab12"), ("test", "ab12", "zz")}
    contract_df = spark.createDataFrame([("b_0", 0), ("a_0", 1), ("c_0", 2)], "id string, pos bigint")
    preds = spark.createDataFrame([("a_0", 1.0), ("b_0", 2.0), ("c_0", 3.0)], "id string, tvt double")
    out = str(tmp_path / "out")
    files.write_predictions(preds, contract_df, out)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert [line for p in parts for line in p.read_text().splitlines() if line != "id,tvt"] == ["b_0,2.0", "a_0,1.0", "c_0,3.0"]
    built = []
    for _ in range(2):
        files.cached_table(spark, str(tmp_path / "cache"), lambda: built.append(1) or preds)
    assert len(built) == 1
    files.write_report(preds, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_canonical_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", "7", None)], "`Gamma-Ray` double, Measured_Depth double, note string, `Other/One` string, empty string")
    assert files.canonicalize(df, ("md", "gr")).columns == ["md", "gr"]
    with pytest.raises(ValueError, match="tvt"):
        files.canonicalize(df, ("tvt",))
    assert files.extra_numeric(df, ["Measured_Depth"]).columns == ["Measured_Depth", "raw_gamma_ray", "raw_other_one"]


def test_depth_is_z_and_the_first_column_counts(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "a")], "MD double, depth double, TVD double, X_Loc double, Layer string")
    got = files.canonicalize(df, ("md", "z"))
    assert got.columns == ["md", "x", "z", "geology"] and tuple(got.first()) == (1.0, 4.0, 2.0, "a")


def test_rate_is_taken_between_the_last_known_rows(spark):
    from loomlog.operators.prefix import rate_init

    # md stands still once, and an unknown row lies inside the prefix: steps 2 / 1, 3 / 1 and 4 / 2 remain
    rows = [("w", i, md, 0.0, t) for i, (md, t) in enumerate([(0.0, 0.0), (1.0, 2.0), (1.0, 9.0), (2.0, 12.0), (3.0, None), (4.0, 16.0), (5.0, None)])]
    df = spark.createDataFrame(rows, "well_id string, row_idx long, md double, z double, tvt_input double")
    assert rate_init(df).first()["rate"] == 2.0 and rate_init(df, recent=3).first()["rate"] == 0.0


def test_a_donor_without_comparable_signal_is_rejected(spark):
    from loomlog.operators.transfer import gated_transfer

    rows = [(w, "d", i, 1.0, 1.0, None if w == "bare" else 5.0, 5.0, 2.0, 2.0, 0.0) for w in ("bare", "full") for i in range(60)]
    df = spark.createDataFrame(rows, "well_id string, donor string, row_idx long, tvt_input double, copy_tvt double, gr double, copy_gr double, z double, copy_z double, pred double")
    assert {r.well_id: r.accepted for r in gated_transfer(df, "pred")[1].collect()} == {"bare": False, "full": True}


def test_ncc_tiny_is_finite(spark):
    pdf = pd.DataFrame({"well_id": "w", "row_idx": range(7), "md": range(7), "z": 0.0, "gr": [1.0, 2, 3, 4, 2, 3, 4], "tvt_input": [10.0, 11, 12, 13, np.nan, np.nan, np.nan]})
    got = align.prefix_ncc(to_spark(spark, pdf.astype({"md": float})), (1,), 1, 5, 3).toPandas()
    assert len(got) == 7 and np.isfinite(got["tvt"]).all() and got["score"].abs().max() <= 1 + 1e-9
