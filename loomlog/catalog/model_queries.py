"""Folds and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import pred_vectors, ref_curve, seq_log
from loomlog.catalog.prefix_queries import LADDER_CTE, LAST_CTE
from loomlog.catalog.registry import PRED_CTE, SEQ_CTE, query
from loomlog.operators import metrics, prefix, sequence
from loomlog.operators import models as op

ID = ["well_id", "row_idx"]

query("group_kfold", lambda s, d: op.group_kfold(seq_log(s, d), 5),
      """SELECT well_id, k AS rows, CAST(fold AS INTEGER) AS fold FROM walk""",
      ctes=SEQ_CTE.replace("ev AS", "RECURSIVE ev AS", 1).lstrip() + """,
      sized AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k DESC, md5(well_id), well_id) AS i FROM (SELECT well_id, count(*) AS k FROM seq_log GROUP BY 1)),
      walk AS (SELECT i, well_id, k, 0 AS fold, [k, 0, 0, 0, 0] AS loads FROM sized WHERE i = 1
        UNION ALL SELECT s.i, s.well_id, s.k, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, n: CASE WHEN n = list_position(loads, list_min(loads)) THEN v + s.k ELSE v END)
        FROM walk w JOIN sized s ON s.i = w.i + 1)""")
query("seeded_kfold", lambda s, d: op.seeded_kfold(seq_log(s, d), 5, 204, 3),
      """SELECT repeat, well_id, (row_number() OVER (PARTITION BY repeat ORDER BY md5(concat(well_id, 204 + 1009 * repeat)), well_id) - 1) % 5 AS fold
      FROM (SELECT DISTINCT well_id FROM seq_log), (SELECT unnest([0, 1, 2]) AS repeat)""", ctes=SEQ_CTE)
_r = ", ".join(f"row_number() OVER (ORDER BY {c}, well_id) - 1 AS r{i}" for i, c in enumerate(("md", "z", "gr")))
_l = ", '_', ".join(f"CASE WHEN r{i} <= (n - 1) / 3 THEN 0 WHEN r{i} <= 2 * (n - 1) / 3 THEN 1 ELSE 2 END" for i in range(3))
query("strata", lambda s, d: op.strata(seq_log(s, d), ["md", "z", "gr"]),
      f"""SELECT well_id, CASE WHEN count(*) OVER (PARTITION BY st) < 2 THEN 'rare' ELSE st END AS stratum FROM (SELECT well_id, concat({_l}) AS st FROM (SELECT *, count(*) OVER () AS n, {_r} FROM (
      SELECT well_id, quantile_cont(md, 0.5) AS md, quantile_cont(z, 0.5) AS z, quantile_cont(gr, 0.5) AS gr FROM seq_log GROUP BY 1)))""", ctes=SEQ_CTE)


def folded(s, d):
    return seq_log(s, d).withColumn("fold", (F.col("y") % 5).cast("int"))


query("impute_median", lambda s, d: op.impute_median(folded(s, d), ["gr"]).select(*ID, "gr"),
      """SELECT well_id, row_idx, coalesce(gr, m) AS gr FROM seq_log JOIN (SELECT h, quantile_cont(gr, 0.5) AS m FROM seq_log, (SELECT unnest(range(0, 5)) AS h) WHERE y % 5 <> h GROUP BY 1) ON y % 5 = h""", ctes=SEQ_CTE, floats="gr")
query("standardize", lambda s, d: op.standardize(folded(s, d), ["md", "z"]).select(*ID, "md", "z"),
      """SELECT well_id, row_idx, (md - m1) / s1 AS md, (z - m2) / s2 AS z FROM seq_log JOIN (SELECT h, avg(md) AS m1, stddev_pop(md) AS s1, avg(z) AS m2, stddev_pop(z) AS s2
      FROM seq_log, (SELECT unnest(range(0, 5)) AS h) WHERE y % 5 <> h GROUP BY 1) ON y % 5 = h""", ctes=SEQ_CTE, floats="md z")
query("ridge_fit",
      lambda s, d: op.ridge_fit(pred_vectors(s, d), ["a", "b"], "truth", 40.0, ["grp"]).select("grp", F.col("coef")[0].alias("wa"), F.col("coef")[1].alias("wb"), "intercept"),
      """SELECT grp, wa, wb, my - wa * ma - wb * mb AS intercept FROM (SELECT *, (sya * (sbb + 40) - syb * sab) / ((saa + 40) * (sbb + 40) - sab * sab) AS wa, (syb * (saa + 40) - sya * sab) / ((saa + 40) * (sbb + 40) - sab * sab) AS wb
      FROM (SELECT grp, count(*) * var_pop(a) AS saa, count(*) * var_pop(b) AS sbb, count(*) * covar_pop(a, b) AS sab, count(*) * covar_pop(a, truth) AS sya, count(*) * covar_pop(b, truth) AS syb,
      avg(a) AS ma, avg(b) AS mb, avg(truth) AS my FROM pred_vectors GROUP BY 1))""", ctes=PRED_CTE, floats="wa wb intercept", digits=4)


def pv_folds(s, d):
    return pred_vectors(s, d).withColumn("fold", (F.col("grp") % 5).cast("int"))


query("ridge_oof", lambda s, d: op.oof_report(op.ridge_oof(pv_folds(s, d), ["a", "b"], "truth", 40.0), "truth", "oof"),
      """SELECT fold, count(*) AS rows, sqrt(avg(e * e)) AS rmse FROM (SELECT unnest([h, -1]) AS fold, truth - my - wa * (a - ma) - wb * (b - mb) AS e FROM pred_vectors JOIN (
        SELECT *, (sya * (sbb + 40) - syb * sab) / ((saa + 40) * (sbb + 40) - sab * sab) AS wa, (syb * (saa + 40) - sya * sab) / ((saa + 40) * (sbb + 40) - sab * sab) AS wb FROM (
          SELECT h, count(*) * var_pop(a) AS saa, count(*) * var_pop(b) AS sbb, count(*) * covar_pop(a, b) AS sab, count(*) * covar_pop(a, truth) AS sya, count(*) * covar_pop(b, truth) AS syb,
          avg(a) AS ma, avg(b) AS mb, avg(truth) AS my FROM pred_vectors, (SELECT unnest(range(0, 5)) AS h) WHERE grp % 5 <> h GROUP BY 1)) ON grp % 5 = h) GROUP BY 1""", ctes=PRED_CTE, floats="rmse", digits=3)
query("stack_oof", lambda s, d: op.oof_report(op.ridge_oof(pv_folds(s, d), ["a", "b", "c"], "truth", 1.66, positive=True, clip_to_target=True), "truth", "oof"))
query("residual_target",
      lambda s, d: prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL").select(*ID, (F.col("tvt") - F.col("last_tvt")).alias("target"), (F.col("last_tvt") + (F.col("tvt") - F.col("last_tvt"))).alias("restored")),
      "SELECT well_id, row_idx, tvt - last_tvt AS target, tvt AS restored FROM priors WHERE tvt_input IS NULL", ctes=LAST_CTE, floats="target restored")


def learn(s, d):
    rows = sequence.interpolate_linear(seq_log(s, d), {"gr": "grf"})
    rows = sequence.rolling_centered(rows, "grf", (5, 25))
    feats = prefix.linear_prior(rows).withColumns({"target": F.col("tvt") - F.col("last_tvt"), "fold": (F.col("y") % 3).cast("int"), "drift": F.col("linear_prior") - F.col("last_tvt")})
    return op.training_frame(feats, seq_log(s, d), ref_curve(s, d))


FEATS = ["md_from_ps", "drift", "z", "grf", "grf_mean_5", "grf_std_5", "grf_mean_25", "grf_std_25"]
query("training_frame", lambda s, d: learn(s, d).select(*ID, "target"),
      "SELECT well_id, row_idx, tvt - last_tvt AS target FROM priors WHERE tvt_input IS NULL AND n_known >= 10 AND well_id IN (SELECT well_id FROM seq_log GROUP BY 1 HAVING count(*) >= 3)", ctes=LAST_CTE, floats="target")


def staged_learn(s, d):
    from loomlog.plans.stage import staged

    return staged(learn(s, d))


query("gbt_fit", lambda s, d: op.oof_report(op.gbt_oof(staged_learn(s, d), FEATS, "target", folds=3, trees=8, depth=3), "target", "oof"))
query("oof_predict", lambda s, d: op.oof_report(op.ridge_oof(staged_learn(s, d), FEATS, "target", 20.0, folds=3), "target", "oof"))


def repeated(s, d):
    folds = op.seeded_kfold(seq_log(s, d), 3, 204, 2)
    rows = staged_learn(s, d).drop("fold")
    parts = None
    for r in (0, 1):
        one = op.ridge_oof(rows.join(folds.where(F.col("repeat") == r).select("well_id", "fold"), "well_id"), FEATS, "target", 20.0, folds=3)
        part = one.select(*ID, "target", "oof")
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(*ID).agg(F.avg("oof").alias("oof"), F.first("target").alias("target"))


query("repeated_oof", lambda s, d: repeated(s, d).agg(F.count("*").alias("rows"), F.sqrt(F.avg((F.col("target") - F.col("oof")) ** 2)).alias("rmse")))
query("prefix_cut_augment", lambda s, d: op.prefix_cut_augment(seq_log(s, d)).groupBy("well_id", "aug_k").agg(F.count("*").alias("rows"), F.count("tvt_input").alias("known"), F.count_if("new_eval").alias("new_eval")),
      """SELECT well_id, aug_k, count(*) AS rows, count(*) FILTER (row_idx < CASE WHEN aug_k < 0 THEN n_known ELSE aug_k END) AS known,
      count(*) FILTER (aug_k >= 0 AND row_idx >= aug_k AND row_idx < n_known) AS new_eval FROM seq_log JOIN (
        SELECT DISTINCT well_id, n_known, aug_k FROM (SELECT well_id, n_known, unnest([-1, 20, CAST(floor(20 + (n_known - 22) * 0.5) AS BIGINT), n_known - 2]) AS aug_k FROM ps) WHERE aug_k < 0 OR n_known >= 25) USING (well_id) GROUP BY 1, 2""", ctes=LAST_CTE)
query("row_subsample", lambda s, d: op.row_subsample(seq_log(s, d), 7, "row_idx", "5").select(*ID),
      "SELECT well_id, row_idx FROM seq_log QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY md5(concat(row_idx, '5')), row_idx) <= 7", ctes=SEQ_CTE)
query("predict_to_contract",
      lambda s, d: op.predict_to_contract(prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL").select(F.concat_ws("_", "well_id", "row_idx").alias("id"), "last_tvt", (F.col("linear_prior") - F.col("last_tvt")).alias("delta")),
                                          seq_log(s, d).where("tvt_input IS NULL").select(F.concat_ws("_", "well_id", "row_idx").alias("id"), F.col("row_idx").alias("pos")), "last_tvt", "delta"),
      "SELECT concat(well_id, '_', row_idx) AS id, row_idx AS pos, linear_prior AS tvt FROM priors WHERE tvt_input IS NULL", ctes=LAST_CTE, floats="tvt")
query("feature_set_select",
      lambda s, d: op.feature_set_select(metrics.score_report(prefix.baseline_ladder(seq_log(s, d))).select("model", "rmse"),
                                         {"constant": "strict", "linear_md_all": "strict", "linear_z_all": "target_free", "linear_md_recent": "open", "linear_z_recent": "open"}, ["strict", "target_free"]),
      "SELECT rmse, model, CASE WHEN model IN ('constant', 'linear_md_all') THEN 'strict' ELSE 'target_free' END AS policy FROM (SELECT model, sqrt(avg(pow(truth - pred, 2))) AS rmse FROM long WHERE model NOT LIKE '%recent' GROUP BY 1) ORDER BY rmse LIMIT 1",
      ctes=LADDER_CTE, floats="rmse")
