"""Profiles, audits and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import line_ids, pred_vectors, ref_curve, sample_ids, seq_log
from loomlog.catalog.curve_queries import CTE, PAIRS
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import CURVE_CTE, IDS_CTE, PRED_CTE, SEQ_CTE, query
from loomlog.operators import contract as ct
from loomlog.operators import profile as op



def split_log(s, d):
    return seq_log(s, d).withColumn("split", F.when(F.col("y") % 3 == 0, "test").otherwise("train"))


query("split_audit", lambda s, d: op.split_audit(split_log(s, d), ref_curve(s, d).where("CAST(well_id AS BIGINT) % 5 <> 0")),
      """SELECT CASE WHEN y % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(DISTINCT well_id) AS keys, count(*) AS rows, count(*) FILTER (tvt_input IS NULL) AS eval_rows,
      count(DISTINCT well_id) FILTER (y % 5 = 0) AS keys_without_curve FROM seq_log GROUP BY 1""", ctes=SEQ_CTE)
query("inventory_check", lambda s, d: op.inventory_check({"log": seq_log(s, d), "train": seq_log(s, d).where("y % 3 <> 0"), "curve": ref_curve(s, d)}),
      """SELECT unnest(['log', 'train', 'curve']) AS "group", unnest([count(DISTINCT user_id), count(DISTINCT user_id) FILTER (user_id % 3 <> 0), count(DISTINCT user_id)]) AS ids,
      unnest([count(DISTINCT user_id) FILTER (user_id % 3 = 0), 0, count(DISTINCT user_id) FILTER (user_id % 3 = 0)]) AS not_everywhere FROM events""")
query("zone_info", lambda s, d: op.zone_info(seq_log(s, d).withColumn("tvt_input", F.when(F.col("gr").isNotNull(), F.col("tvt_input")))),
      """SELECT well_id, count(*) AS rows, count(k) AS known, count(*) - count(k) AS hidden, min(row_idx) FILTER (k IS NULL) AS first_hidden, max(row_idx) FILTER (k IS NULL) AS last_hidden,
      count(*) FILTER (k IS NULL AND (row_idx = 0 OR pk IS NOT NULL)) AS hidden_runs FROM (SELECT *, lag(k) OVER (PARTITION BY well_id ORDER BY row_idx) AS pk
      FROM (SELECT *, CASE WHEN gr IS NOT NULL THEN tvt_input END AS k FROM seq_log)) GROUP BY 1""", ctes=SEQ_CTE)

_KP = "md_span x_span y_span z_span tvt_span azimuth gr_missing gr_missing_known gr_missing_hidden tail_md_range tail_z_range tail_tvt_range tail_gr_range last_tvt ps_md constant_rmse median_step"
query("key_profile", lambda s, d: op.key_profile(seq_log(s, d)),
      """SELECT well_id, count(*) AS rows, count(tvt_input) AS known, count(*) - count(tvt_input) AS hidden, max(md) - min(md) AS md_span, max(x) - min(x) AS x_span, max(y) - min(y) AS y_span,
      max(z) - min(z) AS z_span, max(tvt) - min(tvt) AS tvt_span, degrees(atan2(arg_max(y, row_idx) - arg_min(y, row_idx), arg_max(x, row_idx) - arg_min(x, row_idx))) AS azimuth,
      1 - count(gr) / count(*) AS gr_missing, 1 - count(gr) FILTER (tvt_input IS NOT NULL) / count(tvt_input) AS gr_missing_known,
      1 - count(gr) FILTER (tvt_input IS NULL) / count(*) FILTER (tvt_input IS NULL) AS gr_missing_hidden,
      max(md) FILTER (tvt_input IS NULL) - min(md) FILTER (tvt_input IS NULL) AS tail_md_range, max(z) FILTER (tvt_input IS NULL) - min(z) FILTER (tvt_input IS NULL) AS tail_z_range,
      max(tvt) FILTER (tvt_input IS NULL) - min(tvt) FILTER (tvt_input IS NULL) AS tail_tvt_range, max(gr) FILTER (tvt_input IS NULL) - min(gr) FILTER (tvt_input IS NULL) AS tail_gr_range,
      any_value(last_tvt) AS last_tvt, any_value(ps_md) AS ps_md, sqrt(avg(pow(tvt - last_tvt, 2)) FILTER (tvt_input IS NULL)) AS constant_rmse, quantile_cont(step, 0.5) AS median_step
      FROM (SELECT s.*, last_tvt, ps_md, abs(tvt - lag(tvt) OVER (PARTITION BY well_id ORDER BY row_idx)) AS step FROM seq_log s JOIN ps USING (well_id)) GROUP BY 1""",
      ctes=LAST_CTE, floats=_KP)

RUNS = """runs AS (SELECT well_id, max(c) AS longest, max(ck) AS longest_known, max(ch) AS longest_hidden FROM (
  SELECT well_id, count(*) FILTER (gr IS NULL) AS c, 0 AS ck, 0 AS ch FROM (SELECT *, row_idx - sum(CASE WHEN gr IS NULL THEN 1 ELSE 0 END) OVER w AS island FROM seq_log
    WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) WHERE gr IS NULL GROUP BY well_id, island
  UNION ALL SELECT well_id, 0, count(*) FILTER (hid = 0), count(*) FILTER (hid = 1) FROM (SELECT *, CASE WHEN tvt_input IS NULL THEN 1 ELSE 0 END AS hid,
    row_idx - row_number() OVER (PARTITION BY well_id, tvt_input IS NULL ORDER BY row_idx) AS island FROM seq_log WHERE gr IS NULL) GROUP BY well_id, hid, island
  UNION ALL SELECT DISTINCT well_id, 0, 0, 0 FROM seq_log) GROUP BY 1)"""
query("longest_run", lambda s, d: op.longest_run(seq_log(s, d), F.col("gr").isNull(), {"longest_known": F.expr("tvt_input IS NOT NULL"), "longest_hidden": F.expr("tvt_input IS NULL")}),
      "SELECT * FROM runs", ctes=SEQ_CTE + ",\n" + RUNS)
query("path_profile", lambda s, d: op.path_profile(seq_log(s, d)),
      """SELECT well_id, md_increases, hidden_md_span, hidden_z_span, slope_median, slope_p95, curvature_median, curvature_p95, longest, longest_known, longest_hidden FROM (
      SELECT well_id, coalesce(min(dm) > 0, true) AS md_increases, max(md) FILTER (tvt_input IS NULL) - min(md) FILTER (tvt_input IS NULL) AS hidden_md_span,
      max(z) FILTER (tvt_input IS NULL) - min(z) FILTER (tvt_input IS NULL) AS hidden_z_span, quantile_cont(abs(c), 0.5) AS slope_median, quantile_cont(abs(c), 0.95) AS slope_p95,
      quantile_cont(k, 0.5) AS curvature_median, quantile_cont(k, 0.95) AS curvature_p95 FROM (
        SELECT *, sqrt(pow(a - lag(a) OVER w, 2) + pow(b - lag(b) OVER w, 2) + pow(c - lag(c) OVER w, 2)) AS k FROM (
          SELECT *, md - lag(md) OVER w AS dm, (x - lag(x) OVER w) / nullif(md - lag(md) OVER w, 0) AS a, (y - lag(y) OVER w) / nullif(md - lag(md) OVER w, 0) AS b,
          (z - lag(z) OVER w) / nullif(md - lag(md) OVER w, 0) AS c FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))
      GROUP BY 1) JOIN runs USING (well_id)""",
      ctes=SEQ_CTE + ",\n" + RUNS, floats="hidden_md_span hidden_z_span slope_median slope_p95 curvature_median curvature_p95", digits=3)
query("curve_profile", lambda s, d: op.curve_profile(ref_curve(s, d)),
      """SELECT * FROM (SELECT well_id, count(*) AS rows, min(tvt) AS tvt_min, max(tvt) AS tvt_max, max(tvt) - min(tvt) AS tvt_span, min(gr) AS gr_min, max(gr) AS gr_max,
      count(DISTINCT geology) AS labels, quantile_cont(gr, 0.5) AS gr_median FROM ref_curve GROUP BY 1)
      JOIN (SELECT well_id, arg_min(st, struct_pack(c := -c, s := st)) AS modal_step FROM (SELECT well_id, st, count(*) AS c FROM (
        SELECT well_id, round(tvt - lag(tvt) OVER (PARTITION BY well_id ORDER BY tvt), 6) AS st FROM ref_curve) WHERE st IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (well_id)""",
      ctes=CURVE_CTE, floats="tvt_min tvt_max tvt_span gr_min gr_max gr_median modal_step")
query("prefix_consistency", lambda s, d: op.prefix_consistency(seq_log(s, d).withColumn("tvt", F.col("tvt") + F.when(F.col("y") % 7 == 0, 0.5).otherwise(0.0))),
      "SELECT well_id, CASE WHEN y % 7 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS max_diff, y % 7 = 0 AS differs FROM seq_log GROUP BY well_id, y", ctes=SEQ_CTE, floats="max_diff")
_J = ", ".join(f"count(*) FILTER (st > {j}) AS over_{str(j).replace('.', '_')}" for j in op.JUMPS)
query("step_jumps", lambda s, d: op.step_jumps(seq_log(s, d), "z"),
      f"""SELECT count(st) AS steps, max(st) AS step_max, {_J}, quantile_cont(st, 0.5) AS p50, quantile_cont(st, 0.9) AS p90, quantile_cont(st, 0.99) AS p99, quantile_cont(st, 0.999) AS p999
      FROM (SELECT abs(z - lag(z) OVER (PARTITION BY well_id ORDER BY row_idx)) AS st FROM seq_log)""", ctes=SEQ_CTE, floats="step_max p50 p90 p99 p999")
query("surface_stability", lambda s, d: op.surface_stability(seq_log(s, d), ["y", "gr"]),
      """SELECT well_id, surface, stddev_pop(r) AS std, 1 - count(r) / count(*) AS missing, any_value(md) AS median, quantile_cont(abs(r - md), 0.95) AS p95_abs_dev,
      quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr FROM (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY well_id, surface) AS md FROM (
        SELECT well_id, unnest(['y', 'gr']) AS surface, unnest([tvt + z - y, tvt + z - gr]) AS r FROM seq_log)) GROUP BY 1, 2""",
      ctes=SEQ_CTE, floats="std missing median p95_abs_dev iqr")
query("prefix_alignment", lambda s, d: op.prefix_alignment(seq_log(s, d), ref_curve(s, d)),
      f"""SELECT well_id, count(gr - v) AS pairs, CASE WHEN count(gr - v) >= 30 AND stddev_pop(gr) > 1e-12 AND stddev_pop(v) FILTER (gr IS NOT NULL) > 1e-12 THEN corr(gr, v) END AS corr,
      sqrt(avg(pow(gr - v, 2))) AS rmse, avg(abs(gr - v)) AS mae, stddev_pop(gr - v) AS resid_std, CASE WHEN regr_count(gr, v) >= 20 THEN regr_slope(gr, v) END AS slope,
      CASE WHEN regr_count(gr, v) >= 20 THEN regr_intercept(gr, v) END AS intercept FROM {PAIRS} GROUP BY 1""", ctes=CTE, floats="corr rmse mae resid_std slope intercept")
query("knot_targets", lambda s, d: op.knot_targets(seq_log(s, d)),
      """SELECT k.well_id, k.knot, CASE WHEN hi.f IS NULL THEN lo.dl ELSE lo.dl + (hi.dl - lo.dl) * (k.q - lo.f) / (hi.f - lo.f) END AS delta
      FROM (SELECT well_id, unnest(range(0, 21)) AS knot, unnest(range(0, 21)) / 20 AS q FROM ps) k
      ASOF LEFT JOIN path lo ON k.well_id = lo.well_id AND k.q >= lo.f ASOF LEFT JOIN path hi ON k.well_id = hi.well_id AND k.q < hi.f""",
      ctes=LAST_CTE + """, path AS (SELECT well_id, tvt - last_tvt AS dl, (row_idx - min(row_idx) OVER w) / greatest(max(row_idx) OVER w - min(row_idx) OVER w, 1) AS f
        FROM priors WHERE tvt_input IS NULL WINDOW w AS (PARTITION BY well_id))""", floats="delta")

query("contract_guard", lambda s, d: ct.contract_guard(line_ids(s, d).withColumnRenamed("pred", "tvt"), sample_ids(s, d), least_range=50.0),
      """SELECT *, 'missing' AS reason, false AS passed FROM (SELECT (SELECT count(*) FROM line_ids) AS rows, (SELECT count(*) FROM sample_ids) AS contract_rows,
      (SELECT count(*) FROM sample_ids ANTI JOIN line_ids USING (id)) AS missing, (SELECT count(*) FROM line_ids ANTI JOIN sample_ids USING (id)) AS extra, 0 AS duplicates, 0 AS not_finite,
      0 AS moved, (SELECT max(pred) - min(pred) FROM line_ids) AS value_range, (SELECT quantile_cont(pred, 0.5) FROM line_ids) AS value_median)""",
      ctes=IDS_CTE, floats="value_range value_median", digits=2)
query("diversity_gate", lambda s, d: ct.diversity_gate(pred_vectors(s, d).withColumn("b2", F.col("b") + 0.1), "a", ["b", "b2", "c"]),
      """SELECT model, least(x, y, z) AS nearest_rms, least(x, y, z) >= 0.25 AS passed FROM (
      SELECT 'b' AS model, sqrt(avg(pow(a - b, 2))) AS x, 0.1::DOUBLE AS y, sqrt(avg(pow(b - c, 2))) AS z FROM pred_vectors UNION ALL
      SELECT 'b2', sqrt(avg(pow(a - b - 0.1, 2))), 0.1, sqrt(avg(pow(b + 0.1 - c, 2))) FROM pred_vectors UNION ALL
      SELECT 'c', sqrt(avg(pow(a - c, 2))), sqrt(avg(pow(b - c, 2))), sqrt(avg(pow(b + 0.1 - c, 2))) FROM pred_vectors)""", ctes=PRED_CTE, floats="nearest_rms", digits=3)
query("change_report", lambda s, d: ct.change_report(pred_vectors(s, d), "a", "b"),
      """SELECT count(*) AS rows, count(*) FILTER (abs(b - a) > 1e-9) AS changed, sqrt(avg(pow(b - a, 2))) AS rms_delta, max(abs(b - a)) AS max_abs, avg(b - a) AS mean_delta,
      avg(b) AS new_mean, stddev_pop(b) AS new_std, quantile_cont(abs(b - a), 0.95) AS p95_abs FROM pred_vectors""", ctes=PRED_CTE,
      floats="rms_delta max_abs mean_delta new_mean new_std p95_abs", digits=3)
query("weight_validation", lambda s, d: ct.weight_validation(pred_vectors(s, d).select("grp", (F.col("z") / 10 - 0.0001).alias("weight"))),
      """SELECT grp, 0 AS not_finite, count(*) FILTER (z / 10 - 0.0001 < 0) AS negative, sum(z / 10 - 0.0001) AS total,
      count(*) FILTER (z / 10 - 0.0001 < 0) = 0 AND sum(z / 10 - 0.0001) <= 1.05 AS valid FROM pred_vectors GROUP BY 1""", ctes=PRED_CTE, floats="total")
