"""Prefix statistics and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import seq_log
from loomlog.catalog.registry import SEQ_CTE, query
from loomlog.operators import metrics
from loomlog.operators import prefix as op

ID = ["well_id", "row_idx"]

LAST_CTE = SEQ_CTE + """,
ps AS (SELECT well_id, row_idx AS ps_row, tvt_input AS last_tvt, md AS ps_md, z AS ps_z,
    count(*) OVER (PARTITION BY well_id) AS n_known FROM seq_log WHERE tvt_input IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) = 1),
recent AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back FROM seq_log WHERE tvt_input IS NOT NULL),
slopes AS (SELECT well_id, CASE WHEN count(*) >= 2 AND max(md) > min(md) THEN regr_slope(tvt_input, md) ELSE 0 END AS slope
  FROM recent WHERE back <= 50 GROUP BY 1),
priors AS (SELECT s.*, ps.* EXCLUDE (well_id), slope, last_tvt + slope * (md - ps_md) AS linear_prior
  FROM seq_log s JOIN ps USING (well_id) JOIN slopes USING (well_id))"""

query("prediction_mask", lambda s, d: op.prediction_mask(seq_log(s, d), True).select(*ID, "is_eval"),
      "SELECT well_id, row_idx, tvt_input IS NULL AND tvt IS NOT NULL AS is_eval FROM seq_log", ctes=SEQ_CTE)

query("last_known", lambda s, d: op.last_known(seq_log(s, d)), "SELECT * FROM ps", ctes=LAST_CTE, floats="last_tvt ps_md ps_z")

query("last_known_slope", lambda s, d: op.last_known_slope(seq_log(s, d)), "SELECT * FROM slopes", ctes=LAST_CTE, floats="slope")

query("linear_prior",
      lambda s, d: op.linear_prior(seq_log(s, d)).select(*ID, "is_known", "row_from_ps", "md_from_ps", "linear_prior"),
      """SELECT well_id, row_idx, tvt_input IS NOT NULL AS is_known, row_idx - ps_row AS row_from_ps, md - ps_md AS md_from_ps, linear_prior FROM priors""",
      ctes=LAST_CTE, floats="md_from_ps linear_prior")

query("z_anchor_prior", lambda s, d: op.z_anchor_prior(seq_log(s, d)).select(*ID, "z_anchor_prior"),
      """SELECT well_id, row_idx, a - z AS z_anchor_prior FROM seq_log JOIN (SELECT well_id, quantile_cont(tvt_input + z, 0.5) AS a
      FROM seq_log WHERE tvt_input IS NOT NULL GROUP BY 1) USING (well_id)""", ctes=SEQ_CTE, floats="z_anchor_prior")

LADDER_CTE = LAST_CTE + """,
fits AS (SELECT well_id, regr_slope(tvt_input, md) AS b1, regr_intercept(tvt_input, md) AS a1, regr_slope(tvt_input, z) AS b2, regr_intercept(tvt_input, z) AS a2,
    regr_slope(tvt_input, md) FILTER (back <= 200) AS b3, regr_intercept(tvt_input, md) FILTER (back <= 200) AS a3,
    regr_slope(tvt_input, z) FILTER (back <= 200) AS b4, regr_intercept(tvt_input, z) FILTER (back <= 200) AS a4 FROM recent GROUP BY 1),
long AS (SELECT well_id, tvt AS truth, unnest(['constant', 'linear_md_all', 'linear_z_all', 'linear_md_recent', 'linear_z_recent']) AS model,
    unnest([last_tvt, a1 + b1 * md, a2 + b2 * z, a3 + b3 * md, a4 + b4 * z]) AS pred FROM priors JOIN fits USING (well_id) WHERE tvt_input IS NULL)"""

query("baseline_ladder",
      lambda s, d: metrics.score_report(op.baseline_ladder(seq_log(s, d))).drop("worst"),
      """SELECT model, sqrt(sum(sse) / sum(k)) AS rmse, sum(k)::BIGINT AS rows, count(*) AS keys, avg(sqrt(sse / k)) AS key_rmse_mean, quantile_cont(sqrt(sse / k), 0.5) AS key_rmse_median
      FROM (SELECT model, well_id, sum(pow(truth - pred, 2)) AS sse, count(*) AS k FROM long GROUP BY 1, 2) GROUP BY 1""",
      ctes=LADDER_CTE, floats="rmse key_rmse_mean key_rmse_median")

_EVAL = LAST_CTE + """,
scores AS (SELECT m.model, well_id, sum(pow(tvt - CASE m.model WHEN 'last_known' THEN last_tvt ELSE linear_prior END, 2)) AS sse, count(*) AS k
  FROM priors, (VALUES ('last_known'), ('linear')) AS m(model) WHERE tvt_input IS NULL GROUP BY 1, 2)"""


def eval_priors(s, d):
    rows = op.prediction_mask(op.linear_prior(seq_log(s, d)), True).where("is_eval")
    pairs = F.array(F.struct(F.lit("last_known").alias("model"), F.col("last_tvt").alias("pred")),
                    F.struct(F.lit("linear").alias("model"), F.col("linear_prior").alias("pred")))
    long = rows.select("well_id", F.col("tvt").alias("truth"), F.inline(pairs))
    return metrics.score_report(long)


query("eval_priors",
      lambda s, d: eval_priors(s, d).withColumn("worst", F.array_join(F.transform("worst", lambda w: F.concat_ws(":", w["well_id"], w["rows"])), ",")),
      """SELECT model, sqrt(sum(sse) / sum(k)) AS rmse, sum(k)::BIGINT AS rows, count(*) AS keys, avg(sqrt(sse / k)) AS key_rmse_mean,
      quantile_cont(sqrt(sse / k), 0.5) AS key_rmse_median,
      array_to_string(list(concat(well_id, ':', k) ORDER BY sse / k DESC, well_id)[1:10], ',') AS worst FROM scores GROUP BY 1""",
      ctes=_EVAL, floats="rmse key_rmse_mean key_rmse_median")

_PP = """tvt_min tvt_max tvt_range tvt_mean tvt_std gr_min gr_max gr_mean gr_std gr_missing gr_last gr_last_md azimuth_sin azimuth_cos step_20 step_100"""
query("prefix_profile", lambda s, d: op.prefix_profile(seq_log(s, d)),
      """SELECT well_id, count(*) AS n_known, min(tvt_input) AS tvt_min, max(tvt_input) AS tvt_max, max(tvt_input) - min(tvt_input) AS tvt_range, avg(tvt_input) AS tvt_mean,
      stddev_pop(tvt_input) AS tvt_std, min(gr) AS gr_min, max(gr) AS gr_max, avg(gr) AS gr_mean, stddev_pop(gr) AS gr_std, 1 - count(gr) / count(*) AS gr_missing,
      arg_max(gr, row_idx) FILTER (gr IS NOT NULL) AS gr_last, max(row_idx) - max(row_idx) FILTER (gr IS NOT NULL) AS gr_last_rows,
      arg_max(md, row_idx) - arg_max(md, row_idx) FILTER (gr IS NOT NULL) AS gr_last_md,
      sin(atan2(arg_max(y, row_idx) - arg_min(y, row_idx), arg_max(x, row_idx) - arg_min(x, row_idx))) AS azimuth_sin,
      cos(atan2(arg_max(y, row_idx) - arg_min(y, row_idx), arg_max(x, row_idx) - arg_min(x, row_idx))) AS azimuth_cos,
      avg(step) FILTER (back <= 20) AS step_20, avg(step) FILTER (back <= 100) AS step_100
      FROM (SELECT *, tvt_input - lag(tvt_input) OVER (PARTITION BY well_id ORDER BY row_idx) AS step FROM recent) GROUP BY 1""",
      ctes=LAST_CTE, floats=_PP)

_STEPS = SEQ_CTE + """,
steps AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back FROM (
  SELECT well_id, row_idx, tvt_input, tvt_input - lag(tvt_input) OVER w AS dt, md - lag(md) OVER w AS dm, z - lag(z) OVER w AS dz
  FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) WHERE dt IS NOT NULL AND dm > 0)"""
query("rate_init", lambda s, d: op.rate_init(seq_log(s, d)).join(op.rate_init(seq_log(s, d), 20, False).withColumnRenamed("rate", "rate_plain"), "well_id"),
      """SELECT well_id, coalesce(CASE WHEN count(*) FILTER (back < 30 AND dm > 0) >= 3 THEN quantile_cont((dt + dz) / dm, 0.5) FILTER (back < 30 AND dm > 0) END, 0) AS rate,
      coalesce(CASE WHEN count(*) FILTER (back < 20 AND dm > 0) >= 3 THEN quantile_cont(dt / dm, 0.5) FILTER (back < 20 AND dm > 0) END, 0) AS rate_plain
      FROM (SELECT DISTINCT well_id FROM seq_log) LEFT JOIN known_steps USING (well_id) GROUP BY 1""",
      ctes=SEQ_CTE + """,
known_steps AS (SELECT well_id, tvt_input - lag(tvt_input) OVER w AS dt, md - lag(md) OVER w AS dm, z - lag(z) OVER w AS dz,
  row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back
  FROM seq_log WHERE tvt_input IS NOT NULL WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))""", floats="rate rate_plain")

query("z_coupling", lambda s, d: op.z_coupling(seq_log(s, d)),
      """SELECT well_id, b AS beta, a AS intercept, greatest(stddev_pop(dt / dm - a - b * dz / dm), 0.001) AS noise FROM steps JOIN (
      SELECT well_id, regr_slope(dt / dm, dz / dm) AS b, regr_intercept(dt / dm, dz / dm) AS a FROM steps GROUP BY 1) USING (well_id) GROUP BY 1, 2, 3""",
      ctes=_STEPS, floats="beta intercept noise", digits=4)

query("segment_bias", lambda s, d: op.segment_bias(seq_log(s, d), F.col("tvt_input") + F.col("z") - F.col("y")),
      """SELECT well_id, quantile_cont(b, 0.5) AS bias_all, quantile_cont(b, 0.5) FILTER (i < k // 3) AS bias_first,
      quantile_cont(b, 0.5) FILTER (i >= k // 3 AND i < 2 * (k // 3)) AS bias_middle, quantile_cont(b, 0.5) FILTER (i >= k - 50) AS bias_recent,
      sum(exp(0.02 * (i - k)) * b) / sum(exp(0.02 * (i - k))) AS bias_weighted
      FROM (SELECT well_id, tvt_input + z - y AS b, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY well_id) AS k
        FROM seq_log WHERE tvt_input IS NOT NULL) GROUP BY 1""",
      ctes=SEQ_CTE, floats="bias_all bias_first bias_middle bias_recent bias_weighted")

query("tail_n", lambda s, d: op.last_rows(op.known(seq_log(s, d)), 20, rank="from_end").select(*ID, "from_end", "tvt_input"),
      "SELECT well_id, row_idx, back AS from_end, tvt_input FROM recent WHERE back <= 20", ctes=LAST_CTE, floats="tvt_input")

query("head_n", lambda s, d: op.first_rows(seq_log(s, d), 5).select(*ID, "tvt"),
      "SELECT well_id, row_idx, tvt FROM seq_log WHERE row_idx < 5", ctes=SEQ_CTE, floats="tvt")
