"""Keyed-sequence features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import seq_log
from loomlog.catalog.registry import FILL_CTE, SEQ_CTE, query
from loomlog.operators import sequence as op

ID = ["well_id", "row_idx"]


def filled(s, d):
    return op.interpolate_linear(seq_log(s, d), {"gr": "grf"})


query("row_position", lambda s, d: op.row_position(seq_log(s, d)).select(*ID, "n_rows", "row_frac", "md", "md_from_start"),
      """SELECT well_id, row_idx, n AS n_rows, row_idx / greatest(n - 1, 1) AS row_frac, md,
      md - min(md) OVER (PARTITION BY well_id) AS md_from_start FROM seq_log""",
      ctes=SEQ_CTE, floats="row_frac md md_from_start")

query("from_start_deltas", lambda s, d: op.from_start_deltas(seq_log(s, d)).select(*ID, "x_from_start", "y_from_start", "z_from_start"),
      """SELECT well_id, row_idx, x - first_value(x) OVER w AS x_from_start, y - first_value(y) OVER w AS y_from_start,
      z - first_value(z) OVER w AS z_from_start FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)""",
      ctes=SEQ_CTE, floats="x_from_start y_from_start z_from_start")

query("xy_geometry", lambda s, d: op.xy_geometry(seq_log(s, d), "x", "z").select(*ID, "xy_dist_from_start", "azimuth_sin", "azimuth_cos"),
      """SELECT well_id, row_idx, sqrt(dx*dx + dz*dz) AS xy_dist_from_start, sin(atan2(dz, dx)) AS azimuth_sin, cos(atan2(dz, dx)) AS azimuth_cos
      FROM (SELECT *, x - first_value(x) OVER w AS dx, z - first_value(z) OVER w AS dz FROM seq_log
            WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))""",
      ctes=SEQ_CTE, floats="xy_dist_from_start azimuth_sin azimuth_cos")

query("interpolate_linear", lambda s, d: filled(s, d).select(*ID, "grf"),
      "SELECT well_id, row_idx, grf FROM filled", ctes=SEQ_CTE + FILL_CTE, floats="grf")

query("ffill_bfill", lambda s, d: op.ffill_bfill(seq_log(s, d), {"tvt_input": "tvt_ff", "gr": "gr_ff"}).select(*ID, "tvt_ff", "gr_ff"),
      """SELECT well_id, row_idx,
      coalesce(last_value(tvt_input IGNORE NULLS) OVER p, first_value(tvt_input IGNORE NULLS) OVER f) AS tvt_ff,
      coalesce(last_value(gr IGNORE NULLS) OVER p, first_value(gr IGNORE NULLS) OVER f) AS gr_ff
      FROM seq_log WINDOW p AS (PARTITION BY well_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING),
      f AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
      ctes=SEQ_CTE, floats="tvt_ff gr_ff")

_ROLL_C = ("mean", "std", "min", "max", "range", "energy")
_c_cols = [f"grf_{k}_{n}" for n in (5, 25, 101) for k in _ROLL_C]


def _sql_rolling(n, lo, hi, floor, std_floor, tag):
    w = f"(PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"

    def held(e, k):
        return f"CASE WHEN count(grf) OVER {w} >= {k} THEN {e} END"

    parts = {
        "mean": held(f"avg(grf) OVER {w}", floor),
        "std": f"coalesce({held(f'stddev_samp(grf) OVER {w}', std_floor)}, 0)",
        "min": held(f"min(grf) OVER {w}", floor),
        "max": held(f"max(grf) OVER {w}", floor),
        "range": held(f"max(grf) OVER {w} - min(grf) OVER {w}", floor),
        "energy": held(f"sqrt(avg(grf * grf) OVER {w})", floor),
    }
    return {f"grf_{tag}{k}_{n}": v for k, v in parts.items()}


def _select(parts):
    return ", ".join(f"{v} AS {k}" for k, v in parts.items())


query("rolling_centered", lambda s, d: op.rolling_centered(filled(s, d), "grf", stats=_ROLL_C).select(*ID, *_c_cols),
      "SELECT well_id, row_idx, " + ", ".join(_select(_sql_rolling(n, n // 2, n // 2, 1, 2, "")) for n in (5, 25, 101)) + " FROM filled",
      ctes=SEQ_CTE + FILL_CTE, floats=" ".join(_c_cols))

_T = ("mean", "std", "min", "max", "range")
_t_cols = [f"grf_t{k}_{n}" for n in (25, 100, 300) for k in _T]
_t_sql = {k: v for n in (25, 100, 300) for k, v in _sql_rolling(n, n - 1, 0, max(5, n // 5), max(5, n // 5), "t").items() if k in _t_cols}
_t_sql = {k: v.replace("AND 0 FOLLOWING", "AND CURRENT ROW") for k, v in _t_sql.items()}
query("rolling_trailing", lambda s, d: op.rolling_trailing(filled(s, d), "grf").select(*ID, *_t_cols),
      f"SELECT well_id, row_idx, {_select(_t_sql)} FROM filled", ctes=SEQ_CTE + FILL_CTE, floats=" ".join(_t_cols))

_lags = {f"grf_lag_{k}": f"coalesce(lag(grf, {k}) OVER w, first_value(grf) OVER w)" for k in (1, 5, 15, 30)}
_lags |= {f"grf_lead_{k}": f"coalesce(lead(grf, {k}) OVER w, first_value(grf) OVER r)" for k in (1, 5, 15, 30)}
_lags |= {f"grf_diff_{k}": f"grf - lag(grf, {k}) OVER w" for k in (1, 2, 5)}
_lags["grf_diff2"] = "grf - 2 * lag(grf, 1) OVER w + lag(grf, 2) OVER w"
query("lag_lead_diff", lambda s, d: op.lag_lead_diff(filled(s, d), "grf").select(*ID, *_lags),
      f"""SELECT well_id, row_idx, {_select(_lags)} FROM filled
      WINDOW w AS (PARTITION BY well_id ORDER BY row_idx), r AS (PARTITION BY well_id ORDER BY row_idx DESC)""",
      ctes=SEQ_CTE + FILL_CTE, floats=" ".join(_lags))

query("cumsum_since_anchor",
      lambda s, d: op.cumsum_since_anchor(filled(s, d), "grf", F.col("tvt_input").isNotNull()).select(*ID, "cumsum_anchor"),
      """SELECT well_id, row_idx, run - coalesce(max(CASE WHEN row_idx = last_at THEN run END) OVER (PARTITION BY well_id), 0) AS cumsum_anchor
      FROM (SELECT *, sum(grf) OVER (PARTITION BY well_id ORDER BY row_idx) AS run,
        max(CASE WHEN tvt_input IS NOT NULL THEN row_idx END) OVER (PARTITION BY well_id) AS last_at FROM filled)""",
      ctes=SEQ_CTE + FILL_CTE, floats="cumsum_anchor")


def _sql_gradient(c):
    return f"""CASE WHEN hs IS NULL AND hd IS NULL THEN 0 WHEN hs IS NULL THEN (lead({c}) OVER w - {c}) / hd
    WHEN hd IS NULL THEN ({c} - lag({c}) OVER w) / hs
    ELSE (hs*hs * lead({c}) OVER w + (hd*hd - hs*hs) * {c} - hd*hd * lag({c}) OVER w) / (hs * hd * (hd + hs)) END"""


query("gradient_md", lambda s, d: op.gradient_md(filled(s, d), {"grf": "gr_grad", "z": "z_grad"}).select(*ID, "gr_grad", "z_grad"),
      f"""SELECT well_id, row_idx, {_sql_gradient('grf')} AS gr_grad, {_sql_gradient('z')} AS z_grad
      FROM (SELECT *, md - lag(md) OVER v AS hs, lead(md) OVER v - md AS hd FROM filled WINDOW v AS (PARTITION BY well_id ORDER BY row_idx))
      WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)""",
      ctes=SEQ_CTE + FILL_CTE, floats="gr_grad z_grad", digits=3)

query("step_derivatives", lambda s, d: op.step_derivatives(seq_log(s, d)).select(*ID, "dx_dmd", "dy_dmd", "dz_dmd"),
      """SELECT well_id, row_idx, (x - lag(x) OVER w) / nullif(md - lag(md) OVER w, 0) AS dx_dmd,
      (y - lag(y) OVER w) / nullif(md - lag(md) OVER w, 0) AS dy_dmd, (z - lag(z) OVER w) / nullif(md - lag(md) OVER w, 0) AS dz_dmd
      FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)""",
      ctes=SEQ_CTE, floats="dx_dmd dy_dmd dz_dmd", digits=3)

query("detrend_linear", lambda s, d: op.detrend_linear(filled(s, d), "grf").select(*ID, "grf_detrended"),
      """SELECT well_id, row_idx, grf - CASE WHEN c >= 5 THEN coalesce(b, 0) ELSE 0 END * md AS grf_detrended FROM filled
      JOIN (SELECT well_id, regr_slope(grf, md) AS b, regr_count(grf, md) AS c FROM filled GROUP BY 1) USING (well_id)""",
      ctes=SEQ_CTE + FILL_CTE, floats="grf_detrended")

query("tortuosity", lambda s, d: op.tortuosity(seq_log(s, d)).select(*ID, "tort_25", "tort_75", "dogleg", "tort_25_slope"),
      """SELECT well_id, row_idx, tort_25, tort_75, avg(turn) OVER c AS dogleg, coalesce(avg(rise) OVER c, 0) AS tort_25_slope
      FROM (SELECT *, tort_25 - lag(tort_25) OVER w AS rise,
          coalesce(atan2(sqrt(pow(ay*dz - az*dy, 2) + pow(az*dx - ax*dz, 2) + pow(ax*dy - ay*dx, 2)), ax*dx + ay*dy + az*dz), 0) / (abs(gmd) + 1e-6) AS turn
        FROM (SELECT *, lag(dx) OVER w AS ax, lag(dy) OVER w AS ay, lag(dz) OVER w AS az,
            greatest((cum - cum25) / (sqrt(pow(x - x25, 2) + pow(y - y25, 2) + pow(z - z25, 2)) + 1e-6) - 1, 0) AS tort_25,
            greatest((cum - cum75) / (sqrt(pow(x - x75, 2) + pow(y - y75, 2) + pow(z - z75, 2)) + 1e-6) - 1, 0) AS tort_75
          FROM (SELECT *, first_value(cum) OVER b25 AS cum25, first_value(x) OVER b25 AS x25, first_value(y) OVER b25 AS y25, first_value(z) OVER b25 AS z25,
              first_value(cum) OVER b75 AS cum75, first_value(x) OVER b75 AS x75, first_value(y) OVER b75 AS y75, first_value(z) OVER b75 AS z75,
              last_value(x) OVER s - first_value(x) OVER s AS dx, last_value(y) OVER s - first_value(y) OVER s AS dy, last_value(z) OVER s - first_value(z) OVER s AS dz,
              (last_value(md) OVER g - first_value(md) OVER g) / (count(*) OVER g - 1) AS gmd
            FROM (SELECT *, sum(seg) OVER w AS cum FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS seg
                FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))
            WINDOW b25 AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 25 PRECEDING AND CURRENT ROW),
              b75 AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 75 PRECEDING AND CURRENT ROW),
              s AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),
              g AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
          WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))
      WINDOW c AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
      ctes=SEQ_CTE, floats="tort_25 tort_75 dogleg tort_25_slope", digits=4)

query("curvature", lambda s, d: op.curvature_summary(seq_log(s, d)),
      """SELECT well_id, quantile_cont(k, 0.5) AS curvature_median, quantile_cont(k, 0.95) AS curvature_p95 FROM (
        SELECT well_id, sqrt(pow(a - lag(a) OVER w, 2) + pow(b - lag(b) OVER w, 2) + pow(c - lag(c) OVER w, 2)) AS k FROM (
          SELECT well_id, row_idx, (x - lag(x) OVER w) / nullif(md - lag(md) OVER w, 0) AS a, (y - lag(y) OVER w) / nullif(md - lag(md) OVER w, 0) AS b,
          (z - lag(z) OVER w) / nullif(md - lag(md) OVER w, 0) AS c FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))
        WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)) GROUP BY 1""",
      ctes=SEQ_CTE, floats="curvature_median curvature_p95", digits=3)

_TAIL = "md_since frac frac2 frac3 sqrt_frac log_md frac_sin frac_cos dx_ps dy_ps dz_ps dxy_ps"
query("tail_position", lambda s, d: op.tail_position(seq_log(s, d)).select(*ID, "n_eval", *_TAIL.split()),
      """SELECT well_id, row_idx, n_eval, since AS md_since, f AS frac, f*f AS frac2, f*f*f AS frac3, sqrt(f) AS sqrt_frac, ln(1 + greatest(since, 0)) AS log_md,
      sin(pi()*f) AS frac_sin, cos(pi()*f) AS frac_cos, dx AS dx_ps, dy AS dy_ps, dz AS dz_ps, sqrt(dx*dx + dy*dy) AS dxy_ps FROM (
        SELECT h.well_id, h.row_idx, count(*) OVER (PARTITION BY h.well_id) AS n_eval, h.md - k.md AS since, h.x - k.x AS dx, h.y - k.y AS dy, h.z - k.z AS dz,
        (row_number() OVER (PARTITION BY h.well_id ORDER BY h.row_idx) - 1) / greatest(count(*) OVER (PARTITION BY h.well_id) - 1, 1) AS f
        FROM seq_log h JOIN (SELECT * FROM seq_log WHERE tvt_input IS NOT NULL QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) = 1) k USING (well_id)
        WHERE h.tvt_input IS NULL)""",
      ctes=SEQ_CTE, floats=_TAIL)

_GAP = "x_delta y_delta z_delta x_span y_span z_span md_span gr_mean gr_std gr_min gr_max gr_p05 gr_p25 gr_p50 gr_p75 gr_p95 z_per_md"
query("gap_summary", lambda s, d: op.gap_summary(seq_log(s, d)),
      """SELECT *, z_span / nullif(md_span, 0) AS z_per_md FROM (SELECT well_id, count(*) AS n_eval,
      arg_max(x, row_idx) - arg_min(x, row_idx) AS x_delta, arg_max(y, row_idx) - arg_min(y, row_idx) AS y_delta, arg_max(z, row_idx) - arg_min(z, row_idx) AS z_delta,
      max(x) - min(x) AS x_span, max(y) - min(y) AS y_span, max(z) - min(z) AS z_span, max(md) - min(md) AS md_span,
      avg(gr) AS gr_mean, stddev_pop(gr) AS gr_std, min(gr) AS gr_min, max(gr) AS gr_max, quantile_cont(gr, 0.05) AS gr_p05, quantile_cont(gr, 0.25) AS gr_p25,
      quantile_cont(gr, 0.5) AS gr_p50, quantile_cont(gr, 0.75) AS gr_p75, quantile_cont(gr, 0.95) AS gr_p95
      FROM seq_log WHERE tvt_input IS NULL GROUP BY 1)""",
      ctes=SEQ_CTE, floats=_GAP)

query("window_signature",
      lambda s, d: op.window_signature(filled(s, d), "grf").select(*ID, *[F.col("signature")[i].alias(c) for i, c in enumerate(["m", "sd", "rg", "st", "ce"])]),
      """SELECT well_id, row_idx, CASE WHEN count(grf) OVER w >= 10 THEN avg(grf) OVER w END AS m,
      coalesce(CASE WHEN count(grf) OVER w >= 10 THEN stddev_samp(grf) OVER w END, 0) AS sd,
      coalesce(CASE WHEN count(grf) OVER w >= 10 THEN max(grf) OVER w - min(grf) OVER w END, 0) AS rg,
      coalesce(CASE WHEN count(df) OVER w >= 10 THEN avg(df) OVER w END, 0) AS st, grf AS ce
      FROM (SELECT *, grf - lag(grf) OVER (PARTITION BY well_id ORDER BY row_idx) AS df FROM filled)
      WINDOW w AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
      ctes=SEQ_CTE + FILL_CTE, floats="m sd rg st ce")
