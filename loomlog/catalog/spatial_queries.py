"""Spatial imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import SURFACES, _ingested, seq_log, surface_points
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import SEQ_CTE, SURFACE_CTE, query
from loomlog.operators import prefix
from loomlog.operators import spatial as op
from loomlog.operators.metrics import score_report

S6 = " ".join(SURFACES)
ID = ["well_id", "row_idx"]


def near(s, d):
    """Ten nearest points of other groups, found once and used by several queries."""
    return _ingested(s, d, "near", lambda s_, d_: op.knn(surface_points(s_, d_), surface_points(s_, d_), 10, carry=SURFACES))


NEAR = SURFACE_CTE + """,
sc AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM surface_points),
near AS (SELECT * FROM (SELECT q.id, q.grp, q.x / sx AS qx, q.y / sy AS qy, p.id AS p_id, p.x / sx AS px, p.y / sy AS py, p.s1, p.s2, p.s3, p.s4, p.s5, p.s6,
    sqrt(pow((q.x - p.x) / sx, 2) + pow((q.y - p.y) / sy, 2)) AS dist FROM surface_points q JOIN surface_points p ON q.grp <> p.grp, sc)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, p_id) <= 10)"""

query("surface_sparse_points", lambda s, d: op.surface_sparse_points(surface_points(s, d), ["x", "y", *SURFACES]),
      "SELECT grp, " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ["x", "y", *SURFACES]) + " FROM surface_points GROUP BY 1", ctes=SURFACE_CTE, floats="x y " + S6)
query("surface_dense_points", lambda s, d: op.surface_dense_points(surface_points(s, d), ["x", "y", *SURFACES], 20).select("grp", "id", "s1"),
      """SELECT grp, id, s1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM surface_points)
      WHERE r IN (SELECT CAST(floor(i * (n - 1) / (least(20, n) - 1)) AS BIGINT) FROM (SELECT unnest(range(0, 20)) AS i) WHERE i < n)""", ctes=SURFACE_CTE, floats="s1")
query("axis_scale", lambda s, d: op.axis_scale(surface_points(s, d)), "SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM surface_points", ctes=SURFACE_CTE, floats="sx sy", digits=8)
query("knn_exclude_self", lambda s, d: near(s, d).select("id", F.col("rank").cast("bigint").alias("rank"), "p_id", "dist"),
      "SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, p_id) AS rank, p_id, dist FROM near", ctes=NEAR, floats="dist")
query("idw_predict", lambda s, d: op.idw_predict(near(s, d), SURFACES, surface_points(s, d).agg(*[F.avg(c).alias(c) for c in SURFACES]), surface_points(s, d), spread=True).drop(*[f"{c}_std" for c in SURFACES[1:]]),
      "SELECT id, " + ", ".join(f"sum({c} / (dist + 1e-3)) / sum(1 / (dist + 1e-3)) AS {c}" for c in SURFACES) + """, min(dist) AS nearest,
      sqrt(greatest(0, sum(s1 * s1 / (dist + 1e-3)) / sum(1 / (dist + 1e-3)) - pow(sum(s1 / (dist + 1e-3)) / sum(1 / (dist + 1e-3)), 2))) AS s1_std FROM near GROUP BY 1""", ctes=NEAR, floats=S6 + " nearest s1_std")
_S = {"w": "w", "x": "w*dx", "y": "w*dy", "xx": "w*dx*dx", "xy": "w*dx*dy", "yy": "w*dy*dy"}
query("plane_predict", lambda s, d: op.plane_predict(near(s, d), ["s1", "s2"]),
      "SELECT id, " + ", ".join(f"(v{i} * (xx*yy - xy*xy) - x * (xv{i}*yy - xy*yv{i}) + y * (xv{i}*xy - xx*yv{i})) / (w * (xx*yy - xy*xy) - x * (x*yy - xy*y) + y * (x*xy - xx*y)) AS s{i}" for i in (1, 2)) + """, nearest FROM (
      SELECT id, min(dist) AS nearest, sum(w) + 1e-9 AS w, sum(w*dx) AS x, sum(w*dy) AS y, sum(w*dx*dx) + 1e-9 AS xx, sum(w*dx*dy) AS xy, sum(w*dy*dy) + 1e-9 AS yy, """
      + ", ".join(f"sum(w*s{i}) AS v{i}, sum(w*dx*s{i}) AS xv{i}, sum(w*dy*s{i}) AS yv{i}" for i in (1, 2)) + """ FROM (SELECT *, px - qx AS dx, py - qy AS dy, 1 / (dist + 1e-3) AS w FROM near) GROUP BY 1)""",
      ctes=NEAR, floats="s1 s2 nearest", digits=4)


def centres(s, d):
    return op.surface_sparse_points(surface_points(s, d), ["x", "y", *SURFACES])


query("loo_centroid_idw", lambda s, d: op.loo_centroid_errors(centres(s, d), SURFACES)[1],
      """SELECT surface, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, quantile_cont(abs(e), 0.9) AS p90_abs, quantile_cont(nd, 0.5) AS nearest_median FROM (
      SELECT grp, unnest(['s1', 's2', 's3', 's4', 's5', 's6']) AS surface, unnest([""" + ", ".join(f"sum(p{c} / dist) / sum(1 / dist) - any_value(q{c})" for c in SURFACES) + """]) AS e, min(dist) AS nd FROM (
        SELECT q.grp, greatest(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)), 1e-6) AS dist, """ + ", ".join(f"p.{c} AS p{c}, q.{c} AS q{c}" for c in SURFACES) + """ FROM centres q JOIN centres p ON q.grp <> p.grp
        QUALIFY row_number() OVER (PARTITION BY q.grp ORDER BY dist, p.grp) <= 8) GROUP BY 1) GROUP BY 1""",
      ctes=SURFACE_CTE + ", centres AS (SELECT grp, " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ["x", "y", *SURFACES]) + " FROM surface_points GROUP BY 1)", floats="rmse mae p90_abs nearest_median")
query("neighbor_mean_signal", lambda s, d: op.neighbor_mean_signal(near(s, d), surface_points(s, d), "s1")[1],
      """SELECT corr(s1, m3) AS corr_3, corr(s1, m5) AS corr_5, corr(s1, m10) AS corr_10 FROM surface_points JOIN (SELECT id, avg(s1) FILTER (r <= 3) AS m3, avg(s1) FILTER (r <= 5) AS m5, avg(s1) AS m10
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, p_id) AS r FROM near) GROUP BY 1) USING (id)""", ctes=NEAR, floats="corr_3 corr_5 corr_10")


query("trend_plus_residual_knn", lambda s, d: op.trend_plus_residual(surface_points(s, d), "s1", k=20))
query("fold_safe_surface",
      lambda s, d: op.idw_predict(op.knn(surface_points(s, d).withColumn("fold", F.col("grp") % 5), surface_points(s, d).withColumn("fold", F.col("grp") % 5), 5, exclude="fold", carry=["s1", "s2"]), ["s1", "s2"]),
      """SELECT id, sum(s1 / (dist + 1e-3)) / sum(1 / (dist + 1e-3)) AS s1, sum(s2 / (dist + 1e-3)) / sum(1 / (dist + 1e-3)) AS s2, min(dist) AS nearest FROM (
      SELECT q.id, p.s1, p.s2, sqrt(pow((q.x - p.x) / sx, 2) + pow((q.y - p.y) / sy, 2)) AS dist FROM surface_points q JOIN surface_points p ON q.grp % 5 <> p.grp % 5, sc
      QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY dist, p.id) <= 5) GROUP BY 1""", ctes=NEAR, floats="s1 s2 nearest")


def priors(s, d):
    return op.surface_prior(seq_log(s, d).withColumn("flat", F.col("md") / 10), ["y", "flat"])


PRIORS = SEQ_CTE + """,
lv AS (SELECT *, unnest(['y', 'flat']) AS surface, unnest([y, md / 10]) AS level FROM seq_log),
pr AS (SELECT *, -z + level + coalesce(quantile_cont(tvt_input + z - level, 0.5) OVER (PARTITION BY well_id, surface), 0) AS pred FROM lv)"""
query("surface_prior", lambda s, d: priors(s, d).select(*ID, "surface", "pred"), "SELECT well_id, row_idx, surface, pred FROM pr", ctes=PRIORS, floats="pred")
query("surface_prior_fit", lambda s, d: op.prefix_fit(priors(s, d)),
      "SELECT well_id, surface, sqrt(avg(pow(tvt_input - pred, 2))) AS prefix_rmse, avg(abs(tvt_input - pred)) AS prefix_mae FROM pr WHERE tvt_input IS NOT NULL GROUP BY 1, 2", ctes=PRIORS, floats="prefix_rmse prefix_mae")
query("surface_prior_eval",
      lambda s, d: score_report(priors(s, d).where("tvt_input IS NULL").select("well_id", "surface", F.col("tvt").alias("truth"), "pred"), ["surface"]).drop("worst"),
      """SELECT surface, sqrt(sum(e) / sum(k)) AS rmse, sum(k)::BIGINT AS rows, count(*) AS keys, avg(sqrt(e / k)) AS key_rmse_mean, quantile_cont(sqrt(e / k), 0.5) AS key_rmse_median
      FROM (SELECT surface, well_id, sum(pow(tvt - pred, 2)) AS e, count(*) AS k FROM pr WHERE tvt_input IS NULL GROUP BY 1, 2) GROUP BY 1""", ctes=PRIORS, floats="rmse key_rmse_mean key_rmse_median")
query("distance_decay_blend",
      lambda s, d: op.distance_decay_blend(prefix.linear_prior(seq_log(s, d)), "linear_prior", "last_tvt", 10.0).select(*ID, "decayed"),
      """SELECT s.well_id, s.row_idx, coalesce(s.tvt_input, w * (last_tvt + slope * (md - ps_md)) + (1 - w) * last_tvt) AS decayed FROM (SELECT s.*, last_tvt, ps_md, exp(-0.5 * pow((row_idx - ps_row) / 10, 2)) AS w
        FROM seq_log s JOIN ps USING (well_id)) s JOIN slopes USING (well_id)""",
      ctes=LAST_CTE, floats="decayed")
query("surface_consensus", lambda s, d: op.surface_consensus(surface_points(s, d), SURFACES).select("id", "cons_mean", "cons_std", "cons_range", "cons_min", "cons_max"),
      """SELECT id, avg(v) AS cons_mean, stddev_pop(v) AS cons_std, max(v) - min(v) AS cons_range, min(v) AS cons_min, max(v) AS cons_max FROM (SELECT id, unnest([s1, s2, s3, s4, s5, s6]) AS v FROM surface_points) GROUP BY 1""",
      ctes=SURFACE_CTE, floats="cons_mean cons_std cons_range cons_min cons_max")
