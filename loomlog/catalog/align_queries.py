"""Self-correlation, alignment, trackers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog import workflows as wf
from loomlog.bindings import MICROS, _ingested, copies, pred_vectors, ref_curve, seq_log, surface_points, table
from loomlog.catalog import blend_queries  # noqa: F401  registers the batch form of st_slope_clip
from loomlog.catalog.curve_queries import CTE, interp
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import CURVE_CTE, FILL_CTE, ORACLES, PRED_CTE, SEQ_CTE, query
from loomlog.operators import align as op
from loomlog.operators import prefix
from loomlog.operators.transfer import candidate_signatures
from loomlog.plans.stage import staged
from loomlog.streaming import causal as st

ID = ["well_id", "row_idx"]


def ncc(s, d):
    return _ingested(s, d, "ncc", lambda s_, d_: op.prefix_ncc(seq_log(s_, d_), (2, 8, 15)))


NCC = LAST_CTE + FILL_CTE + """,
qs AS (SELECT well_id, row_idx, n, avg(grf) OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS q FROM filled),
ks AS (SELECT well_id, k, tvt_input, avg(grf) OVER (PARTITION BY well_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS p, count(*) OVER (PARTITION BY well_id) AS nk
  FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS k FROM filled WHERE tvt_input IS NOT NULL)),
qw AS (SELECT a.well_id, a.row_idx, o, q.q FROM (SELECT well_id, row_idx, n, unnest(range(-2, 3)) AS o FROM qs) a JOIN qs q ON q.well_id = a.well_id AND q.row_idx = greatest(0, least(a.n - 1, a.row_idx + o))),
qn AS (SELECT *, (q - avg(q) OVER w) / (stddev_pop(q) OVER w + 1e-6) AS z FROM qw WINDOW w AS (PARTITION BY well_id, row_idx)),
kw AS (SELECT a.well_id, a.k AS start, o, b.p FROM (SELECT well_id, k, nk, unnest(range(0, 5)) AS o FROM ks WHERE k % 3 = 0 AND k <= nk - 5 AND nk >= 10) a JOIN ks b ON a.well_id = b.well_id AND b.k = a.k + o),
kn AS (SELECT *, (p - avg(p) OVER w) / (stddev_pop(p) OVER w + 1e-6) AS z FROM kw WINDOW w AS (PARTITION BY well_id, start)),
sc AS (SELECT qn.well_id, row_idx, start, sum(qn.z * kn.z) / 5 AS score FROM qn JOIN kn ON qn.well_id = kn.well_id AND qn.o + 2 = kn.o GROUP BY 1, 2, 3),
hit AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY well_id, row_idx ORDER BY score DESC, start) = 1)"""
query("prefix_ncc", lambda s, d: ncc(s, d).where("hw = 2").select(*ID, "tvt", "score"),
      "SELECT q.well_id, q.row_idx, coalesce(k.tvt_input, last_tvt) AS tvt, coalesce(score, 0) AS score FROM qs q JOIN ps USING (well_id) LEFT JOIN hit h USING (well_id, row_idx) LEFT JOIN ks k ON k.well_id = q.well_id AND k.k = h.start + 2",
      ctes=NCC, floats="tvt score", digits=4)
query("prefix_ncc_scales", lambda s, d: ncc(s, d).drop("last_tvt"))
query("ncc_ensemble", lambda s, d: op.ncc_ensemble(ncc(s, d), prefix.last_known(seq_log(s, d))))
query("nn_signature_match", lambda s, d: op.nn_signature_match(seq_log(s, d), 6))


def beams(s, d):
    return _ingested(s, d, "beams", lambda s_, d_: op.beam_align(seq_log(s_, d_), ref_curve(s_, d_)))


query("beam_align", beams)
query("beam_features", lambda s, d: op.beam_features(seq_log(s, d), ref_curve(s, d), beams(s, d)))
query("hybrid_reference",
      lambda s, d: beams(s, d).where("config = 'cons'").join(ncc(s, d).where("hw = 2").select(*ID, F.col("tvt").alias("sc"), "score"), ID).select(*ID, op.hybrid_reference(F.col("tvt"), F.col("sc"), F.col("score")).alias("ref")))
query("dtw_align", lambda s, d: op.dtw_align(seq_log(s, d), ref_curve(s, d), (5, 10), 2)[1])
query("dtw_stochastic", lambda s, d: op.dtw_stochastic(seq_log(s, d), ref_curve(s, d), 5, 4, 0.2, 2))


def tracks(s, d):
    return _ingested(s, d, "tracks", lambda s_, d_: _both(s_, d_))


def _both(s, d):
    t, ll = op.pf_track(seq_log(s, d), ref_curve(s, d), wf.tracker_start(seq_log(s, d), ref_curve(s, d)), 64, 3)
    return t.join(ll, ["well_id", "seed"])


query("pf_track", tracks)


def seed_table(s, d):
    """Three stand-in runs per row from the prediction vectors: the blend has SQL to compare."""
    run = F.array(*[F.struct(F.lit(i).alias("seed"), F.col(c).alias("tvt")) for i, c in enumerate("abc")])
    t = pred_vectors(s, d).select(F.col("grp").cast("string").alias("well_id"), F.col("id").alias("row_idx"), F.inline(run))
    ll = t.select("well_id", "seed").distinct().withColumn("loglik", -(F.col("seed") * 2.5 + F.length("well_id")) - 10.0)
    return t, ll


query("pf_ensemble", lambda s, d: op.pf_ensemble(*seed_table(s, d)),
      "SELECT CAST(grp AS VARCHAR) AS well_id, id AS row_idx, " + ", ".join(f"(a + b * exp(-2.5 / {x}) + c * exp(-5.0 / {x})) / (1 + exp(-2.5 / {x}) + exp(-5.0 / {x})) AS pf_{x}" for x in (3, 5, 8, 12)) +
      ", (a + b + c) / 3 AS pf_mean, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS pf_std, -length(CAST(grp AS VARCHAR)) - 10.0::DOUBLE AS best_ll, 5.0::DOUBLE AS ll_spread FROM pred_vectors",
      ctes=PRED_CTE, floats="pf_3 pf_5 pf_8 pf_12 pf_mean pf_std best_ll ll_spread", digits=3)


def candidates(s, d):
    rows = prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL AND gr IS NOT NULL")
    items = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("cand")) for n, c in (("last", F.col("last_tvt")), ("line", F.col("linear_prior")), ("mid", (F.col("last_tvt") + F.col("linear_prior")) / 2))])
    return rows.select(*ID, "gr", "z", (F.col("last_tvt") + 3).alias("surf"), F.inline(items))


_cw = interp("(SELECT *, unnest([last_tvt, linear_prior, (last_tvt + linear_prior) / 2]) AS q FROM priors WHERE tvt_input IS NULL AND gr IS NOT NULL)", False)
query("candidate_weighting", lambda s, d: op.candidate_weighting(candidates(s, d), ref_curve(s, d), "surf"),
      f"""SELECT well_id, row_idx, sum(w * q) / sum(w) AS tvt, sqrt(greatest(0, sum(w * q * q) / sum(w) - pow(sum(w * q) / sum(w), 2))) AS std, sum(w) AS weight_sum, count(*) AS candidates, min(gap) AS best_resid FROM (
      SELECT well_id, row_idx, q, abs(gr - v) AS gap, exp(-greatest(0, least(6, coalesce(abs(gr - v), 60) / 20))) * (0.2 + 0.8 * exp(-greatest(0, least(6, abs(q + z - last_tvt - 3) / 35)))) AS w FROM {_cw}) GROUP BY 1, 2""",
      ctes=CTE, floats="tvt std weight_sum best_resid", digits=3)
query("signal_consensus",
      lambda s, d: op.signal_consensus(pred_vectors(s, d), ["a", "b", "c"], "truth", [("a", "b"), ("b", "c")]).select("id", "delta_mean", "delta_std", "a_vs_b", "b_vs_c"),
      """SELECT id, (a + b + c) / 3 - truth AS delta_mean, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3) AS delta_std, a - b AS a_vs_b, b - c AS b_vs_c FROM pred_vectors""",
      ctes=PRED_CTE, floats="delta_mean delta_std a_vs_b b_vs_c", digits=3)

# ---- streams ----


def tail_start(s, d):
    return prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL").select(*ID, "md", "tvt", "last_tvt", "ps_md")


query("st_slope_clip", lambda s, d: st.drain(st.st_slope_clip(st.as_stream(tail_start(s, d)), "tvt", "last_tvt", "ps_md", 0.05)))
ORACLES["st_slope_clip"] = ORACLES["causal_slope_clip"].replace("y AS limited", "y AS limited, 0 AS late")  # the stream must give what the batch gives
query("st_trailing", lambda s, d: st.drain(st.st_trailing(st.as_stream(seq_log(s, d).select(*ID, "md", "gr", "tvt_input")), "gr", 25)),
      """SELECT well_id, row_idx, CASE WHEN count(gr) OVER w >= 5 THEN avg(gr) OVER w END AS t_mean, CASE WHEN count(gr) OVER w >= 5 THEN stddev_samp(gr) OVER w ELSE 0 END AS t_std,
      CASE WHEN count(gr) OVER w >= 5 THEN min(gr) OVER w END AS t_min, CASE WHEN count(gr) OVER w >= 5 THEN max(gr) OVER w END AS t_max,
      last_value(tvt_input IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS last_tvt, 0 AS late
      FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)""", ctes=SEQ_CTE, floats="t_mean t_std t_min t_max last_tvt")


def gap_events(s, d):
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("well_id"), F.timestamp_micros(F.expr(MICROS)).alias("ts"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("gr"))


query("st_gap_monitor", lambda s, d: st.drain(st.st_gap_monitor(st.as_stream(gap_events(s, d)), "gr")),
      """SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS well_id, (epoch_us(ts) // 86400000000) * 86400000000 AS start_us, count(*) AS rows, count(*) FILTER (event_id % 11 = 0) AS missing,
      count(*) FILTER (event_id % 11 = 0) / count(*) AS missing_rate FROM events GROUP BY 1, 2) WHERE start_us + 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""", floats="missing_rate")
query("st_gap_runs", lambda s, d: st.drain(st.st_gap_runs(st.as_stream(seq_log(s, d).select(*ID, "md", "gr")), "gr")),
      """SELECT well_id, row_idx, row_idx - coalesce(max(CASE WHEN gr IS NOT NULL THEN row_idx END) OVER (PARTITION BY well_id ORDER BY row_idx), -1) AS run_length, 0 AS late FROM seq_log""", ctes=SEQ_CTE)

# ---- compositions ----


def tracked(s, d):
    return _ingested(s, d, "tracked", lambda s_, d_: wf.trackers(seq_log(s_, d_), ref_curve(s_, d_), 48, 2))


def spatial_log(s, d):
    """Logs placed in the points' space: position from a point chosen by the key."""
    pts = surface_points(s, d).select(F.col("id"), "grp", F.col("x").alias("px"), F.col("y").alias("py"), "s1")
    log = seq_log(s, d).withColumn("id", F.pmod(F.col("well_id").cast("bigint"), F.lit(pts.count())))  # ids count from 0
    return staged(log.join(pts, "id").drop("x", "y", "id").withColumnsRenamed({"px": "x", "py": "y"}))


query("build_features", lambda s, d: wf.build_features(seq_log(s, d), ref_curve(s, d)))
query("build_features_full", lambda s, d: wf.build_features(seq_log(s, d), ref_curve(s, d), ncc=True, beam=True))
query("tail_features", lambda s, d: wf.tail_features(seq_log(s, d), ref_curve(s, d), {"causal", "offsets", "selfcorr"}))
query("build_well_features", lambda s, d: wf.build_well_features(seq_log(s, d).withColumn("flat", F.col("md") / 10), ref_curve(s, d), tracked(s, d), ["y", "flat"], scales=ncc(s, d), paths=beams(s, d), dense="flat"))
query("eval_surface_priors", lambda s, d: wf.eval_surface_priors(spatial_log(s, d), surface_points(s, d), ["s1", "s2"], [3, 5]))
query("eval_dense_surface_priors", lambda s, d: wf.eval_surface_priors(spatial_log(s, d), surface_points(s, d), ["s1", "s2"], [10, 20], dense=True))
query("cv_tail", lambda s, d: wf.cv_tail(seq_log(s, d), ref_curve(s, d)))
query("selector_replay", lambda s, d: wf.selector_replay(seq_log(s, d), tracked(s, d), 27, (14.0, 17.0)))
query("final_blend_replay", lambda s, d: wf.final_blend_replay(seq_log(s, d), ref_curve(s, d), tracked(s, d)))
query("tracker_residual_model", lambda s, d: wf.tracker_residual_model(seq_log(s, d), ref_curve(s, d), tracked(s, d)))
query("two_engine_blend", lambda s, d: wf.two_engine_blend(seq_log(s, d), ref_curve(s, d), tracked(s, d), copies(s, d), staged(candidate_signatures(seq_log(s, d), copies(s, d), 0.4)), least=20))
query("data_audit", lambda s, d: wf.data_audit(seq_log(s, d), seq_log(s, d).where("y % 3 = 0"), ref_curve(s, d), ["md", "z", "gr"])[1],
      "SELECT well_id, count(*) AS rows_a, count(*) AS rows_b, true AS same_length, true AS md_equal, true AS z_equal, true AS gr_equal, min(row_idx) AS first_row, max(row_idx) AS last_row FROM seq_log WHERE y % 3 = 0 GROUP BY 1", ctes=SEQ_CTE)
query("inspect", lambda s, d: wf.inspect(seq_log(s, d), ref_curve(s, d)),
      """SELECT well_id, rows, eval_rows, curve_rows FROM (SELECT well_id, count(*) AS rows, count(*) FILTER (tvt_input IS NULL) AS eval_rows FROM seq_log GROUP BY 1 ORDER BY 1 LIMIT 20)
      JOIN (SELECT well_id, count(*) AS curve_rows FROM ref_curve GROUP BY 1) USING (well_id)""", ctes=CURVE_CTE)
