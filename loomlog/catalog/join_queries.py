"""Joins, set operations, metrics, order and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import line_ids, pred_vectors, sample_ids, seq_log, table
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import IDS_CTE, PRED_CTE, SEQ_CTE, query
from loomlog.operators import joins as op
from loomlog.operators import metrics as m
from loomlog.operators import prefix

query("join_left_contract", lambda s, d: op.join_left_contract(sample_ids(s, d), line_ids(s, d)),
      "SELECT id, pos, pred FROM sample_ids LEFT JOIN line_ids USING (id)", ctes=IDS_CTE, floats="pred", digits=2)

query("join_inner_components",
      lambda s, d: op.join_inner_components({k: pred_vectors(s, d).select("id", k) for k in "abc"})[1],
      "SELECT count(*) AS rows_a, count(*) AS rows_b, count(*) AS rows_c, count(*) AS rows_joined, true AS complete FROM lineitem")

query("semi_anti_ids", lambda s, d: op.semi_anti_ids(sample_ids(s, d), line_ids(s, d)),
      """SELECT kind, count(id) AS ids, coalesce(array_to_string(list(id ORDER BY id) FILTER (id IS NOT NULL)[1:10], ','), '') AS examples FROM (
      SELECT 'missing' AS kind, id FROM sample_ids ANTI JOIN line_ids USING (id) UNION ALL SELECT 'extra', id FROM line_ids ANTI JOIN sample_ids USING (id)
      UNION ALL SELECT 'extra', NULL UNION ALL SELECT 'shared', id FROM sample_ids SEMI JOIN line_ids USING (id)) GROUP BY 1""", ctes=IDS_CTE)


def halves(s, d):
    log = seq_log(s, d)
    u = F.col("well_id").cast("bigint")
    return log.where(u % 3 != 0), log.where(u % 2 == 0)


query("overlap_keys", lambda s, d: op.overlap_keys(*halves(s, d)),
      "SELECT DISTINCT CAST(user_id AS VARCHAR) AS well_id FROM events WHERE user_id % 3 <> 0 AND user_id % 2 = 0")
query("intersect_keys", lambda s, d: op.intersect_keys(*halves(s, d), "well_id"),
      "SELECT CAST(user_id AS VARCHAR) AS well_id FROM events WHERE user_id % 3 <> 0 INTERSECT SELECT CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 = 0")
query("except_ids", lambda s, d: op.except_ids(*halves(s, d), "well_id"),
      "SELECT CAST(user_id AS VARCHAR) AS well_id FROM events WHERE user_id % 3 <> 0 EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 = 0")
query("id_set_equal", lambda s, d: op.id_set_equal(sample_ids(s, d), line_ids(s, d)),
      """SELECT l AS only_left, r AS only_right, l = 0 AND r = 0 AS equal FROM (SELECT (SELECT count(*) FROM sample_ids ANTI JOIN line_ids USING (id)) AS l,
      (SELECT count(*) FROM line_ids ANTI JOIN sample_ids USING (id)) AS r)""", ctes=IDS_CTE)
query("union_frames", lambda s, d: op.union_frames([halves(s, d)[0].select("well_id", "row_idx", "tvt"), halves(s, d)[1].select("well_id", "row_idx", "gr")]),
      """SELECT well_id, row_idx, tvt, NULL::DOUBLE AS gr FROM seq_log WHERE y % 3 <> 0 UNION ALL SELECT well_id, row_idx, NULL, gr FROM seq_log WHERE y % 2 = 0""",
      ctes=SEQ_CTE, floats="tvt gr")

query("self_pairwise", lambda s, d: op.self_pairwise(pred_vectors(s, d), ["a", "b", "c"]),
      """SELECT m1, m2, msd, sqrt(msd) AS rms, sqrt(msd) < 0.01 AS duplicate FROM (SELECT 'a' AS m1, 'b' AS m2, avg(pow(a - b, 2)) AS msd FROM pred_vectors
      UNION ALL SELECT 'a', 'c', avg(pow(a - c, 2)) FROM pred_vectors UNION ALL SELECT 'b', 'c', avg(pow(b - c, 2)) FROM pred_vectors)""",
      ctes=PRED_CTE, floats="msd rms", digits=2)

query("join_by_position",
      lambda s, d: op.join_by_position(seq_log(s, d).select(F.concat_ws("_", "well_id", "row_idx").alias("id"), F.col("tvt").alias("pred")),
                                       seq_log(s, d).select("well_id", "row_idx", F.col("z").alias("truth")), "well_id", "row_idx"),
      "SELECT concat(well_id, '_', row_idx) AS id, tvt AS pred, well_id, row_idx, z AS truth FROM seq_log", ctes=SEQ_CTE, floats="pred truth")

query("broadcast_scalar_join",
      lambda s, d: op.with_scalars(pred_vectors(s, d), pred_vectors(s, d).agg(F.avg("truth").alias("mu"), F.stddev_pop("truth").alias("sd")))
      .select("id", ((F.col("truth") - F.col("mu")) / F.col("sd")).alias("zscore")),
      "SELECT id, (truth - mu) / sd AS zscore FROM pred_vectors CROSS JOIN scalars", ctes=PRED_CTE + ", scalars AS MATERIALIZED (SELECT avg(truth) AS mu, stddev_pop(truth) AS sd FROM pred_vectors)", floats="zscore")

_GRID = [(w / 10, s) for w in range(11) for s in (0.9, 1.0, 1.1)]
query("cross_grid_join",
      lambda s, d: op.grid_scores(pred_vectors(s, d), _GRID, ["w", "scale"], F.col("truth") - F.col("scale") * (F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b"))).drop("sse"),
      """SELECT w, scale, count(*) AS rows, sqrt(avg(pow(truth - scale * (w * a + (1 - w) * b), 2))) AS rmse
      FROM pred_vectors, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) / 10 AS w), (SELECT unnest([0.9, 1.0, 1.1])::DOUBLE AS scale) GROUP BY 1, 2""",
      ctes=PRED_CTE, floats="w scale rmse", digits=3)

LONG = "(SELECT id, grp, truth, unnest(['a', 'b', 'c']) AS model, unnest([a, b, c]) AS pred FROM pred_vectors)"


def long(s, d):
    pairs = F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("pred")) for k in "abc"])
    return pred_vectors(s, d).select("id", "grp", "truth", F.inline(pairs))


query("rmse", lambda s, d: long(s, d).groupBy("model").agg(m.rmse().alias("rmse")), f"SELECT model, sqrt(avg(pow(truth - pred, 2))) AS rmse FROM {LONG} GROUP BY 1", ctes=PRED_CTE, floats="rmse", digits=3)
query("mae", lambda s, d: long(s, d).groupBy("model").agg(m.mae().alias("mae")), f"SELECT model, avg(abs(truth - pred)) AS mae FROM {LONG} GROUP BY 1", ctes=PRED_CTE, floats="mae", digits=3)

KEYS = f"(SELECT model, grp, sum(pow(truth - pred, 2)) AS sse, count(*) AS k, sqrt(avg(pow(truth - pred, 2))) AS r FROM {LONG} GROUP BY 1, 2)"
query("score_report",
      lambda s, d: m.score_report(long(s, d), key="grp").withColumn("worst", F.array_join(F.transform("worst", lambda x: x["grp"].cast("string")), ",")),
      f"""SELECT model, sqrt(sum(sse) / sum(k)) AS rmse, sum(k)::BIGINT AS rows, count(*) AS keys, avg(r) AS key_rmse_mean, quantile_cont(r, 0.5) AS key_rmse_median,
      array_to_string(list(grp ORDER BY r DESC, grp)[1:10], ',') AS worst FROM {KEYS} GROUP BY 1""", ctes=PRED_CTE, floats="rmse key_rmse_mean key_rmse_median", digits=3)


def key_rmse(s, d):
    return m.key_scores(long(s, d), ["model"], "grp").withColumn("rmse", F.sqrt(F.col("sse") / F.col("rows")))


query("worst_decile", lambda s, d: m.worst_decile(key_rmse(s, d)),
      f"""SELECT model, avg(r) AS worst_decile, max(r) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY r DESC, grp) AS i, count(*) OVER (PARTITION BY model) AS n
      FROM {KEYS}) WHERE i <= greatest(1, n // 10) GROUP BY 1""", ctes=PRED_CTE, floats="worst_decile worst", digits=3)
query("order_limit", lambda s, d: key_rmse(s, d).where("model = 'b'").orderBy(F.desc("rmse"), "grp").limit(10).select("grp", "rmse", "rows"),
      f"SELECT grp, r AS rmse, k AS rows FROM {KEYS} WHERE model = 'b' ORDER BY r DESC, grp LIMIT 10", ctes=PRED_CTE, floats="rmse", digits=3)
query("topk_per_group",
      lambda s, d: prefix.last_rows(pred_vectors(s, d).select("grp", "id", F.abs(F.col("truth") - F.col("b")).alias("err"), F.struct(F.abs(F.col("truth") - F.col("b")), "id").alias("o")), 3,
                                    prefix.Seq(key="grp", pos="o"), "rank").drop("o"),
      "SELECT grp, id, err, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY err DESC, id DESC) AS i FROM (SELECT grp, id, abs(truth - b) AS err FROM pred_vectors)) WHERE i <= 3",
      ctes=PRED_CTE, floats="err", digits=3)
query("best_per_group", lambda s, d: key_rmse(s, d).groupBy("grp").agg(F.min_by("model", F.struct("rmse", "model")).alias("best"), F.min("rmse").alias("rmse")),
      f"SELECT grp, arg_min(model, struct_pack(r := r, m := model)) AS best, min(r) AS rmse FROM {KEYS} GROUP BY 1", ctes=PRED_CTE, floats="rmse", digits=3)
query("arg_first", lambda s, d: seq_log(s, d).groupBy("well_id").agg(F.min_by("row_idx", F.when(F.col("gr").isNotNull(), F.struct("gr", "row_idx"))).alias("argmin"),
                                                                    F.max_by("row_idx", F.when(F.col("gr").isNotNull(), F.struct(F.col("gr"), -F.col("row_idx")))).alias("argmax")),
      """SELECT well_id, arg_min(row_idx, struct_pack(g := gr, i := row_idx)) FILTER (gr IS NOT NULL) AS argmin, arg_max(row_idx, struct_pack(g := gr, i := -row_idx)) FILTER (gr IS NOT NULL) AS argmax
      FROM seq_log GROUP BY 1""", ctes=SEQ_CTE)
query("stable_order", lambda s, d: op.join_left_contract(sample_ids(s, d), line_ids(s, d)).orderBy("pos").select("pos", "id", "pred"),
      "SELECT pos, id, pred FROM sample_ids LEFT JOIN line_ids USING (id) ORDER BY pos", ctes=IDS_CTE, floats="pred", digits=2)

query("row_vs_key_weighting", lambda s, d: m.row_vs_key_weighting(pred_vectors(s, d), "grp", "truth", "b"),
      """SELECT grp, k AS rows, r AS rmse, k / sum(k) OVER () AS row_share, sse / sum(sse) OVER () AS sse_share, sqrt(sum(sse) OVER () / sum(k) OVER ()) AS pooled, avg(r) OVER () AS key_mean,
      quantile_cont(r, 0.5) OVER () AS key_median FROM (SELECT grp, count(*) AS k, sum(pow(truth - b, 2)) AS sse, sqrt(avg(pow(truth - b, 2))) AS r FROM pred_vectors GROUP BY 1)""",
      ctes=PRED_CTE, floats="rmse row_share sse_share pooled key_mean key_median", digits=4)
query("binned_error",
      lambda s, d: m.binned_error(prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL"), "md_from_ps", [0.0, 10.0, 50.0, 100.0, 200.0, float("inf")], "last_tvt", "tvt", "linear_prior"),
      """SELECT CASE WHEN away <= 10 THEN 0 WHEN away <= 50 THEN 1 WHEN away <= 100 THEN 2 WHEN away <= 200 THEN 3 ELSE 4 END AS bin, count(*) AS rows, sqrt(avg(pow(tvt - linear_prior, 2))) AS rmse,
      sqrt(avg(pow(tvt - last_tvt, 2))) AS base_rmse, sqrt(avg(pow(tvt - last_tvt, 2))) - sqrt(avg(pow(tvt - linear_prior, 2))) AS gain, stddev_pop(tvt) AS target_std
      FROM (SELECT *, md - ps_md AS away FROM priors WHERE tvt_input IS NULL) WHERE away >= 0 GROUP BY 1""", ctes=LAST_CTE, floats="rmse base_rmse gain target_std")
_KG = "(SELECT grp, sqrt(avg(pow(truth - c, 2))) - sqrt(avg(pow(truth - b, 2))) AS g FROM pred_vectors GROUP BY 1)"
query("key_gain", lambda s, d: m.key_gain(pred_vectors(s, d), "c", "grp", "truth", "b")[1],
      f"""SELECT min(g) AS gain_min, max(g) AS gain_max, count(*) FILTER (g > 0) AS improved, count(*) FILTER (g < 0) AS hurt, quantile_cont(g, 0.05) AS p05, quantile_cont(g, 0.25) AS p25,
      quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.75) AS p75, quantile_cont(g, 0.95) AS p95 FROM {_KG}""", ctes=PRED_CTE, floats="gain_min gain_max p05 p25 p50 p75 p95", digits=3)
query("stage_report", lambda s, d: m.stage_report(pred_vectors(s, d), ["a", "b", "c"], "c").drop("sse"),
      f"SELECT model AS stage, sqrt(avg(pow(truth - pred, 2))) AS rmse, (SELECT sqrt(avg(pow(truth - c, 2))) FROM pred_vectors) - sqrt(avg(pow(truth - pred, 2))) AS gain FROM {LONG} GROUP BY 1",
      ctes=PRED_CTE, floats="rmse gain", digits=3)
query("rank_correlation", lambda s, d: m.rank_correlation(pred_vectors(s, d), "truth", "b"),
      """SELECT count(*) AS rows, corr(truth, b) AS pearson, corr(ra, rb) AS spearman FROM (SELECT truth, b, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2 AS ra,
      rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM pred_vectors)""", ctes=PRED_CTE, floats="pearson spearman")
query("safe_corr", lambda s, d: pred_vectors(s, d).groupBy("grp").agg(m.safe_corr("truth", "a").alias("r")),
      "SELECT grp, CASE WHEN count(*) >= 30 THEN corr(truth, a) END AS r FROM pred_vectors GROUP BY 1", ctes=PRED_CTE, floats="r")
_PCT = " ".join(f"p{p:02d}" for p in m.PERCENTS)
query("describe_pct", lambda s, d: m.describe_pct(pred_vectors(s, d), "truth"),
      "SELECT count(truth) AS n, avg(truth) AS mean, stddev_samp(truth) AS std, min(truth) AS min, max(truth) AS max, " + ", ".join(f"quantile_cont(truth, {p / 100}) AS p{p:02d}" for p in m.PERCENTS) + " FROM pred_vectors",
      ctes=PRED_CTE, floats="mean std min max " + _PCT, digits=3)
query("value_counts", lambda s, d: m.value_counts(table(s, d, "events"), "event_type", 3),
      "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
query("replicate_variance", lambda s, d: m.replicate_variance(pred_vectors(s, d), "truth", ["a", "b", "c"])[0],
      """SELECT (ra + rb + rc) / 3 AS rmse_mean, sqrt((pow(ra - (ra + rb + rc) / 3, 2) + pow(rb - (ra + rb + rc) / 3, 2) + pow(rc - (ra + rb + rc) / 3, 2)) / 3) AS rmse_std, bagged_rmse
      FROM (SELECT sqrt(avg(pow(truth - a, 2))) AS ra, sqrt(avg(pow(truth - b, 2))) AS rb, sqrt(avg(pow(truth - c, 2))) AS rc, sqrt(avg(pow(truth - (a + b + c) / 3, 2))) AS bagged_rmse FROM pred_vectors)""",
      ctes=PRED_CTE, floats="rmse_mean rmse_std bagged_rmse", digits=3)
