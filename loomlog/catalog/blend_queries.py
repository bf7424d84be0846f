"""Post-processing and blend algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import pred_vectors, seq_log
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import PRED_CTE, SEQ_CTE, query
from loomlog.operators import blend as op
from loomlog.operators import post, prefix

pv = pred_vectors


def folded(s, d):
    return pv(s, d).withColumn("fold", (F.col("grp") % 5).cast("int"))


def sse(w):
    return f"sqrt(avg(pow(truth - ({w}) * a - (1 - ({w})) * b, 2)))"


LSW = "CASE WHEN sum(pow(a - b, 2)) <= 1e-12 THEN 0.5 ELSE greatest(0, least(1, sum((truth - b) * (a - b)) / sum(pow(a - b, 2)))) END"

query("blend_fixed", lambda s, d: op.blend_fixed(pv(s, d).withColumn("b", F.when(F.col("z") > 0.02, F.col("b"))), {"a": 0.63, "b": 0.61, "c": -0.24}, "a").select("id", "blend"),
      "SELECT id, 0.63 * a + 0.61 * coalesce(CASE WHEN z > 0.02 THEN b END, a) - 0.24 * c AS blend FROM pred_vectors", ctes=PRED_CTE, floats="blend", digits=3)
query("blend_weight_ls", lambda s, d: op.blend_weight_ls(pv(s, d), "truth", "a", "b", ["grp"]), f"SELECT grp, count(*) AS rows, {LSW} AS weight FROM pred_vectors GROUP BY 1", ctes=PRED_CTE, floats="weight")
query("blend_sweep", lambda s, d: op.blend_sweep(pv(s, d), "truth", "a", "b", [i / 20 for i in range(21)]),
      f"SELECT weight, {sse('weight')} AS rmse FROM pred_vectors, (SELECT unnest(range(0, 21)) / 20 AS weight) GROUP BY 1", ctes=PRED_CTE, floats="weight rmse", digits=3)
query("blend_cv_global", lambda s, d: op.blend_cv_global(folded(s, d), "truth", "a", "b", "fold"),
      f"""SELECT h AS fold, count(*) AS n, any_value(weight) AS weight, {sse('weight')} AS rmse FROM pred_vectors JOIN (SELECT h, {LSW} AS weight FROM pred_vectors, (SELECT unnest(range(0, 5)) AS h)
      WHERE grp % 5 <> h GROUP BY 1) ON grp % 5 = h GROUP BY 1""", ctes=PRED_CTE, floats="weight rmse", digits=3)


def _cv_sql(train, feature, bins, least):
    """Binned cross-validation: ``train`` supplies feature values for the cuts."""
    qs = ", ".join(f"quantile_cont({feature}, {i / bins!r})" for i in range(1, bins))
    return f"""SELECT h AS fold, count(*) AS n, {sse('w')} AS rmse FROM (
      SELECT t.*, CASE WHEN pb.k >= {least} THEN pb.w ELSE g.w END AS w FROM (SELECT *, len(list_filter(cuts, lambda q: q <= {feature})) AS bin FROM rows_h JOIN cuts USING (h)) t
      LEFT JOIN (SELECT h, bin, count(*) AS k, {LSW} AS w FROM (SELECT *, len(list_filter(cuts, lambda q: q <= {feature})) AS bin FROM rows_h JOIN cuts USING (h)) WHERE f <> h GROUP BY 1, 2) pb USING (h, bin)
      JOIN (SELECT h, {LSW} AS w FROM rows_h WHERE f <> h GROUP BY 1) g USING (h) WHERE f = h) GROUP BY 1""", f""",
rows_h AS (SELECT p.*, k.zm, p.grp % 5 AS f, h FROM pred_vectors p JOIN (SELECT grp, quantile_cont(a, 0.5) AS zm FROM pred_vectors GROUP BY 1) k USING (grp), (SELECT unnest(range(0, 5)) AS h)),
cuts AS (SELECT h, list_distinct([{qs}]) AS cuts FROM ({train}) WHERE f <> h GROUP BY 1)"""


_kb, _kb_cte = _cv_sql("SELECT DISTINCT h, f, grp, zm FROM rows_h", "zm", 3, 100)
query("blend_cv_key_bins", lambda s, d: op.blend_cv_key_bins(folded(s, d), "truth", "a", "b", "a", "grp", "fold"), _kb, ctes=PRED_CTE + _kb_cte, floats="rmse", digits=3)
_rb, _rb_cte = _cv_sql("SELECT h, f, z FROM rows_h", "z", 6, 500)
query("blend_cv_row_bins", lambda s, d: op.blend_cv_row_bins(folded(s, d), "truth", "a", "b", "z", "fold"), _rb, ctes=PRED_CTE + _rb_cte, floats="rmse", digits=3)

_SPEC = PRED_CTE + f""",
cuts AS (SELECT list_distinct([{', '.join(f'quantile_cont(z, {i / 12!r})' for i in range(1, 12))}]) AS cuts FROM pred_vectors),
g AS (SELECT {LSW} AS w0 FROM pred_vectors),
spec AS (SELECT bin, k AS rows, greatest(0, least(1, (k * w + 1000 * w0) / (k + 1000))) AS weight, w0 AS fallback FROM (
  SELECT bin, count(*) AS k, {LSW} AS w FROM (SELECT *, len(list_filter(cuts, lambda q: q <= z)) AS bin FROM pred_vectors, cuts) GROUP BY 1), g)"""
query("blend_bins_shrunk", lambda s, d: op.bins_spec(pv(s, d), "truth", "a", "b", "z").drop("cuts"), "SELECT bin, rows, weight, fallback FROM spec", ctes=_SPEC, floats="weight fallback")
query("blend_bins_apply",
      lambda s, d: op.apply_bins(pv(s, d).withColumn("z", F.when(F.col("grp") % 4 != 0, F.col("z"))), op.bins_spec(pv(s, d), "truth", "a", "b", "z"), "a", "b", "z").select("id", "blend"),
      """SELECT id, coalesce(CASE WHEN grp % 4 <> 0 THEN weight END, w0) * a + (1 - coalesce(CASE WHEN grp % 4 <> 0 THEN weight END, w0)) * b AS blend
      FROM (SELECT *, len(list_filter(cuts, lambda q: q <= z)) AS bin FROM pred_vectors, cuts) LEFT JOIN spec USING (bin), g""", ctes=_SPEC, floats="blend", digits=3)

query("gram", lambda s, d: op.gram(pv(s, d), "truth", ["a", "b", "c"]),
      """SELECT unnest(['a','a','a','b','b','c']) AS m1, unnest(['a','b','c','b','c','c']) AS m2, unnest([avg(pow(truth-a,2)), avg((truth-a)*(truth-b)), avg((truth-a)*(truth-c)),
      avg(pow(truth-b,2)), avg((truth-b)*(truth-c)), avg(pow(truth-c,2))]) AS c FROM pred_vectors""", ctes=PRED_CTE, floats="c", digits=1)
query("hill_climb", lambda s, d: op.hill_climb(pv(s, d), "truth", ["a", "b", "c"]))
query("stack_choice", lambda s, d: op.stack_choice(pv(s, d), "truth", ["a", "b", "c"]),
      """SELECT arg_min(m, r) AS choice, min(r) AS rmse FROM (SELECT unnest(['a', 'b', 'c', 'mean']) AS m, unnest([sqrt(avg(pow(truth - a, 2))), sqrt(avg(pow(truth - b, 2))), sqrt(avg(pow(truth - c, 2))),
      sqrt(avg(pow(truth - (a + b + c) / 3, 2)))]) AS r FROM pred_vectors)""", ctes=PRED_CTE, floats="rmse", digits=3)
_gs = ", ".join(f"('{p}', '{q}', (SELECT avg((truth - {p}) * (truth - {q})) FROM pred_vectors), (SELECT avg(pow(truth - {p}, 2)) FROM pred_vectors), (SELECT avg(pow(truth - {q}, 2)) FROM pred_vectors))" for p, q in ("ab", "ac", "bc"))
query("gram_from_scores", lambda s, d: op.gram_from_scores(pv(s, d), "truth", ["a", "b", "c"]),
      f"""SELECT m1, m2, c12, alpha, sqrt(alpha*alpha*e1 + 2*alpha*(1-alpha)*c12 + (1-alpha)*(1-alpha)*e2) AS rmse FROM (SELECT *, greatest(0, least(1, (e2 - c12) / (e1 + e2 - 2 * c12))) AS alpha
      FROM (VALUES {_gs}) AS t(m1, m2, c12, e1, e2))""", ctes=PRED_CTE, floats="c12 alpha rmse", digits=2)
query("simplex_blend", lambda s, d: op.simplex_blend(pv(s, d), "truth", ["a", "b", "c"]),
      """SELECT i / 20 AS w1, j / 20 AS w2, (20 - i - j) / 20 AS w3, sqrt(avg(pow(truth - (i * a + j * b + (20 - i - j) * c) / 20, 2))) AS rmse
      FROM pred_vectors, (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(0, 21)) AS j) WHERE i + j <= 20 GROUP BY i, j""", ctes=PRED_CTE, floats="w1 w2 w3 rmse", digits=3)


GATES = ["signed_gap", "abs_gap", "z"]


def gates(s, d):
    """Gate features; z is missing in every fourth group and infinite in every seventh."""
    df = folded(s, d).withColumn("z", F.when(F.col("grp") % 7 == 3, F.lit(float("inf"))).when(F.col("grp") % 4 != 0, F.col("z")))
    return op.gate_features(df, "a", "b").withColumns({"half": F.col("a") / 2, "least": F.least("a", "c")})


def _ridge3_sql(name, target, alpha):
    """Median fill, scaling and ridge over three features by Cramer's rule, one row of ``fits`` per held-out fold."""
    xs = ("signed_gap", "abs_gap", "zf")
    cov = {(i, j): f"(n * c{min(i, j)}{max(i, j)} / (s{i} * s{j}){f' + {alpha}' if i == j else ''})" for i in range(3) for j in range(3)}
    rhs = [f"(n * v{i} / s{i})" for i in range(3)]

    def det(m):
        return f"({m[0, 0]} * ({m[1, 1]} * {m[2, 2]} - {m[1, 2]} * {m[2, 1]}) - {m[0, 1]} * ({m[1, 0]} * {m[2, 2]} - {m[1, 2]} * {m[2, 0]}) + {m[0, 2]} * ({m[1, 0]} * {m[2, 1]} - {m[1, 1]} * {m[2, 0]}))"

    w = [f"{det({k: (rhs[k[0]] if k[1] == i else v) for k, v in cov.items()})} / {det(cov)} AS w{i}" for i in range(3)]
    sums = ", ".join([f"covar_pop({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({x}, {target}) AS v{i}, avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(xs)])
    fix = " + ".join(f"w{i} * ({x} - m{i}) / s{i}" for i, x in enumerate(xs))
    return f"""SELECT '{name}' AS model, unnest([h, -1]) AS fold, pow({target} - mt - ({fix}), 2) AS e FROM wide JOIN (SELECT h, mt, m0, m1, m2, s0, s1, s2, {', '.join(w)} FROM (
      SELECT h, CAST(count(*) AS DOUBLE) AS n, avg({target}) AS mt, {sums} FROM wide WHERE f <> h GROUP BY h)) USING (h) WHERE f = h"""


_GATES = PRED_CTE + f""",
base AS (SELECT avg(w) AS bw FROM (SELECT h, {LSW} AS w FROM pred_vectors, (SELECT unnest(range(0, 5)) AS h) WHERE grp % 5 <> h GROUP BY 1)),
gaps AS MATERIALIZED (SELECT grp % 5 AS f, truth, truth - bw * a - (1 - bw) * b AS miss, a - b AS signed_gap, abs(a - b) AS abs_gap, CASE WHEN grp % 7 <> 3 AND grp % 4 <> 0 THEN z END AS zn FROM pred_vectors, base),
held AS (SELECT *, h FROM gaps, (SELECT unnest(range(0, 5)) AS h)),
wide AS MATERIALIZED (SELECT held.*, coalesce(zn, zm) AS zf FROM held JOIN (SELECT h, quantile_cont(zn, 0.5) AS zm FROM held WHERE f <> h GROUP BY 1) USING (h))"""
query("blend_residual_model", lambda s, d: op.residual_model_report(gates(s, d), "truth", "a", "b", GATES),
      f"""SELECT model, fold, count(*) AS rows, sqrt(avg(e)) AS rmse FROM ({_ridge3_sql('ridge_residual', 'miss', 80.0)} UNION ALL {_ridge3_sql('ridge_direct', 'truth', 40.0)}) GROUP BY 1, 2""",
      ctes=_GATES, floats="rmse", digits=3)


def _by_rows(kind, features, **trees):
    return lambda s, d: op.residual_model(gates(s, d), "truth", "a", "b", features, kind=kind, **trees).groupBy("fold").agg(
        F.count("*").alias("rows"), F.sqrt(F.avg((F.col("truth") - F.col("pred")) ** 2)).alias("rmse"))


query("blend_residual_rows", _by_rows("ridge_residual", GATES),
      f"SELECT fold, count(*) AS rows, sqrt(avg(e)) AS rmse FROM ({_ridge3_sql('ridge_residual', 'miss', 80.0)}) WHERE fold >= 0 GROUP BY 1", ctes=_GATES, floats="rmse", digits=3)
query("blend_residual_trees", _by_rows("trees_residual", ["a", "b", "c", "half", "least", *GATES], trees=10, depth=3))


def _grid_sql(feature, counts, least, by_key):
    """CTEs and SELECT of the errors of weights by quantile bin of a feature, or of its median over a key, for every number of bins."""
    kind, x = ("key", f"k_{feature}") if by_key else ("row", feature)
    t = f"{kind}_{feature}"
    probs = sorted({i / n for n in counts for i in range(1, n)})
    picks = ", ".join(f"({n}, [{', '.join(str(probs.index(i / n) + 1) for i in range(1, n))}])" for n in counts)
    train = f"SELECT DISTINCT f, grp, {x} AS x FROM feats" if by_key else f"SELECT f, {x} AS x FROM feats"
    weight = "CASE WHEN sum(den) <= 1e-12 THEN 0.5 ELSE greatest(0, least(1, sum(num) / sum(den))) END"
    return f""",
{t}_q AS MATERIALIZED (SELECT h, quantile_cont(x, {probs}) AS qs FROM ({train}), (SELECT unnest(range(0, 5)) AS h) WHERE f <> h GROUP BY 1),
{t}_cuts AS MATERIALIZED (SELECT h, bins, list_distinct(list_select(qs, idx)) AS cuts FROM {t}_q, (VALUES {picks}) AS p(bins, idx)),
{t}_pieces AS MATERIALIZED (SELECT f, lim, sum(e * e) AS s11, sum(e * g) AS s12, sum(g * g) AS s22, sum(g * (g - e)) AS num, sum(pow(g - e, 2)) AS den, count(*) AS k
  FROM (SELECT f, truth - a AS e, truth - b AS g, {x} AS x FROM feats) ASOF LEFT JOIN (SELECT DISTINCT unnest(qs) AS lim FROM {t}_q) ON x >= lim GROUP BY 1, 2),
{t}_cells AS MATERIALIZED (SELECT p.*, h, bins, len(list_filter(cuts, lambda q: q <= lim)) AS bin FROM {t}_pieces p, {t}_cuts)""", f"""SELECT concat('{kind}_bins_{feature}_q', bins) AS formula,
      sqrt(sum(w * w * s11 + 2 * w * (1 - w) * s12 + (1 - w) * (1 - w) * s22) / sum(k)) AS rmse FROM (SELECT t.*, CASE WHEN pb.k >= {least} THEN pb.w ELSE g.w END AS w FROM {t}_cells t
      LEFT JOIN (SELECT h, bins, bin, sum(k) AS k, {weight} AS w FROM {t}_cells WHERE f <> h GROUP BY 1, 2, 3) pb USING (h, bins, bin)
      JOIN (SELECT h, bins, {weight} AS w FROM {t}_cells WHERE f <> h GROUP BY 1, 2) g USING (h, bins) WHERE f = h) GROUP BY bins"""


_SEARCH = PRED_CTE + f""",
base AS (SELECT avg(w) AS bw FROM (SELECT h, {LSW} AS w FROM pred_vectors, (SELECT unnest(range(0, 5)) AS h) WHERE grp % 5 <> h GROUP BY 1)),
gaps AS MATERIALIZED (SELECT *, grp % 5 AS f, truth - bw * a - (1 - bw) * b AS miss, a - b AS signed_gap, abs(a - b) AS abs_gap, z AS zf FROM pred_vectors, base),
medians AS (SELECT grp, quantile_cont(signed_gap, 0.5) AS k_signed_gap, quantile_cont(abs_gap, 0.5) AS k_abs_gap, quantile_cont(z, 0.5) AS k_z FROM gaps GROUP BY 1),
feats AS MATERIALIZED (SELECT gaps.*, k_signed_gap, k_abs_gap, k_z FROM gaps JOIN medians USING (grp)),
wide AS (SELECT gaps.*, h FROM gaps, (SELECT unnest(range(0, 5)) AS h))"""
_grids = [_grid_sql(f, n, least, by_key) for f in GATES for n, least, by_key in ((op.KEY_BINS, 100, True), (op.ROW_BINS, 500, False))]
_SEARCH += "".join(c for c, _ in _grids)
_found = [q for _, q in _grids]
_found += [f"SELECT model AS formula, sqrt(avg(e)) AS rmse FROM ({_ridge3_sql(m, t, al)}) WHERE fold = -1 GROUP BY 1" for m, t, al in (("ridge_residual", "miss", 80.0), ("ridge_direct", "truth", 40.0))]
_found.append(f"SELECT 'global_cv' AS formula, {sse('w')} AS rmse FROM wide JOIN (SELECT h, {LSW} AS w FROM wide WHERE f <> h GROUP BY 1) USING (h) WHERE f = h")
_found.append(f"SELECT printf('fixed_%.2f', w::DOUBLE) AS formula, {sse('w')} AS rmse FROM pred_vectors, (SELECT unnest(range(2, 9)) / 10 AS w) GROUP BY w")


def search(s, d):
    from loomlog.plans.stage import staged
    from loomlog.workflows import blend_search

    return blend_search(staged(folded(s, d)), "truth", "a", "b", "grp", GATES)


query("blend_search", search, " UNION ALL ".join(_found), ctes=_SEARCH, floats="rmse", digits=3)


def runs(s, d):
    return pv(s, d).select("id", F.inline(F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("pred")) for r in "abc"])))


query("bag_replicates", lambda s, d: op.bag_replicates(runs(s, d), 3), "SELECT id, (a + b + c) / 3 AS bag, true AS complete FROM pred_vectors", ctes=PRED_CTE, floats="bag", digits=3)
query("extrapolate_from",
      lambda s, d: op.extrapolate_from(pv(s, d).withColumns({"b": F.when(F.col("z") > 0.03, F.col("b")), "c": F.when(F.col("z") > 0.01, F.col("c"))}), "a", "b", 0.3, ["c"]).select("id", "moved"),
      """SELECT id, coalesce(a + 0.3 * (a - CASE WHEN z > 0.03 THEN b END), CASE WHEN z > 0.01 THEN c END, (SELECT quantile_cont(a, 0.5) FROM pred_vectors)) AS moved FROM pred_vectors""",
      ctes=PRED_CTE, floats="moved", digits=3)
query("shift_probe", lambda s, d: op.shift_probe(pv(s, d), "truth", "a", "grp", 50.0), "SELECT grp, count(*) AS n, avg(a - truth) AS mean_residual FROM pred_vectors GROUP BY 1", ctes=PRED_CTE, floats="mean_residual", digits=2)
query("hedge_parabola", lambda s, d: op.hedge_parabola(pv(s, d), "truth", "a", "c"),
      """SELECT w AS w_best, sqrt((SELECT avg(pow(truth - (1 - w) * a - w * c, 2)) FROM pred_vectors)) AS rmse_best
      FROM (SELECT sum((truth - a) * (c - a)) / sum(pow(c - a, 2)) AS w FROM pred_vectors)""", ctes=PRED_CTE, floats="w_best rmse_best", digits=3)

# ---- post-processing ----


def tail(s, d):
    return prefix.linear_prior(seq_log(s, d)).where("tvt_input IS NULL").withColumns(
        {"dm": F.col("linear_prior") - F.col("last_tvt"), "dp": F.col("z") / 10, "dy": F.col("tvt") - F.col("last_tvt")})


TAIL = LAST_CTE + ", tail AS (SELECT *, linear_prior - last_tvt AS dm, z / 10 AS dp, tvt - last_tvt AS dy, md - ps_md AS since FROM priors WHERE tvt_input IS NULL)"
ID = ["well_id", "row_idx"]

query("delta_postprocess", lambda s, d: post.delta_postprocess(tail(s, d), "md_from_ps", "dm", "dp", 0.09, 0.9, 85.0, ("dy", 0.1)).select(*ID, "delta"),
      "SELECT well_id, row_idx, 0.9 * (1 - exp(-greatest(since, 0) / 85)) * (0.81 * dm + 0.09 * dp + 0.1 * dy) AS delta FROM tail", ctes=TAIL, floats="delta")
query("quantile_clip", lambda s, d: post.quantile_clip(tail(s, d), tail(s, d), "dm", 0.05, 0.95).select(*ID, "dm_clipped"),
      "SELECT well_id, row_idx, greatest(lo, least(hi, dm)) AS dm_clipped FROM tail, (SELECT quantile_cont(dm, 0.05) AS lo, quantile_cont(dm, 0.95) AS hi FROM tail)", ctes=TAIL, floats="dm_clipped")
query("global_alpha", lambda s, d: post.global_alpha(tail(s, d), "dy", "dm"),
      """SELECT greatest(0, least(1.5, sum(dy * dm) / sum(dm * dm))) AS alpha, (SELECT arg_min(al, e) FROM (SELECT al, avg(pow(dy - al * dm, 2)) AS e FROM tail, (SELECT unnest(range(0, 61)) * 1.5 / 60 AS al) GROUP BY 1)) AS grid_alpha,
      (SELECT sqrt(min(e)) FROM (SELECT al, avg(pow(dy - al * dm, 2)) AS e FROM tail, (SELECT unnest(range(0, 61)) * 1.5 / 60 AS al) GROUP BY 1)) AS grid_rmse FROM tail""", ctes=TAIL, floats="alpha grid_alpha grid_rmse")
_A, _T, _W = [0.6, 0.8, 1.0, 1.2], [20.0, 85.0, 200.0], [0.0, 0.1, 0.3]
query("policy_grid", lambda s, d: post.policy_grid(tail(s, d), "dy", "md_from_ps", "dm", "dp", _A, _T, _W).drop("sse"),
      f"""SELECT alpha, tau, w, count(*) AS rows, sqrt(avg(pow(dy - alpha * (1 - exp(-greatest(since, 0) / tau)) * ((1 - w) * dm + w * dp), 2))) AS rmse
      FROM tail, (SELECT unnest({_A})::DOUBLE AS alpha), (SELECT unnest({_T})::DOUBLE AS tau), (SELECT unnest({_W})::DOUBLE AS w) GROUP BY 1, 2, 3""", ctes=TAIL, floats="alpha tau w rmse")
query("slope_quantiles", lambda s, d: post.slope_quantiles(seq_log(s, d)),
      "SELECT " + ", ".join(f"quantile_cont(k, {p}) AS q{str(p)[2:]}" for p in post.SLOPE_PROBS) + """ FROM (SELECT abs((tvt - lag(tvt) OVER w) / nullif(md - lag(md) OVER w, 0)) AS k
      FROM seq_log WINDOW w AS (PARTITION BY well_id ORDER BY row_idx))""", ctes=SEQ_CTE, floats=" ".join(f"q{str(p)[2:]}" for p in post.SLOPE_PROBS), digits=4)
query("causal_slope_clip", lambda s, d: post.causal_slope_clip(tail(s, d), "tvt", "last_tvt", "ps_md", 0.05).select(*ID, "limited"),
      """SELECT well_id, row_idx, y AS limited FROM walk""",
      ctes=TAIL.replace("ev AS", "RECURSIVE ev AS", 1).lstrip() + """,
      steps AS MATERIALIZED (SELECT well_id, row_idx, tvt, md, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) AS i, last_tvt, ps_md FROM tail),
      walk AS (SELECT well_id, row_idx, i, md, greatest(least(tvt, last_tvt + 0.05 * greatest(md - ps_md, 1e-6)), last_tvt - 0.05 * greatest(md - ps_md, 1e-6)) AS y FROM steps WHERE i = 1
        UNION ALL SELECT s.well_id, s.row_idx, s.i, s.md, greatest(least(s.tvt, w.y + 0.05 * greatest(s.md - w.md, 1e-6)), w.y - 0.05 * greatest(s.md - w.md, 1e-6))
        FROM walk w JOIN steps s ON s.well_id = w.well_id AND s.i = w.i + 1)""", floats="limited")
query("savgol_smooth", lambda s, d: post.savgol_smooth(seq_log(s, d), "tvt").select(*ID, "smooth"))


def unit_tail(s, d):
    t = tail(s, d).withColumn("u", F.col("tvt") + F.col("z") / 100 - F.col("last_tvt"))
    ends = t.groupBy("well_id").agg(F.max("md").alias("md_end"))
    return t.join(ends, "well_id").withColumn("s", (F.col("md") - F.col("ps_md")) / (F.col("md_end") - F.col("ps_md"))).select(*ID, "u", "s", "n_known")


query("robust_projection", lambda s, d: post.robust_projection(unit_tail(s, d), "u", "s", 3, keep=0.75).select(*ID, "projected"))
_pg = "greatest(0, least(1, (sc - 0.58) / 0.22)) * greatest(0, least(1, kn / 260)) "
query("prefix_gate", lambda s, d: pv(s, d).select("id", post.gated(F.col("a"), F.col("b"), post.prefix_gate(F.col("z") * 10, F.col("a") / 100, F.col("b") - F.col("c")), 0.35).alias("gated")),
      f"SELECT id, a * (1 - 0.35 * g) + b * 0.35 * g AS gated FROM (SELECT *, {_pg} * 18 / (abs(b - c) + 18) AS g FROM (SELECT *, z * 10 AS sc, a / 100 AS kn FROM pred_vectors))", ctes=PRED_CTE, floats="gated", digits=3)
query("formation_gate",
      lambda s, d: pv(s, d).select("id", post.gated(F.col("a"), F.col("b"), post.formation_gate(F.col("z") * 10, F.col("a") / 100, F.col("z") * 500, F.col("z") * 900, F.col("a") / 1000), 0.35).alias("gated")),
      f"""SELECT id, a * (1 - 0.35 * g) + b * 0.35 * g AS gated FROM (SELECT *, {_pg} * greatest(0, least(1, 1 - z * 500 / 90)) * greatest(0, least(1, 1 - z * 900 / 140)) / (1 + a / 6000) AS g
      FROM (SELECT *, z * 10 AS sc, a / 100 AS kn FROM pred_vectors))""", ctes=PRED_CTE, floats="gated", digits=3)
query("disagreement_gate", lambda s, d: pv(s, d).select("id", post.disagreement_weight(F.col("a") / 1000, F.col("b") / 1000, F.col("c") / 1000, F.col("truth") / 1000).alias("w")),
      "SELECT id, greatest(0.04, least(0.14, 0.06 + 0.08 * greatest(0, least(1, (abs(a - b) / 1000 - 6) / 24)) * exp(-pow(abs(c - truth) / 28000, 2)))) AS w FROM pred_vectors", ctes=PRED_CTE, floats="w")
query("cauchy_gate", lambda s, d: post.cauchy_gate(pv(s, d), "a", "b", 0.4, 2000.0, 1e9, 1e9).select("id", "weight", "gated"),
      "SELECT id, w AS weight, a + w * (b - a) AS gated FROM (SELECT *, 0.4 / (1 + pow(abs(b - a) / 2000, 2)) AS w FROM pred_vectors)", ctes=PRED_CTE, floats="weight gated", digits=3)
query("regime_selector", lambda s, d: post.regime_selector(seq_log(s, d), long_tail=27, spans=(14.0, 17.0)),
      """SELECT *, CAST(regexp_extract(recipe, 'scale_([0-9.]+)', 1) AS DOUBLE) AS scale, coalesce(TRY_CAST(regexp_extract(recipe, 'beam_([0-9.]+)', 1) AS DOUBLE), 0) AS beam_weight,
      coalesce(TRY_CAST(regexp_extract(recipe, 'hold_([0-9.]+)', 1) AS DOUBLE), 0) AS hold_weight FROM (SELECT *, (""" + str(post.RECIPES) + """)[code + 1] AS recipe FROM (
      SELECT *, CASE WHEN n_eval > 27 THEN 1 ELSE 0 END + 2 * (CASE WHEN z_span >= 14 THEN 1 ELSE 0 END + CASE WHEN z_span >= 17 THEN 1 ELSE 0 END) AS code FROM (
      SELECT well_id, count(*) AS n_eval, max(z) - min(z) AS z_span FROM seq_log WHERE tvt_input IS NULL GROUP BY 1)))""", ctes=SEQ_CTE, floats="z_span scale beam_weight hold_weight")
query("feature_policy_audit",
      lambda s, d: post.regime_selector(seq_log(s, d), long_tail=27, spans=(14.0, 17.0)).join(prefix.last_known(seq_log(s, d)), "well_id")
      .groupBy("code", "recipe").agg(F.count("*").alias("keys"), F.sum("n_eval").alias("eval_rows"), F.sum("n_known").alias("known_rows")),
      """SELECT code, (""" + str(post.RECIPES) + """)[code + 1] AS recipe, count(*) AS keys, sum(n_eval)::BIGINT AS eval_rows, sum(n_known)::BIGINT AS known_rows FROM (
      SELECT CASE WHEN count(*) FILTER (tvt_input IS NULL) > 27 THEN 1 ELSE 0 END + 2 * (CASE WHEN max(z) FILTER (tvt_input IS NULL) - min(z) FILTER (tvt_input IS NULL) >= 14 THEN 1 ELSE 0 END
        + CASE WHEN max(z) FILTER (tvt_input IS NULL) - min(z) FILTER (tvt_input IS NULL) >= 17 THEN 1 ELSE 0 END) AS code, count(*) FILTER (tvt_input IS NULL) AS n_eval, count(tvt_input) AS n_known
      FROM seq_log GROUP BY well_id) GROUP BY 1, 2""", ctes=SEQ_CTE)
