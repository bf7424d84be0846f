"""User-level compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import align, blend, curves, metrics, models, post, prefix, profile, sequence, spatial, transfer
from loomlog.operators.joins import union_frames
from loomlog.plans.blocks import SEQ, Seq, framed, per_block, scan
from loomlog.plans.stage import staged

CENTRED = (5, 21, 51, 101)
_NEAR = (-30.0, -15.0, -8.0, -4.0, -2.0, 0.0, 2.0, 4.0, 8.0, 15.0, 30.0)
#: Residual families: name, anchor and offsets.
AROUND = {
    "tda": ("last_tvt", (-80.0, -40.0, -20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0, 40.0, 80.0)), "tdb": ("beam_ref", (-40.0, -20.0, -10.0, -5.0, -3.0, 0.0, 3.0, 5.0, 10.0, 20.0, 40.0)),
    "tds": ("sc_ens", _NEAR), "tdp": ("pf_mean", _NEAR), "tdl": ("slope_prior", (0.0,)),
}
GRADS = {"grf": "gr_grad_md", "x": "dx_dmd", "y": "dy_dmd", "z": "dz_dmd"}


def build_features(log: DataFrame, curve: DataFrame | None = None, ncc: bool = False, beam: bool = False, seq: Seq = SEQ) -> DataFrame:
    """Row features of a log: position, signal windows, gradients, geometry, priors and, if
    asked, self-correlation and beam alignment. Only the asked blocks are computed.

    Rows move three times and while they are narrow: one scan fills all gaps, the curve is asked before any feature is added, and
    one exchange serves windows and gradients. What the rows of a key share is joined after that, beside the blocks."""
    log = log if hasattr(log, "_stage_path") else staged(log)
    ids = [seq.key, seq.pos]
    shared = sequence.key_start(log, seq=seq).join(prefix.prior_stats(log, seq=seq), seq.key).join(sequence.moving_keys(log, seq=seq), seq.key)
    if curve is not None:
        shared = shared.join(curves.curve_bounds(curve, key=seq.key), seq.key, "left")
    shared = staged(shared)

    gaps, fill = sequence.gap_parts({"gr": "grf"}, seq=seq), sequence.fill_parts({"tvt_input": "tvt_input_ffill"})
    line = ["last_tvt", "slope", "ps_md"]
    rows = scan(log, last=gaps[0] | fill[0], following=gaps[1] | fill[1], beside=shared.select(seq.key, *line), seq=seq)
    asked = {"linear_prior": prefix.prior_columns(seq)["linear_prior"]} if curve is not None else {}
    rows = rows.select(*log.columns, *[c.alias(n) for n, c in {**gaps[2], **fill[2], **asked}.items()])
    if curve is not None:
        rows = curves.curve_interp(rows, curve, "linear_prior", "curve_gr_at_prior", key=seq.key)

    reach = max(sequence.CENTERED) // 2
    rows = framed(rows, lambda w: sequence.centered_columns(w, "grf") | sequence.gradient_columns(w, GRADS), reach, reach, seq, beside=per_block(log, shared, seq))
    position, start = sequence.position_columns(seq=seq), sequence.delta_columns() | sequence.geometry_columns()
    prior = prefix.prior_columns(seq) | {"gr_missing": F.col("gr").isNull().cast("double")}
    rows = rows.withColumns(position | sequence.flat_columns(GRADS) | start | prior)
    windows = [f"grf_{k}_{n}" for n in sequence.CENTERED for k in ("mean", "std")]
    stats = ["last_tvt", "ps_md", "ps_z", "ps_row", "n_known", "slope"]
    of_curve = [] if curve is None else ["curve_gr_at_prior", "curve_min", "curve_max", curves.held_in_bounds(F.col("linear_prior")).alias("linear_prior_clipped")]
    rows = rows.select(*log.columns, "n_rows", *position, "grf", *windows, *GRADS.values(), *start, "tvt_input_ffill", *stats, *prior, *of_curve)
    if curve is not None:
        if beam:
            rows = rows.join(align.beam_features(log, curve, staged(align.beam_align(log, curve, seq=seq)), seq=seq), ids)
    if ncc:
        rows = rows.join(align.ncc_ensemble(staged(align.prefix_ncc(log, seq=seq)), prefix.last_known(log, seq), seq=seq), ids)
    return rows


def tail_features(log: DataFrame, curve: DataFrame, blocks: set[str], seq: Seq = SEQ, scales: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Wide frame of the hidden rows from the named blocks: position, causal, windows (centred, with shifts and step derivatives),
    offsets, paths, selfcorr, scales (self-correlation at several widths), beams, dtw. Blocks that are not named cost nothing.
    ``scales`` and ``paths`` are the results of ``prefix_ncc`` and ``beam_align``, where they are at hand."""
    ids = [seq.key, seq.pos]
    rows = staged(sequence.tail_position(prefix.linear_prior(log, seq=seq), seq))
    if blocks & {"causal", "windows"}:
        filled = staged(sequence.interpolate_linear(log, {"gr": "grf"}, seq=seq))
    if "causal" in blocks:
        causal = sequence.rolling_trailing(filled, "grf", (25, 100), seq=seq)
        rows = rows.join(causal.where("tvt_input IS NULL").select(*ids, *[c for c in causal.columns if c.startswith("grf")]), ids)
    if "windows" in blocks:
        def around(w):
            made = sequence.centered_columns(w, "grf", CENTRED) | sequence.shift_columns(w, "grf") | sequence.step_columns(w)
            near = w.rowsBetween(-10, 10)
            return made | {"grf_max_21": F.max("grf").over(near), "grf_energy_21": F.sqrt(F.avg(F.col("grf") ** 2).over(near))}

        wide = framed(filled, around, max(CENTRED) // 2, max(CENTRED) // 2, seq).where("tvt_input IS NULL")
        rows = rows.join(wide.select(*ids, *[c for c in wide.columns if c not in rows.columns and c not in log.columns]), ids)
    if "offsets" in blocks:
        off = curves.local_offset_search(rows, curve, F.col("last_tvt"), key=seq.key)
        rows = rows.join(off.select(*ids, *[F.col(c).alias(f"off_{c}") for c in off.columns if c not in ids]), ids, "left")
    if "paths" in blocks:
        _, best = curves.candidate_paths(rows, curve, curves.curve_boundaries(curve, key=seq.key), "last_tvt", F.col("frac"), key=seq.key)
        rows = rows.join(best.select(*ids, *[F.col(c).alias(f"path_{c}") for c in best.columns if c not in ids]), ids, "left")
    if "selfcorr" in blocks:
        rows = rows.join(align.nn_signature_match(log, seq=seq), ids, "left")
    if "scales" in blocks:
        scales = align.prefix_ncc(log, seq=seq) if scales is None else scales
        scales = staged(scales.join(rows.select(*ids), ids, "left_semi"))
        widths = sorted(r.hw for r in scales.select("hw").distinct().collect())  # a handful of half-widths
        each = scales.groupBy(*ids).agg(*[F.max(F.when(F.col("hw") == h, F.col(c))).alias(f"sc{h}_{c}") for h in widths for c in ("tvt", "score")])
        mixed = align.ncc_ensemble(scales, prefix.last_known(log, seq), seq=seq).drop("known_rows").withColumnsRenamed({"tvt_ensemble": "sc_ens", "tvt_consensus": "sc_cons", "trust": "sc_trust"})
        rows = rows.join(each, ids, "left").join(mixed, ids, "left")
    if "beams" in blocks:
        paths = staged(align.beam_align(log, curve, seq=seq) if paths is None else paths)
        configs = [c[4] for c in align.BEAMS]
        wide = paths.groupBy(*ids).agg(*[F.max(F.when(F.col("config") == c, F.col("tvt"))).alias(f"beam_{c}") for c in configs],
                                       F.avg("tvt").alias("beam_mean"), F.percentile("tvt", F.lit(0.5)).alias("beam_med"), F.stddev_pop("tvt").alias("beam_std"))  # one value per configuration in each group
        rows = rows.join(wide, ids, "left")
    if "dtw" in blocks:
        rows = rows.join(align.dtw_align(log, curve, seq=seq)[1], ids, "left")
    return rows


def tracker_start(log: DataFrame, curve: DataFrame, seq: Seq = SEQ) -> DataFrame:
    pairs = curves.curve_interp(prefix.known(log), curve, "tvt_input", key=seq.key)
    return prefix.last_known(log, seq).join(prefix.rate_init(log, seq=seq), seq.key).join(prefix.noise_scale(pairs, nulls="zero", key=seq.key), seq.key)


def trackers(log: DataFrame, curve: DataFrame, particles: int = 64, seeds: int = 3, seq: Seq = SEQ) -> DataFrame:
    """Tracker ensemble and mean beam path of every hidden row."""
    tracks, ll = align.pf_track(log, curve, tracker_start(log, curve, seq), particles, seeds, seq=seq)
    beam = align.beam_align(log, curve, seq=seq).groupBy(seq.key, seq.pos).agg(F.avg("tvt").alias("beam"))
    return align.pf_ensemble(tracks, ll, seq=seq).join(beam, [seq.key, seq.pos], "left")


def dense_surface(log: DataFrame, surface: str, k: int = 20, most: int = 60, seq: Seq = SEQ) -> DataFrame:
    """``surface`` at every row from dense points of other keys: (key, row, dense, dense_std, dense_dist)."""
    key, pos = seq.key, seq.pos
    rows = log.select(F.col(key).alias("grp"), pos, "x", "y", F.col(surface).cast("double").alias("level"))
    points = spatial.surface_dense_points(rows, ["x", "y", "level"], most, order=pos).withColumn("id", F.concat_ws("|", "grp", pos))
    asked = rows.withColumn("_q", F.struct("grp", pos))
    near = spatial.knn(asked.select("_q", "grp", "x", "y"), staged(points), k, "_q", "id", "grp", carry=["level"])
    got = spatial.idw_predict(near, ["level"], qid="_q", spread=True)
    return got.select(F.col("_q")["grp"].alias(key), F.col("_q")[pos].alias(pos), F.col("level").alias("dense"), F.col("level_std").alias("dense_std"), F.col("nearest").alias("dense_dist"))


def key_profile(log: DataFrame, curve: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """One row per key: calibration of the signal to the curve, error and slopes over the prefix, extent of prefix and curve."""
    key, known = seq.key, prefix.known(log)
    pairs = staged(curves.curve_interp(known, curve, "tvt_input", key=key))
    y, gap = F.col("tvt_input"), F.col("gr") - F.col("ref_gr")
    fit = pairs.groupBy(key).agg(F.sqrt(F.avg(gap * gap)).alias("pfx_rmse"), prefix.fitted_slope(y, F.col("md")).alias("slope_all"), prefix.fitted_slope(y, F.col("z")).alias("slope_z"),
                                 (F.max(y) - F.min(y)).alias("ktvt_range"), F.stddev_pop(y).alias("ktvt_std"))
    cal = prefix.affine_calibration(pairs, key=key).select(key, F.col("slope").alias("cal_a"), F.col("intercept").alias("cal_b"))
    ref = curve.groupBy(key).agg((F.max("tvt") - F.min("tvt")).alias("tw_range"), F.avg("gr").alias("tw_gr_mean"))
    return log.select(key).distinct().join(fit, key, "left").join(cal, key, "left").join(ref, key, "left")


def with_surface(rows: DataFrame, log: DataFrame, level: str, name: str, seq: Seq = SEQ) -> DataFrame:
    """Targets that a surface implies, -z + level + bias, for the bias of the whole prefix, its recent rows and its weighted mean; the biases of
    its parts and the error over the prefix. ``level`` is a column of both frames."""
    key = seq.key
    off = F.col("tvt_input") + F.col("z") - F.col(level)
    spread = prefix.known(log).groupBy(key).agg(F.avg(off).alias("_mean"), F.var_pop(off).alias("_var"))
    bias = prefix.segment_bias(log.where(F.col(level).isNotNull()), off, seq=seq).join(spread, key)
    error = F.sqrt(F.col("_var") + (F.col("_mean") - F.col("bias_all")) ** 2)
    parts = ["all", "first", "middle", "recent", "weighted"]
    rows = rows.join(bias.select(key, *[F.col(f"bias_{p}").alias(f"{name}_bias_{p}") for p in parts], error.alias(f"{name}_rmse")), key, "left")
    at = {"": "all", "_w": "weighted", "_50": "recent"}
    return rows.withColumns({f"{name}{t}": F.col(level) - F.col("z") + F.coalesce(F.col(f"{name}_bias_{p}"), F.lit(0.0)) for t, p in at.items()})


def build_well_features(log: DataFrame, curve: DataFrame, tracked: DataFrame, surfaces: list[str], seq: Seq = SEQ, scales: DataFrame | None = None,
                        paths: DataFrame | None = None, dense: str | None = None) -> DataFrame:
    """Tail rows with trackers, beams, self-correlation at several widths, surface priors with the biases of prefix parts, a surface imputed
    densely from other keys (``dense``, else the first of ``surfaces``), calibration, signal windows, residual families around four anchors
    and the signals' consensus. ``scales`` and ``paths`` as in ``tail_features``."""
    key, ids = seq.key, [seq.key, seq.pos]
    imputed = staged(dense_surface(log, dense or surfaces[0], seq=seq))
    rows = tail_features(log, curve, {"causal", "windows", "selfcorr", "scales", "beams"}, seq, scales, paths)
    extra = [c for c in tracked.columns if c not in ids]
    rows = staged(rows.join(tracked.select(*ids, *extra), ids).join(imputed, ids, "left"))
    rows = rows.join(key_profile(log, curve, seq), key, "left")
    for s in surfaces:
        rows = with_surface(rows, log, s, f"surf_{s}", seq)
    rows = with_surface(rows, log.join(imputed.select(*ids, "dense"), ids, "left"), "dense", "surf_dense", seq)
    rows = rows.withColumns({f"surf_{n}": c for n, c in spatial.row_stats(F.array(*[F.col(f"surf_{s}") for s in surfaces])).items() if n in ("mean", "std", "range")})
    beam_ref = (F.col("beam_cons") + F.col("beam_sm5")) / 2
    rows = rows.withColumns({"beam_ref": beam_ref, "hyb_ref": align.hybrid_reference(beam_ref, F.col("sc_ens"), F.col("sc_trust")), "slope_prior": F.col("last_tvt") + F.col("slope_all") * F.col("md_since")})
    rows = staged(rows)
    num = align.tail_of(log, seq).select(*ids, "_i", F.col("grf").alias("_signal"))
    near = align.residuals_at(rows.select(*ids, *[c for c, _ in AROUND.values()]).join(num, ids), curve, AROUND, "_signal", seq=seq)
    rows = rows.join(near, ids, "left")
    first = f"surf_{surfaces[0]}"
    signals = ["pf_mean", *[f"beam_{c[4]}" for c in align.BEAMS], *[c for c in rows.columns if c.startswith("sc") and c.endswith("_tvt")], "sc_ens", *[f"surf_{s}" for s in surfaces], "surf_dense"]
    pairs = [("pf_mean", first), ("pf_mean", "surf_dense"), (first, "surf_dense"), ("beam_cons", first), ("sc_ens", "beam_cons"), ("beam", first)]
    return align.signal_consensus(rows, signals, "last_tvt", pairs)


def eval_surface_priors(log: DataFrame, points: DataFrame, surfaces: list[str], ks: list[int], dense: bool = False, key: str = "well_id") -> DataFrame:
    """Every (k, surface) imputed at the log's positions from other groups' points, in long form,
    and scored on the hidden rows. ``log`` has grp, x, y in the points' space; each different place is looked up once."""
    pts = spatial.surface_dense_points(points, ["x", "y", *surfaces]) if dense else spatial.surface_sparse_points(points, ["x", "y", *surfaces]).withColumn("id", F.col("grp"))
    place = ["grp", "x", "y"]
    spots = staged(log.dropna(subset=place).select(*place).distinct().withColumn("_q", F.concat_ws("|", *place)))
    near = spatial.knn(spots, staged(pts), max(ks), "_q", "id", "grp", carry=surfaces)
    near = staged(near.select("_q", "rank", "dist", *[f"p_{s}" for s in surfaces]))
    parts = []
    for k in ks:  # a handful of settings over one neighbour table
        est = spatial.idw_predict(near.where(F.col("rank") <= k), surfaces, qid="_q").drop("nearest").join(spots, "_q").drop("_q")
        pred = spatial.surface_prior(log.drop(*surfaces).join(est, place), surfaces, key)
        parts.append(pred.where("tvt_input IS NULL").select(F.lit(k).alias("k"), "surface", key, F.col("tvt").alias("truth"), "pred"))
    return metrics.score_report(union_frames(parts), ["k", "surface"], key).drop("worst")


FEATS = ["md_from_ps", "drift", "z", "grf", "grf_mean_5", "grf_std_5", "grf_mean_25", "grf_std_25"]


def learning_rows(log: DataFrame, curve: DataFrame, folds: int = 3, seq: Seq = SEQ) -> DataFrame:
    rows = sequence.rolling_centered(sequence.interpolate_linear(log, {"gr": "grf"}, fallback=0.0, seq=seq), "grf", (5, 25), seq=seq)
    rows = prefix.linear_prior(rows, seq=seq).withColumns({"target": F.col("tvt") - F.col("last_tvt"), "drift": F.col("linear_prior") - F.col("last_tvt")})
    rows = models.training_frame(rows, log, curve, seq.key)
    return staged(rows.join(models.group_kfold(log, folds, seq.key).select(seq.key, "fold"), seq.key))


def cv_tail(log: DataFrame, curve: DataFrame, folds: int = 3, seq: Seq = SEQ) -> DataFrame:
    """Naive priors and ridge models, cross-validated by whole keys, in one report."""
    rows = learning_rows(log, curve, folds, seq)
    rows = rows.join(prefix.z_anchor(log, seq), seq.key, "left").withColumn("z_anchor_prior", F.col("z_anchor") - F.col("z"))
    rows = models.ridge_oof(rows, FEATS, "target", 20.0, folds=folds)
    preds = {"last_known": F.col("last_tvt"), "linear": F.col("linear_prior"), "z_anchor": F.col("z_anchor_prior"), "ridge_last_residual": F.col("last_tvt") + F.col("oof")}
    long = rows.select(seq.key, F.col("tvt").alias("truth"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in preds.items()])))
    return metrics.score_report(long, key=seq.key).drop("worst")


def selector_replay(log: DataFrame, tracked: DataFrame, long_tail: float = post.LONG_TAIL, spans=tuple(post.Z_SPANS), seq: Seq = SEQ) -> DataFrame:
    """Tracker, beam and last value mixed by each key's regime: (key, row, selector, parts)."""
    regime = post.regime_selector(log, long_tail=long_tail, spans=spans, key=seq.key).drop("n_eval", "z_span")
    rows = tracked.join(regime, seq.key).join(prefix.last_known(log, seq).select(seq.key, "last_tvt"), seq.key)
    track = F.coalesce(*[F.when(F.col("scale") == s, F.col(f"pf_{s:g}")) for s in (3.0, 5.0, 8.0, 12.0)], F.col("pf_8"))
    return rows.withColumn("selector", post.regime_mix(track, F.coalesce("beam", "pf_mean"), F.col("last_tvt")))


def final_blend_replay(log: DataFrame, curve: DataFrame, tracked: DataFrame, folds: int = 3, seq: Seq = SEQ) -> DataFrame:
    """Stacked residual model, faded and mixed with the tracker, blended with the selector for
    several weights, and the cross-validated weight: RMSE per stage."""
    ids = [seq.key, seq.pos]
    rows = learning_rows(log, curve, folds, seq).join(selector_replay(log, tracked, seq=seq).select(*ids, "selector", "pf_mean"), ids)
    rows = models.ridge_oof(rows, FEATS, "target", 20.0, folds=folds, out="stack", clip_to_target=True)
    rows = rows.withColumn("pf_delta", F.col("pf_mean") - F.col("last_tvt"))
    rows = post.delta_postprocess(rows, "md_from_ps", "stack", "pf_delta", 0.09, 1.0, 85.0)
    rows = staged(rows.withColumn("ridge_pp", F.col("last_tvt") + F.col("delta")).select(*ids, "fold", "tvt", "last_tvt", "selector", "ridge_pp"))
    sweep = blend.blend_sweep(rows, "tvt", "ridge_pp", "selector", [0.2, 0.25, 0.3, 0.35, 0.4, 0.6, 0.7, 0.8]).select(F.format_string("blend_%.2f", "weight").alias("stage"), "rmse")
    cv = blend.blend_cv_global(rows, "tvt", "ridge_pp", "selector", "fold").agg(F.lit("blend_cv").alias("stage"), F.sqrt(F.sum(F.col("rmse") ** 2 * F.col("n")) / F.sum("n")).alias("rmse"))
    return metrics.stage_report(rows, ["last_tvt", "selector", "ridge_pp"], "last_tvt", "tvt").select("stage", "rmse").union(sweep).union(cv)


def blend_search(df: DataFrame, y: str, r: str, s: str, key: str, features: list[str], folds: int = 5, top: int | None = None,
                 key_bins: tuple[int, ...] = blend.KEY_BINS, row_bins: tuple[int, ...] = blend.ROW_BINS) -> DataFrame:
    """Fixed, global, key-binned and row-binned blends (every feature in every number of bins) and ridge models on the gate features, ranked
    by cross-validated RMSE: all of them, or the ``top`` first. ``signed_gap`` and ``abs_gap`` may be named as features beside the columns of ``df``."""
    df = blend.gate_features(df, r, s)
    parts = [blend.blend_sweep(df, y, r, s, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]).select(F.format_string("fixed_%.2f", "weight").alias("formula"), "rmse")]
    pooled = F.sqrt(F.sum(F.col("rmse") ** 2 * F.col("n")) / F.sum("n")).alias("rmse")
    parts.append(blend.blend_cv_global(df, y, r, s, "fold").agg(F.lit("global_cv").alias("formula"), pooled))
    grid = blend.blend_cv_grid(df, y, r, s, features, key, "fold", folds, key_bins, row_bins)
    parts.append(grid.groupBy("kind", "feature", "bins").agg(pooled).select(F.format_string("%s_bins_%s_q%d", "kind", "feature", "bins").alias("formula"), "rmse"))
    parts.append(blend.residual_model_report(df, y, r, s, features, "fold", folds).where("fold = -1").select(F.col("model").alias("formula"), "rmse"))
    ranked = union_frames(parts).orderBy("rmse", "formula")
    return ranked if top is None else ranked.limit(top)


def tracker_residual_model(log: DataFrame, curve: DataFrame, tracked: DataFrame, folds: int = 3, seq: Seq = SEQ) -> DataFrame:
    """Models learn what the tracker misses; 0.4 / 0.4 / 0.2 mean of three of them, added back."""
    ids = [seq.key, seq.pos]
    rows = learning_rows(log, curve, folds, seq).join(tracked.select(*ids, "pf_mean", "pf_std"), ids)
    rows = staged(rows.withColumn("miss", F.col("tvt") - F.col("pf_mean")))
    feats = [*FEATS, "pf_std"]
    for name, alpha in (("m1", 20.0), ("m2", 80.0)):
        rows = models.ridge_oof(rows, feats, "miss", alpha, folds=folds, out=name)
    rows = models.gbt_oof(staged(rows), feats, "miss", folds=folds, out="m3", trees=6, depth=3)
    return rows.withColumn("pred", F.col("pf_mean") + 0.4 * F.col("m1") + 0.4 * F.col("m2") + 0.2 * F.col("m3")).select(*ids, "fold", F.col("tvt").alias("truth"), "pf_mean", "pred")


def two_engine_blend(log: DataFrame, curve: DataFrame, tracked: DataFrame, donors: DataFrame, pairs: DataFrame, weight: float = 0.6, seq: Seq = SEQ, least: int = 50) -> DataFrame:
    """Engine A (selector with robust projection) and engine B (likelihood ensemble, faded and
    smoothed) blended, then guarded transfer from copies: (key, row, a, b, blend, final)."""
    key, pos = seq.key, seq.pos
    ids = [key, pos]
    base = prefix.linear_prior(log, seq=seq).where("tvt_input IS NULL")
    ends = base.groupBy(key).agg(F.max("md").alias("_end"))
    rows = base.select(*ids, "md", "z", "ps_md", "n_known", F.col("last_tvt").alias("_last")).join(ends, key).join(selector_replay(log, tracked, seq=seq), ids)
    rows = rows.withColumns({"u": F.col("selector") + F.col("z") - F.col("_last"), "s": F.coalesce((F.col("md") - F.col("ps_md")) / F.nullif(F.col("_end") - F.col("ps_md"), F.lit(0.0)), F.lit(0.0))})
    rows = post.robust_projection(rows, "u", "s", 3, rounds=2, keep=0.75, key=key)
    rows = rows.withColumn("a", F.col("projected") - F.col("z") + F.col("_last"))
    fade = post.faded(F.col("md") - F.col("ps_md"), [(F.col("pf_5") - F.col("_last"), 1.0)], 1.0, 85.0)
    tail = staged(rows.withColumn("b_raw", F.col("_last") + fade).select(*ids, "a", "b_raw"))
    num = align.tail_of(log, seq).select(*ids, "_i")
    b = post.savgol_smooth(staged(tail.join(num, ids)), "b_raw", 17, 3, "b", Seq(key=key, pos="_i", rows=seq.rows)).drop("_i", "b_raw")
    mixed = staged(b.withColumn("blend", weight * F.col("a") + (1 - weight) * F.col("b")))
    # only what the transfer compares and moves
    all_rows = log.select(*ids, "md", "z", "gr", "tvt_input").join(mixed.select(*ids, "blend"), ids, "left")
    pairs = staged(transfer.first_of_alike(pairs, donors, key=key))  # a crowd of equal copies adds one pair per key
    moved, _ = transfer.gated_transfer(transfer.copied_rows(all_rows, donors, pairs, key=key), "blend", 1.0, least=least, key=key)
    moved = moved.where("tvt_input IS NULL").select(*ids, "new_pred")
    return mixed.join(moved, ids, "left").withColumn("final", F.coalesce("new_pred", "blend")).drop("new_pred")


def data_audit(train: DataFrame, test: DataFrame, curve: DataFrame, cols: list[str], key: str = "well_id") -> tuple[DataFrame, DataFrame]:
    """Per-split counts and the comparison of keys that are in both splits."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    return profile.split_audit(both, curve, key), transfer.exact_overlap_audit(train, test, cols, key)


def inspect(log: DataFrame, curve: DataFrame, first: int = 20, key: str = "well_id") -> DataFrame:
    """Rows, hidden rows and curve points of the first keys in key order."""
    keys = log.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("tvt_input").isNull()).alias("eval_rows")).orderBy(key).limit(first)
    return keys.join(curve.groupBy(key).agg(F.count("*").alias("curve_rows")), key, "left")
