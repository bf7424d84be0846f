"""Curve look-ups and interpolating joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.bindings import ref_curve, seq_log
from loomlog.catalog.prefix_queries import LAST_CTE
from loomlog.catalog.registry import CURVE_CTE, query
from loomlog.operators import curves as op
from loomlog.operators import prefix

ID = ["well_id", "row_idx"]
CTE = LAST_CTE + CURVE_CTE[len(CURVE_CTE.split(",\nusers AS")[0]):]


def interp(q: str, hold: bool = True) -> str:
    """Interpolated curve value ``v`` for a subquery with columns well_id and q."""
    ends = ("hi.gr", "lo.gr") if hold else ("NULL", "CASE WHEN lo.tvt = a.q THEN lo.gr END")
    return f"""(SELECT a.*, CASE WHEN a.q IS NULL THEN NULL WHEN lo.tvt IS NULL THEN {ends[0]} WHEN hi.tvt IS NULL THEN {ends[1]}
      ELSE lo.gr + (hi.gr - lo.gr) * (a.q - lo.tvt) / (hi.tvt - lo.tvt) END AS v
      FROM {q} AS a ASOF LEFT JOIN ref_curve lo ON a.well_id = lo.well_id AND a.q >= lo.tvt
      ASOF LEFT JOIN ref_curve hi ON a.well_id = hi.well_id AND a.q < hi.tvt)"""


def prior(s, d):
    return prefix.linear_prior(seq_log(s, d))


def pairs(s, d):
    """Prefix rows with the curve's value at the known target."""
    return op.curve_interp(prefix.known(seq_log(s, d)), ref_curve(s, d), "tvt_input")


PAIRS = interp("(SELECT *, tvt_input AS q FROM seq_log WHERE tvt_input IS NOT NULL)")

query("curve_interp",
      lambda s, d: op.curve_interp(op.curve_interp(prior(s, d), ref_curve(s, d), "linear_prior", "held"), ref_curve(s, d), "linear_prior", "inside", outside="null")
      .select(*ID, "held", "inside"),
      f"""SELECT x.well_id, x.row_idx, x.v AS held, y.v AS inside FROM {interp('(SELECT *, linear_prior AS q FROM priors)')} x
      JOIN {interp('(SELECT *, linear_prior AS q FROM priors)', False)} y USING (well_id, row_idx)""",
      ctes=CTE, floats="held inside")

query("curve_bounds_clip", lambda s, d: op.curve_bounds_clip(prior(s, d), ref_curve(s, d), "linear_prior").select(*ID, "curve_min", "curve_max", "linear_prior_clipped"),
      """SELECT well_id, row_idx, curve_min, curve_max, least(greatest(linear_prior, curve_min), curve_max) AS linear_prior_clipped
      FROM priors JOIN (SELECT well_id, min(tvt) AS curve_min, max(tvt) AS curve_max FROM ref_curve GROUP BY 1) USING (well_id)""",
      ctes=CTE, floats="curve_min curve_max linear_prior_clipped")

query("curve_grid", lambda s, d: op.curve_grid(ref_curve(s, d)).select("well_id", "cell", "grid_y"),
      f"""SELECT well_id, cell, v AS grid_y FROM {interp('''(SELECT well_id, cell, lo + cell * 0.2 AS q FROM
        (SELECT well_id, lo, unnest(range(0, CAST(floor((hi - lo) / 0.2) AS BIGINT) + 2)) AS cell FROM (SELECT well_id, min(tvt) AS lo, max(tvt) AS hi FROM ref_curve GROUP BY 1)))''')}""",
      ctes=CURVE_CTE, floats="grid_y")

query("nearest_knot", lambda s, d: op.nearest_knot(prior(s, d), ref_curve(s, d), "linear_prior").select(*ID, "knot_idx", "knot_x"),
      """SELECT well_id, row_idx, CASE WHEN take_lo THEN i0 ELSE i1 END AS knot_idx, CASE WHEN take_lo THEN x0 ELSE x1 END AS knot_x FROM (
      SELECT p.well_id, p.row_idx, lo.i AS i0, hi.i AS i1, lo.tvt AS x0, hi.tvt AS x1,
        hi.tvt IS NULL OR (lo.tvt IS NOT NULL AND abs(linear_prior - lo.tvt) <= abs(hi.tvt - linear_prior)) AS take_lo
      FROM priors p ASOF LEFT JOIN knots lo ON p.well_id = lo.well_id AND p.linear_prior >= lo.tvt
      ASOF LEFT JOIN knots hi ON p.well_id = hi.well_id AND p.linear_prior < hi.tvt)""",
      ctes=CTE + ", knots AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY tvt) - 1 AS i FROM ref_curve)", floats="knot_x")


def donor(s, d):
    k = s.read.parquet(f"{d}/events.parquet").select("user_id").distinct().agg(F.count("*")).scalar()
    return seq_log(s, d).select(F.pmod(F.col("well_id").cast("bigint") - 1 + k, k).cast("string").alias("well_id"), "md", "tvt", "gr", "z", "row_idx", "n")


DONOR = "SELECT CAST((CAST(well_id AS BIGINT) - 1 + k) % k AS VARCHAR) AS well_id, md, tvt, gr, z, row_idx, n FROM seq_log, users"

query("asof_transfer_md", lambda s, d: op.asof_transfer_md(seq_log(s, d), donor(s, d)).select(*ID, "copy"),
      f"""SELECT a.well_id, a.row_idx, CASE WHEN hi.md IS NULL THEN CASE WHEN lo.md = a.md THEN lo.tvt END ELSE lo.tvt + (hi.tvt - lo.tvt) * (a.md - lo.md) / (hi.md - lo.md) END AS copy
      FROM seq_log a ASOF LEFT JOIN ({DONOR}) lo ON a.well_id = lo.well_id AND a.md >= lo.md ASOF LEFT JOIN ({DONOR}) hi ON a.well_id = hi.well_id AND a.md < hi.md""",
      ctes=CURVE_CTE, floats="copy")

query("noise_scale", lambda s, d: op_noise(s, d), f"""SELECT well_id, CASE WHEN count(gr - v) >= 20 THEN greatest(10, least(60, stddev_pop(gr - v))) ELSE 30 END AS drop_nulls,
      CASE WHEN count(v) >= 20 THEN greatest(10, least(60, stddev_pop(coalesce(gr, 0) - v))) ELSE 30 END AS zero_nulls FROM {PAIRS} GROUP BY 1""",
      ctes=CTE, floats="drop_nulls zero_nulls")


def op_noise(s, d):
    p = pairs(s, d)
    a = prefix.noise_scale(p).withColumnRenamed("noise_scale", "drop_nulls")
    return a.join(prefix.noise_scale(p, nulls="zero").withColumnRenamed("noise_scale", "zero_nulls"), "well_id")


query("affine_calibration", lambda s, d: prefix.affine_calibration(pairs(s, d)),
      f"""SELECT well_id, regr_count(gr, v)::BIGINT AS n_pairs, CASE WHEN regr_count(gr, v) >= 20 AND regr_sxx(gr, v) > 1e-12 THEN regr_slope(gr, v) ELSE 1 END AS slope,
      CASE WHEN regr_count(gr, v) >= 20 AND regr_sxx(gr, v) > 1e-12 THEN regr_intercept(gr, v) ELSE coalesce(avg(gr - v), 0) END AS intercept FROM {PAIRS} GROUP BY 1""",
      ctes=CTE, floats="slope intercept")

_ANCHORS = {"last": ("last_tvt", [-10.0, 0.0, 10.0]), "line": ("linear_prior", [-4.0, 0.0, 4.0])}
_fam = [f"{n}_{'m' if o < 0 else 'p'}{abs(int(o))}" for n, (_, os) in _ANCHORS.items() for o in os]
_fam_rows = "(SELECT *, unnest([" + ", ".join(f"'{c}'" for c in _fam) + "]) AS nm, unnest([last_tvt - 10, last_tvt, last_tvt + 10, linear_prior - 4, linear_prior, linear_prior + 4]) AS q FROM priors)"
query("offset_residual_family", lambda s, d: op.offset_residual_family(prior(s, d), ref_curve(s, d), {n: (F.col(c), o) for n, (c, o) in _ANCHORS.items()}),
      "SELECT well_id, row_idx, " + ", ".join(f"max(CASE WHEN nm = '{c}' THEN gr - v END) AS {c}" for c in _fam) + f" FROM {interp(_fam_rows)} GROUP BY 1, 2",
      ctes=CTE, floats=" ".join(_fam))

_BEST = """SELECT well_id, row_idx, arg_min(o, struct_pack(r := r, o := o)) FILTER (r IS NOT NULL) AS best, min(r) AS best_abs, max(r) FILTER (o = 0) AS zero_abs,
      list(r ORDER BY r)[2] - list(r ORDER BY r)[1] AS top2_gap, sum(exp(-r / 20) * o) / sum(exp(-r / 20)) AS soft_mean,
      arg_min(v, struct_pack(r := r, o := o)) FILTER (r IS NOT NULL) AS best_gr"""
_BEST_COLS = "best best_abs zero_abs top2_gap soft_mean best_gr"
_off_rows = "(SELECT *, last_tvt + o AS q FROM (SELECT *, unnest([" + ", ".join(str(o) for o in op.STEP_OFFSETS) + "]) AS o FROM priors WHERE gr IS NOT NULL AND tvt_input IS NULL))"
query("local_offset_search",
      lambda s, d: op.local_offset_search(prior(s, d).where("gr IS NOT NULL AND tvt_input IS NULL"), ref_curve(s, d), F.col("last_tvt")),
      f"{_BEST} FROM (SELECT *, abs(gr - v) AS r FROM {interp(_off_rows)}) GROUP BY 1, 2", ctes=CTE, floats=_BEST_COLS)

BOUND_CTE = CTE + """,
marks AS (SELECT well_id, tvt AS boundary FROM (SELECT well_id, tvt, geology, lag(geology) OVER (PARTITION BY well_id ORDER BY tvt, geology) AS pg FROM ref_curve) WHERE pg <> geology),
bounds AS (SELECT well_id, boundary FROM marks UNION SELECT well_id, min(tvt) FROM ref_curve GROUP BY 1 UNION SELECT well_id, max(tvt) FROM ref_curve GROUP BY 1)"""

query("curve_boundaries", lambda s, d: op.curve_boundaries(ref_curve(s, d), bounds=True), "SELECT well_id, boundary FROM bounds", ctes=BOUND_CTE, floats="boundary")

_CTX = "prev_dist next_dist thickness phase phase_sin phase_cos balance proximity"
query("interval_context",
      lambda s, d: op.interval_context(prior(s, d), op.curve_boundaries(ref_curve(s, d), bounds=True), "linear_prior").select(*ID, *_CTX.split()),
      """SELECT well_id, row_idx, pd AS prev_dist, nd AS next_dist, th AS thickness, pd / th AS phase, sin(pi() * pd / th) AS phase_sin, cos(pi() * pd / th) AS phase_cos,
      (nd - pd) / (th + 1e-6) AS balance, least(pd, nd) / (th + 1e-6) AS proximity FROM (
        SELECT p.well_id, p.row_idx, p.linear_prior - b.boundary AS pd, b.base - p.linear_prior AS nd, b.base - b.boundary AS th FROM priors p
        JOIN (SELECT *, CASE WHEN row_number() OVER w = 1 THEN -1e18 ELSE boundary END AS reach, lead(boundary) OVER w AS base FROM bounds WINDOW w AS (PARTITION BY well_id ORDER BY boundary)
              QUALIFY base IS NOT NULL) b ON p.well_id = b.well_id AND b.reach <= p.linear_prior
        QUALIFY row_number() OVER (PARTITION BY p.well_id, p.row_idx ORDER BY b.boundary DESC) = 1)""",
      ctes=BOUND_CTE, floats=_CTX, digits=4)

query("boundary_counts",
      lambda s, d: op.boundary_counts(prior(s, d), op.curve_boundaries(ref_curve(s, d)), "last_tvt", "linear_prior").select(*ID, "crossed", "nearest"),
      """SELECT p.well_id, p.row_idx, count(*) FILTER (boundary > least(last_tvt, linear_prior) AND boundary <= greatest(last_tvt, linear_prior)) AS crossed,
      min(abs(boundary - linear_prior)) AS nearest FROM priors p JOIN marks USING (well_id) GROUP BY 1, 2""",
      ctes=BOUND_CTE, floats="nearest")


def paths(s, d):
    rows = prior(s, d).where("tvt_input IS NULL AND gr IS NOT NULL")
    frac = (F.col("row_idx") - F.col("ps_row")) / (F.col("n") - F.col("ps_row"))
    return op.candidate_paths(rows, ref_curve(s, d), op.curve_boundaries(ref_curve(s, d)), "last_tvt", frac)


_path_rows = "(SELECT *, last_tvt + f * o AS q FROM (SELECT *, (row_idx - ps_row) / (n - ps_row) AS f, unnest([" + ", ".join(str(o) for o in op.ENDPOINTS) + "]) AS o FROM priors WHERE gr IS NOT NULL AND tvt_input IS NULL))"
query("candidate_paths", lambda s, d: paths(s, d)[1].drop("zero_abs"),
      f"SELECT * EXCLUDE (zero_abs) FROM ({_BEST} FROM (SELECT *, abs(gr - v) AS r FROM {interp(_path_rows)}) GROUP BY 1, 2)", ctes=CTE,
      floats=_BEST_COLS.replace("zero_abs ", ""))
query("candidate_path_scores", lambda s, d: paths(s, d)[0].select(*ID, "endpoint", "diff", "absdiff", "crossed", "nearest"),
      f"""SELECT well_id, row_idx, endpoint, any_value(gr - v) AS diff, any_value(abs(gr - v)) AS absdiff,
      count(*) FILTER (boundary > least(last_tvt, q) AND boundary <= greatest(last_tvt, q)) AS crossed, min(abs(boundary - q)) AS nearest
      FROM (SELECT *, o AS endpoint FROM {interp(_path_rows)}) JOIN marks USING (well_id) GROUP BY 1, 2, 3""",
      ctes=BOUND_CTE, floats="endpoint diff absdiff nearest")

SURFACES = {"view": "y", "click": "x", "purchase": "md"}


def partly_named(s, d):
    """Every third curve has no ``view``, so its first label stands in."""
    return ref_curve(s, d).where((F.col("geology") != "view") | (F.col("well_id").cast("long") % 3 != 0))


query("contact_reconstruction", lambda s, d: op.contact_reconstruction(seq_log(s, d), partly_named(s, d), SURFACES, "view").select(*ID, "ref_tvt", "contact_tvt"),
      """SELECT well_id, row_idx, ref_tvt, raw + coalesce(avg(tvt_input - raw) OVER (PARTITION BY well_id), 0) AS contact_tvt FROM (
      SELECT *, ref_tvt - (z - CASE label WHEN 'view' THEN y WHEN 'click' THEN x WHEN 'purchase' THEN md END) AS raw FROM seq_log JOIN (
        SELECT well_id, coalesce(min(tvt) FILTER (geology = 'view'), min(tvt)) AS ref_tvt, CASE WHEN bool_or(geology = 'view') THEN 'view' ELSE arg_min(geology, tvt) END AS label
        FROM ref_curve WHERE geology <> 'view' OR CAST(well_id AS BIGINT) % 3 <> 0 GROUP BY 1) USING (well_id))""",
      ctes=CURVE_CTE, floats="ref_tvt contact_tvt")
