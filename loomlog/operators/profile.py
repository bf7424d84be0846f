"""Profiles and audits of logs, curves and prediction contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.operators.curves import curve_interp
from loomlog.operators.joins import with_scalars
from loomlog.operators.metrics import modal_value, safe_corr
from loomlog.operators.prefix import known, last_known
from loomlog.operators.sequence import curvature
from loomlog.plans.blocks import SEQ, Seq, axis_block, framed, scan
from loomlog.plans.quantiles import quantiles

JUMPS = [0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]


def split_audit(logs: DataFrame, curves: DataFrame, key: str = "well_id") -> DataFrame:
    """Per split: keys, rows, rows to predict and keys without a curve."""
    per_key = logs.groupBy("split", key).agg(F.count("*").alias("rows"), F.count_if(F.col("tvt_input").isNull()).alias("eval_rows"))
    has = curves.select(key).distinct().withColumn("_has", F.lit(True))
    return per_key.join(has, key, "left").groupBy("split").agg(
        F.count("*").alias("keys"), F.sum("rows").alias("rows"), F.sum("eval_rows").alias("eval_rows"), F.count_if(F.col("_has").isNull()).alias("keys_without_curve")
    )


def inventory_check(groups: dict[str, DataFrame], key: str = "well_id") -> DataFrame:
    """Ids per group and how many of them any other group lacks."""
    tagged = None
    for name, df in groups.items():
        part = df.select(F.lit(name).alias("group"), F.col(key)).distinct()
        tagged = part if tagged is None else tagged.union(part)
    spread = tagged.groupBy(key).agg(F.collect_set("group").alias("in_groups"))  # at most one entry per group
    return spread.select(F.explode("in_groups").alias("group"), (F.size("in_groups") < len(groups)).alias("_odd")).groupBy("group").agg(
        F.count("*").alias("ids"), F.count_if("_odd").alias("not_everywhere")
    )


def zone_info(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Known and hidden rows of each key and the number of separate hidden runs."""
    hidden = F.col("tvt_input").isNull()
    rows = framed(df.select(seq.key, seq.pos, "tvt_input"), lambda w: {"_before": F.lag(hidden).over(w)}, 1, 0, seq)
    pos = F.col(seq.pos)
    return rows.groupBy(seq.key).agg(
        F.count("*").alias("rows"), F.count("tvt_input").alias("known"), F.count_if(hidden).alias("hidden"),
        F.min(F.when(hidden, pos)).alias("first_hidden"), F.max(F.when(hidden, pos)).alias("last_hidden"),
        F.count_if(hidden & ~F.coalesce(F.col("_before"), F.lit(False))).alias("hidden_runs"),
    )


def longest_run(df: DataFrame, flag: Column, zones: dict[str, Column] | None = None, seq: Seq = SEQ) -> DataFrame:
    """Longest run of TRUE per key; a row's run length is its distance to the last FALSE row.
    ``zones``: further results over runs cut to a part of the log."""
    pos = F.col(seq.pos)
    conds = {"longest": flag, **{n: flag & z for n, z in (zones or {}).items()}}
    rows = scan(df, last={f"_{n}": F.when(~c, pos) for n, c in conds.items()}, seq=seq)
    return rows.groupBy(seq.key).agg(
        *[F.coalesce(F.max(F.when(c, pos - F.coalesce(F.col(f"_{n}"), F.lit(-1)))), F.lit(0)).cast("bigint").alias(n) for n, c in conds.items()]
    )


def key_profile(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Spans, azimuth, missing rates by zone, tail ranges, median step and constant-prior error."""
    pos, hidden = F.col(seq.pos), F.col("tvt_input").isNull()
    rows = framed(df, lambda w: {"_step": F.abs(F.col("tvt") - F.lag("tvt").over(w))}, 1, 0, seq)

    def first_to_last(c):
        return F.max_by(c, pos) - F.min_by(c, pos)

    gone = F.when(F.col("gr").isNull(), 1.0).otherwise(0.0)
    agg = rows.groupBy(seq.key).agg(
        F.count("*").alias("rows"), F.count("tvt_input").alias("known"), F.count_if(hidden).alias("hidden"),
        *[(F.max(c) - F.min(c)).alias(f"{c}_span") for c in ("md", "x", "y", "z", "tvt")],
        F.degrees(F.atan2(first_to_last("y"), first_to_last("x"))).alias("azimuth"),
        F.avg(gone).alias("gr_missing"), F.avg(F.when(~hidden, gone)).alias("gr_missing_known"), F.avg(F.when(hidden, gone)).alias("gr_missing_hidden"),
        *[(F.max(F.when(hidden, F.col(c))) - F.min(F.when(hidden, F.col(c)))).alias(f"tail_{c}_range") for c in ("md", "z", "tvt", "gr")],
        F.max_by("tvt_input", F.when(~hidden, pos)).alias("last_tvt"),
        F.max_by("md", F.when(~hidden, pos)).alias("ps_md"),
        F.avg(F.when(hidden, F.col("tvt"))).alias("_m1"), F.var_pop(F.when(hidden, F.col("tvt"))).alias("_v"),
    )
    # mean squared distance of the tail to the last known value: variance plus squared shift
    rmse = F.sqrt(F.col("_v") + (F.col("_m1") - F.col("last_tvt")) ** 2)
    med = quantiles(rows, [seq.key], {"median_step": (F.col("_step"), 0.5)})
    return agg.withColumn("constant_rmse", rmse).drop("_m1", "_v").join(med, seq.key, "left")


def path_profile(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Monotonic md, hidden spans, slope and curvature quantiles and longest gaps."""

    def steps(w):
        dmd = F.col("md") - F.lag("md").over(w)
        return {"_dmd": dmd, "_slope": F.abs((F.col("z") - F.lag("z").over(w)) / F.nullif(dmd, F.lit(0.0)))}

    rows = framed(curvature(df, seq), steps, 1, 0, seq)
    hidden = F.col("tvt_input").isNull()
    agg = rows.groupBy(seq.key).agg(
        F.coalesce(F.min("_dmd") > 0, F.lit(True)).alias("md_increases"),
        *[(F.max(F.when(hidden, F.col(c))) - F.min(F.when(hidden, F.col(c)))).alias(f"hidden_{c}_span") for c in ("md", "z")],
    )
    s, c = F.col("_slope"), F.col("curvature")
    pct = quantiles(rows, [seq.key], {"slope_median": (s, 0.5), "slope_p95": (s, 0.95), "curvature_median": (c, 0.5), "curvature_p95": (c, 0.95)})
    runs = longest_run(df, F.col("gr").isNull(), {"longest_known": ~hidden, "longest_hidden": hidden}, seq)
    return agg.join(pct, seq.key, "left").join(runs, seq.key)


def curve_profile(curve: DataFrame, key: str = "well_id") -> DataFrame:
    seq = Seq(key=key, pos="_i")
    agg = curve.groupBy(key).agg(
        F.count("*").alias("rows"), F.min("tvt").alias("tvt_min"), F.max("tvt").alias("tvt_max"), (F.max("tvt") - F.min("tvt")).alias("tvt_span"),
        F.min("gr").alias("gr_min"), F.max("gr").alias("gr_max"), F.count_distinct(F.coalesce("geology", F.lit("<blank>"))).alias("labels"),
    )
    ranked = scan(curve, run={"_i": F.lit(1).cast("bigint")}, seq=seq, order=["tvt", "gr"], block=axis_block(curve, key, "tvt"))
    ranked = framed(ranked.withColumn("_i", F.col("_i") - 1), lambda w: {"_step": F.col("tvt") - F.lag("tvt").over(w)}, 1, 0, seq)
    med = quantiles(curve, [key], {"gr_median": (F.col("gr"), 0.5)})
    return agg.join(med, key, "left").join(modal_value(ranked, F.col("_step"), key).withColumnRenamed("mode", "modal_step"), key, "left")


def prefix_consistency(df: DataFrame, key: str = "well_id") -> DataFrame:
    """Largest difference between target and known prefix per key, and whether it counts."""
    return known(df).groupBy(key).agg(F.max(F.abs(F.col("tvt") - F.col("tvt_input"))).alias("max_diff")).withColumn("differs", F.col("max_diff") > 1e-9)


def step_jumps(df: DataFrame, col: str = "tvt", seq: Seq = SEQ) -> DataFrame:
    rows = framed(df, lambda w: {"_step": F.abs(F.col(col) - F.lag(col).over(w))}, 1, 0, seq)
    s = F.col("_step")
    pct = quantiles(rows, [], {f"p{n}": (s, p) for n, p in (("50", 0.5), ("90", 0.9), ("99", 0.99), ("999", 0.999))})
    agg = rows.agg(F.count(s).alias("steps"), F.max(s).alias("step_max"), *[F.count_if(s > j).alias(f"over_{str(j).replace('.', '_')}") for j in JUMPS])
    return with_scalars(agg, pct)


def surface_stability(df: DataFrame, surfaces: list[str], key: str = "well_id") -> DataFrame:
    """Spread of tvt + z - surface per key and surface."""
    r = F.array(*[F.struct(F.lit(s).alias("surface"), (F.col("tvt") + F.col("z") - F.col(s)).alias("r")) for s in surfaces])
    long = df.select(key, F.inline(r))
    by, x = [key, "surface"], F.col("r")
    med = quantiles(long, by, {"median": (x, 0.5), "_q1": (x, 0.25), "_q3": (x, 0.75)})
    dev = long.join(med, by)
    p95 = quantiles(dev, by, {"p95_abs_dev": (F.abs(x - F.col("median")), 0.95)})
    agg = long.groupBy(*by).agg(F.stddev_pop(x).alias("std"), F.avg(F.when(x.isNull(), 1.0).otherwise(0.0)).alias("missing"))
    return agg.join(med, by, "left").join(p95, by, "left").withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


def prefix_alignment(df: DataFrame, curve: DataFrame, key: str = "well_id") -> DataFrame:
    """How well the curve explains the signal on the known prefix."""
    p = curve_interp(known(df), curve, "tvt_input", key=key)
    y, x = F.col("gr"), F.col("ref_gr")
    d = y - x
    ok = F.regr_count(y, x) >= 20
    return p.groupBy(key).agg(
        F.count(d).alias("pairs"), safe_corr("gr", "ref_gr").alias("corr"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"),
        F.stddev_pop(d).alias("resid_std"), F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"),
    )


def knot_targets(df: DataFrame, knots: int = 21, seq: Seq = SEQ) -> DataFrame:
    """Target change of the tail at equally spaced fractions of it."""
    stats = last_known(df, seq)
    tail = df.where("tvt_input IS NULL AND tvt IS NOT NULL").join(stats, seq.key)
    ends = tail.groupBy(seq.key).agg(F.min(seq.pos).alias("_p0"), F.max(seq.pos).alias("_p1"))
    frac = (F.col(seq.pos) - F.col("_p0")) / F.greatest(F.col("_p1") - F.col("_p0"), F.lit(1))
    path = tail.join(ends, seq.key).select(seq.key, frac.alias("frac"), (F.col("tvt") - F.col("last_tvt")).alias("delta"))
    asked = ends.select(seq.key, F.explode(F.sequence(F.lit(0), F.lit(knots - 1))).alias("knot")).withColumn("_q", F.col("knot") / (knots - 1))
    return curve_interp(asked, path, "_q", "delta", "frac", "delta", key=seq.key).drop("_q")
