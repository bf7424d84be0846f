"""Statistics of the known prefix and the naive priors built on them.

Per-key results are plain aggregates, combined before the shuffle, so a hot key
costs no more than any other. They are attached to rows with an ordinary join:
the planner broadcasts them when they are small and splits skewed keys when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.functions.exprs import clip
from loomlog.plans.blocks import SEQ, Seq, framed, scan
from loomlog.plans.quantiles import quantiles

KNOWN = "tvt_input IS NOT NULL"


def known(df: DataFrame) -> DataFrame:
    return df.where(KNOWN)


def prediction_mask(df: DataFrame, require_target: bool = False, out: str = "is_eval") -> DataFrame:
    """Rows to predict. Without ``tvt_input`` all rows are; a required target that is
    absent leaves none."""
    mask = F.col("tvt_input").isNull() if "tvt_input" in df.columns else F.lit(True)
    if require_target:
        mask = (mask & F.col("tvt").isNotNull()) if "tvt" in df.columns else F.lit(False)
    return df.withColumn(out, mask)


def last_known(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Last known target of each key and where it is; (0, first md, row 0) when none is known."""
    at = F.when(F.expr(KNOWN), F.col(seq.pos))
    agg = df.groupBy(seq.key).agg(
        F.max_by("tvt_input", at).alias("_tvt"), F.max_by("md", at).alias("_md"), F.max_by("z", at).alias("_z"),
        F.max(at).alias("_row"), F.min_by("md", F.col(seq.pos)).alias("_md0"), F.min_by("z", F.col(seq.pos)).alias("_z0"),
        F.count("tvt_input").alias("n_known"),
    )
    return agg.select(
        seq.key,
        F.coalesce("_tvt", F.lit(0.0)).alias("last_tvt"),
        F.coalesce("_md", "_md0").alias("ps_md"),
        F.coalesce("_z", "_z0").alias("ps_z"),
        F.coalesce("_row", F.lit(0)).cast("bigint").alias("ps_row"),
        "n_known",
    )


def last_rows(df: DataFrame, k: int, seq: Seq = SEQ, rank: str | None = None) -> DataFrame:
    """Last ``k`` rows of every key. The rank filter is applied before the shuffle too, so
    each task sends at most ``k`` rows per key."""
    w = W.partitionBy(seq.key).orderBy(F.desc(seq.pos))
    rows = df.withColumn("_from_end", F.row_number().over(w)).where(F.col("_from_end") <= k)
    return rows.withColumnRenamed("_from_end", rank) if rank else rows.drop("_from_end")


def first_rows(df: DataFrame, k: int, seq: Seq = SEQ) -> DataFrame:
    w = W.partitionBy(seq.key).orderBy(seq.pos)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fitted_slope(y: Column, x: Column) -> Column:
    b = F.when((F.regr_count(y, x) >= 2) & (F.max(x) > F.min(x)), F.regr_slope(y, x))
    return F.coalesce(b, F.lit(0.0))


def last_known_slope(df: DataFrame, window: int = 50, on: str = "md", out: str = "slope", seq: Seq = SEQ) -> DataFrame:
    """Least-squares slope of the target over the last ``window`` known rows; 0 if undefined."""
    pairs = known(df).where(F.col(on).isNotNull()).select(seq.key, seq.pos, on, "tvt_input")
    fit = last_rows(pairs, window, seq).groupBy(seq.key).agg(fitted_slope(F.col("tvt_input"), F.col(on)).alias(out))
    keys = df.select(seq.key).distinct()
    return keys.join(fit, seq.key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def prior_stats(df: DataFrame, window: int = 50, seq: Seq = SEQ) -> DataFrame:
    """One row per key: what ``prior_columns`` needs."""
    return last_known(df, seq).join(last_known_slope(df, window, seq=seq), seq.key)


def prior_columns(seq: Seq = SEQ) -> dict[str, Column]:
    return {
        "is_known": F.expr(KNOWN),
        "row_from_ps": F.col(seq.pos) - F.col("ps_row"),
        "md_from_ps": F.col("md") - F.col("ps_md"),
        "linear_prior": F.col("last_tvt") + F.col("slope") * (F.col("md") - F.col("ps_md")),
    }


def linear_prior(df: DataFrame, window: int = 50, seq: Seq = SEQ) -> DataFrame:
    return df.join(prior_stats(df, window, seq), seq.key).withColumns(prior_columns(seq))


def z_anchor(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    return quantiles(known(df), [seq.key], {"z_anchor": (F.col("tvt_input") + F.col("z"), 0.5)})


def z_anchor_prior(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    return df.join(z_anchor(df, seq), seq.key, "left").withColumn("z_anchor_prior", F.col("z_anchor") - F.col("z"))


def baseline_ladder(df: DataFrame, recent: int = 200, seq: Seq = SEQ) -> DataFrame:
    """Five naive predictors of the hidden tail, in long form: (key, row, model, pred, truth)."""

    def fits(rows: DataFrame, tag: str) -> DataFrame:
        y = F.col("tvt_input")
        aggs = []
        for x in ("md", "z"):
            b = fitted_slope(y, F.col(x))
            aggs += [b.alias(f"b_{x}_{tag}"), (F.avg(y) - b * F.avg(x)).alias(f"a_{x}_{tag}")]
        return rows.groupBy(seq.key).agg(*aggs)

    k = known(df).select(seq.key, seq.pos, "md", "z", "tvt_input")
    stats = last_known(df, seq).join(fits(k, "all"), seq.key, "left").join(
        fits(last_rows(k, recent, seq), "recent"), seq.key, "left"
    )
    rows = df.where("tvt_input IS NULL AND tvt IS NOT NULL").join(stats, seq.key)
    models = [("constant", F.col("last_tvt"))]
    for tag in ("all", "recent"):
        for x in ("md", "z"):
            line = F.col(f"a_{x}_{tag}") + F.col(f"b_{x}_{tag}") * F.col(x)
            models.append((f"linear_{x}_{tag}", F.coalesce(line, F.col("last_tvt"))))
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in models])
    return rows.select(seq.key, seq.pos, F.col("tvt").alias("truth"), F.inline(pairs))


def prefix_profile(df: DataFrame, seq: Seq = SEQ) -> DataFrame:
    """Shape of the known prefix, one row per key."""
    pos, ok = F.col(seq.pos), F.expr(KNOWN)
    gr_at = F.when(ok & F.col("gr").isNotNull(), pos)
    known_at = F.when(ok, pos)

    def ends(c):
        return F.max_by(c, known_at) - F.min_by(c, known_at)

    tvt, gr = F.col("tvt_input"), F.when(ok, F.col("gr"))
    agg = df.groupBy(seq.key).agg(
        F.count(tvt).alias("n_known"), F.min(tvt).alias("tvt_min"), F.max(tvt).alias("tvt_max"),
        (F.max(tvt) - F.min(tvt)).alias("tvt_range"), F.avg(tvt).alias("tvt_mean"), F.stddev_pop(tvt).alias("tvt_std"),
        F.min(gr).alias("gr_min"), F.max(gr).alias("gr_max"), F.avg(gr).alias("gr_mean"), F.stddev_pop(gr).alias("gr_std"),
        (1 - F.count(gr) / F.nullif(F.count(tvt), F.lit(0))).alias("gr_missing"),
        F.max_by("gr", gr_at).alias("gr_last"),
        (F.max(known_at) - F.max(gr_at)).alias("gr_last_rows"),
        (F.max_by("md", known_at) - F.max_by("md", gr_at)).alias("gr_last_md"),
        F.sin(F.atan2(ends("y"), ends("x"))).alias("azimuth_sin"), F.cos(F.atan2(ends("y"), ends("x"))).alias("azimuth_cos"),
    )
    for k in (20, 100):
        tail = last_rows(known(df).select(seq.key, seq.pos, "tvt_input"), k + 1, seq)
        steps = tail.groupBy(seq.key).agg(
            ((F.max_by("tvt_input", seq.pos) - F.min_by("tvt_input", seq.pos)) / F.nullif(F.count("*") - 1, F.lit(0))).alias(f"step_{k}")
        )
        agg = agg.join(steps, seq.key, "left")
    return agg


def _steps(df: DataFrame, seq: Seq) -> DataFrame:
    """Known rows with the change to the known row before them."""

    def build(w):
        cols = {"md": "dmd", "z": "dz", "tvt_input": "dtvt"}
        return {out: F.col(c) - F.lag(c).over(w) for c, out in cols.items()}

    return framed(df, build, 1, 0, seq).where(F.expr(KNOWN) & F.col("dtvt").isNotNull() & (F.col("dmd") > 0))


def rate_init(df: DataFrame, recent: int = 30, with_z: bool = True, seq: Seq = SEQ) -> DataFrame:
    """Median rate of (tvt + z), or of tvt alone, over the steps between the last ``recent`` known rows
    where md grows; 0 below 3 steps. The window and the percentile see ``recent`` rows per key at most."""
    tail = last_rows(known(df).select(seq.key, seq.pos, "md", "z", "tvt_input"), recent, seq)
    w = W.partitionBy(seq.key).orderBy(seq.pos)
    dmd, dz, dtvt = (F.col(c) - F.lag(c).over(w) for c in ("md", "z", "tvt_input"))
    tail = tail.select(seq.key, dmd.alias("_d"), (dtvt + dz if with_z else dtvt).alias("_c"))
    steps = tail.where(F.col("_d") > 0).select(seq.key, (F.col("_c") / F.col("_d")).alias("_r"))
    rate = steps.groupBy(seq.key).agg(F.when(F.count("_r") >= 3, F.percentile("_r", F.lit(0.5))).alias("rate"))
    return df.select(seq.key).distinct().join(rate, seq.key, "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def z_coupling(df: DataFrame, min_steps: int = 10, seq: Seq = SEQ) -> DataFrame:
    """Regression of the target's rate on the rate of z over the prefix; (-1, 0, 0.1) by default."""
    steps = _steps(df, seq).select(seq.key, (F.col("dtvt") / F.col("dmd")).alias("y"), (F.col("dz") / F.col("dmd")).alias("x"))
    y, x = F.col("y"), F.col("x")
    fit = steps.groupBy(seq.key).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    )
    ok = (F.col("n") >= min_steps) & (F.col("sxx") > 0)
    left = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"), F.lit(0.0)) / F.col("n"))
    out = df.select(seq.key).distinct().join(fit, seq.key, "left")
    return out.select(
        seq.key,
        F.when(ok, F.col("b")).otherwise(F.lit(-1.0)).alias("beta"),
        F.when(ok, F.col("a")).otherwise(F.lit(0.0)).alias("intercept"),
        F.when(ok, F.greatest(left, F.lit(0.001))).otherwise(F.lit(0.1)).alias("noise"),
    )


def noise_scale(pairs: DataFrame, signal: str = "gr", ref: str = "ref_gr", nulls: str = "drop", key: str = "well_id") -> DataFrame:
    """Spread of signal minus reference over the prefix, limited to [10, 60]; 30 below 20 pairs.
    ``nulls``: leave missing signal out ("drop") or count it as 0 ("zero")."""
    s = F.coalesce(F.col(signal), F.lit(0.0)) if nulls == "zero" else F.col(signal)
    d = s - F.col(ref)
    return pairs.groupBy(key).agg(
        F.when(F.count(d) >= 20, clip(F.stddev_pop(d), 10.0, 60.0)).otherwise(F.lit(30.0)).alias("noise_scale")
    )


def affine_calibration(pairs: DataFrame, signal: str = "gr", ref: str = "ref_gr", min_pairs: int = 20, key: str = "well_id") -> DataFrame:
    """signal = slope * reference + intercept; (1, mean difference) when it cannot be fitted."""
    y, x = F.col(signal), F.col(ref)
    ok = (F.regr_count(y, x) >= min_pairs) & (F.regr_sxx(y, x) > 1e-12)
    return pairs.groupBy(key).agg(
        F.regr_count(y, x).alias("n_pairs"),
        F.when(ok, F.regr_slope(y, x)).otherwise(F.lit(1.0)).alias("slope"),
        F.when(ok, F.regr_intercept(y, x)).otherwise(F.coalesce(F.avg(y - x), F.lit(0.0))).alias("intercept"),
    )


def segment_bias(df: DataFrame, bias: Column, rate: float = 0.02, recent: int = 50, seq: Seq = SEQ) -> DataFrame:
    """Median of ``bias`` over the prefix, its first and middle third and last rows, and its
    mean with weights growing towards the end of the prefix."""
    rows = scan(
        df,
        run={"_i": F.when(F.expr(KNOWN), 1).otherwise(0).cast("bigint")},
        total={"_n": ("sum", F.when(F.expr(KNOWN), 1).otherwise(0).cast("bigint"))},
        seq=seq,
    ).where(KNOWN)
    i, n = F.col("_i") - 1, F.col("_n")
    rows = rows.withColumn("_bias", bias)
    b, third = F.col("_bias"), F.floor(n / 3)
    med = quantiles(
        rows,
        [seq.key],
        {
            "bias_all": (b, 0.5),
            "bias_first": (F.when(i < third, b), 0.5),
            "bias_middle": (F.when((i >= third) & (i < 2 * third), b), 0.5),
            "bias_recent": (F.when(i >= n - recent, b), 0.5),
        },
    )
    weight = F.exp((i - (n - 1)) * rate)  # scaled so that the last row weighs 1
    mean = rows.groupBy(seq.key).agg((F.sum(weight * b) / F.sum(weight)).alias("bias_weighted"))
    return med.join(mean, seq.key)
