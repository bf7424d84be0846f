"""Errors, score reports and descriptive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.operators.joins import pair_sums, with_scalars
from loomlog.plans.quantiles import _bin, quantiles


def _pair(y: str, p: str) -> Column:
    a, b = F.col(y), F.col(p)
    return F.when(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), a - b)


def rmse(y: str = "truth", p: str = "pred") -> Column:
    """Root mean squared error over rows where both sides are present; NULL if there is none."""
    d = _pair(y, p)
    return F.sqrt(F.avg(d * d))


def mae(y: str = "truth", p: str = "pred") -> Column:
    return F.avg(F.abs(_pair(y, p)))


def key_scores(df: DataFrame, by: list[str], key: str, y: str = "truth", p: str = "pred") -> DataFrame:
    d = _pair(y, p)
    return df.groupBy(*by, key).agg(F.sum(d * d).alias("sse"), F.count(d).alias("rows")).where("rows > 0")


def score_report(df: DataFrame, by=("model",), key: str = "well_id", worst: int = 10) -> DataFrame:
    """Pooled RMSE (sum of squares over all rows), mean and median of the per-key RMSEs and
    the worst keys. The second level sees one row per key."""
    by = list(by)
    keys = key_scores(df, by, key).withColumn("rmse", F.sqrt(F.col("sse") / F.col("rows")))
    top = keys.groupBy(*by).agg(
        F.sqrt(F.sum("sse") / F.sum("rows")).alias("rmse"), F.sum("rows").alias("rows"), F.count("*").alias("keys"),
        F.avg("rmse").alias("key_rmse_mean"),
    )
    med = quantiles(keys, by, {"key_rmse_median": (F.col("rmse"), 0.5)})
    rank = W.partitionBy(*by).orderBy(F.desc("rmse"), key) if by else W.orderBy(F.desc("rmse"), key)
    bad = keys.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= worst)
    bad = bad.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_r", key, "rmse", "rows"))).alias("worst")  # at most ``worst`` entries
    )
    return top.join(med, by).join(bad, by) if by else with_scalars(with_scalars(top, med), bad)


def worst_decile(keys: DataFrame, by=("model",)) -> DataFrame:
    """Mean of the worst tenth of the per-key RMSEs (at least one key) and the maximum.
    The cut value is found by exact rank selection, so the keys are never sorted in one task."""
    by, r = list(by), F.col("rmse")

    def take(n: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(n / 10))

    cut = quantiles(keys, by, {"_cut": (r, lambda n: n - take(n))})
    above = F.when(r > F.col("_cut"), r)
    agg = keys.join(cut, by).groupBy(*by).agg(
        F.count("*").alias("_n"), F.max(r).alias("worst"), F.count(above).alias("_k"), F.sum(above).alias("_s"), F.max("_cut").alias("_cut")
    )
    k = take(F.col("_n"))
    mean = (F.coalesce("_s", F.lit(0.0)) + (k - F.col("_k")) * F.col("_cut")) / k
    return agg.select(*by, mean.alias("worst_decile"), "worst")


def row_vs_key_weighting(df: DataFrame, key: str = "well_id", y: str = "truth", p: str = "pred") -> DataFrame:
    """Share of rows and of squared error per key beside the pooled, mean and median RMSE."""
    keys = key_scores(df, [], key, y, p).withColumn("rmse", F.sqrt(F.col("sse") / F.col("rows")))
    all_ = keys.agg(F.sum("sse").alias("_s"), F.sum("rows").alias("_n"), F.avg("rmse").alias("key_mean"))
    all_ = with_scalars(all_, quantiles(keys, [], {"key_median": (F.col("rmse"), 0.5)}))
    whole = all_.select(F.struct("*").alias("s")).scalar()
    return keys.withColumn("_w", whole).select(
        key, "rows", "rmse", (F.col("rows") / F.col("_w")["_n"]).alias("row_share"), (F.col("sse") / F.col("_w")["_s"]).alias("sse_share"),
        F.sqrt(F.col("_w")["_s"] / F.col("_w")["_n"]).alias("pooled"), F.col("_w")["key_mean"].alias("key_mean"), F.col("_w")["key_median"].alias("key_median"),
    )


def binned_error(df: DataFrame, feature: str, edges: list[float], base: str, y: str = "truth", p: str = "pred") -> DataFrame:
    """Error per bin of a feature; bins are closed on the right and the lowest edge belongs
    to the first bin. The last edge may be infinite."""
    x = F.col(feature)
    inner = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:]]), lambda e: e < x))
    bin_no = F.when((x >= edges[0]) & (x <= edges[-1]), inner)
    e, b = F.col(y) - F.col(p), F.col(y) - F.col(base)
    return df.withColumn("bin", bin_no).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(b * b)).alias("base_rmse"),
        (F.sqrt(F.avg(b * b)) - F.sqrt(F.avg(e * e))).alias("gain"), F.stddev_pop(y).alias("target_std"),
    )


def key_gain(df: DataFrame, base: str, key: str = "well_id", y: str = "truth", p: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Gain over a base prediction per key, and its distribution."""
    e, b = F.col(y) - F.col(p), F.col(y) - F.col(base)
    keys = df.groupBy(key).agg((F.sqrt(F.avg(b * b)) - F.sqrt(F.avg(e * e))).alias("gain"))
    g = F.col("gain")
    pct = quantiles(keys, [], {f"p{int(q * 100):02d}": (g, q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)})
    top = keys.agg(
        F.min(g).alias("gain_min"), F.max(g).alias("gain_max"), F.count_if(g > 0).alias("improved"), F.count_if(g < 0).alias("hurt")
    )
    return keys, with_scalars(top, pct)


def stage_report(df: DataFrame, stages: list[str], base: str, y: str = "truth") -> DataFrame:
    """Squared error and RMSE of every processing stage and its gain over the base."""
    rows = F.array(*[F.struct(F.lit(s).alias("stage"), ((F.col(y) - F.col(s)) ** 2).alias("_e")) for s in stages])
    out = df.select(((F.col(y) - F.col(base)) ** 2).alias("_b"), F.inline(rows)).groupBy("stage").agg(
        F.sum("_e").alias("sse"), F.sqrt(F.avg("_e")).alias("rmse"), (F.sqrt(F.avg("_b")) - F.sqrt(F.avg("_e"))).alias("gain")
    )
    return out


def average_ranks(df: DataFrame, cols: list[str], width: float | None = None) -> DataFrame:
    """Add ``<col>_rank``: the rank from 1, ties averaged. Ranks come from counts per distinct
    value, accumulated over coarse value bins and then inside each bin."""
    out = df
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_c")).withColumn("_b", _bin(F.col(c)))
        bins = counts.groupBy("_b").agg(F.sum("_c").alias("_bc"))
        # one row per occupied bin: the only ordering over everything
        before = F.sum("_bc").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
        bins = bins.select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
        inside = F.sum("_c").over(W.partitionBy("_b").orderBy(c).rowsBetween(W.unboundedPreceding, 0))
        ranks = counts.join(bins, "_b").select(c, (F.col("_base") + inside - (F.col("_c") - 1) / 2).alias(f"{c}_rank"))
        out = out.join(ranks, c, "left")
    return out


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman between two score columns; NULL below two rows."""
    r = average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b])
    n = F.count("*")
    return r.agg(n.alias("rows"), F.when(n >= 2, F.corr(a, b)).alias("pearson"), F.when(n >= 2, F.corr(f"{a}_rank", f"{b}_rank")).alias("spearman"))


def safe_corr(a: str, b: str, least: int = 30) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.corr(x, y))


PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def describe_pct(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    by, x = by or [], F.col(col)
    agg = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    pct = quantiles(df, by, {f"p{p:02d}": (x, p / 100) for p in PERCENTS})
    return agg.join(pct, by, "left") if by else with_scalars(agg, pct)


def value_counts(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit("<blank>")).alias(col)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(top)


def modal_value(df: DataFrame, value: Column, key: str, digits: int = 6) -> DataFrame:
    """Most frequent rounded value per key, the smallest on a tie; counted per value first."""
    counts = df.groupBy(key, F.round(value, digits).alias("_v")).agg(F.count("*").alias("_c")).where("_v IS NOT NULL")
    return counts.groupBy(key).agg(F.min_by("_v", F.struct((-F.col("_c")).alias("c"), "_v")).alias("mode"))


def replicate_variance(df: DataFrame, y: str, replicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """RMSE of each replicate, of their row mean, and the spread; pairwise distances apart."""
    bag = sum(F.col(r) for r in replicates) / len(replicates)
    one = df.agg(*[F.sqrt(F.avg((F.col(y) - F.col(r)) ** 2)).alias(r) for r in replicates], F.sqrt(F.avg((F.col(y) - bag) ** 2)).alias("bagged_rmse"))
    scores = F.array(*replicates)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, v: s + v) / len(replicates)
    var = F.aggregate(scores, F.lit(0.0), lambda s, v: s + (v - mean) ** 2) / len(replicates)
    return one.select(mean.alias("rmse_mean"), F.sqrt(var).alias("rmse_std"), "bagged_rmse"), pair_sums(df, replicates)
