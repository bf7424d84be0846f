"""Checks that a prediction vector fulfils its contract, as result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.joins import pair_sums, with_scalars
from loomlog.plans.quantiles import quantiles


def contract_guard(
    preds: DataFrame, contract: DataFrame, key: str = "id", value: str = "tvt", least_range: float | None = None, median: tuple[float, float] | None = None
) -> DataFrame:
    """One row of findings with ``passed`` and the first reason. Order is checked when both
    sides carry ``pos``."""
    columns_ok = set(preds.columns) - {"pos"} == {key, value}
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    side = preds.select(key, v.alias("_v"), bad.alias("_bad"), F.lit(1).alias("_p"), F.lit(0).alias("_c"), (F.col("pos") if "pos" in preds.columns else F.lit(None).cast("bigint")).alias("_pp"), F.lit(None).cast("bigint").alias("_cp"))
    side = side.union(contract.select(key, F.lit(None).cast("double"), F.lit(False), F.lit(0), F.lit(1), F.lit(None).cast("bigint"), "pos"))
    per_id = side.groupBy(key).agg(F.sum("_p").alias("p"), F.sum("_c").alias("c"), F.count_if("_bad").alias("bad"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                                   F.min("_pp").alias("pp"), F.min("_cp").alias("cp"))
    found = per_id.agg(
        F.sum("p").alias("rows"), F.sum("c").alias("contract_rows"), F.count_if(F.expr("c > 0 AND p = 0")).alias("missing"),
        F.count_if(F.expr("p > 0 AND c = 0")).alias("extra"), F.count_if(F.expr("p > 1")).alias("duplicates"), F.sum("bad").alias("not_finite"),
        F.count_if(F.expr("pp <> cp")).alias("moved"), (F.max("hi") - F.min("lo")).alias("value_range"),
    )
    found = with_scalars(found, quantiles(preds, [], {"value_median": (v, 0.5)}))
    reason = F.when(F.lit(not columns_ok), "columns")
    for name in ("duplicates", "missing", "extra", "not_finite", "moved"):
        reason = reason.when(F.col(name) > 0, name)
    reason = reason.when(F.col("rows") != F.col("contract_rows"), "row count")
    if least_range is not None:
        reason = reason.when(F.col("value_range") < least_range, "range")
    if median is not None:
        reason = reason.when(~F.col("value_median").between(*median), "median")
    return found.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("passed", F.col("reason") == "ok")


def diversity_gate(df: DataFrame, base: str, candidates: list[str], floor: float = 0.25) -> DataFrame:
    """Candidates and their smallest RMS distance to the base or to each other."""
    pairs = pair_sums(df, [base, *candidates]).withColumn("rms", F.sqrt("msd"))
    ends = pairs.select(F.explode(F.array("m1", "m2")).alias("model"), "rms").where(F.col("model") != base)
    return ends.groupBy("model").agg(F.min("rms").alias("nearest_rms")).withColumn("passed", F.col("nearest_rms") >= floor)


def change_report(df: DataFrame, old: str, new: str) -> DataFrame:
    d = F.col(new) - F.col(old)
    agg = df.agg(
        F.count("*").alias("rows"), F.count_if(F.abs(d) > 1e-9).alias("changed"), F.sqrt(F.avg(d * d)).alias("rms_delta"), F.max(F.abs(d)).alias("max_abs"),
        F.avg(d).alias("mean_delta"), F.avg(new).alias("new_mean"), F.stddev_pop(new).alias("new_std"),
    )
    return with_scalars(agg, quantiles(df, [], {"p95_abs": (F.abs(d), 0.95)}))


def weight_validation(weights: DataFrame, limit: float = 1.05) -> DataFrame:
    """Weights per group: finite, not negative, sum within the limit."""
    w = F.col("weight")
    odd = w.isNull() | F.isnan(w) | (F.abs(w) == F.lit(float("inf")))
    out = weights.groupBy("grp").agg(F.count_if(odd).alias("not_finite"), F.count_if(w < 0).alias("negative"), F.sum(w).alias("total"))
    return out.withColumn("valid", (F.col("not_finite") == 0) & (F.col("negative") == 0) & (F.col("total") <= limit))
