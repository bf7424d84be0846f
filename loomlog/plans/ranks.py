"""Exact global ranks without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def global_rank(df: DataFrame, coarse: Column, order: list, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Zero-based rank in ``order``. ``coarse`` must grow with the order; its counts are
    accumulated first, then rows are ranked inside each coarse value."""
    by = by or []
    d = df.withColumn("_c", coarse)
    counts = d.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_c").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*by, "_c", F.coalesce(before, F.lit(0)).alias("_start"))
    rows = d.join(starts, [*by, "_c"])
    inside = F.row_number().over(W.partitionBy(*by, "_c").orderBy(*order))
    return rows.withColumn(out, F.col("_start") + inside - 1).drop("_c", "_start")
