"""Row ids, guards and fingerprints of prediction frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, key: str = "grp", row_id: str = "id", value: str = "pred", digits: int = 6) -> DataFrame:
    """Hashes that tell whether two vectors are identical, whatever their row order: rows are
    hashed one by one and combined by sums and xor, so a group is never gathered."""
    text = F.concat_ws("=", row_id, F.format_number(value, digits))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("_h", h).groupBy(key).agg(F.count("*").alias("rows"), F.bit_xor("_h").alias("hash_xor"), F.sum(F.col("_h") % 1000003).alias("hash_sum"))


def fallback_fill(df: DataFrame, pred: str, last: str, delta: str, out: str = "filled") -> DataFrame:
    """Missing prediction: the key's last known value, else mean last value plus mean delta."""
    default = df.agg((F.avg(last) + F.avg(delta)).alias("m")).scalar()
    return df.withColumn("_m", default).withColumn(out, F.coalesce(pred, last, "_m")).drop("_m")
