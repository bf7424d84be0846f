"""The driver tables seen as logs, curves, point samples and prediction vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.plans.blocks import Seq, axis_block, scan
from loomlog.plans.stage import staged

MICROS_PER_HOUR = 3_600_000_000.0
# independent of the session's time zone
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
SURFACES = ["s1", "s2", "s3", "s4", "s5", "s6"]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


_tables: dict[tuple[str, str, str], DataFrame] = {}


def _ingested(spark: SparkSession, path: str, name: str, build) -> DataFrame:
    """Logs are numbered once, at ingest, and written; queries read the written table."""
    key = (spark.sparkContext.applicationId, path, name)
    if key not in _tables:
        _tables[key] = staged(build(spark, path))
    return _tables[key]


def seq_log(spark: SparkSession, path: str) -> DataFrame:
    return _ingested(spark, path, "seq_log", build_seq_log)


def pred_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _ingested(spark, path, "pred_vectors", build_pred_vectors)


def build_seq_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a user as one depth-indexed log; the target is hidden on the last 40%."""
    ev = table(spark, path, "events").select(
        "user_id", "event_id", "event_type", "value",
        F.expr(MICROS).alias("us"),
    )
    rows = scan(
        ev,
        run={"rn": F.lit(1).cast("bigint"), "cum": F.col("value")},
        total={"n": ("sum", F.lit(1).cast("bigint")), "us0": ("min", F.col("us"))},
        seq=Seq(key="user_id"),
        order=["us", "event_id"],
        block=axis_block(ev, "user_id", "us"),
    )
    md = (F.col("us") - F.col("us0")) / MICROS_PER_HOUR
    tvt = F.lit(1000.0) + F.col("cum") / 100
    idx = F.col("rn") - 1
    return rows.select(
        F.col("user_id").cast("string").alias("well_id"),
        idx.alias("row_idx"),
        "n",
        md.alias("md"),
        md.alias("x"),
        F.col("user_id").cast("double").alias("y"),
        (-F.col("value") / 10).alias("z"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("gr"),
        tvt.alias("tvt"),
        F.when(idx < F.floor(F.col("n") * 0.6), tvt).alias("tvt_input"),
        "event_type",
    )


def ref_curve(spark: SparkSession, path: str) -> DataFrame:
    """Reference curve of key k: the gap-free rows of key k+1, wrapping around."""
    users = table(spark, path, "events").select("user_id").distinct().agg(F.count("*")).scalar()
    log = seq_log(spark, path).where(F.col("gr").isNotNull())
    return log.select(
        F.pmod(F.col("well_id").cast("bigint") - 1 + users, users).cast("string").alias("well_id"),
        "row_idx", "tvt", "gr", F.col("event_type").alias("geology"),
    )


def surface_points(spark: SparkSession, path: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("grp"),
        e[0].cast("double").alias("x"),
        e[1].cast("double").alias("y"),
        *[e[i + 2].cast("double").alias(s) for i, s in enumerate(SURFACES)],
    )


def build_pred_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Order lines as truth and three competing estimates, grouped by supplier."""
    line = table(spark, path, "lineitem")
    price = table(spark, path, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    unit = line.groupBy("l_returnflag").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    rows = scan(
        line,
        run={"rn": F.lit(1).cast("bigint")},
        total={"cs": ("sum", F.col("l_extendedprice")), "cn": ("sum", F.lit(1))},
        seq=Seq(key="l_suppkey"),
        order=["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice"],
        block=axis_block(line, "l_suppkey", "l_orderkey"),
    )
    rows = rows.join(price, "l_partkey").join(unit, "l_returnflag")
    return rows.select(
        F.concat_ws("_", "l_suppkey", F.col("rn") - 1).alias("id"),
        F.col("l_suppkey").alias("grp"),
        F.col("l_extendedprice").alias("truth"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("a"),
        (F.col("l_quantity") * F.col("unit")).alias("b"),
        (F.col("cs") / F.col("cn")).alias("c"),
        F.col("l_discount").alias("z"),
    )


def sample_ids(spark: SparkSession, path: str) -> DataFrame:
    """Contract: every order key; ``pos`` is the key itself, which is the contract order."""
    return table(spark, path, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"))


def line_ids(spark: SparkSession, path: str) -> DataFrame:
    """Predictions to compare with the contract: one per order that has lines."""
    return table(spark, path, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_extendedprice").alias("pred")
    )


def copies(spark: SparkSession, path: str) -> DataFrame:
    """Logs with a suffix: an exact copy of every third key, a perturbed one of every fifth."""
    log = seq_log(spark, path)
    u = F.col("well_id").cast("bigint")
    same = log.where(u % 3 == 0).withColumn("well_id", F.concat("well_id", F.lit("_c")))
    bent = log.where((u % 5 == 0) & (u % 3 != 0)).withColumns(
        {"well_id": F.concat("well_id", F.lit("_c")), "gr": F.col("gr") + 1, "tvt": F.col("tvt") + 0.05}
    )
    return same.unionByName(bent)
