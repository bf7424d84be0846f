"""Write a frame once where several branches of a plan need it.

The table goes to the shared folder the session names in ``spark.checkpoint.dir``,
so it outlives lost executors, keeps plans short and lets readers prune columns.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir: executors do not see each other's disks")
    if sc.applicationId not in _own_dir:  # one machine, as in tests: a folder of our own
        _own_dir[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir[sc.applicationId]


def staged(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{stage_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


TASK_ROWS = 1 << 19


def in_tasks(df: DataFrame, rows: int, *by: str, each: int = TASK_ROWS) -> DataFrame:
    """``df`` of ``rows`` rows dealt by columns to tasks of about ``each`` rows, so what a task sorts or groups does not grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // each)), *by)


def again(df: DataFrame) -> DataFrame:
    """A second, independent reading of a staged frame, for joins of a frame with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._stage_path)
