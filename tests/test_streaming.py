"""Streams over several micro-batches equal the batch operators."""

import numpy as np
from logs import hot_log, to_spark
from pyspark.sql import functions as F

from loomlog.operators import post, prefix, sequence
from loomlog.streaming import causal as st


def in_slices(spark, df, n, path, by="row_idx"):
    """Landing folder with one file per slice of the logs, in order of time."""
    import time

    for i in range(n):
        df.where(F.col(by) % 1 == 0).where((F.col(by) >= i * 10) & ((F.col(by) < (i + 1) * 10) | F.lit(i == n - 1))).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_slope_clip_in_batches(spark, tmp_path):
    rows = prefix.linear_prior(to_spark(spark, hot_log(3))).where("tvt_input IS NULL").select("well_id", "row_idx", "md", "tvt", "last_tvt", "ps_md")
    got = st.drain(st.st_slope_clip(in_slices(spark, rows, 4, str(tmp_path / "in")), "tvt", "last_tvt", "ps_md", 0.3)).toPandas().sort_values(["well_id", "row_idx"])
    want = post.causal_slope_clip(rows, "tvt", "last_tvt", "ps_md", 0.3).toPandas().sort_values(["well_id", "row_idx"])
    np.testing.assert_allclose(got["limited"], want["limited"])
    assert got["late"].max() == 0


def test_late_rows_come_out_empty_and_counted(spark, tmp_path):
    schema = "well_id string, row_idx bigint, md double, v double, s double, m double"
    path = str(tmp_path / "in")
    for part in ([("w", 0, 1.0, 5.0, 5.0, 0.0), ("w", 2, 3.0, 5.0, 5.0, 0.0)], [("w", 1, 2.0, 9.0, 5.0, 0.0), ("w", 3, 4.0, 5.0, 5.0, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = st.drain(st.st_slope_clip(stream, "v", "s", "m", 1.0)).orderBy("row_idx").collect()
    assert [(r.row_idx, r.limited, r.late) for r in got] == [(0, 5.0, 0), (1, None, 1), (2, 5.0, 0), (3, 5.0, 1)]


def test_trailing_in_batches(spark, tmp_path):
    log = to_spark(spark, hot_log(4)).select("well_id", "row_idx", "md", "gr", "tvt_input")
    got = st.drain(st.st_trailing(in_slices(spark, log, 5, str(tmp_path / "in")), "gr", 10)).toPandas().sort_values(["well_id", "row_idx"])
    want = sequence.rolling_trailing(log, "gr", (10,)).toPandas().sort_values(["well_id", "row_idx"])
    for a, b in (("t_mean", "grf"), ("t_std", "std"), ("t_min", "min"), ("t_max", "max")):
        b = {"t_mean": "gr_tmean_10", "t_std": "gr_tstd_10", "t_min": "gr_tmin_10", "t_max": "gr_tmax_10"}[a]
        np.testing.assert_allclose(got[a].astype(float), want[b].astype(float), atol=1e-9)


def test_equal_times_are_kept_and_late_rows_counted(spark, tmp_path):
    import time

    schema = "well_id string, row_idx bigint, md double, gr double, tvt_input double, s double, m double"
    path = str(tmp_path / "in")
    for part in ([(1, 1.0), (0, 1.0), (2, 2.0)], [(3, 2.0), (4, 1.5), (5, 2.0), (6, 3.0)]):
        spark.createDataFrame([("w", r, x, None, None, 5.0, 0.0) for r, x in part], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    late = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 1)]  # row 4 comes first in its batch
    runs = sorted((r.row_idx, r.late, r.run_length) for r in st.drain(st.st_gap_runs(stream, "gr")).collect())
    assert runs == [(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 4), (4, 1, None), (5, 1, 5), (6, 1, 6)]
    assert sorted((r.row_idx, r.late) for r in st.drain(st.st_trailing(stream, "gr", 10)).collect()) == late
    clipped = st.drain(st.st_slope_clip(stream.withColumn("gr", F.lit(5.0)), "gr", "s", "m", 1.0)).collect()
    assert sorted((r.row_idx, r.late) for r in clipped) == late and [r.limited for r in sorted(clipped)].count(None) == 1


def test_rows_before_the_start_and_no_limit(spark, tmp_path):
    """A first row above its start reaches as far as one below it, as in the batch form; a limit of 0 changes nothing."""
    rows = spark.createDataFrame([("w", i, 3.0 + i, 50.0, 5.0, 10.0) for i in range(4)], "well_id string, row_idx bigint, md double, v double, s double, m double")
    got = [r.limited for r in st.drain(st.st_slope_clip(in_slices(spark, rows, 1, str(tmp_path / "in")), "v", "s", "m", 1.0)).orderBy("row_idx").collect()]
    assert got == [r.limited for r in post.causal_slope_clip(rows, "v", "s", "m", 1.0).orderBy("row_idx").collect()] == [12.0, 13.0, 14.0, 15.0]
    assert [r.limited for r in post.causal_slope_clip(rows, "v", "s", "m", 0.0).collect()] == [50.0] * 4
