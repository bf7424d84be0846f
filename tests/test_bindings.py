"""Numbering at ingest must not depend on block sizes or the session's time zone."""

import pandas as pd

from loomlog import bindings
from loomlog.plans import blocks

PATH = "/root/testdata/sf0.001"


def table(df, by):
    return df.toPandas().sort_values(by, ignore_index=True)


def test_small_blocks_give_the_same_logs(spark, monkeypatch):
    want = table(bindings.build_seq_log(spark, PATH), ["well_id", "row_idx"])
    monkeypatch.setattr(blocks, "AXIS_ROWS", 6)
    pd.testing.assert_frame_equal(table(bindings.build_seq_log(spark, PATH), ["well_id", "row_idx"]), want)


def test_small_blocks_give_the_same_vectors(spark, monkeypatch):
    want = table(bindings.build_pred_vectors(spark, PATH), ["id"])
    monkeypatch.setattr(blocks, "AXIS_ROWS", 40)
    pd.testing.assert_frame_equal(table(bindings.build_pred_vectors(spark, PATH), ["id"]), want)


def test_time_zone_does_not_matter(spark):
    want = table(bindings.build_seq_log(spark, PATH), ["well_id", "row_idx"])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        pd.testing.assert_frame_equal(table(bindings.build_seq_log(spark, PATH), ["well_id", "row_idx"]), want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
