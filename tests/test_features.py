"""Row features: the same values as the operators one after another, with few bytes moved."""

import time

import numpy as np
import pytest
from logs import curve_of, hot_log, to_spark
from pyspark.sql import functions as F

from loomlog import workflows as wf
from loomlog.operators import curves, prefix, sequence
from loomlog.plans.blocks import Seq
from loomlog.plans.stage import staged

CUT = Seq(rows=57)  # the longest window reaches 50 rows


def one_by_one(log, curve, seq):
    rows = sequence.interpolate_linear(sequence.row_position(log, seq=seq), {"gr": "grf"}, seq=seq)
    rows = sequence.gradient_md(staged(sequence.rolling_centered(rows, "grf", seq=seq)), wf.GRADS, seq=seq)
    rows = staged(sequence.xy_geometry(sequence.from_start_deltas(rows, seq=seq), seq=seq))
    rows = prefix.linear_prior(sequence.ffill_bfill(rows, {"tvt_input": "tvt_input_ffill"}, seq=seq), seq=seq)
    rows = rows.withColumn("gr_missing", F.col("gr").isNull().cast("double"))
    if curve is None:
        return rows
    rows = curves.curve_interp(rows, curve, "linear_prior", "curve_gr_at_prior", key=seq.key)
    return curves.curve_bounds_clip(rows, curve, "linear_prior", seq.key)


@pytest.mark.parametrize("seq", [CUT, Seq()])
@pytest.mark.parametrize("with_curve", [True, False])
def test_features_equal_the_operators_one_by_one(spark, seq, with_curve):
    pdf = hot_log(keys=4, small=70)
    pdf.loc[pdf["well_id"] == "k1", "md"] = 3.0  # md that does not move
    pdf.loc[pdf["well_id"] == "k2", ["gr", "tvt_input"]] = np.nan  # nothing known
    pdf.loc[(pdf["well_id"] == "k3") & (pdf["row_idx"] == 0), ["x", "md"]] = np.nan
    log, curve = staged(to_spark(spark, pdf)), curve_of(keys=3) if with_curve else None  # k3 and k4 have no curve
    curve = staged(spark.createDataFrame(curve)) if with_curve else None
    got, want = wf.build_features(log, curve, seq=seq), one_by_one(log, curve, seq)
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = (df.toPandas().sort_values(["well_id", "row_idx"], ignore_index=True) for df in (got, want))
    assert len(a) == len(pdf)
    for c in a.columns:
        assert a[c].equals(b[c]) or np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-12, equal_nan=True), c


def shuffled(spark):
    """Bytes all tasks have written to shuffles so far; the listener that counts them lags a little."""
    def now():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    seen = -1
    while seen != now():
        seen = now()
        time.sleep(0.5)
    return seen


def test_features_move_few_bytes_a_row(spark):
    from loomlog.bindings import ref_curve, seq_log

    log, curve = seq_log(spark, "/root/testdata/sf0.1"), staged(ref_curve(spark, "/root/testdata/sf0.1"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins move as many rows as over tables too large to broadcast
    try:
        start = shuffled(spark)
        wf.build_features(log, curve).write.format("noop").mode("overwrite").save()
        moved = (shuffled(spark) - start) / log.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert moved < 700
