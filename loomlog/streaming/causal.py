"""Causal operators as streams: they use only rows up to the current one, so they can run
on logs that are still being written. State is small and kept per key. Rows that come late (before the
key's last (md, row)) are in the result with NULL values and ``late`` counted up, so none is lost without a trace."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _in_order(batches: Iterator[pd.DataFrame], md: str, row: str) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order of md and row; the trigger bounds their number."""
    parts = list(batches)
    return pd.concat(parts).sort_values([md, row], kind="stable", ignore_index=True) if parts else pd.DataFrame()


def st_slope_clip(stream: DataFrame, value: str, start: str, start_md: str, limit: float, key: str = "well_id", md: str = "md", row: str = "row_idx") -> DataFrame:
    """Streaming form of ``causal_slope_clip``. Rows before the key's last (md, row) are late: they come out with a NULL value and
    are counted (``late`` is the count so far); rows of equal md are kept."""

    def run(k, batches, state):
        prev, prev_md, prev_row, late = state.get if state.exists else (None, None, None, 0)
        pdf = _in_order(batches, md, row)
        out = []
        for r, x, m, s, s_md in zip(pdf[row], pdf[value], pdf[md], pdf[start], pdf[start_md]):
            if prev is None:
                prev, prev_md = float(s), float(s_md)
            elif (m, r) < (prev_md, prev_row):
                late += 1
                out.append((k[0], int(r), None, late))
                continue
            reach = limit * max(abs(m - prev_md), 1e-6)
            prev = float(min(max(x, prev - reach), prev + reach))
            prev_md, prev_row = float(m), int(r)
            out.append((k[0], int(r), prev, late))
        state.update((prev, prev_md, prev_row, late))
        yield pd.DataFrame(out, columns=[key, row, "limited", "late"])

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} string, {row} bigint, limited double, late bigint", "prev double, prev_md double, prev_row bigint, late bigint", "append", "NoTimeout"
    )


def st_trailing(stream: DataFrame, value: str, window: int = 25, key: str = "well_id", md: str = "md", row: str = "row_idx") -> DataFrame:
    """Streaming form of ``rolling_trailing`` (mean, sample std, min, max) and the last known
    target so far; late rows as in ``st_slope_clip``. State: the last ``window`` values and the anchor."""
    floor = max(5, window // 5)

    def run(k, batches, state):
        kept, anchor, seen, seen_row, late = state.get if state.exists else ([], None, None, None, 0)
        ring = deque(kept, maxlen=window)
        out = []
        for _, r in _in_order(batches, md, row).iterrows():
            if seen is not None and (r[md], r[row]) < (seen, seen_row):
                late += 1
                out.append((k[0], int(r[row]), *[None] * 5, late))
                continue
            seen, seen_row = float(r[md]), int(r[row])
            ring.append(float(r[value]) if pd.notna(r[value]) else None)
            if pd.notna(r["tvt_input"]):
                anchor = float(r["tvt_input"])
            x = np.array([v for v in ring if v is not None])
            enough = len(x) >= floor
            out.append((k[0], int(r[row]), *((float(x.mean()), float(x.std(ddof=1)), float(x.min()), float(x.max())) if enough else (None, 0.0, None, None)), anchor, late))
        state.update((list(ring), anchor, seen, seen_row, late))
        yield pd.DataFrame(out, columns=[key, row, "t_mean", "t_std", "t_min", "t_max", "last_tvt", "late"])

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} string, {row} bigint, t_mean double, t_std double, t_min double, t_max double, last_tvt double, late bigint", "kept array<double>, anchor double, seen double, seen_row bigint, late bigint", "append", "NoTimeout"
    )


def st_gap_monitor(stream: DataFrame, value: str, ts: str = "ts", key: str = "well_id", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows, missing rows and missing rate per key and event-time window; a window is emitted
    when the watermark has passed its end."""
    gone = F.count_if(F.col(value).isNull())
    agg = stream.withWatermark(ts, delay).groupBy(F.window(ts, width), key).agg(F.count("*").alias("rows"), gone.alias("missing"), (gone / F.count("*")).alias("missing_rate"))
    return agg.select(key, F.unix_micros(F.col("window.start").cast("timestamp")).alias("start_us"), "rows", "missing", "missing_rate")


def st_gap_runs(stream: DataFrame, value: str, key: str = "well_id", md: str = "md", row: str = "row_idx") -> DataFrame:
    """Length of the current run of missing values at every row; late rows as in ``st_slope_clip``."""

    def run(k, batches, state):
        length, seen, seen_row, late = state.get if state.exists else (0, None, None, 0)
        out = []
        for _, r in _in_order(batches, md, row).iterrows():
            if seen is not None and (r[md], r[row]) < (seen, seen_row):
                late += 1
                out.append((k[0], int(r[row]), None, late))
                continue
            seen, seen_row = float(r[md]), int(r[row])
            length = length + 1 if pd.isna(r[value]) else 0
            out.append((k[0], int(r[row]), length, late))
        state.update((length, seen, seen_row, late))
        yield pd.DataFrame(out, columns=[key, row, "run_length", "late"]).astype({"run_length": "Int64"})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, {row} bigint, run_length bigint, late bigint", "length bigint, seen double, seen_row bigint, late bigint", "append", "NoTimeout")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over the files that are there now into a written table, and read it."""
    import uuid

    from loomlog.plans.stage import stage_dir

    spark = stream.sparkSession
    base = f"{stage_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def as_stream(table: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """File stream over a copy of a table, as a landing folder of finished files."""
    import uuid

    from loomlog.plans.stage import stage_dir

    spark = table.sparkSession
    path = f"{stage_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    table.write.parquet(path)
    reader = spark.readStream.schema(table.schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(path)
