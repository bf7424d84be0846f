"""Small logs for the tests: one key holds a third of all rows."""

import numpy as np
import pandas as pd


def hot_log(seed=1, keys=5, small=23, gaps=0.15):
    rng = np.random.default_rng(seed)
    sizes = [small] * keys + [small * keys // 2]
    parts = []
    for k, n in enumerate(sizes):
        md = np.cumsum(rng.uniform(0.5, 2.0, n))
        gr = rng.normal(60, 20, n).round(2)
        gr[rng.random(n) < gaps] = np.nan
        tvt = 1000 + np.cumsum(rng.uniform(0.05, 1.0, n))
        known = int(0.6 * n)
        parts.append(pd.DataFrame({"well_id": f"k{k}", "row_idx": np.arange(n), "md": md, "x": md * 0.7, "y": md * 0.1 + k, "z": rng.normal(-5, 1, n), "gr": gr, "tvt": tvt,
                                   "tvt_input": np.where(np.arange(n) < known, tvt, np.nan)}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType

    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def curve_of(seed=2, keys=6, n=40):
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(keys):
        tvt = 998 + np.cumsum(rng.uniform(0.1, 1.2, n))
        parts.append(pd.DataFrame({"well_id": f"k{k}", "tvt": tvt, "gr": rng.normal(60, 20, n), "geology": rng.choice(list("abc"), n)}))
    return pd.concat(parts, ignore_index=True)
