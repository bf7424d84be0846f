"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEQ_CTE = """
ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
    count(*) OVER (PARTITION BY user_id) AS n,
    min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us0,
    sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM events),
seq_log AS (SELECT CAST(user_id AS VARCHAR) AS well_id, row_idx, n, (us - us0) / 3600000000.0 AS md,
    (us - us0) / 3600000000.0 AS x, CAST(user_id AS DOUBLE) AS y, -value / 10 AS z,
    CASE WHEN event_id % 11 <> 0 THEN value END AS gr, 1000 + cum / 100 AS tvt,
    CASE WHEN row_idx < floor(0.6 * n) THEN 1000 + cum / 100 END AS tvt_input, event_type
  FROM ev)"""

CURVE_CTE = SEQ_CTE + """,
users AS (SELECT count(DISTINCT user_id) AS k FROM events),
ref_curve AS (SELECT CAST((CAST(well_id AS BIGINT) - 1 + k) % k AS VARCHAR) AS well_id, tvt, gr, event_type AS geology
  FROM seq_log, users WHERE gr IS NOT NULL)"""

FILL_CTE = """,
gaps AS (SELECT *, last_value(gr IGNORE NULLS) OVER p AS g0, last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER p AS i0,
    first_value(gr IGNORE NULLS) OVER f AS g1, first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER f AS i1
  FROM seq_log WINDOW p AS (PARTITION BY well_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING),
    f AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT * EXCLUDE (g0, i0, g1, i1), CASE WHEN gr IS NOT NULL THEN gr WHEN g0 IS NULL THEN g1 WHEN g1 IS NULL THEN g0
    ELSE g0 + (g1 - g0) * (row_idx - i0) / (i1 - i0) END AS grf FROM gaps)"""

SURFACE_CTE = """
surface_points AS (SELECT vec_id AS id, label AS grp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
    CAST(embedding[3] AS DOUBLE) AS s1, CAST(embedding[4] AS DOUBLE) AS s2, CAST(embedding[5] AS DOUBLE) AS s3,
    CAST(embedding[6] AS DOUBLE) AS s4, CAST(embedding[7] AS DOUBLE) AS s5, CAST(embedding[8] AS DOUBLE) AS s6
  FROM embeddings)"""

PRED_CTE = """
unit AS (SELECT l_returnflag, avg(l_extendedprice / l_quantity) AS unit FROM lineitem GROUP BY 1),
pred_vectors AS (SELECT concat(l_suppkey, '_', row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice) - 1) AS id,
    l_suppkey AS grp, l_extendedprice AS truth, l_quantity * p_retailprice AS a, l_quantity * unit AS b,
    avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS c, l_discount AS z
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN unit USING (l_returnflag))"""

IDS_CTE = """
sample_ids AS (SELECT o_orderkey AS id, o_orderkey AS pos FROM orders),
line_ids AS (SELECT l_orderkey AS id, sum(l_extendedprice) AS pred FROM lineitem GROUP BY 1)"""


# Values such as means of two-decimal prices often end exactly on a rounding edge, where
# the last bit of the sum decides. A shift far below the kept digits moves them off it.
SHIFT = 0.0137


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column; adding 0.0 turns a negative zero into zero."""
    shift = SHIFT * 10.0**-digits

    def one(name):
        return (F.round(F.col(name) + F.lit(shift), digits) + F.lit(0.0)).alias(name)

    return df.select(*[one(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(
    name: str,
    run: Callable[[SparkSession, str], DataFrame],
    sql: str | None = None,
    *,
    ctes: str = "",
    floats: str = "",
    digits: int = 5,
) -> None:
    """Register ``run``; ``sql`` is the SELECT over ``ctes``, ``floats`` its double columns."""
    QUERIES[name] = lambda spark, path: rounded(run(spark, path), digits)
    if sql is not None:
        shift = SHIFT * 10.0**-digits
        cols = ", ".join(f"round({c} + {shift!r}, {digits}) + 0.0 AS {c}" for c in floats.split())
        star = f"* REPLACE ({cols})" if cols else "*"
        head = f"WITH {ctes.strip()} " if ctes else ""
        ORACLES[name] = f"{head}SELECT {star} FROM ({sql.strip()}) AS answer"
