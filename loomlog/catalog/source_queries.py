"""Sources, ids and scalar expressions."""

from __future__ import annotations

import uuid
from math import pi

from pyspark.sql import functions as F

from loomlog.bindings import pred_vectors, ref_curve, seq_log, table
from loomlog.catalog.registry import CURVE_CTE, PRED_CTE, SEQ_CTE, query
from loomlog.functions import exprs as x
from loomlog.operators import ids
from loomlog.plans.stage import stage_dir
from loomlog.sources import files as io

_SPLIT = "CASE WHEN list_has_any(string_split(lower(url), '/'), ['fr', 'es']) THEN 'train' WHEN list_has_any(string_split(lower(url), '/'), ['en', 'de']) THEN 'test' ELSE 'unknown' END"


def page_paths(s, d):
    return table(s, d, "pages").select("page_id", F.col("url").alias("path"), io.infer_split(F.col("url"), ("fr", "es"), ("en", "de")).alias("split"))


query("infer_split", lambda s, d: page_paths(s, d), f"SELECT page_id, url AS path, {_SPLIT} AS split FROM pages")


def sides(s, d):
    p = page_paths(s, d).withColumn("well_id", (F.col("page_id") % 90).cast("string"))
    return p.where("page_id % 2 = 0"), p.where("page_id % 3 = 0")


query("pair_logs_curves", lambda s, d: io.pair_logs_curves(*sides(s, d)),
      f"""SELECT a.split, a.well_id, log_path, curve_path FROM (SELECT {_SPLIT} AS split, CAST(page_id % 90 AS VARCHAR) AS well_id, max(url) AS log_path FROM pages WHERE page_id % 2 = 0 GROUP BY 1, 2) a
      LEFT JOIN (SELECT {_SPLIT} AS split, CAST(page_id % 90 AS VARCHAR) AS well_id, max(url) AS curve_path FROM pages WHERE page_id % 3 = 0 GROUP BY 1, 2) b ON a.split = b.split AND a.well_id = b.well_id""")
query("column_summary", lambda s, d: io.column_summary(seq_log(s, d).select("well_id", "row_idx", "md", "gr", "tvt_input"), 50),
      """SELECT unnest(['well_id', 'md', 'gr', 'tvt_input']) AS "column", unnest(['string', 'double', 'double', 'double']) AS dtype,
      unnest([0.0, 0.0, 1 - count(gr) / count(*), 1 - count(tvt_input) / count(*)])::DOUBLE AS missing FROM seq_log WHERE row_idx < 50""", ctes=SEQ_CTE, floats="missing")
query("project_read", lambda s, d: table(s, d, "lineitem").where("l_shipdate < '1998-01-01'").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty")),
      "SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1", floats="qty", digits=2)
query("tail_fraction", lambda s, d: io.tail_fraction(seq_log(s, d)),
      "SELECT quantile_cont(f, 0.5) AS tail_fraction FROM (SELECT 1 - count(tvt_input) / count(*) AS f FROM seq_log GROUP BY well_id)", ctes=SEQ_CTE, floats="tail_fraction")
query("sample_every_nth_key", lambda s, d: io.sample_keys(seq_log(s, d), 3).groupBy("well_id").agg(F.count("*").alias("rows")),
      "SELECT well_id, count(*) AS rows FROM (SELECT *, dense_rank() OVER (ORDER BY well_id) - 1 AS r FROM seq_log) WHERE r % 3 = 0 GROUP BY 1", ctes=SEQ_CTE)


def holdout(s, d):
    return io.synthetic_holdout(seq_log(s, d), ref_curve(s, d), 10, 0.72, 40, "204")


query("synthetic_holdout_dataset", lambda s, d: holdout(s, d)[1],
      """SELECT concat(well_id, '_', row_idx) AS id, tvt FROM seq_log JOIN (SELECT well_id, k - t AS cut FROM (SELECT well_id, count(*) AS k, CAST(round_even(count(*) * 0.72, 0) AS BIGINT) AS t FROM seq_log GROUP BY 1)
      WHERE t >= 40 AND well_id IN (SELECT well_id FROM ref_curve) ORDER BY md5(concat(well_id, '204')), well_id LIMIT 10) USING (well_id) WHERE row_idx >= cut""", ctes=CURVE_CTE, floats="tvt")

query("parse_row_id", lambda s, d: pred_vectors(s, d).select("id", x.row_key(F.concat(F.lit("a_"), "id")).alias("key"), x.row_number_of(F.col("id")).alias("row")),
      "SELECT id, concat('a_', regexp_extract(id, '^(.+)_(\\d+)$', 1)) AS key, CAST(regexp_extract(id, '^(.+)_(\\d+)$', 2) AS BIGINT) AS row FROM pred_vectors", ctes=PRED_CTE)
query("make_row_id", lambda s, d: seq_log(s, d).select(x.make_row_id(F.col("well_id"), F.col("row_idx")).alias("id")), "SELECT concat(well_id, '_', row_idx) AS id FROM seq_log", ctes=SEQ_CTE)
query("nan_guard", lambda s, d: table(s, d, "events").select("event_id", x.finite(F.expr("CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN double('-Infinity') ELSE value END")).alias("v")),
      "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events", floats="v")
query("math_scalars",
      lambda s, d: seq_log(s, d).select("well_id", "row_idx", F.hypot("x", "z").alias("dist"), F.sin(F.atan2("z", "x")).alias("az_sin"), F.pmod(F.degrees(F.atan2("z", "x")), F.lit(360.0)).alias("deg"),
                                        F.log1p("md").alias("lg"), F.sin(F.col("row_idx") / F.col("n") * pi).alias("sw"), F.exp(-F.col("md") / 85).alias("fade"), x.clip(F.col("z"), -3.0, -1.0).alias("cl"), F.pow(F.col("md"), 1.5).alias("pw")),
      """SELECT well_id, row_idx, sqrt(x*x + z*z) AS dist, sin(atan2(z, x)) AS az_sin, (degrees(atan2(z, x)) + 360) % 360 AS deg, ln(1 + md) AS lg, sin(pi() * row_idx / n) AS sw, exp(-md / 85) AS fade,
      greatest(-3, least(-1, z)) AS cl, pow(md, 1.5) AS pw FROM seq_log""", ctes=SEQ_CTE, floats="dist az_sin deg lg sw fade cl pw")
query("stable_seed", lambda s, d: seq_log(s, d).select("well_id").distinct().select("well_id", x.stable_seed(F.col("well_id"), 42).alias("seed")),
      "SELECT DISTINCT well_id, (CAST(concat('0x', substr(md5(well_id), 1, 8)) AS BIGINT) + 42) % 2147483647 AS seed FROM seq_log", ctes=SEQ_CTE)
query("fingerprint", lambda s, d: ids.fingerprint(pred_vectors(s, d).withColumn("pred", F.round("a", 2)), digits=2))
query("fallback_fill",
      lambda s, d: ids.fallback_fill(pred_vectors(s, d).withColumns({"p": F.when(F.col("z") > 0.05, F.col("a")), "l": F.when(F.col("z") > 0.02, F.col("c")), "dl": F.col("b") - F.col("c")}), "p", "l", "dl").select("id", "filled"),
      """SELECT id, coalesce(CASE WHEN z > 0.05 THEN a END, CASE WHEN z > 0.02 THEN c END, mean) AS filled FROM pred_vectors CROSS JOIN scalars""", ctes=PRED_CTE + ", scalars AS MATERIALIZED (SELECT avg(CASE WHEN z > 0.02 THEN c END) + avg(b - c) AS mean FROM pred_vectors)", floats="filled", digits=3)


def folder(s) -> str:
    """A fresh place for files a query writes and reads back."""
    return f"{stage_dir(s).rstrip('/')}/files-{uuid.uuid4().hex}"


def one_file_each(df, by: str, path: str) -> None:
    """CSV, a folder and a file per value of ``by``; tasks move their files themselves, as there are as many as logs."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism  # the work is in the files, however small they are
    df.repartition(tasks, by).write.partitionBy(by).option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path)


def csv_logs(s, d):
    """The logs as CSV, one folder per log named like its file, below train and test."""
    root = folder(s)
    log = seq_log(s, d).select(F.concat("well_id", F.lit("__horizontal_well.csv")).alias("log"), F.col("md").alias("MD"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"),
                               F.col("gr").alias("GR"), F.col("tvt").alias("TVT"), F.col("tvt_input").alias("TVT_input"))
    for split, cond in (("train", "Y % 3 <> 0"), ("test", "Y % 3 = 0")):
        one_file_each(log.where(cond), "log", f"{root}/{split}")
    return io.scan_logs(s, root, glob="part-*.csv", name=r"log=([^/]+?)__horizontal_well\.csv/")


def csv_curves(s, d):
    root = folder(s)
    name = F.concat("well_id", F.lit("__typewell"), F.when(F.col("well_id").cast("bigint") % 2 == 0, F.concat(F.lit("__c"), "well_id")).otherwise(""), F.lit(".csv"))
    curve = ref_curve(s, d).select(name.alias("curve"), F.col("tvt").alias("TVT"), F.col("gr").alias("GR"), F.col("geology").alias("Geology"))
    one_file_each(curve, "curve", f"{root}/train")
    return io.scan_curves(s, root, glob="part-*.csv", name=r"curve=([^/]+?)__typewell(?:__([^/]+?))?\.csv/")


query("scan_logs", csv_logs, "SELECT CASE WHEN y % 3 = 0 THEN 'test' ELSE 'train' END AS split, well_id, row_idx, md, x, y, z, gr, tvt, tvt_input FROM seq_log", ctes=SEQ_CTE, floats="md x y z gr tvt tvt_input")
query("scan_curves", csv_curves, "SELECT 'train' AS split, well_id, CASE WHEN CAST(well_id AS BIGINT) % 2 = 0 THEN concat('c', well_id) ELSE well_id END AS curve_id, tvt, gr, geology FROM ref_curve", ctes=CURVE_CTE, floats="tvt gr")
query("canonicalize", lambda s, d: io.canonicalize(seq_log(s, d).withColumnsRenamed({"md": " Measured-Depth ", "gr": "Gamma/Ray", "z": "TVD", "tvt_input": "TVT_Input"}), ("md", "gr", "z")),
      "SELECT md, x, y, z, gr, tvt, tvt_input FROM seq_log", ctes=SEQ_CTE, floats="md x y z gr tvt tvt_input")
query("extra_numeric", lambda s, d: io.extra_numeric(table(s, d, "events").withColumns({"Half-Id": (F.col("event_id") / 2).cast("string"), "nothing": F.lit(None).cast("string")}).drop("ts"), ["event_id"]),
      "SELECT event_id, CAST(user_id AS DOUBLE) AS raw_user_id, value AS raw_value, event_id / 2 AS raw_half_id FROM events", floats="raw_user_id raw_value raw_half_id")


def written(s, d):
    path = folder(s)
    preds = pred_vectors(s, d).select("id", F.round("a", 4).alias("tvt"))
    io.write_predictions(preds, pred_vectors(s, d).select("id", F.col("grp").alias("pos")), path)
    return s.read.schema("id string, tvt double").option("header", True).csv(path)


query("write_predictions", written, "SELECT id, a AS tvt FROM pred_vectors", ctes=PRED_CTE, floats="tvt", digits=3)


def reported(s, d):
    path = folder(s)
    io.write_report(pred_vectors(s, d).groupBy("grp").agg(F.count("*").alias("rows"), F.avg("truth").alias("mean")), path)
    return s.read.schema("grp bigint, rows bigint, mean double").json(path)


query("write_report", reported, "SELECT grp, count(*) AS rows, avg(truth) AS mean FROM pred_vectors GROUP BY 1", ctes=PRED_CTE, floats="mean", digits=3)


def cached(s, d):
    path = folder(s)
    io.cached_table(s, path, lambda: pred_vectors(s, d).select("id", "grp", "a"))
    return io.cached_table(s, path, lambda: None)


query("csv_to_parquet_cache", cached, "SELECT id, grp, a FROM pred_vectors", ctes=PRED_CTE, floats="a", digits=3)
