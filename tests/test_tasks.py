"""Tasks keep their size as tables grow."""

from loomlog.operators import align
from loomlog.plans import stage


def test_number_of_tasks_follows_the_rows(spark):
    df = spark.range(100)
    cores = spark.sparkContext.defaultParallelism
    assert stage.in_tasks(df, 100, "id").rdd.getNumPartitions() == cores
    assert stage.in_tasks(df, 100, "id", each=2).rdd.getNumPartitions() == 50


def test_seeds_are_blended_in_tasks_of_bounded_size(spark, monkeypatch):
    seen = []
    real = align.in_tasks
    monkeypatch.setattr(align, "in_tasks", lambda df, rows, *by, **kw: seen.append((rows, by)) or real(df, rows, *by, **kw))
    tracks = spark.range(30).selectExpr("'a' AS well_id", "id div 3 AS row_idx", "int(id % 3) AS seed", "double(id) AS tvt")
    ll = spark.range(3).selectExpr("'a' AS well_id", "int(id) AS seed", "-1D AS loglik")
    got = align.pf_ensemble(tracks, ll)
    assert seen == [(30, ("well_id", "row_idx"))]
    assert {(r.row_idx, r.pf_mean, r.pf_3) for r in got.collect()} == {(i, 3.0 * i + 1, 3.0 * i + 1) for i in range(10)}
