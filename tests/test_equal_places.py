"""Equal places are asked once."""

from pyspark.sql import functions as F

from loomlog.operators import spatial


def test_neighbours_are_sought_once_per_place_and_group(spark, monkeypatch):
    asked = []
    real = spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda queries, *a, **kw: asked.append(queries.count()) or real(queries, *a, **kw))
    points = spark.range(120).selectExpr("id", "int(id % 3) AS grp", "double(id % 12) AS x", "double(id % 4) AS y", "double(id) AS v")
    got = spatial.knn(points, points, 2, carry=["v"], scaled=False)
    assert asked == [12]
    every = points.crossJoin(points.select(F.col("id").alias("p"), F.col("grp").alias("pg"), F.col("x").alias("px"), F.col("y").alias("py"))).where("grp <> pg")
    want = {}
    for r in every.collect():
        want.setdefault(r.id, []).append((((r.x - r.px) ** 2 + (r.y - r.py) ** 2) ** 0.5, r.p))
    want = {(i, rank, d, p) for i, all_ in want.items() for rank, (d, p) in enumerate(sorted(all_)[:2], 1)}
    assert {(r.id, r["rank"], r.dist, r.p_id) for r in got.collect()} == want
