"""Surface priors look each different place up once."""

import numpy as np

from loomlog import workflows as wf


def test_rows_at_one_place_ask_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(i, i % 6, *map(float, rng.normal(size=2)), float(rng.normal()), float(rng.normal())) for i in range(120)], "id long, grp long, x double, y double, s1 double, s2 double")
    places = {k: (k % 6, *map(float, rng.normal(size=2))) for k in range(4)}
    rows = [(f"k{k}", i, *places[k], float(i), -1.0, 10.0 + i, 10.0 + i if i < 15 else None) for k in places for i in range(30)]
    log = spark.createDataFrame(rows, "well_id string, row_idx long, grp long, x double, y double, md double, z double, tvt double, tvt_input double")
    asked, knn = [], wf.spatial.knn
    monkeypatch.setattr(wf.spatial, "knn", lambda q, *a, **k: asked.append(q.count()) or knn(q, *a, **k))
    got = {(r.k, r.surface): r.rmse for r in wf.eval_surface_priors(log, pts, ["s1", "s2"], [3, 8], dense=True).collect()}
    assert asked == [4]  # 120 rows
    # a level that is constant along a log is taken up by its bias: z is constant too, so the median offset is left
    want = np.sqrt(np.mean([(10.0 + i - np.median(10.0 + np.arange(15))) ** 2 for i in range(15, 30)]))
    assert set(got) == {(3, "s1"), (3, "s2"), (8, "s1"), (8, "s2")} and np.allclose(list(got.values()), want)
