"""Recursions take many short keys in one task call."""

import numpy as np
from logs import hot_log, to_spark

from loomlog import workflows
from loomlog.operators import align
from loomlog.plans import recursion


def counted(spark, rows, side, monkeypatch, lone=1 << 16, chunk=1 << 15):
    monkeypatch.setattr(recursion, "LONE_ROWS", lone)
    calls = spark.sparkContext.accumulator(0)
    groups = recursion._groups

    def step(k, part, ref, state):
        before = state or 0.0
        sums = before + np.cumsum(part["v"])
        return {"i": part["i"], "sum": sums + ref["w"].sum() if len(ref.get("w", ())) else sums}, float(sums[-1])

    def seen(t, by, order=None, down=False):
        if order:
            calls.add(1)
        return groups(t, by, order, down)

    monkeypatch.setattr(recursion, "_groups", seen)
    got = recursion.recursed(rows, side, ["k"], "i", recursion.one_by_one(step), "k string, i bigint, sum double", chunk)
    return {(r.k, r.i): r["sum"] for r in got.collect()}, calls.value


def test_short_keys_share_a_call_and_a_long_curve_does_not(spark, monkeypatch):
    rows = spark.range(600).selectExpr("concat('k', id % 200) AS k", "id div 200 AS i", "double(id % 7) AS v")
    side = spark.range(90).selectExpr("if(id < 50, 'k7', concat('k', id)) AS k", "1D AS w")
    want = {}
    for k in range(200):
        ref = 50.0 if k == 7 else 1.0 if 50 <= k < 90 else 0.0
        for i in range(3):
            want[f"k{k}", i] = sum((j * 200 + k) % 7 for j in range(i + 1)) + ref
    got, calls = counted(spark, rows, side, monkeypatch)
    assert got == want and calls == 1
    got, calls = counted(spark, rows, side, monkeypatch, lone=40)
    assert got == want and calls == 2


def test_keys_of_one_and_of_several_chunks_give_the_same(spark, monkeypatch):
    rows = spark.range(60).selectExpr("if(id < 50, 'long', concat('s', id)) AS k", "if(id < 50, id, 0) AS i", "double(id) AS v")
    side = spark.createDataFrame([], "k string, w double")
    assert counted(spark, rows, side, monkeypatch, chunk=8)[0] == counted(spark, rows, side, monkeypatch)[0]


def test_logs_without_a_curve_hold_their_last_value(spark):
    log = to_spark(spark, hot_log(seed=3, keys=2, small=31))
    curve = spark.createDataFrame([], "well_id string, row_idx long, tvt double, gr double, geology string")
    tracks, _ = align.pf_track(log, curve, workflows.tracker_start(log, curve).fillna(1.0), 8, 2)
    assert tracks.where("tvt IS NULL").count() == 0
    assert align.dtw_stochastic(log, curve, 3, 2, 0.3, 1).where("mean_tvt IS NOT NULL").count() == 0


def test_keys_of_a_call_are_taken_side_by_side():
    order, left = recursion.side_by_side([2, 5, 1, 5])
    assert order.tolist() == [1, 3, 0, 2] and left == [4, 3, 2, 2, 2]


def test_tiles_of_short_keys_share_a_call(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    groups = recursion._groups

    def seen(t, by, order=None, down=False):
        calls.add(1)
        return groups(t, by, order, down)

    monkeypatch.setattr(recursion, "_groups", seen)
    q = spark.range(300).selectExpr("concat('k', id % 100) AS k", "id div 100 AS i", "double(id) AS v")
    t = spark.range(200).selectExpr("concat('k', id % 50) AS k", "id div 50 AS j", "double(id) AS w")

    def match(qc, tc, a, b):
        return {"i": a["i"], "s": a["v"] + b["w"].sum()}

    got = recursion.tiled(q, t, match, "k string, i bigint, s double", key="k", q_pos="i", t_pos="j", q_size=2, t_size=8)
    assert {(r.k, r.i, r.s) for r in got.collect()} == {(f"k{n}", i, float(i * 100 + n + sum(j * 50 + n for j in range(4)))) for n in range(50) for i in range(3)}
    assert calls.value == 2
