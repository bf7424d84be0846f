import random
import zlib

import numpy as np
import pytest
import tables

from loomlog.llm import toxicity as M


@pytest.mark.parametrize("n", [1, 10, 300])
def test_nearest_equals_all_cosines(n, monkeypatch):
    monkeypatch.setattr(M, "PER_BLOCK", 8)
    monkeypatch.setattr(M, "COMMON", 12)
    rng = np.random.default_rng(n)
    examples = []
    for i in range(n):
        numbers = np.flatnonzero(rng.random(50) < 0.1)
        examples.append((i, int(rng.random() < 0.3), numbers, rng.integers(1, 5, len(numbers))))
    index = M.build(np.arange(50, dtype=np.uint64), rng.integers(1, 100, 50).astype(float), 500, examples)
    q = np.where(rng.random((40, 50)) < 0.15, rng.random((40, 50)), 0).astype(np.float32)
    q /= np.maximum(np.sqrt((q * q).sum(1, keepdims=True)), 1e-9)
    whole = index.whole
    order = {key: (numbers, tf) for key, _, numbers, tf in examples}
    for place, key in enumerate(index.ids):  # the index holds each example's own weights
        numbers, tf = order[key]
        want = np.zeros(50)
        want[numbers] = (1 + np.log(tf)) * index.idf[numbers]
        assert np.allclose(whole[:, place], want / max(np.sqrt(want @ want), 1e-9), atol=1e-6)
    cosines, who = index.nearest(q, 7)
    want = -np.sort(-(q @ whole), axis=1)[:, : min(7, n)]
    assert np.allclose(cosines, want, atol=1e-5)
    assert np.allclose(np.take_along_axis(q @ whole, who, 1), want, atol=1e-5)
    skipped = np.arange(40) % n
    left = (q @ whole)
    left[np.arange(40), skipped] = -1
    cosines, who = index.nearest(q, 7, skipped)
    assert np.allclose(cosines, np.maximum(-np.sort(-left, axis=1)[:, : min(7, n)], 0), atol=1e-5) and (n < 8 or (who != skipped[:, None]).all())


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = tables.prose(rng, rng.randrange(20, 80)).split()
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "scummy", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_oddities(spark):
    rng = random.Random(1)
    rows, labels = labelled(rng, 600)
    odd = [(i if i is None else i + 10_000, x) for i, x in tables.odd_rows(rng)]
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (10_005, None)], "doc_id long, toxic int")
    df = tables.documents(spark, rows + odd)
    index = M.fit(df, known)
    got = M.scores(df, index).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    right = [(score[i] >= 0.5) == bool(y) for i, y in labels if held_out(i)]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert not {int(i) for i in index.ids} & {i for i, _ in labels if held_out(i)}
    kept = M.clean(df, index)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.score < 0.5)
    assert M.scores(tables.documents(spark, []), index).count() == 0


def test_without_labels_all_get_the_prior(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = tables.documents(spark, [(1, "a b c"), (2, None)])
    got = M.scores(df, M.fit(df, none)).collect()
    assert len({r.score for r in got}) == 1
    same = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert M.clean(df, M.fit(df, same)).count() == 2


def test_sample_is_bounded(spark):
    rows, labels = labelled(random.Random(2), 200)
    index = M.fit(tables.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), examples=50, n_terms=30)
    assert len(index.labels) == 50 and len(index.vocabulary) <= 30


def test_terms_that_tell_no_labels_apart_are_indexed(spark):
    rows, labels = labelled(random.Random(3), 300)
    rare = "quagga zeppelin fjord"  # each in one labelled row only: no chi-squared to speak of, the only terms of their text
    own = next(i for i in range(1000, 1100) if not held_out(i))
    df = tables.documents(spark, [*rows, (own, rare), (5000, rare), (5001, "unheard")])
    index = M.fit(df, spark.createDataFrame([*labels, (own, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in M.scores(df, index).collect()}
    assert got[5000].evidence.startswith(f"{own}:1.0000:1") and got[5000].score == got[own].score > M.UNKNOWN
    assert got[5001].evidence == "" and got[5001].score <= M.UNKNOWN
