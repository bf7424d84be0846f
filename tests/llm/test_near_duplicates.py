import random
import re

import numpy as np
import tables
from pyspark.sql import functions as F
from oracle_check import compare, connect

from loomlog.llm import near_duplicates as M

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    found = [grams(x) for _, x in rows]
    n = len(rows)
    linked = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = found[i], found[j]
            same = (rows[i][1] or "") == (rows[j][1] or "") if not a and not b else False
            linked[i][j] = i != j and (same or bool(a and b) and len(a & b) * 5 >= 4 * len(a | b))
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(n):
            if linked[i][j]:
                parent[top(i)] = top(j)
    first = {}
    for i in range(n):
        first[top(i)] = min(first.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], first[top(i)], sum(linked[i])) for i in range(n))


def groups(rng):
    rows, i = [], 0
    for size in (1, 2, 5, 40):
        text = tables.prose(rng, 120).split()
        for k in range(size):
            own = list(text)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = "edit%d" % rng.randrange(1000)
            rows.append((i := i + 1, " ".join(own)))
    for _ in range(30):
        rows.append((i := i + 1, tables.prose(rng, rng.randrange(1, 90))))
    rows += [(i := i + 1, rows[k][1].upper()) for k in (0, 3, 10)] + [(i + 1, ""), (i + 2, "one two"), (i + 3, "One, two"), (i + 4, ""), (i + 5, " ")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = groups(random.Random(1))
    for tile in (300, 1 << 19):  # many tiles per component, and one
        monkeypatch.setattr(M, "TILE", tile)
        got = M.join(tables.documents(spark, rows)).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_intersections():
    rng = np.random.default_rng(1)
    for high in (30, 3000):
        a = [np.unique(rng.integers(0, high, 40).astype(np.uint64)) for _ in range(50)]
        b = [np.unique(rng.integers(0, high, 40).astype(np.uint64)) for _ in range(70)]
        assert (M.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_banding_reaches_the_recall():
    bands, rows = M.banding()
    assert bands * rows <= M.MOST_HASHES and 1 - (1 - M.SIMILARITY**rows) ** bands >= M.RECALL


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    names = {r.key: r.component for r in M.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert names == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_oddities(spark):
    rows = tables.odd_rows(random.Random(2))
    df = tables.documents(spark, rows)
    got = M.join(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].class_id == by_id[4].class_id == by_id[9].class_id == 3 and by_id[9].n_links == 2 and by_id[9].n_texts == 1
    kept = M.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect() if r.doc_id in (3, 4, 7, 8, 9, 6)) == sorted((repr(i), x) for i, x in {(3, rows[4][1]), (6, rows[7][1]), *[r for r in rows if r[0] == 7], (8, "twice")})
    assert M.join(tables.documents(spark, [])).count() == 0 and M.keep_one(tables.documents(spark, [])).count() == 0


def test_a_third_without_an_id(spark):
    """Such rows are found one by one: looking their texts up again makes as many rows as there are, and the links are those of rows with ids."""
    rows = groups(random.Random(5))
    gone = [(None if k % 3 == 0 else i, x) for k, (i, x) in enumerate(rows)]
    links = [sorted(r.n_links for r in M.join(tables.documents(spark, own)).collect()) for own in (rows, gone)]
    assert links[0] == links[1]
    df = M.docs.texts(tables.documents(spark, gone))
    wanted = df.select(M._row_hash().alias("row"), F.lit(1).alias("key")).distinct()
    assert M._rows_of(df, wanted).count() == len(gone)


def test_any_column_comes_along(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words")]
    df = tables.documents(spark, rows).withColumns({c: F.lit("own") for c in ("row", "row_", "__row", "own", "asked")})
    kept = M.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["row"], r["__row"]) for r in kept.collect()) == [(1, "own", "own"), (3, "own", "own")]


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    assert compare(M.op4(spark, path), connect(path), M.OP4_SQL).startswith("ok")
