import hashlib
import random
import re

import pytest
import tables
from oracle_check import compare, connect

from loomlog.llm import contamination as M

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items, window):
    own = WORD.findall((text or "").lower())
    hit, found = set(), set()
    for item, other in items:
        words = WORD.findall((other or "").lower())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            win = words[k : k + window]
            for i in range(len(own) - len(win) + 1):
                if own[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_against_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    texts = [(i, " ".join(rng.choice(["a", "B", "c,", "dé", "e"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    items = [(k, " ".join(rng.choice(["a", "b", "c", "dé", "e"]) for _ in range(rng.randrange(14)))) for k in range(25)] + [(None, "a b"), (99, None), (100, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(M, "LANE", 7)
    monkeypatch.setattr(M, "BLOCK", 20)  # several broadcast blocks
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in M.occurrences(tables.documents(spark, texts), benchmark, window).collect()}
    assert got == {i: brute(x, items, window) for i, x in texts}


def test_oddities(spark):
    rows = tables.odd_rows(random.Random(1))
    benchmark = spark.createDataFrame([(7, "three four five six seven eight nine ten eleven TWELVE"), (8, "One two three FOUR five six seven eight nine ten and more"), (9, "twice")], "item_id long, text string").withColumnRenamed("text", "text")
    got = M.occurrences(tables.documents(spark, rows), benchmark).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_hit) for r in got if r.n_hit) == [(8, 1), (8, 1), (11, 10)]
    assert M.occurrences(tables.documents(spark, []), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert M.clean(tables.documents(spark, rows), none).count() == len(rows)
    kept = M.clean(tables.documents(spark, rows), benchmark)
    assert kept.columns == tables.documents(spark, rows).columns and kept.count() == len(rows) - 3


def test_shift_tables_skip(spark):
    """Most places are never looked at: a text without any pattern word is crossed in steps of m - 1."""
    patterns = M.compile_patterns({tuple(b"w%d" % i for i in range(10)): {"1"}})[0]
    assert patterns.shifts.tolist().count(0) == 1 and sorted(patterns.shifts) == list(range(9))


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    assert compare(M.op2(spark, path), connect(path), M.OP2_SQL).startswith("ok")
    digest = {r.items_sha256 for r in M.op2(spark, path).collect()}
    assert hashlib.sha256(b"").hexdigest() in digest
