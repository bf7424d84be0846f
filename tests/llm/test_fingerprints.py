import hashlib
import random

import tables
from loomlog.llm import fingerprints as M


def test_spans_and_extensions_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(40)))
        b = "".join(rng.choice("ab\U0001f600") for _ in range(rng.randrange(40)))
        x, y = M.PrefixHash(M.code_points(a)), M.PrefixHash(M.code_points(b))
        for _ in range(30):
            i, j, n = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1), rng.randrange(12)
            fits = i + n <= len(a) and j + n <= len(b)
            assert x.same(i, y, j, n) == (fits and a[i : i + n] == b[j : j + n])
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert x.common_extension(i, y, j) == want


def test_likeness_follows_shared_spans():
    rng = random.Random(3)
    text = tables.prose(rng, 4000)
    half = text[: len(text) // 2] + tables.prose(rng, 2000)
    assert M.likeness(M.fingerprint(text), M.fingerprint(text)) == 1
    spans = [{t[i : i + M.SPAN] for i in range(len(t) - M.SPAN + 1)} for t in (text, half)]
    true = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
    assert abs(M.likeness(M.fingerprint(text), M.fingerprint(half)) - true) < 0.25
    assert M.likeness(M.fingerprint("abc"), M.fingerprint("")) == 0 and M.likeness(M.fingerprint(""), M.fingerprint(None)) == 1


def test_sketch_over_block_borders_is_the_smallest_hashes():
    text = tables.prose(random.Random(4), 20_000)
    own = M.PrefixHash(M.code_points(text))
    single = {int(M.PrefixHash(M.code_points(text[i : i + M.SPAN])).sketch()[0]) for i in range(len(text) - M.SPAN + 1)}
    assert own.sketch().tolist() == sorted(single)[: M.SKETCH]


def brute(rows):
    """Documents by descending id, each beside the next."""
    import numpy as np  # noqa: F401

    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0)))
    out = []
    for k, i in enumerate(order):
        own, following = rows[i][1] or "", rows[order[(k + 1) % len(order)]][1] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        out.append((rows[i][0], len(own), hashlib.sha256(changed.encode()).hexdigest(), M.fingerprint(own), M.fingerprint(changed), M.likeness(M.fingerprint(own), M.fingerprint(following))))
    return sorted(out, key=repr)


def test_rows_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i * 3 - 50, tables.prose(rng, rng.randrange(60))) for i in range(100)] + [(1000, ""), (1001, None)]
    rng.shuffle(rows)
    for size in (300, 1 << 20):
        monkeypatch.setattr(M, "BUCKET_CHARS", size)
        got = M.fingerprints(tables.documents(spark, rows)).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) for r in got], key=repr) == brute(rows)
        assert all(r.common_prefix >= r.n_chars - r.n_chars // 2 for r in got)


def test_oddities(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_CHARS", 100)
    rows = tables.odd_rows(random.Random(6))
    got = M.fingerprints(tables.documents(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in got) == sorted((repr(i), len(x or "")) for i, x in rows)
    prints = {}
    for r in got:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert prints[3, len(rows[4][1])] == prints[4, len(rows[4][1])]
    assert M.fingerprints(tables.documents(spark, [])).count() == 0
    only = M.fingerprints(tables.documents(spark, [(1, "abcdef")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
