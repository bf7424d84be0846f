import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomlog.llm import prefix_trie as P

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(donor, [])[:h] + v[h:])
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    children = defaultdict(set)
    for node in nodes:
        if node:
            children[node[:-1]].add(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(nodes[node]) - 1) * words
        ends = ",".join(map(str, sorted(c for c in nodes[node] if len(whole[c]) == len(node))))
        out.append((min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def agree(spark, rows, shards=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("path", "words", "node", "depth", "shard", "donor", "digest", "turns")})
    got = P.prefix_nodes(P.rebuilt(df.repartition(3)), shards).select(NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return got


def conversations(rng, n, longest=6, choices=3):
    """Few different turns, so that prefixes are shared."""
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi there", "", "what now\tthen", "ok"][:choices])) for c in range(n) for t in range(rng.randrange(1, longest))]
    rng.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "no conversation"), (40, None, None, None), (40, 0, "user", "x y"), (40, 0, "user", "x y"), (40, 0, "user", "a b c"), (41, None, "user", "later"), (41, 5, "system", ""), (45, 1, "a", "bc"), (46, 1, "ab", "c"),
    (7, 1, "user", "its donor is absent"), (-3, 1, "user", "below zero"), (-3, 2, "user", "below zero 2"), (-21, 0, "user", "x"), (1 << 60, 3, "user", "far"), (61, 9, "u", " \n é 日本\x0b \U0001f600"),
]


@pytest.mark.parametrize("shards", [None, 1, 2, 7, 40])
def test_against_sets_of_prefixes(spark, shards):
    rng = random.Random(shards or 0)
    agree(spark, ODD + [(c + 100, *r) for c, *r in conversations(rng, 120)], shards)


def test_hot_conversation_over_many_shards(spark, monkeypatch):
    """A third of all conversations are one; its ends are sent in pieces over several shards and one longer conversation goes on from it."""
    monkeypatch.setattr(P, "PIECE", 3)
    rng = random.Random(8)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2000, 20) for t in range(4)] + [(5000, t, "user", f"turn {t}") for t in range(9)] + [(c + 7000, *r) for c, *r in conversations(rng, 200)]
    got = agree(spark, rows, 12)
    assert max(r.n_convs for r in got if r.depth == 4) >= 101


def test_small_skeleton_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = conversations(rng, 100)
    monkeypatch.setattr(P, "SKELETON", 5)
    sample = [(hashlib.md5(bytes([i % 7])).digest() * (1 + i % 3), i, [1] * 3) for i in range(64)]
    assert len(P.skeleton(sample, 16, 5).parent) <= 5
    agree(spark, rows, 8)


def test_long_conversations(spark):
    same = [(c, t, "user", f"t{t % 11}") for c in (20, 40, 60) for t in range(1500)]
    rows = [*same, (80, 0, "user", "t0"), *[(100, t, "user", f"t{t % 11}" if t < 1490 else "other") for t in range(1600)]]
    got = agree(spark, rows, 3)
    assert max(r.depth for r in got) == 1600


def test_empty_table_and_turnless_conversation(spark):
    assert agree(spark, []) == []
    assert agree(spark, [(None, 1, "user", "x")]) == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    (root,) = agree(spark, [(c, 0, "user", "taken off, and no donor")])
    assert root.depth == 0 and root.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_shared_turns():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (b"".join(bytes([rng.randrange(2)]) * 16 for _ in range(rng.randrange(9))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) // 16 and a[n * 16 : n * 16 + 16] == b[n * 16 : n * 16 + 16]:
            n += 1
        assert P.shared_turns(a, b) == n
