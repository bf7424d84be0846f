import math
import random
import zlib

import numpy as np
import tables

from loomlog.llm import language_model as M


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % M.MODULUS == M.HELD_OUT


def fold(x):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (x or "").encode())


class Tree:
    """Context-tree weighting written as its definition: one recursive tree per bit prefix."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, {}
        for x in texts:
            line = b"\0" * depth + fold(x) + b"\0"
            for i in range(depth, len(line)):
                for k in range(8):
                    node, bit = (1 << k) | (line[i] >> (8 - k)), (line[i] >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.counts.setdefault((node, line[i - d : i]), [0, 0])[bit] += 1
        self.children = {}
        for node, context in self.counts:
            if context:
                self.children.setdefault((node, context[1:]), set()).add((node, context))
        self.known = {}

    def kt(self, n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    def below(self, at):
        return sum(self.weighted(c) for c in self.children.get(at, ()))

    def weighted(self, at):
        if at not in self.known:
            own = self.kt(*self.counts[at])
            self.known[at] = own if len(at[1]) == self.depth else np.logaddexp(own, self.below(at)) - math.log(2)
        return self.known[at]

    def chance(self, node, context, d=0):
        """Probability of a one after the last d bytes, with all longer contexts mixed in."""
        at = (node, context[len(context) - d :])
        n0, n1 = self.counts.get(at, (0, 0))
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return own
        share = 1 / (1 + math.exp(self.below(at) - self.kt(n0, n1)))
        return share * own + (1 - share) * self.chance(node, context, d + 1)

    def score(self, x):
        line, total = b"\0" * self.depth + fold(x) + b"\0", 0.0
        for i in range(self.depth, len(line)):
            for k in range(8):
                p = self.chance((1 << k) | (line[i] >> (8 - k)), line[i - self.depth : i])
                total += math.log10(p if (line[i] >> (7 - k)) & 1 else 1 - p)
        return total


def base(rows):
    count, n_docs = {}, 0
    words = [fold(x).replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() for _, x in rows]
    for (i, _), own in zip(rows, words):
        if not held(i):
            n_docs += 1
            for w in own:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + n_docs, len(count) + (n_docs > 0)
    out = []
    for (i, _), own in zip(rows, words):
        c = [count.get(w, 0) for w in own] + [n_docs]
        out.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def test_against_the_definition(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abAé \n") for _ in range(rng.randrange(40)))) for i in range(25)] + [(90, ""), (91, None)]
    tree = Tree([x for i, x in rows if not held(i)], 2)
    want = {b[0]: (*b[1:], tree.score(x)) for b, (_, x) in zip(base(rows), rows)}
    for size in (60, 1 << 20):  # many blocks, with texts cut inside, and one
        got = M.score(tables.documents(spark, rows), depth=2, size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
            assert abs(r.base_score - w[4]) < 1e-8 and abs(r.score - w[5]) < 1e-6


def test_probabilities_of_the_next_byte_sum_to_one(spark):
    grams = spark.createDataFrame([((7 << 8) | b, 3 * (b % 5 == 0)) for b in range(256)], "key long, n long")
    assert abs(sum(10**r.value for r in M.train(grams, 1).collect()) - 1) < 1e-9


def test_cuts_keep_words_whole():
    data = np.frombuffer(b"aaaa bbbb cc" + b"d" * 50 + b" e", np.uint8)
    ends = M.cuts(data, 6)
    assert ends[-1] == len(data) and all(data[e - 1] == 32 for e in ends[:-1]) and len(ends) == 3


def test_oddities(spark):
    rows = tables.odd_rows(random.Random(2))
    got = M.score(tables.documents(spark, rows), depth=3, size=20_000).collect()
    assert sorted(map(repr, [r.doc_id for r in got])) == sorted(repr(i) for i, _ in rows)
    assert {r.score for r in got if r.doc_id == 3} == {r.score for r in got if r.doc_id == 4}
    want = {repr(w[0]): w for w in base(rows) if w[0] not in (7, None)}
    for r in got:
        if repr(r.doc_id) in want:
            assert abs(r.base_score - want[repr(r.doc_id)][5]) < 1e-6
    assert M.score(tables.documents(spark, [])).count() == 0


def test_default_depth_learns_from_five_bytes(spark):
    rng = random.Random(3)  # the byte after "wxyz" follows from the fifth byte before it: one bit in six bytes is open, not two
    rows = [(i, "".join(rng.choice(("1wxyzA", "2wxyzB")) for _ in range(300))) for i in range(30)]
    got = [r.bits_per_byte for r in M.score(tables.documents(spark, rows)).collect() if r.held_out]
    assert got and max(got) < 0.25


def test_symbols_move_packed(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(60)]
    table = M.blocks(tables.documents(spark, rows), 5, 1 << 20).cache()
    for kind, most in ((M.GRAM, 4), (M.WORD, 9)):  # bytes of a key and its count; a row of its own takes 24 and more
        got = M._symbols(table, 5, kind, 3).collect()
        keys = [M._unpack_keys(bytes(r["keys"])) for r in got]
        assert len(got) <= 3 * table.count()
        assert sum(len(r["keys"]) + len(r["n"]) for r in got) < most * sum(map(len, keys))
        assert all((np.diff(k.view(np.uint64 if kind == M.GRAM else np.int64)) > 0).all() for k in keys)


def test_packed_keys_and_numbers_come_back():
    keys = np.array([-(2**63), -5, -1, 0, 7, 2**63 - 1], np.int64)
    assert np.array_equal(M._unpack_keys(M._pack_keys(keys)), keys) and not len(M._unpack_keys(M._pack_keys(keys[:0])))
    values = np.array([-0.1, 1e-300, 3.5])
    assert np.array_equal(M._unpack(M._pack(values), 3, np.float64), values)


def test_a_column_and_an_array_of_grams_have_the_same_parts(spark):
    keys = [random.Random(5).randrange(1 << 56) for _ in range(500)] + [0, 255, (1 << 56) - 1]
    for depth in (1, 2, 5, 6):
        own = np.array([k & ((1 << (8 * depth + 8)) - 1) for k in keys])
        df = spark.createDataFrame([(int(k),) for k in own], "key long")
        assert [r.p for r in df.select(M._gram_part(df["key"], depth, 13).alias("p")).collect()] == M._gram_part(own, depth, 13).tolist()
