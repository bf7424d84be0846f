import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tables
from tokenizers import Tokenizer

from loomlog.llm import packing as K
from loomlog.llm import text as T


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(K.tokenizer_path())
    own.encode_special_tokens = True
    return lambda text: [*own.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [
    "It's a don't-care, isn't it? 'S 's x''s I'LL", "<|startoftext|> and <|endoftext|>end", "a|b a.b. 3,5 x1y2 (see)[1] <b>", "İstanbul ΣΑΣ ΟΔΟΣ. Straße ÉÈ é ä", "日本語 テスト 한국어 \U0001f600\U0001f600 x", "tab\tline\nfeed\r\n \x0b\x0c  end ",
    " nbsp wide　", "ﬁ ligature ½ ² Ⅷ", "áb ≮ ≠", "\x1c\x1d\x85 odd\x00null", "", " ", "'", "word" * 400, "́ start", "ᄀ ᅡ ᆨ 각",
]


def test_ids_are_the_librarys(plain):
    rng = random.Random(1)
    alphabet = "abzA Z'|.,<>-_1 9\n\t éßİσΣ́日 ½"
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)), tables.prose(rng, 3000)]
    ids, counts = K.encode(*T.column(pa.array(texts)), K.tokenizer_path())
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(x) for x in texts]


def test_words_are_forgotten_but_never_wrong(plain, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 10)
    monkeypatch.setattr(K.Words, "_own", {})
    rng = random.Random(2)
    for _ in range(5):
        text = tables.prose(rng, 50)
        assert K.encode(*T.column(pa.array([text])), K.tokenizer_path())[0].tolist() == plain(text)


def slow_pack(lengths, size, most):
    """Best fit by looking at all open bins; of equal ones the youngest to reach that space, as in the bitset's lists."""
    bins, out, made, tick = {}, [], 0, 0
    for n in lengths:
        tick += 1
        fits = [(free, -when, b) for b, (free, when) in bins.items() if free >= n]
        if fits:
            free, _, b = min(fits)
        else:
            if len(bins) == most and n < size:
                del bins[min((free, -when, b) for b, (free, when) in bins.items())[2]]
            b, free, made = made, size, made + 1
        out.append((b, size - free))
        bins.pop(b, None)
        if free > n:
            bins[b] = (free - n, tick)
    return out


@pytest.mark.parametrize("most", [1, 2, 5, 100])
def test_best_fit_against_a_search_of_all_bins(most):
    rng = random.Random(most)
    for size in (7, 50, 2048):
        lengths = [rng.randint(1, size) for _ in range(500)]
        assert K.pack(lengths, size, most) == slow_pack(lengths, size, most)


def check(rows, texts, plain, size):
    """Pieces join to the ids of their texts; sequences are gapless and no longer than ``size``."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    expected = []
    for key, text in texts:
        ids = plain(text)
        for p in range(0, len(ids), size):
            own = ids[p : p + size]
            expected.append((key, p // size, p, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(expected, key=order)
    return len(by_seq)


@pytest.mark.parametrize(("size", "most", "again"), [(2048, 2048, 200_000), (16, 2, 3), (64, 8, 1000)])
def test_table_with_oddities(spark, plain, monkeypatch, size, most, again):
    monkeypatch.setattr(K, "AGAIN_ROWS", again)
    rng = random.Random(3)
    rows = [*tables.odd_rows(rng), *((100 + i, tables.prose(rng, rng.randrange(1, 40))) for i in range(200)), *((1000 + i, "the same text of a hot group of copies") for i in range(100))]
    got = K.packed(tables.documents(spark, rows).repartition(3), size=size, most=most).collect()
    check(got, rows, plain, size)


def test_few_sequences_in_many_partitions(spark, plain):
    """Short tasks don't leave half-empty bins: one sequence in a hundred more than the sum needs, and one besides."""
    rng = random.Random(4)
    rows = [(i, tables.prose(rng, rng.randrange(1, 120))) for i in range(3000)]
    got = K.packed(tables.documents(spark, rows).repartition(40)).collect()
    n, total = check(got, rows, plain, 2048), sum(r.length for r in got)
    assert n <= 1.01 * -(-total // 2048) + 1


def test_same_numbers_again_and_nothing_from_nothing(spark):
    rng = random.Random(5)
    df = tables.documents(spark, [(i % 7, tables.prose(rng, 20)) for i in range(50)])
    assert sorted(map(tuple, K.packed(df).collect())) == sorted(map(tuple, K.packed(df).collect()))
    assert K.packed(tables.documents(spark, [])).collect() == []
