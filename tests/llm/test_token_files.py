import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tables

from loomlog.llm import simple8b
from loomlog.llm import text as T
from loomlog.llm import token_files as M


@pytest.mark.parametrize("high", [1, 2, 3, 300, 50_257, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        values = rng.integers(0, high, n, np.uint64, endpoint=True)
        values[rng.random(n) < 0.3] = 0
        payload = simple8b.encode(values)
        assert (simple8b.decode(payload) == values).all()
        for b in range(-(-n // simple8b.BLOCK)):
            assert (simple8b.decode_block(payload, b) == values[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_simple8b_packs_by_width():
    assert len(simple8b.encode(np.ones(2560, np.uint64))) < 10 * (simple8b.BLOCK // 60 + 5) * 8 + 100
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 40)


def library(texts):
    tokenizer = M.Pieces.of(M.tokenizer_path()).tokenizer
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_pieces_give_the_library_s_ids(monkeypatch):
    monkeypatch.setattr(M, "REMEMBERED", 50)
    rng = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "’", "1", "…", "\u3000", "\xa0", "\x85", "\x1c", "x'll", "日", "#", "<|endoftext|>", "\r\n", "abc", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", "word " * 9000]
    ids, counts = M.encode(*T.column(pa.array(texts)), M.tokenizer_path())
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x + [M.END] for x in library(texts)]


@pytest.mark.parametrize("segment", [50, 1 << 20])
def test_files_against_the_library(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(M, "SEGMENT", segment)
    monkeypatch.setattr(M, "SHARD_CHARS", 40_000)
    rows = tables.odd_rows(random.Random(1))
    M.write(tables.documents(spark, rows), str(tmp_path / "f"))
    got = M.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert sorted(ids) == sorted(x + [0] for x in library([x or "" for _, x in rows]))
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    short = M.read_digests(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in short] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def test_empty_table(spark, tmp_path):
    M.write(tables.documents(spark, []), str(tmp_path / "f"))
    assert M.read_digests(spark, str(tmp_path / "f")).count() == 0
