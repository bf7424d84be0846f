import hashlib
import random

import numpy as np
import tables

from loomlog.llm import bpe as M


def test_pieces_give_the_library_s_ids():
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", ".", "'s", "'", "1", "\u3000", "\xa0", "\x1c", "x'll", "日", "<|endoftext|>", "\r\n", "\U0001f600"]
    own = M.encoding(M.ranks_path())
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        for size in (3, 50):
            assert "".join(M.pieces(text, size)) == text
            assert M.encode(text, M.ranks_path(), size).tolist() == own.encode_ordinary(text)
    long = tables.prose(rng, 50_000)
    assert M.encode(long, M.ranks_path()).tolist() == own.encode_ordinary(long) and max(map(len, M.pieces(long))) < 2 * M.PIECE


def test_decoding_joins_bytes_inside_characters():
    ids = M.encode("日本語 \U0001f600é" * 50, M.ranks_path())
    assert M.decode(ids, M.ranks_path(), 1) == ("日本語 \U0001f600é" * 50).encode()


def test_rows(spark):
    rows = tables.odd_rows(random.Random(2))
    df = tables.documents(spark, rows)
    own = M.encoding(M.ranks_path())
    want = [(repr(i), len(own.encode_ordinary(x or "")), hashlib.sha256(np.array(own.encode_ordinary(x or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in rows]
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in M.digests(df).collect()) == sorted(want)
    assert M.digests(tables.documents(spark, [])).count() == 0
    both = M.decode_column(M.encode_column(df))  # its own column ``ids`` gives way
    assert both.columns == [*df.drop("ids").columns, "ids", "decoded"]
    assert all(r.decoded.decode() == (r.text or "") for r in both.collect())
    coded = M.encode_and_verify(df.withColumn("n_tokens", df.text))
    assert coded.columns == [*df.drop("ids").columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == sorted(want)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and r["key"] == "clash" for r in coded.collect())
    assert M.encode_and_verify(tables.documents(spark, [])).count() == 0
