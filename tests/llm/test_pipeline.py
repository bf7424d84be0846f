import random

import corpus_pipeline as P
import tables
import test_near_duplicates as near
import test_personal_data as private
from test_contamination import brute as occurrences

from loomlog.llm import bpe


def lay_out(spark, folder, rows, labels, items):
    tables.documents(spark, rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = near.groups(rng)
    rows += [(1000 + k, x.replace("house", "house a.b@c.de")) for k, (_, x) in enumerate(rows[-30:-20])]
    rows += [(2000 + i, f"{tables.prose(rng, 50)} {'idiot' if i % 3 == 0 else 'fine'} {tables.prose(rng, 20)}") for i in range(300)]
    labels = [(2000 + i, int(i % 3 == 0)) for i in range(0, 300)]
    items = [(1, " ".join(rows[-1][1].split()[5:30])), (2, " ".join(rows[60][1].split()[:12]))]
    lay_out(spark, str(tmp_path), rows, labels, items)
    docs = P.table(spark, str(tmp_path), "documents")
    first = docs.columns

    kept = P.not_toxic(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    wrong = [i for i, _ in rows if (i in ids) == (i >= 2000 and i % 3 == 2000 % 3)]
    assert kept.columns == first and len(wrong) <= 3

    kept = P.no_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == first and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in near.brute(rows)})

    kept = P.no_benchmark(spark, docs, str(tmp_path))
    assert kept.columns == first and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in rows if not occurrences(x, items, 10)[1])

    kept = P.no_personal_data(spark, docs, str(tmp_path)).collect()
    assert len(kept) == len(rows) and all(not private.brute(r.text) and r.n_chars == len(r.text) for r in kept)
    clean = {i: x for i, x in rows if not private.brute(x)}
    assert all(r.text == clean[r.doc_id] for r in kept if r.doc_id in clean)

    kept = P.tokens(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in kept} == {i: len(bpe.encode(x, bpe.ranks_path())) for i, x in rows}


def test_run_with_oddities_and_without_rows(spark, tmp_path):
    rows = tables.odd_rows(random.Random(3))
    for name, own in (("odd", rows), ("none", [])):
        lay_out(spark, str(tmp_path / name), own, [(5, 0), (3, 1), (None, None)] if own else [], [(1, "one two three four five six seven eight nine ten")] if own else [])
        got = P.run(spark, str(tmp_path / name)).collect()
        assert len(got) == (0 if not own else len(got)) and (not own or {6, 10} <= {r.doc_id for r in got})
    assert [s for s, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
