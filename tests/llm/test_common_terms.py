"""Common terms of many texts are multiplied at once, whatever their number."""

import numpy as np

from loomlog.llm import toxicity as tox


def test_cosines_of_many_texts_and_of_an_index_with_few_common_terms(monkeypatch):
    rng = np.random.default_rng(4)
    terms = np.arange(1, 41, dtype=np.uint64)
    examples = [(i, i % 2, np.sort(rng.choice(40, 8, replace=False)), rng.integers(1, 4, 8)) for i in range(300)]
    rows = (rng.random((150, 40)) * (rng.random((150, 40)) < 0.2)).astype(np.float32)
    products = []
    for common in (2000, 5, 1):
        monkeypatch.setattr(tox, "COMMON", common)
        index = tox.build(terms, np.full(40, 3.0), 400, examples)
        cosines, who = index.nearest(rows, 15)
        whole = rows @ index.whole
        assert np.allclose(cosines, -np.sort(-whole, axis=1)[:, :15], atol=1e-5)
        assert np.allclose(np.take_along_axis(whole, who, 1), cosines, atol=1e-5)
        products.append(cosines)
    assert np.allclose(products[0], products[2], atol=1e-5)
