import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import tables
from pyspark.sql import functions as F

from loomlog.llm import search as S

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items, places=10):
    bags = [(key, Counter(words(text))) for key, text in documents]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    by_item = {}
    for key, text in items:
        by_item.setdefault(key, set()).update(words(text))
    out = []
    for item, terms in by_item.items():
        found = []
        for (key, bag), n in zip(bags, sizes, strict=True):
            score = 0
            for t in terms & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + 90 * n * n_docs // n_words
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:places])]
    return out


def item_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("term", "rank", "score", "doc_id", "bag", "key", "m")})


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def agree(spark, documents, items, parts=3, places=10):
    got = S.search(tables.documents(spark, documents).repartition(parts), item_table(spark, items), places).collect()
    assert by_key(map(tuple, got)) == by_key(brute(documents, items, places))
    return got


def some(rng, n):
    return " ".join(rng.choice(tables.WORDS) for _ in range(n))


def test_against_all_scores_with_oddities(spark):
    rng = random.Random(1)
    documents = [*tables.odd_rows(rng), *((100 + i, some(rng, rng.randrange(1, 60))) for i in range(150))]
    items = [(1, "The HOUSE garden"), (2, ""), (3, None), (None, "stone cloud twice 日本語"), (4, "no word of any"), (5, "river"), (5, "window River é"), (6, "one two three"), (-7, "morning morning paper"), (8, documents[7][1][:3000])]
    agree(spark, documents, items)
    agree(spark, documents, items, places=1)


def test_copies_and_equal_bags_take_places_by_id(spark, monkeypatch):
    """A third of all rows are one text; other texts have the same bag in another order; ids repeat and are missing."""
    monkeypatch.setattr(S, "HELD", 2000)
    monkeypatch.setattr(S, "CELLS", 50)
    rng = random.Random(2)
    documents = [(900 - i, "green silver table and more") for i in range(120)] + [(i, "Table GREEN silver, and more.") for i in range(0, 40, 3)] + [(None, "table green silver and more"), (5, "green silver table and more"), (5, "green silver table and more")]
    documents += [(2000 + i, some(rng, 12)) for i in range(200)]
    rng.shuffle(documents)
    got = agree(spark, documents, [(1, "green table silver"), (2, "house of stone")], parts=7)
    assert [r.doc_id for r in got if r.item_id == 1] == [None, 0, 3, 5, 5, 6, 9, 12, 15, 18]


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 5)
    rng = random.Random(3)
    agree(spark, [(i, some(rng, 15)) for i in range(80)], [(i, some(rng, 3)) for i in range(12)])


def test_empty_tables(spark):
    assert agree(spark, [], [(1, "the house")]) == []
    assert agree(spark, [(1, "the house")], []) == []
    assert agree(spark, [(1, None), (2, "..")], [(1, "the house")]) == []


def test_bags_of_one_hash_stay_apart(spark, monkeypatch):
    plain = S.classes
    monkeypatch.setattr(S, "classes", lambda *a: plain(*a).withColumn("key", F.lit(7).cast("long")))
    rng = random.Random(4)
    agree(spark, [(i, some(rng, 3)) for i in range(60)], [(1, "the house stone"), (2, "river")], parts=5)


def test_sums_beyond_doubles_are_exact():
    items = S.Items.of(pa.table({"item_id": pa.array([1, 1, 2]), "term": pa.array([3, 4, 4])}))
    bag = np.array([(0, 2), (1, 3)], S._ENTRY).tobytes()
    for weights in (np.array([5, 7]), np.array([1 << 40, (1 << 40) + 1])):
        (_, got), = S.score(items, weights, [bag], np.array([11]))
        value = [int(w) * (1_000_000_000 * tf // (1000 * tf + 88)) for w, tf in zip(weights, (2, 3), strict=True)]
        assert got.tolist() == [[sum(value), value[1]]]
