"""Small tables with every oddity: nulls, empty texts, a long one, ties, repeated rows, extra columns."""

from pyspark.sql import types as t

DOCUMENTS = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("text", t.StringType()), t.StructField("lang", t.StringType()), t.StructField("source", t.StringType()), t.StructField("n_chars", t.LongType())])
CLASHES = ["key", "bucket", "bands", "term", "row", "block", "spans", "start", "ids", "items", "score", "kind", "value", "tie", "last", "component", "__found"]


def documents(spark, rows, extra=True):
    """rows: (doc_id, text)."""
    df = spark.createDataFrame([(i, x, "en", "s", None if x is None else len(x)) for i, x in rows], DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


WORDS = "the of and house garden river stone cloud window letter seven green morning paper winter silver table music".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def odd_rows(rng):
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    near = same.split()
    near[30] = "changed"
    return [
        (5, "A short text. With TWO sentences, mail a.b@example.com and +1 (743) 555-3824."), (1, ""), (2, None), (None, "no id here at all"), (3, same), (4, same), (9, " ".join(near)), (6, long),
        (7, "éàü 日本語 \U0001f600 ñ x"), (7, "the same id again"), (8, "twice"), (8, "twice"), (-3, " \n\t "), (10, "x" * 5000), (None, None), (11, "one two three four five six seven eight nine ten eleven"),
    ]
