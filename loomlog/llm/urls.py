"""URL filters: rules first, then naive Bayes over segmented words (operator 7).

Host labels are split into words by the Viterbi path under unigram probabilities of the words of the pages themselves and of the seeds. Only the
parts of labels are looked up, joined with the word counts in Spark, so neither the dictionary nor the labels meet in one place. Multinomial naive Bayes
scores words of host and path. It is trained on all URLs: an URL whose host holds one of ``SEEDS`` is an example to block, any other one to allow; the
words that stand beside seeds carry the verdict over to hosts without one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import staged

# The rules, in the order they are listed.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words of hosts that mark examples to block.
SEEDS = [
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "clickbait", "escort", "gambling", "hentai", "jackpot", "lottery", "malware", "nude",
    "payday", "phishing", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
]
LONGEST = 20
#: A seed counts as one word in so many at least, so that names are split the same whether pages use it or not.
SEED_RARITY = 10_000
SMOOTHING = 1.0


def parts(df: DataFrame) -> DataFrame:
    """page_id, host and path of each url. Null urls and those without ``://`` have neither."""
    rest = F.substring_index("url", "://", 1)
    after = F.when(F.contains("url", F.lit("://")), F.substr("url", F.length(rest) + 4)).otherwise("")
    host = F.regexp_extract(F.coalesce(after, F.lit("")), r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(after, F.lit("")), r"^[^/?#]*(/[^?#]*)", 1)
    return df.select(F.col("page_id").cast("long").alias("page_id"), lowered.alias("host"), path.alias("path"))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (the first listed of equally long ones) and its verdict, or nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, what).otherwise(verdict)
    return found, verdict


def word_counts(pages: DataFrame, column: str = "html") -> DataFrame:
    """Counts of the words of a-z, ``LONGEST`` letters at most, of all pages. A task adds up its words before it sends them."""

    def count(batches):
        own: Counter[bytes] = Counter()
        for whole in batches:
            for batch in T.portions(whole, "html", 1 << 20):
                data, offsets = T.column(batch.column("html"))
                folded, starts, ends, _, hashes = T.words(data, offsets)
                fits = ends - starts <= LONGEST
                starts, ends, hashes = starts[fits], ends[fits], hashes[fits]
                order = np.argsort(hashes)
                edge = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0])) if len(order) else np.zeros(0, np.int64)
                raw = folded.tobytes()
                for k, n in zip(order[edge].tolist(), np.diff(np.append(edge, len(order))).tolist(), strict=True):
                    word = raw[starts[k] : ends[k]]
                    if word.isalpha():
                        own[word] += n
                if len(own) > 500_000:
                    yield from _sent(own)
                    own = Counter()
        yield from _sent(own)

    few = pages.select(F.coalesce(F.col(column), F.lit("")).alias("html"))
    return few.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_seeds(counts: DataFrame, seeds: list[str]) -> DataFrame:
    """The counts with every seed among them, as one in ``SEED_RARITY`` words and once at least."""
    least = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // SEED_RARITY)
    own = counts.sparkSession.createDataFrame([(s, least) for s in seeds], "word string, n long")
    return counts.unionByName(own).groupBy("word").agg(F.max("n").alias("n"))


def _sent(own: Counter):
    words = [w.decode() for w in own]
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split of a name. A word never seen has probability 10 / (N * 10 ** length), as in Norvig's segmentation."""
    floor = math.log(10 / (max(total, 1) + 1))
    best, cut = [0.0] * (len(name) + 1), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        best[end] = -math.inf
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end], 0)
            score = best[start] + (math.log(n / total) if n else floor - (end - start) * math.log(10))
            if score > best[end]:
                best[end], cut[end] = score, start
    words, end = [], len(name)
    while end:
        words.append(name[cut[end] : end])
        end = cut[end]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of each distinct label; the words of a label are those of the dictionary that stand in it, brought to it by a join."""
    total = counts.agg(F.sum("n")).first()[0] or 0

    def substrings(batches):
        for batch in batches:
            owners, found = [], []
            for name in batch.column("label").to_pylist():
                own = {name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + LONGEST) + 1)}
                owners += [name] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(found, pa.string())], names=["label", "word"])

    asked = labels.mapInArrow(substrings, "label string, word string")
    known = asked.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches):
        for batch in batches:
            out = [viterbi(r["label"], {k["word"]: k["n"] for k in r["known"] or []}, total) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return labels.join(known, "label", "left").mapInArrow(split, "label string, words array<string>")


def _names(text: Column) -> Column:
    """Runs of letters; a run longer than a host label may be comes in pieces."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{1,63}"), F.lit(0))


def judged(df: DataFrame, rules: list[tuple[str, str]] = RULES, seeds: list[str] = SEEDS) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and the log odds of blocking.

    Host and path are scored once for each different pair of them, so that a host with a third of all rows is a single row. Null and unusable urls have empty
    host and path and get the verdict of the prior. Only page_id, url and html are read.
    """
    own = parts(df)
    keys = staged(own.groupBy("host", "path").agg(F.count("*").alias("n")))
    hosts = keys.groupBy("host").agg(F.sum("n").alias("n"))
    label_rows = hosts.select("host", F.explode(_names(F.col("host"))).alias("label"))
    split = staged(segmented(label_rows.select("label").distinct(), staged(with_seeds(staged(word_counts(df)), seeds))))
    # words of each host, back from its labels; a host has a bounded number of them
    of_host = label_rows.join(split, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))
    of_host = staged(hosts.select("host").join(of_host, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))
    seed = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds]))
    per_key = keys.join(of_host.withColumn("blocked", seed), "host")
    # features: words of the host, and words of the path marked as such; weights of a feature are two sums
    marked = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform(_names(F.col("path")), lambda w: F.concat(F.lit("p:"), w)))
    per_key = staged(per_key.select("host", "path", "n", "blocked", marked.alias("features")))
    side = F.when(F.col("blocked"), F.col("n")).otherwise(0)
    prior = per_key.agg(F.sum(side), F.sum("n")).first()
    n1, n = prior[0] or 0, prior[1] or 0
    each = per_key.select("host", "path", "n", "blocked", F.explode("features").alias("feature"))
    features = staged(each.groupBy("feature").agg(F.sum(side).alias("n1"), F.sum(F.col("n") - side).alias("n0")))
    sums = features.agg(F.sum("n1"), F.sum("n0"), F.count("*")).first()
    t1, t0, v = (x or 0 for x in sums)
    weight = F.log((F.col("n1") + SMOOTHING) / (t1 + SMOOTHING * (v + 1))) - F.log((F.col("n0") + SMOOTHING) / (t0 + SMOOTHING * (v + 1)))
    odds = each.join(features.select("feature", weight.alias("weight")), "feature").groupBy("host", "path").agg(F.sum("weight").alias("sum"))
    base = math.log((n1 + 1) / (n - n1 + 1))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    scored = per_key.select("host", "path").join(odds, ["host", "path"], "left").withColumn("log_odds", F.coalesce("sum", F.lit(0.0)) + base)
    scored = scored.select("host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
    return own.join(scored, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "log_odds")


def op7(spark: SparkSession, path: str) -> DataFrame:
    return judged(docs.table(spark, path, "pages"))


docs.register("op7_url_filter", op7)
