"""Joins and set operations on id-keyed prediction frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.exprs import row_key, row_number_of


def join_left_contract(contract: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Predictions for every contract id; ``pos`` keeps the contract order for the sink."""
    return contract.join(preds, key, "left")


def join_inner_components(parts: dict[str, DataFrame], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Components joined on id, and one row of counts that shows whether any id was lost."""
    joined = reduce(lambda a, b: a.join(b, key, "inner"), parts.values())
    tagged = [p.agg(F.lit(n).alias("part"), F.count("*").alias("rows")) for n, p in parts.items()]
    tagged.append(joined.agg(F.lit("joined").alias("part"), F.count("*").alias("rows")))
    counts = reduce(DataFrame.unionByName, tagged)
    check = counts.agg(
        *[F.max(F.when(F.col("part") == n, F.col("rows"))).alias(f"rows_{n}") for n in [*parts, "joined"]],
        (F.min("rows") == F.max("rows")).alias("complete"),
    )
    return joined, check


def semi_anti_ids(contract: DataFrame, preds: DataFrame, key: str = "id", examples: int = 10) -> DataFrame:
    """How many ids are missing, extra and shared, with the first few as examples."""

    def side(name: str, ids: DataFrame) -> DataFrame:
        n = ids.agg(F.lit(name).alias("kind"), F.count("*").alias("ids"))
        few = ids.orderBy(key).limit(examples).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("examples"))
        return n.withColumn("examples", few.scalar())

    a, b = contract.select(key), preds.select(key)
    return side("missing", a.join(b, key, "left_anti")).union(side("extra", b.join(a, key, "left_anti"))).union(
        side("shared", a.join(b, key, "left_semi"))
    )


def overlap_keys(left: DataFrame, right: DataFrame, key: str = "well_id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def pair_sums(df: DataFrame, models: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean squared distance of every unordered pair of vectors in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    sums = df.groupBy(*(by or [])).agg(
        *[F.avg((F.col(a) - F.col(b)) ** 2).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(*[F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.col(f"_{i}").alias("msd")) for i, (a, b) in enumerate(pairs)])
    return sums.select(*(by or []), F.inline(rows))


def self_pairwise(df: DataFrame, models: list[str], same_below: float = 0.01) -> DataFrame:
    out = pair_sums(df, models).withColumn("rms", F.sqrt("msd"))
    return out.withColumn("duplicate", F.col("rms") < same_below)


def join_by_position(preds: DataFrame, truth: DataFrame, key: str, pos: str, row_id: str = "id") -> DataFrame:
    """Truth picked by the key and row number inside the prediction id."""
    parsed = preds.withColumns({key: row_key(F.col(row_id)), pos: row_number_of(F.col(row_id))})
    return parsed.join(truth, [key, pos])


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row result to every row as scalar subqueries, without a join."""
    whole = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumns({c: whole[c] for c in stats.columns})


def grid_scores(df: DataFrame, grid: list[tuple], names: list[str], error: Column, by: list[str] | None = None) -> DataFrame:
    """Squared error of every grid point in one pass: the grid is a literal beside each row
    and is summed before any shuffle. ``error`` may use the grid columns by name."""
    points = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p)]) for p in grid])
    wide = df.select("*", F.inline(points))
    return wide.groupBy(*(by or []), *names).agg(F.sum(error * error).alias("sse"), F.count(error).alias("rows")).withColumn(
        "rmse", F.sqrt(F.col("sse") / F.col("rows"))
    )


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def except_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def id_set_equal(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: are both id sets equal, and how many ids differ on either side."""
    sides = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1)))
    per_id = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return per_id.agg(F.count_if(F.expr("l > r")).alias("only_left"), F.count_if(F.expr("r > l")).alias("only_right")).withColumn(
        "equal", F.expr("only_left = 0 AND only_right = 0")
    )
