"""Per-key recursions and all-against-all matching in tasks of bounded size.

``tiled`` cuts both sides of a match into chunks; a task call gets one pair of long chunks or those of many short keys.
``recursed`` runs a recursion over buckets of short keys, each key whole. ``forward`` and
``backward`` run it chunk by chunk for long ones: every round handles the same chunk of
all keys in parallel, and only a small state per key moves between rounds, so a long key
means more rounds and not a larger task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomlog.plans.stage import again, staged

CHUNK_ROWS = 1 << 15
CURVE_ROWS = 4_000_000
BUCKET_ROWS = 1 << 12  # rows and curve points of the keys that share a call
LONE_ROWS = 1 << 16  # a longer curve shares its call with no other key


def checked_curve(curve: DataFrame, key: str, most: int = CURVE_ROWS) -> DataFrame:
    """A recursion reads the key's whole reference curve; refuse curves too long for a task."""
    n = curve.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if n > most:
        raise ValueError(f"a reference curve has {n} points, more than {most}; resample it with curve_grid first")
    return curve


def _spread(df: DataFrame, pos: str, size: int, before: int, after: int, out: str) -> DataFrame:
    own, off = F.expr(f"`{pos}` div {size}"), F.col(pos) % size
    homes = [own]
    if before:
        homes.append(F.when(off >= size - before, own + 1))
    if after:
        homes.append(F.when((off < after) & (own > 0), own - 1))
    return df.withColumn(out, F.explode(F.array_compact(F.array(*homes))))


Columns = dict[str, np.ndarray | list]
Variants = list[dict[str, object]]


def _table(cols: Columns, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def tiled(
    queries: DataFrame, targets: DataFrame, match: Callable[[int, int, Columns, Columns], Columns | None], schema: str, *,
    key: str, q_pos: str, t_pos: str, q_size: int, t_size: int, q_halo: int = 0, t_after: int = 0,
) -> DataFrame:
    """Run ``match(q_chunk, t_chunk, queries, targets)`` on every pair of chunks of a key.
    Queries get ``q_halo`` neighbours on both sides, targets ``t_after`` rows behind."""
    queries, targets = staged(queries), staged(targets)  # both are read twice
    size = queries.groupBy(key).agg(F.max(F.expr(f"`{q_pos}` div {q_size}")).alias("_nq")).join(
        targets.groupBy(key).agg(F.max(F.expr(f"`{t_pos}` div {t_size}")).alias("_nt")), key
    )
    size = staged(size)
    q_side, t_side = size.select(key, "_nt"), again(size).select(key, "_nq")
    q = _spread(queries.join(q_side, key), q_pos, q_size, q_halo, q_halo, "_qc").withColumn("_tc", F.explode(F.sequence(F.lit(0).cast("bigint"), "_nt")))
    t = _spread(targets.join(t_side, key), t_pos, t_size, 0, t_after, "_tc").withColumn("_qc", F.explode(F.sequence(F.lit(0).cast("bigint"), "_nq")))

    shape = to_arrow_schema(StructType.fromDDL(schema))

    by = [key, "_qc", "_tc"]

    def run(k: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        cols, parts = _groups(left.drop_columns("_bucket"), by, q_pos)
        other, spans = _groups(right.drop_columns("_bucket"), by, t_pos)
        spans = {name: (i, j) for name, i, j in spans}
        done = []
        for name, i, j in parts:
            if name not in spans:
                continue
            p, r = spans[name]
            out = match(name[1], name[2], {c: v[i:j] for c, v in cols.items()}, {c: v[p:r] for c, v in other.items()})
            if out is not None:
                done.append(out | {key: [name[0]] * len(out[q_pos])})
        return _table({f.name: _joined([d[f.name] for d in done]) for f in shape}, shape) if done else shape.empty_table()

    left, right = _dealt(q.drop("_nt"), t.drop("_nq"), by, False)
    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(run, schema)


def _groups(t: pa.Table, by: list[str], order: str | None = None, down: bool = False) -> tuple[Columns, list[tuple[tuple, int, int]]]:
    """The columns of a table in order of ``by`` and ``order``, and (values of ``by``, first row, row behind the last) of every group."""
    t = t.sort_by([(c, "ascending") for c in by] + ([(order, "descending" if down else "ascending")] if order else []))
    flat = {c: t[c].combine_chunks() for c in t.column_names}
    cols = {c: v.to_numpy(zero_copy_only=False) if pa.types.is_primitive(v.type) else v.to_pylist() for c, v in flat.items()}
    names = list(zip(*[flat[c].to_pylist() for c in by]))
    ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
    return {c: v for c, v in cols.items() if c not in by}, [(names[i], i, j) for i, j in zip([0, *ends], [*ends, len(names)]) if names]


def _joined(parts: list) -> np.ndarray | list:
    return np.concatenate(parts) if all(isinstance(p, np.ndarray) for p in parts) else [v for p in parts for v in p]


def one_by_one(step: Callable) -> Callable:
    """A step for all keys of a bucket from ``step(key and variant, rows, curve, state) -> (out rows, state)``."""

    def run(*lists):
        return [step(*one) for one in zip(*lists)]

    return run


def side_by_side(lengths: list[int]) -> tuple[np.ndarray, list[int]]:
    """Keys from longest to shortest, and how many of them have an i-th row, for every i."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    left = np.bincount(lengths)[::-1].cumsum()[::-1]  # keys of at least i rows
    return order, left[1:].tolist()


def _dealt(rows: DataFrame, side: DataFrame, keys: list[str], uneven: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides with the bucket of their key, about ``BUCKET_ROWS`` rows and points each, in tasks of a few buckets. With
    ``uneven`` keys one with a long curve has a bucket of its own."""
    size = rows.agg(F.count("*").alias("n")).union(side.agg(F.count("*"))).agg(F.sum("n")).first()[0]
    buckets = max(1, -(-size // BUCKET_ROWS))
    tasks = min(buckets, max(64, buckets // 8))
    long = side.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LONE_ROWS).select(*keys, F.lit(True).alias("_lone"))
    lone = staged(long) if uneven and size > LONE_ROWS else None
    lone = lone if lone is not None and lone.head(1) else None
    at = F.xxhash64(*keys)

    def deal(df: DataFrame) -> DataFrame:
        if lone is None:
            df = df.withColumn("_bucket", F.pmod(at, F.lit(buckets)))
        else:
            df = df.join(again(lone), keys, "left").withColumn("_bucket", F.when(F.col("_lone"), at).otherwise(F.pmod(at, F.lit(buckets)))).drop("_lone")
        return df.repartition(tasks, "_bucket")

    return deal(rows), deal(side)


def _round(rows: DataFrame, side: DataFrame, keys: list[str], pos: str, step, schema: str, down: bool, variants: Variants, keep: bool = True) -> DataFrame:
    """One chunk of all keys. A task call gets a bucket of keys, as calls cost far more than the rows of a short key; ``step`` gets all
    keys of a bucket, variant by variant. Rows in falling order (``down``) already carry their variant."""
    full = to_arrow_schema(StructType.fromDDL(schema + ", _state binary"))
    extra = list(variants[0])
    split = [*keys, *extra] if down else keys
    each = [tuple(v.values()) for v in variants]

    def run(k: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return full.empty_table()
        kept = right.filter(right["_state"].is_valid())
        held = dict(zip(zip(*[kept[c].to_pylist() for c in keys]), map(pickle.loads, kept["_state"].to_pylist())))
        ref, spans = _groups(right.filter(right["_state"].is_null()).drop_columns(["_state", "_bucket"]), keys)
        spans = {name: (i, j) for name, i, j in spans}
        cols, parts = _groups(left.drop_columns("_bucket"), split, pos, down)
        todo: dict[tuple, list[tuple[tuple, Columns, Columns]]] = {}
        for name, i, j in parts:
            own, part = name[:len(keys)], {c: v[i:j] for c, v in cols.items()}
            p, q = spans.get(own, (0, 0))
            for variant in [name[len(keys):]] if down else each:
                todo.setdefault(variant, []).append((own, part, {c: v[p:q] for c, v in ref.items()}))
        done, after = [], {}
        for variant, work in todo.items():
            owns, some, others = zip(*work)
            for own, (out, state) in zip(owns, step([(*own, *variant) for own in owns], some, others, [held.get(own, {}).get(variant) for own in owns])):
                n = len(out[pos])  # a step may give several rows for one
                done.append(out | {c: [v] * n for c, v in zip((*keys, *extra), (*own, *variant))} | {"_state": [None] * n})
                after.setdefault(own, {})[variant] = state
        table = _table({f.name: _joined([d[f.name] for d in done]) for f in full}, full)
        if not keep:
            return table
        last = {f.name: [None] * len(after) for f in full} | {c: [own[i] for own in after] for i, c in enumerate(keys)}
        return pa.concat_tables([table, _table(last | {pos: [-1] * len(after), "_state": [pickle.dumps(s) for s in after.values()]}, full)])

    left, right = _dealt(rows, side, keys)
    return left.groupBy("_bucket").cogroup(right.groupBy("_bucket")).applyInArrow(run, schema + ", _state binary")


def recursed(
    rows: DataFrame, curve: DataFrame, keys: list[str], pos: str, step, schema: str, chunk: int = CHUNK_ROWS, variants: Variants | None = None, walk=None, walked: str | None = None
) -> DataFrame:
    """The rows that ``step`` gives over all chunks of every key (see ``forward``), or those that ``walk`` then gives from each key's end back
    to its start (see ``backward``). Keys that fit one chunk take both ways at once and leave no history; longer ones go in rounds."""
    variants = variants or [{}]
    rows = staged(rows)
    long = rows.where(F.col(pos) >= chunk).select(*keys).distinct()
    several = bool(long.head(1))
    short = rows
    if several:
        long = staged(long)
        short, rows = rows.join(long, keys, "left_anti"), rows.join(again(long), keys, "left_semi")

    def whole(names, parts, refs, held):
        outs, ends = zip(*step(names, parts, refs, held))
        return walk(names, [{c: v[::-1] for c, v in o.items()} for o in outs], refs, ends) if walk else zip(outs, ends)

    given = curve.withColumn("_state", F.lit(None).cast("binary"))
    out = _round(short, given, keys, pos, whole, walked if walk else schema, False, variants, keep=False).drop("_state")
    if not several:
        return out
    hist, states = forward(rows, curve, keys, pos, step, schema, chunk, variants)
    return out.unionByName(backward(hist, states, keys, pos, walk, walked, chunk, variants) if walk else hist)


def forward(rows: DataFrame, curve: DataFrame, keys: list[str], pos: str, step, schema: str, chunk: int = CHUNK_ROWS, variants: Variants | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``step(keys and variant, rows, curves, states) -> [(out rows, state)]``, lists of equal length over the keys of a bucket, over
    the chunks of every key in order, for each variant (``one_by_one`` makes it of a step for one key). Returns the rows and, per round, the states of the keys that had that chunk."""
    rows = staged(rows)
    last = rows.agg(F.max(F.expr(f"`{pos}` div {chunk}"))).first()[0]
    curve = curve.withColumn("_state", F.lit(None).cast("binary"))
    outs, states = [], []
    for r in range((0 if last is None else last) + 1):
        side = curve if not states else curve.unionByName(states[-1], allowMissingColumns=True)
        got = staged(_round(rows.where(F.expr(f"`{pos}` div {chunk} = {r}")), side, keys, pos, step, schema, False, variants or [{}]))
        outs.append(got.where(F.col(pos) >= 0).drop("_state"))
        states.append(got.where(F.col(pos) < 0).select(*keys, "_state"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out, states


def backward(history: DataFrame, states: list[DataFrame], keys: list[str], pos: str, step, schema: str, chunk: int = CHUNK_ROWS, variants: Variants | None = None) -> DataFrame:
    """Walk the history from its end: ``step(keys and variant, rows in falling order, empty, states)``. The
    first state of a key is the forward state of its last chunk."""
    out, state = None, None
    for r in range(len(states) - 1, -1, -1):
        side = states[r]
        if state is not None:
            side = state.unionByName(side.join(state.select(*keys), keys, "left_anti"))
        got = staged(_round(history.where(F.expr(f"`{pos}` div {chunk} = {r}")), side, keys, pos, step, schema, True, variants or [{}]))
        state = got.where(F.col(pos) < 0).select(*keys, "_state")
        part = got.where(F.col(pos) >= 0).drop("_state")
        out = part if out is None else out.unionByName(part)
    return out


def seeded(*parts) -> np.random.Generator:
    """Generator that depends on the given values alone, not on where the task runs."""
    import hashlib

    text = "|".join(str(p) for p in parts)
    return np.random.default_rng(int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big"))
