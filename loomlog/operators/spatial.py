"""Imputation of surfaces from neighbouring points.

Nearest neighbours are exact. Points are packed into tiles of equal counts (slabs along x, each cut along y), tiles into
larger boxes, eight by eight, so the depth of the tree and the size of a tile don't depend on where the points lie. Queries go
down level by level: the boxes that a query still holds give an upper bound of its k-th distance, counting only points
of other groups, and boxes beyond the bound are dropped. At the end a query meets the points of a few tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomlog.plans.blocks import SEQ, Seq, axis_block, scan
from loomlog.plans.quantiles import quantiles
from loomlog.plans.stage import in_tasks, staged

TILE = 32  # points of a tile
FAN = 3  # a box holds 2**FAN by 2**FAN boxes of the level below
TOP = 64  # boxes of the highest level


def surface_sparse_points(df: DataFrame, cols: list[str], grp: str = "grp") -> DataFrame:
    """Median position and surfaces of every group over its complete rows."""
    clean = df.dropna(subset=cols)
    return quantiles(clean, [grp], {c: (F.col(c), 0.5) for c in cols})


def surface_dense_points(df: DataFrame, cols: list[str], most: int = 80, grp: str = "grp", order: str = "id") -> DataFrame:
    """At most ``most`` complete rows per group, evenly spaced in row order (a sampling operator)."""
    clean = df.dropna(subset=cols)
    rows = scan(clean, run={"_r": F.lit(1).cast("bigint")}, total={"_n": ("sum", F.lit(1).cast("bigint"))}, seq=Seq(key=grp), order=[order], block=axis_block(clean, grp, order))
    r, last = F.col("_r") - 1, F.col("_n") - 1
    take = F.least(F.lit(most), F.col("_n")) - 1
    step = F.ceil(r * take / F.nullif(last, F.lit(0)))
    at = F.floor(step * last / F.nullif(take, F.lit(0)))
    return rows.where((F.col("_n") == 1) | (at == r)).drop("_r", "_n")


def axis_scale(points: DataFrame, x: str = "x", y: str = "y", least: float = 1e-6) -> DataFrame:
    """Population spread of both axes; an axis without spread counts as 1."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return points.agg(F.when(sx < least, 1.0).otherwise(sx).alias("sx"), F.when(sy < least, 1.0).otherwise(sy).alias("sy"))


def _tiles(points: DataFrame, crowd: int) -> DataFrame:
    """The points (_x, _y, p_id), written once with the tile they belong to: slab of about equal counts along x, tile of ``crowd`` points
    along y. A slab holds about the root of ``crowd`` times the number of points."""
    n = points.count()
    slabs = max(1, round((n / crowd) ** 0.5))
    ranged = staged(points.repartitionByRange(slabs, "_x", "_y", "p_id").withColumn("slab", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("slab").orderBy("_y", "_x", "p_id"))
    return staged(ranged.withColumn("tile", F.floor((inside - 1) / crowd).cast("int")))


def _boxes(tiles: DataFrame, level: int, by: list[str]) -> DataFrame:
    """Boxes of a level (0: tiles) with their extent and number of points, or with their points per value of ``by``."""
    at = [F.shiftright("slab", FAN * level).alias("a"), F.shiftright("tile", FAN * level).alias("b")]
    if by:
        return tiles.groupBy(*at, *by).agg(F.sum("n").alias("own"))
    ends = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    return tiles.groupBy(*at).agg(*ends, F.sum("n").alias("n"))


def near_pairs(queries: DataFrame, points: DataFrame, k: int, exclude: str | None = None, crowd: int = TILE) -> DataFrame:
    """Queries (q_id, q_x, q_y, ``exclude``) beside the points of every tile that can hold one of their k nearest points of another
    ``exclude`` value (points: p_id, _x, _y, p_<exclude>, ...). Both without missing coordinates or groups."""
    ex = [exclude] if exclude else []
    pts = _tiles(points, crowd)
    size = pts.groupBy("slab", "tile").agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"), F.count("*").alias("n"))
    leaves = staged(size)
    groups = staged(pts.groupBy("slab", "tile", *[F.col(f"p_{e}").alias(e) for e in ex]).agg(F.count("*").alias("n"))) if ex else None
    slab, tile = leaves.agg(F.coalesce(F.max("slab"), F.lit(0)), F.coalesce(F.max("tile"), F.lit(0))).first()
    top = 0
    while ((slab >> FAN * top) + 1) * ((tile >> FAN * top) + 1) > TOP:
        top += 1
    front: DataFrame | None = None
    for level in range(top, -1, -1):
        boxes = _boxes(leaves, level, [])
        if front is None:  # TOP boxes at most
            held = boxes.agg(F.collect_list(F.struct(*boxes.columns)).alias("all")).scalar()
            met = queries.withColumn("_b", F.explode(held)).select("q_id", *ex, "q_x", "q_y", "_b.*")
        else:
            below = boxes.withColumns({"_pa": F.shiftright("a", FAN), "_pb": F.shiftright("b", FAN)})
            met = front.withColumnsRenamed({"a": "_pa", "b": "_pb"}).join(below, ["_pa", "_pb"]).drop("_pa", "_pb")
        foreign = F.col("n")
        if groups is not None:
            met = met.join(_boxes(groups, level, ex), ["a", "b", *ex], "left")
            foreign = F.col("n") - F.coalesce("own", F.lit(0))
        zero = F.lit(0.0)
        dx, dy = (F.greatest(F.col(f"{c}0") - F.col(f"q_{c}"), F.col(f"q_{c}") - F.col(f"{c}1"), zero) for c in "xy")
        fx, fy = (F.greatest(F.abs(F.col(f"q_{c}") - F.col(f"{c}0")), F.abs(F.col(f"q_{c}") - F.col(f"{c}1"))) for c in "xy")
        met = met.withColumns({"_n": foreign, "_least": F.sqrt(dx * dx + dy * dy), "_most": F.sqrt(fx * fx + fy * fy)}).where("_n > 0")
        mine = W.partitionBy("q_id")
        enough = F.sum("_n").over(mine.orderBy("_most", "a", "b").rowsBetween(W.unboundedPreceding, W.currentRow)) >= k
        met = met.withColumn("_enough", F.when(enough, F.col("_most")))
        bound = F.min("_enough").over(mine)
        met = met.withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound") * (1 + 1e-12)))
        front = staged(met.select("q_id", *ex, "q_x", "q_y", "a", "b"))
    front = in_tasks(front, front.count() * crowd, "a", "b")
    pairs = front.join(pts.withColumnsRenamed({"slab": "a", "tile": "b"}), ["a", "b"]).drop("a", "b")
    for e in ex:
        pairs = pairs.where(F.col(e) != F.col(f"p_{e}"))
    return pairs.withColumn("dist", F.sqrt((F.col("q_x") - F.col("_x")) ** 2 + (F.col("q_y") - F.col("_y")) ** 2))


def knn(
    queries: DataFrame, points: DataFrame, k: int, qid: str = "id", pid: str = "id", exclude: str | None = "grp", scaled: bool = True, carry: list[str] | None = None, crowd: int = TILE
) -> DataFrame:
    """k nearest points of every query, those with the query's own ``exclude`` value left out
    before ranking; ties by point id. Long form: query id, rank, distance, point columns as p_*.
    Queries and points without coordinates, or without a value of ``exclude``, take no part."""
    carry = carry or []
    s = axis_scale(points).first() if scaled else None
    sx, sy = (s.sx, s.sy) if s else (1.0, 1.0)
    ex = [exclude] if exclude else []
    there = " AND ".join(f"`{c}` IS NOT NULL" for c in ["x", "y", *ex])
    pts = points.where(there).select(
        F.col(pid).alias("p_id"), *[F.col(e).alias(f"p_{e}") for e in ex], (F.col("x") / sx).alias("_x"), (F.col("y") / sy).alias("_y"), *[F.col(c).alias(f"p_{c}") for c in carry]
    )
    # of points at one place and of one group only the first k can ever be needed
    spot = W.partitionBy("_x", "_y", *[f"p_{e}" for e in ex]).orderBy("p_id")
    pts = staged(pts.withColumn("_r", F.row_number().over(spot)).where(F.col("_r") <= k).drop("_r"))
    asked = queries.where(there).select(F.col(qid).alias("q_id"), *ex, (F.col("x") / sx).alias("q_x"), (F.col("y") / sy).alias("q_y"))
    place = [*ex, "q_x", "q_y"]  # queries at one place and of one group have one answer
    spots = staged(asked.select(*place).distinct().withColumn("q_id", F.monotonically_increasing_id()))
    pairs = near_pairs(spots, pts, k, exclude, crowd)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("dist", "p_id"))).where(F.col("rank") <= k)
    return asked.join(ranked.drop("q_id"), place).select(F.col("q_id").alias(qid), "rank", "dist", "p_id", *[f"p_{e}" for e in ex], *[f"p_{c}" for c in carry], "_x", "_y", "q_x", "q_y")


def idw_predict(near: DataFrame, values: list[str], means: DataFrame | None = None, ids: DataFrame | None = None, qid: str = "id", floor: float = 1e-3, spread: bool = False) -> DataFrame:
    """Inverse-distance mean of the carried values. ``ids`` adds queries without neighbours,
    which get the global mean (``means``: one row)."""
    w = 1 / (F.col("dist") + floor)
    aggs = [(F.sum(w * F.col(f"p_{v}")) / F.sum(F.when(F.col(f"p_{v}").isNotNull(), w))).alias(v) for v in values]
    if spread:
        for v in values:
            m1, m2 = F.sum(w * F.col(f"p_{v}")) / F.sum(w), F.sum(w * F.col(f"p_{v}") ** 2) / F.sum(w)
            aggs.append(F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0))).alias(f"{v}_std"))
    out = near.groupBy(qid).agg(*aggs, F.min("dist").alias("nearest"))
    if ids is not None and means is not None:
        m = means.select(F.struct(*values).alias("m")).scalar()
        out = ids.select(qid).join(out, qid, "left").withColumn("_m", m)
        out = out.withColumns({v: F.coalesce(F.col(v), F.col("_m")[v]) for v in values}).drop("_m")
    return out


def plane_predict(near: DataFrame, values: list[str], qid: str = "id", floor: float = 1e-3, ridge: float = 1e-9) -> DataFrame:
    """Weighted least-squares plane through the neighbours, read at the query; below three
    neighbours the inverse-distance mean. Coordinates are taken from the query, so the
    value there is the constant term (Cramer's rule on the 3 x 3 sums)."""
    w = 1 / (F.col("dist") + floor)
    dx, dy = F.col("_x") - F.col("q_x"), F.col("_y") - F.col("q_y")
    sums = {"w": w, "x": w * dx, "y": w * dy, "xx": w * dx * dx, "xy": w * dx * dy, "yy": w * dy * dy}
    aggs = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.count("*").alias("_k"), F.min("dist").alias("nearest")]
    for v in values:
        p = F.col(f"p_{v}")
        aggs += [F.sum(w * p).alias(f"_v_{v}"), F.sum(w * dx * p).alias(f"_xv_{v}"), F.sum(w * dy * p).alias(f"_yv_{v}")]
    near = near if hasattr(near, "_stage_path") else staged(near)
    g = in_tasks(near, near.count(), qid).groupBy(qid).agg(*aggs)
    sw, sx, sy = F.col("_w") + ridge, F.col("_x"), F.col("_y")
    xx, xy, yy = F.col("_xx") + ridge, F.col("_xy"), F.col("_yy") + ridge
    m0, m1, m2 = xx * yy - xy * xy, sx * yy - xy * sy, sx * xy - xx * sy
    det = sw * m0 - sx * m1 + sy * m2
    outs = []
    for v in values:
        a, b, c = F.col(f"_v_{v}"), F.col(f"_xv_{v}"), F.col(f"_yv_{v}")
        top = a * m0 - sx * (b * yy - xy * c) + sy * (b * xy - xx * c)
        ok = (F.col("_k") >= 3) & (F.abs(det) > 1e-18)
        outs.append(F.when(ok, top / det).otherwise(a / F.col("_w")).alias(v))
    return g.select(qid, *outs, "nearest")


def loo_centroid_errors(points: DataFrame, values: list[str], k: int = 8, grp: str = "grp") -> tuple[DataFrame, DataFrame]:
    """Each group centre predicted from the others: (error rows, summary per surface)."""
    own = points.withColumn("_g", F.col(grp))
    near = knn(own, own, k, grp, grp, "_g", scaled=False, carry=values)
    w = 1 / F.greatest(F.col("dist"), F.lit(1e-6))
    pred = near.groupBy(grp).agg(*[(F.sum(w * F.col(f"p_{v}")) / F.sum(w)).alias(f"_p_{v}") for v in values], F.min("dist").alias("nearest"))
    both = points.join(pred, grp)
    errors = both.select(grp, "nearest", F.inline(F.array(*[F.struct(F.lit(v).alias("surface"), (F.col(f"_p_{v}") - F.col(v)).alias("error")) for v in values])))
    e = F.col("error")
    top = errors.groupBy("surface").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    pct = quantiles(errors, ["surface"], {"p90_abs": (F.abs(e), 0.9), "nearest_median": (F.col("nearest"), 0.5)})
    return errors, top.join(pct, "surface")


def neighbor_mean_signal(near: DataFrame, own: DataFrame, value: str, ks=(3, 5, 10), qid: str = "id") -> tuple[DataFrame, DataFrame]:
    """Mean of the k nearest values for several k, and their correlation with the own value."""
    means = near.groupBy(qid).agg(*[F.avg(F.when(F.col("rank") <= k, F.col(f"p_{value}"))).alias(f"mean_{k}") for k in ks])
    both = own.select(qid, value).join(means, qid)
    return means, both.agg(*[F.corr(value, f"mean_{k}").alias(f"corr_{k}") for k in ks])


def surface_prior(rows: DataFrame, surfaces: list[str], key: str = "well_id", ids=("well_id", "row_idx")) -> DataFrame:
    """Prediction -z + surface + bias per surface, the bias being the prefix median of
    tvt + z - surface (0 if nothing is known). Long over surfaces, with the prefix fit."""
    items = F.array(*[F.struct(F.lit(s).alias("surface"), F.col(s).alias("level")) for s in surfaces])
    keep = [c for c in ("tvt", "tvt_input", "z") if c in rows.columns]
    long = staged(rows.select(*ids, *keep, F.inline(items)))
    off = F.col("tvt_input") + F.col("z") - F.col("level")
    bias = quantiles(long.where("tvt_input IS NOT NULL"), [key, "surface"], {"bias": (off, 0.5)})
    out = long.join(bias, [key, "surface"], "left").withColumn("bias", F.coalesce("bias", F.lit(0.0)))
    return out.withColumn("pred", -F.col("z") + F.col("level") + F.col("bias"))


def prefix_fit(priors: DataFrame, key: str = "well_id") -> DataFrame:
    e = F.col("tvt_input") - F.col("pred")
    return priors.where("tvt_input IS NOT NULL").groupBy(key, "surface").agg(F.sqrt(F.avg(e * e)).alias("prefix_rmse"), F.avg(F.abs(e)).alias("prefix_mae"))


def distance_decay_blend(rows: DataFrame, near: str, far: str, sigma: float, out: str = "decayed", seq: Seq = SEQ) -> DataFrame:
    """Weight exp(-(rows to the nearest known row / sigma)^2 / 2) for ``near``, the rest for
    ``far``; known rows keep their value."""
    pos = F.col(seq.pos)
    at = F.when(F.col("tvt_input").isNotNull(), pos)
    got = scan(rows, last={"_b": at}, following={"_f": at}, seq=seq)
    gap = F.least(pos - F.col("_b"), F.col("_f") - pos)
    w = F.coalesce(F.exp(-0.5 * (gap / sigma) ** 2), F.lit(0.0))
    return got.withColumn(out, F.coalesce(F.col("tvt_input"), w * F.col(near) + (1 - w) * F.col(far))).drop("_b", "_f")


def row_stats(values: Column) -> dict[str, Column]:
    """Mean, population std, range, min and max over an array of a few values, NULLs left out."""
    v = F.array_compact(values)
    n = F.nullif(F.size(v), F.lit(0))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    centred = F.aggregate(F.transform(v, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
    return {"mean": mean, "std": F.sqrt(centred), "range": F.array_max(v) - F.array_min(v), "min": F.array_min(v), "max": F.array_max(v)}


def surface_consensus(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.withColumns({f"cons_{n}": c for n, c in row_stats(F.array(*values)).items()})


def trend_plus_residual(points: DataFrame, value: str, alpha: float = 100.0, degree: int = 3, k: int = 20, qid: str = "id", exclude: str = "grp") -> DataFrame:
    """Polynomial ridge trend of a surface over scaled x and y, plus the distance-weighted mean
    of the nearest residuals. Rows: (id, trend, pred, trend_r2)."""
    from loomlog.operators.models import linear_value, ridge_fit

    centre = points.agg(F.struct(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).alias("c")).scalar()
    p = points.withColumn("_c", centre)
    u, v = (F.col("x") - F.col("_c")["mx"]) / F.col("_c")["sx"], (F.col("y") - F.col("_c")["my"]) / F.col("_c")["sy"]
    powers = {f"_t{i}{j}": F.pow(u, F.lit(i)) * F.pow(v, F.lit(j)) for i in range(degree + 1) for j in range(degree + 1 - i) if i + j}
    p = staged(p.withColumns(powers).drop("_c"))
    fit = ridge_fit(p, list(powers), value, alpha).select(F.struct("coef", "intercept").alias("f")).scalar()
    p = p.withColumn("_f", fit).select("*", "_f.*").withColumn("trend", linear_value(list(powers)))
    p = staged(p.withColumn("resid", F.col(value) - F.col("trend")).select(qid, exclude, "x", "y", value, "trend", "resid"))
    r2 = p.agg((1 - F.var_pop("resid") / F.var_pop(value)).alias("r2")).scalar()
    near = idw_predict(knn(p, p, k, qid, qid, exclude, carry=["resid"]), ["resid"], qid=qid)
    got = p.select(qid, "trend").join(near.select(qid, F.col("resid").alias("_near")), qid, "left")
    return got.withColumn("trend_r2", r2).select(qid, "trend", (F.col("trend") + F.coalesce("_near", F.lit(0.0))).alias("pred"), "trend_r2")
