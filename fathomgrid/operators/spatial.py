"""Range, cover and lookup operators over points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metric as M


def radius_pairs(points: DataFrame, centers: DataFrame, radius: float, dim: int, metric: str = "l2", closed: bool = False) -> DataFrame:
    """(center_id, id, dist): points within radius of a center, themselves included.

    An equi-join on grid cells of the radius over the first two coordinates; a center goes to its neighbouring
    cells. The cost follows the points per cell, not the product of the tables.
    """
    axes = range(min(dim, 2))
    cell = lambda v, k: F.floor(v[k] / F.lit(float(radius))).cast("long")
    left = points.select("id", "v", *(cell(F.col("v"), k).alias(f"g{k}") for k in axes))
    right = centers.select(F.col("id").alias("center_id"), F.col("v").alias("center_v"))
    for k in axes:
        own = cell(F.col("center_v"), k)
        right = right.withColumn(f"g{k}", F.explode(F.array(own - 1, own, own + 1)))
    joined = left.join(right, [f"g{k}" for k in axes]).select("center_id", "id", M.get(metric)(F.col("v"), F.col("center_v"), dim).alias("dist"))
    return joined.where(F.col("dist") <= radius if closed else F.col("dist") < radius)


def _totals(own: np.ndarray, total: np.ndarray, hits: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(np.arange(0, hits.sum() * own.shape[1] + 1, own.shape[1], dtype=np.int32), own[hits].ravel())
    return pa.table({"v": lists, "total": pa.array(total[hits])})


def _strips_do(metric: str, dim: int, radius: float, w: np.ndarray) -> bool:
    """Whether _in_strips is exact: sums of whole weights below 2**53 do not depend on their order."""
    return metric.lower() in ("l1", "l2", "linf") and dim <= 2 and bool(np.isfinite(radius)) and bool((w == np.floor(w)).all()) and np.abs(w).sum() < 2**53


def _in_strips(own: np.ndarray, near: np.ndarray, w: np.ndarray, radius: float, metric: str, closed: bool, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(total, hits) of own: the weight of the vectors of near within the radius, and whether there are any.

    near is cut into at most `most` strips along the coordinate with fewer values, each ordered by the other one. What
    is surely within the radius of a center is a run of a strip, weighed by running sums; only vectors about as far as
    the radius are compared one by one. Few values of a coordinate leave hardly any of those.
    """
    total, hits = np.zeros(len(own)), np.zeros(len(own), bool)
    fine = np.isfinite(near).all(1)
    near, w, live = near[fine], w[fine], np.flatnonzero(np.isfinite(own).all(1))
    if not len(near) or not len(live):
        return total, hits
    if near.shape[1] == 1:
        flat = lambda a: np.column_stack((np.zeros(len(a)), a))
        own, near = flat(own), flat(near)
    values = [np.unique(near[:, k]) for k in (0, 1)]
    across = int(len(values[1]) < len(values[0]))
    along, values = 1 - across, values[across]
    starts = values if len(values) <= most else np.unique(np.quantile(near[:, across], np.arange(most) / most))
    strip = np.searchsorted(starts, near[:, across], "right") - 1
    order = np.lexsort((near[:, along], strip))
    near, w, strip = near[order], w[order], strip[order]
    ends = np.searchsorted(strip, np.arange(len(starts) + 1))
    live = live[np.argsort(own[live, along], kind="stable")]
    # Bounds are a little wider or narrower than the radius, so that rounding cannot decide for them.
    slack = 1e-9 * (radius + np.abs(near).max())
    half = {"l1": lambda d: radius - d, "l2": lambda d: np.sqrt(np.maximum(radius - d, 0) * (radius + d)), "linf": lambda d: np.full(len(d), radius)}[metric]
    for low, high in zip(ends[:-1], ends[1:]):
        if low == high:
            continue
        x, y, sums = near[low:high, across], near[low:high, along], np.concatenate(([0.0], np.cumsum(w[low:high])))
        c = own[live, across]
        least, widest = np.maximum(np.maximum(x.min() - c, c - x.max()) - slack, 0), np.maximum(c - x.min(), x.max() - c) + slack
        some = np.flatnonzero(least <= radius)
        who, least, widest = live[some], least[some], widest[some]
        at, outer = own[who, along], half(least) + slack
        first, last = np.searchsorted(y, at - outer, "left"), np.searchsorted(y, at + outer, "right")
        inner = np.where(widest < radius, half(widest) - slack, -1.0)
        begin = np.where(inner > 0, np.searchsorted(y, at - inner, "left"), last)
        end = np.maximum(begin, np.where(inner > 0, np.searchsorted(y, at + inner, "right"), last))
        total[who] += sums[end] - sums[begin]
        hits[who] |= end > begin
        for a, b in ((first, begin), (end, last)):
            n = np.maximum(b - a, 0)
            todo = np.flatnonzero(n)
            ahead = np.cumsum(n[todo])
            for chunk in np.split(todo, np.searchsorted(ahead, np.arange(1_000_000, ahead[-1], 1_000_000))) if len(todo) else ():
                if not len(chunk):
                    continue
                m = n[chunk]
                mine = np.repeat(np.arange(len(chunk)), m)
                other = np.arange(len(mine)) + np.repeat(low + a[chunk] - (np.cumsum(m) - m), m)
                d = _gaps(metric, own[who[chunk]][mine], near[other])
                hit = d <= radius if closed else d < radius
                total[who[chunk]] += np.bincount(mine[hit], w[other[hit]], len(chunk))
                hits[who[chunk]] |= np.bincount(mine[hit], minlength=len(chunk)) > 0
    return total, hits


def _gaps(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of vectors of two coordinates, row by row, as M.table adds them."""
    x, y = a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]
    return np.sqrt(x * x + y * y) if metric == "l2" else np.abs(x) + np.abs(y) if metric == "l1" else np.maximum(np.abs(x), np.abs(y))


def weights_near(places: DataFrame, centers: DataFrame, radius: float, dim: int, metric: str = "l2", closed: bool = False, block: int = 131_072) -> DataFrame:
    """(v, total): for each distinct v of centers, the weight of the places (v, w) within the radius, where there are any.

    A center belongs to one grid cell of the radius over the first two coordinates, and a place goes to the neighbouring
    cells too. The rows of a cell are dealt into blocks, so that no task grows with the densest cell, and a task weighs
    strips of places (see _in_strips) or, in more than two coordinates, with a metric of its own or with weights that
    doubles do not add exactly, all pairs in vectorised passes: no pair becomes a row. metric must not be below the
    difference in any coordinate.
    """
    grid = [f"g{k}" for k in range(min(dim, 2))]
    # A little wider than the radius, so that rounding cannot put two cells between points at the radius.
    cells = [F.floor(F.col("v")[k] / F.lit(radius * 1.0000001)).cast("long").alias(g) for k, g in enumerate(grid)]
    own = centers.select("v").distinct().select("v", *cells)
    near = places.select("v", F.col("w").cast("double").alias("w"), *cells)
    for g in grid:
        near = near.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    blocks = lambda rows, name: rows.groupBy(*grid).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(own, "own_blocks").join(blocks(near, "near_blocks"), grid)
    dealt = lambda name: F.pmod(F.xxhash64("v"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = own.join(sizes, grid).select(*grid, dealt("own_blocks").alias("x"), every("near_blocks").alias("y"), "v", F.lit(None).cast("double").alias("w"))
    right = near.join(sizes, grid).select(*grid, every("own_blocks").alias("x"), dealt("near_blocks").alias("y"), "v", "w")

    def one(table: pa.Table) -> pa.Table:
        center = table.column("w").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        v = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(len(center), -1)
        w, own, near = table.column("w").to_numpy()[~center], v[center], v[~center]
        if _strips_do(metric, v.shape[1], radius, w):
            total, hits = _in_strips(own, near, w, radius, metric.lower(), closed)
            return _totals(own, total, hits)
        rows, total, hits = M.rows_of(len(near), v.shape[1]), np.zeros(len(own)), np.zeros(len(own), bool)
        for at in range(0, len(own) if len(near) else 0, rows):
            d = M.table(metric, own[at : at + rows], near)
            hit = d <= radius if closed else d < radius
            total[at : at + rows], hits[at : at + rows] = hit.astype(float) @ w, hit.any(1)
        return _totals(own, total, hits)

    return left.unionAll(right).groupBy(*grid, "x", "y").applyInArrow(one, "v array<double>, total double").groupBy("v").agg(F.sum("total").alias("total"))


def _counts(points: DataFrame, centers: DataFrame, radius: float, dim: int, metric: str, closed: bool) -> DataFrame:
    found = weights_near(points.groupBy("v").agg(F.count("*").alias("w")), centers, radius, dim, metric, closed)
    return centers.select(F.col("id").alias("center_id"), "v").join(found, "v").select("center_id", F.col("total").cast("long").alias("n"))


def ball_counts(points: DataFrame, centers: DataFrame, radius: float, dim: int, metric: str = "l2") -> DataFrame:
    """(center_id, n) in the open ball."""
    return _counts(points, centers, radius, dim, metric, False)


def cover_step(points: DataFrame, radius: float, dim: int) -> DataFrame:
    """One row (center_id, n): the point whose open ball holds the most points, lowest id among equals."""
    places = points.groupBy("v").agg(F.min("id").alias("center_id"), F.count("*").alias("w"))
    found = weights_near(places, places, radius, dim).join(places, "v")
    return found.select("center_id", F.col("total").cast("long").alias("n")).orderBy(F.desc("n"), "center_id").limit(1)


def weighted_cover_step(centers: DataFrame, g: float, dim: int, near: float = 5.0) -> DataFrame:
    """One row (center_id, weight): the center with the most weight within near * g; centers are (id, v, weight)."""
    places = centers.groupBy("v").agg(F.min("id").alias("center_id"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    found = weights_near(places, places, near * g, dim, closed=True).join(places.select("v", "center_id"), "v")
    return found.select("center_id", F.col("total").cast(places.schema["w"].dataType).alias("weight")).orderBy(F.desc("weight"), "center_id").limit(1)


def box_range(points: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Points in the closed box."""
    cond = F.lit(True)
    for k, (a, b) in enumerate(zip(low, high)):
        cond = cond & F.col("v")[k].between(a, b)
    return points.where(cond)


def box_counts(points: DataFrame, centers: DataFrame, radius: float, dim: int) -> DataFrame:
    """(center_id, n) in the closed box of the radius around each center."""
    return _counts(points, centers, radius, dim, "linf" if "linf" in M._METRICS else _linf(), True)


def _linf() -> str:
    def column(a, b, dim):
        if dim == 1:
            return F.abs(a[0] - b[0])
        return F.greatest(*(F.abs(a[k] - b[k]) for k in range(dim)))

    M.register("linf", column, lambda a, b: np.abs(a - b).max(-1))
    return "linf"


def nearest_n(points: DataFrame, target: list[float], n: int, metric: str = "l2") -> DataFrame:
    """(id, dist): the n points nearest to target; a top-k."""
    return points.select("id", M.get(metric)(F.col("v"), F.array(*map(F.lit, map(float, target))), len(target)).alias("dist")).orderBy("dist", "id").limit(n)


def point_lookup(points: DataFrame, target: list[float]) -> DataFrame:
    """Points with exactly these coordinates."""
    return points.where(F.col("v") == F.array(*map(F.lit, map(float, target))))


def delete_points(points: DataFrame, gone: DataFrame) -> DataFrame:
    """points without those whose coordinates occur in gone."""
    return points.join(gone.select("v").distinct(), "v", "left_anti").select(*points.columns)


def distinct_coordinates(points: DataFrame) -> DataFrame:
    """(id, v): one point per coordinates, the lowest id."""
    return points.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def remove_near(points: DataFrame, outliers: DataFrame, g: float, dim: int, near: float = 5.0) -> DataFrame:
    """points farther than near * g from every outlier."""
    hit = radius_pairs(points, outliers, near * g, dim, closed=True).select("id").distinct()
    return points.join(hit, "id", "left_anti").select(*points.columns)


def grid_representatives(points: DataFrame, dim: int, width: float, per_dim: int, max_rep: int) -> DataFrame:
    """(cell, block, n, id, m0..): means of runs of max_rep points of a grid cell in id order, with the last id."""
    celled = points.withColumn("cell", M.grid_cell(F.col("v"), dim, width, per_dim))
    block = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("id")) - 1) / max_rep).cast("long")
    return celled.withColumn("block", block).groupBy("cell", "block").agg(F.count("*").alias("n"), F.max("id").alias("id"), *(F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(dim)))


def word_count(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of blank-separated words."""
    return texts.select(F.explode(F.split(F.col(text_col), "\\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
