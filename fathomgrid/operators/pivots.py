"""Pivot selection: random best-of-sets, k-center, weighted cover with outliers, k-cover and k-means.

The bucketed algorithms deal points into buckets by a hash of the id, with as many buckets as keep each within a
row limit, run a greedy step per bucket and go on with what the buckets return until that fits one bucket. So no
task and no driver step holds more than the limit. Ties always go to the lowest id; runs are deterministic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metric as M
from .partition import assign, vectors

#: Rows that one greedy step may hold.
BUCKET_ROWS = 4_000


def _renumbered(points: DataFrame) -> DataFrame:
    return points.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("cell_id"), "v")


def sample_pivots(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points in the order of a hash of the id: a repeatable random sample without replacement."""
    return _renumbered(points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n))


def systematic_sample(points: DataFrame, every: int) -> DataFrame:
    return points.where(F.pmod(F.col("id"), F.lit(every)) == 0)


def pair_sum(sets: DataFrame, dim: int, metric: str = "l2") -> DataFrame:
    """(set_id, score): the sum of distances of all pairs in each of some small sets (set_id, id, v)."""
    a, b = (sets.select("set_id", F.col("id").alias(f"{s}_id"), F.col("v").alias(f"{s}_v")) for s in "ab")
    return a.join(b, "set_id").where("a_id < b_id").groupBy("set_id").agg(F.sum(M.get(metric)(F.col("a_v"), F.col("b_v"), dim)).alias("score"))


def best_of_sets(points: DataFrame, n_sets: int, size: int, dim: int, metric: str = "l2", by=None) -> DataFrame:
    """(id, v, set_id, score) of the set with the largest pair sum among n_sets disjoint sets of size points.

    by orders the points; a hash of the id unless given. n_sets * size is a parameter and so bounds the sample.
    """
    order = [F.xxhash64("id") if by is None else by, F.col("id")]
    picked = points.orderBy(*order).limit(n_sets * size).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    sets = picked.select("id", "v", F.floor((F.col("rn") - 1) / size).cast("int").alias("set_id"))
    best = pair_sum(sets, dim, metric).orderBy(F.desc("score"), "set_id").limit(1)
    return sets.join(F.broadcast(best), "set_id")


def farthest_first(ids: np.ndarray, v: np.ndarray, k: int, dist, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of up to k centers, and the weight that each one's nearest points bring; starts at the lowest id.

    Stops early when every point coincides with a center.
    """
    order = np.argsort(ids, kind="stable")
    chosen = [order[0]]
    gap, nearest = dist(v, v[order[0]]), np.zeros(len(ids), int)
    while len(chosen) < min(k, len(ids)):
        far = order[np.argmax(gap[order])]
        if gap[far] == 0:
            break
        d = dist(v, v[far])
        closer = d < gap
        nearest[closer], gap = len(chosen), np.minimum(gap, d)
        chosen.append(far)
    return np.array(chosen), np.bincount(nearest, weights, len(chosen))


def _greedy(points: DataFrame, bucket, pick, schema: str) -> DataFrame:
    def one(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        v = np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        rows, w = pick(ids, v, t.column("weight").to_numpy())
        return pa.table({"id": pa.array(ids[rows]), "v": pa.array(v[rows].tolist(), pa.list_(pa.float64())), "weight": pa.array(np.asarray(w, float))})

    return points.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(one, schema)


_CENTERS = "id long, v array<double>, weight double"


def kcenter_bucketed(points: DataFrame, k: int, metric: str = "l2", n_buckets: int | None = None, by=None) -> DataFrame:
    """(id, v, weight): farthest-first centers of each bucket, with the number of points nearest to each."""
    n_buckets = n_buckets or max(1, math.ceil(points.count() / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("id") if by is None else by, F.lit(n_buckets)).cast("int")
    dist = M.vectorised(metric)
    weighted = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    return _greedy(weighted.select("id", "v", "weight"), bucket, lambda i, v, w: farthest_first(i, v, k, dist, w), _CENTERS)


#: Coordinates that one task takes where all that is left is one bucket.
ONE_TASK = 1_000_000


def farthest_first_spread(points: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(id, v, weight): the centers of farthest_first and their weights over any number of points (id, v, weight), by a
    pass over all points for each center. Only centers and the farthest point of a pass come to the driver."""
    spark, chosen = points.sparkSession, points.select("id", "v").orderBy("id").limit(1).collect()

    def gaps(each, schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast(np.array([r["v"] for r in chosen], float))

        def run(it):
            for batch in it:
                v = vectors(batch.column(1))
                step = M.rows_of(len(shared.value), v.shape[1])
                for at in range(0, len(v), step):
                    yield each(batch.slice(at, step), M.table(metric, v[at : at + step], shared.value))

        return points.select("id", "v", "weight").mapInArrow(run, schema)

    def farthest(batch, d):
        gap, ids = d.min(1), batch.column(0).to_numpy()
        at = int(np.lexsort((ids, -gap))[0])
        return pa.RecordBatch.from_arrays([pa.array(gap[at : at + 1]), batch.column(0).slice(at, 1), batch.column(1).slice(at, 1)], names=["gap", "id", "v"])

    def weights(batch, d):
        w = np.bincount(d.argmin(1), batch.column(2).to_numpy(), d.shape[1])
        return pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(w)), pa.int64()), "w": pa.array(w)})

    while chosen and len(chosen) < k:
        best = gaps(farthest, "gap double, id long, v array<double>").orderBy(F.desc("gap"), "id").limit(1).collect()[0]
        if best["gap"] == 0:
            break
        chosen.append(best)
    total = {r["at"]: r["w"] for r in gaps(weights, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).collect()} if chosen else {}
    return spark.createDataFrame([(r["id"], r["v"], float(total[i])) for i, r in enumerate(chosen)], _CENTERS)


def kcenter(points: DataFrame, k: int, metric: str = "l2", extra: int = 0, by=None, rounds: int | None = None) -> DataFrame:
    """(id, v, weight): k centers in rounds, with the points that each stands for; extra more, for outliers.

    by deals points to buckets, a hash of the id unless given. After so many rounds in buckets (where rounds is given),
    all that is left is one bucket, whatever its size. Otherwise half a bucket's rows is the limit for k + extra where
    there is more than one bucket, so that every round has fewer rows than the last.
    """
    from ..storage import shared_table

    rows, n, done = points, points.count(), 0
    if rounds is None and n > BUCKET_ROWS and 2 * (k + extra) > BUCKET_ROWS:
        raise ValueError(f"{k + extra} centers are too many for buckets of {BUCKET_ROWS} rows")
    while n > BUCKET_ROWS and done != rounds:
        rows = shared_table(kcenter_bucketed(rows, k + extra, metric, math.ceil(n / BUCKET_ROWS), by))
        n, done = rows.count(), done + 1
    if n > BUCKET_ROWS and n * len(rows.first()["v"]) > ONE_TASK:
        return farthest_first_spread(rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0)), k + extra, metric)
    return kcenter_bucketed(rows, k + extra, metric, 1)


def cover_with_outliers(centers: DataFrame, k: int, g: float, metric: str = "l2", near: float = 5.0, far: float = 11.0, max_pivots: int = 100) -> tuple[list[tuple], list[tuple]]:
    """Greedy weighted cover of bounded centers (id, v, weight): (pivots, outliers) as lists of (id, v, weight).

    Of all centers that are no pivot yet, covered or not, the one with the most weight that is left within near * g
    becomes a pivot and everything within far * g goes, until the best weight is at most 5 * k or there are max_pivots;
    what is left are outliers. Weights are counts of points, so sums of them are exact.
    """
    rows = centers.limit(4 * BUCKET_ROWS + 1).collect()
    if len(rows) > 4 * BUCKET_ROWS:
        raise ValueError("too many centers for the final round; run kcenter first")
    if not rows:
        return [], []
    rows.sort(key=lambda r: r["id"])
    v, w, dist = np.array([r["v"] for r in rows]), np.array([float(r["weight"]) for r in rows]), M.vectorised(metric)
    slab = max(1, 4_000_000 // v.size)

    def weight_near(of: np.ndarray) -> np.ndarray:
        """For every center, the weight of these within near * g."""
        total = np.zeros(len(w))
        for low in range(0, len(of), slab):
            some = of[low : low + slab]
            total += (dist(v[:, None], v[None, some]) <= near * g) @ w[some]
        return total

    left, chosen, pivots = np.ones(len(rows), bool), np.zeros(len(rows), bool), []
    weight = weight_near(np.arange(len(rows)))
    while len(pivots) < min(max_pivots, len(rows)):
        best = int(np.where(chosen, -1.0, weight).argmax())
        if weight[best] <= 5 * k:
            break
        chosen[best] = True
        pivots.append(rows[best])
        gone = np.flatnonzero(left & (dist(v, v[best]) <= far * g))
        left[gone] = False
        weight -= weight_near(gone)
    return [tuple(r) for r in pivots], [tuple(rows[i]) for i in np.flatnonzero(left)]


#: Pairs of places that one cover holds at a time.
COVER_PAIRS = 4_000_000


class _Cover:
    """The number of centers within a radius of each place, where how many each place has and the radius change.

    Pairs of places up to a limit somewhat above the radius are held, in the order of their distance and by place, so
    that a change costs what it changes. Where these are more than COVER_PAIRS, every change counts anew in slabs.
    """

    def __init__(self, places: np.ndarray, has: np.ndarray, radius: float, box: bool):
        self.v, self.has, self.box, self.held, self.too_wide = places, has, box, -1.0, np.inf
        spread = np.ptp(np.where(np.isfinite(places), places, 0.0), axis=0)
        self.axis = places[:, int(spread.argmax())]
        self.by_axis = np.argsort(self.axis, kind="stable")
        self.go_to(radius)

    def gaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        with np.errstate(invalid="ignore"):
            for c in range(self.v.shape[1]):
                step = np.abs(self.v[a, c, None] - self.v[None, b, c])
                out = np.maximum(out, step) if self.box else out + step * step
            return out if self.box else np.sqrt(out)

    def inside(self, gap: np.ndarray, radius: float) -> np.ndarray:
        return gap <= radius if self.box else gap < radius

    def _hold(self, limit: float) -> bool:
        """Holds the pairs up to the limit, unless they are too many."""
        m, found, total = len(self.v), [], 0
        axis = self.axis[self.by_axis]
        for low in range(0, m, rows := max(1, min(256, 2_000_000 // m))):
            a = self.by_axis[low : low + rows]
            some = self.by_axis[np.searchsorted(axis, axis[low] - limit * 1.0000001) : np.searchsorted(axis, axis[min(m, low + rows) - 1] + limit * 1.0000001, "right")]
            gap = self.gaps(a, some)
            i, j = np.nonzero(gap <= limit)
            total += len(i)
            if total > COVER_PAIRS:
                return False
            found.append((a[i].astype(np.int32), some[j].astype(np.int32), gap[i, j]))
        p, q, gap = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(gap, kind="stable")
        self.p, self.q, self.gap = p[order], q[order], gap[order]
        order = np.argsort(self.q, kind="stable")
        self.near, self.near_gap = self.p[order], self.gap[order]
        self.start = np.searchsorted(self.q[order], np.arange(m + 1))
        self.held = limit
        return True

    def _upto(self, gaps: np.ndarray, radius: float) -> int:
        return int(np.searchsorted(gaps, radius, "right" if self.box else "left"))

    def go_to(self, radius: float) -> None:
        fresh = False
        if radius > self.held:
            self.held, self.p, self.q, self.gap, self.near, self.near_gap = -1.0, *[None] * 5
            for limit in (radius * 1.5, radius):
                if limit < self.too_wide:
                    if fresh := self._hold(limit):
                        break
                    self.too_wide = limit
        if self.held < 0:
            self._count(radius)
        elif (upto := self._upto(self.gap, radius)) < (0 if fresh else getattr(self, "upto", 0)) or fresh or self.upto < 0:
            self.count, self.upto = np.bincount(self.p[:upto], self.has[self.q[:upto]], len(self.v)), upto
        else:
            np.add.at(self.count, self.p[self.upto : upto], self.has[self.q[self.upto : upto]])
            self.upto = upto
        self.radius = radius

    def _count(self, radius: float) -> None:
        some = np.flatnonzero(self.has)
        rows, self.count, self.upto = max(1, 2_000_000 // max(1, len(some))), np.zeros(len(self.v)), -1
        for low in range(0, len(self.v), rows):
            a = np.arange(low, min(len(self.v), low + rows))
            self.count[a] = self.inside(self.gaps(a, some), radius).astype(float) @ self.has[some]

    def near_to(self, place: int) -> np.ndarray:
        """The places within the radius."""
        if self.held < 0:
            return np.flatnonzero(self.inside(self.gaps(np.array([place]), np.arange(len(self.v)))[0], self.radius))
        a, b = self.start[place], self.start[place + 1]
        return self.near[a : a + self._upto(self.near_gap[a:b], self.radius)]

    def change(self, place: int, by: float) -> None:
        """Counts are right after the next go_to where pairs are not held."""
        self.has[place] += by
        if self.held >= 0:
            self.count[self.near_to(place)] += by


def cover_greedily(ids: np.ndarray, v: np.ndarray, k: int, domain: float, factor: float, box: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of at most k centers, and for every row the row number of the center that it went to.

    At first every point is a center. Again and again the point (of all points, the lowest id among equals) whose open
    ball, or closed box, holds the most centers absorbs them and the center it went to itself; a count beyond what is
    too much for k is no better than that. The radius is the side of a cell that each center would have in the domain,
    times factor, anew after each merger; it doubles where nothing can be merged. Up to k points all stay, repeated
    ones too. Points at no finite distance from others stay. Points of one place count together, and memory grows with
    the points and a bounded number of pairs of places.
    """
    order = np.argsort(ids, kind="stable")
    v = np.asarray(v, float)[order]
    n, dim = v.shape
    if n <= k:
        return order, np.arange(n)
    places, first, place = np.unique(v, axis=0, return_index=True, return_inverse=True)
    by_id = np.argsort(first)
    number = np.empty(len(by_id), int)
    number[by_id] = np.arange(len(by_id))
    places, first, place = places[by_id], first[by_id], number[place.ravel()]
    # A node is a center at its time: at first the points, then one for each merger. into is the node that took it in.
    into, point = list(range(n)), list(range(n))
    nodes: list[list[int]] = [[] for _ in places]
    for i, p in enumerate(place.tolist()):
        nodes[p].append(i)

    def center_of(node: int) -> int:
        while into[node] != node:
            into[node] = into[into[node]]
            node = into[node]
        return node

    radius, left = M.cover_radius(0.0, domain, dim, n, factor), n
    cover = _Cover(places, np.bincount(place, minlength=len(places)).astype(float), radius, box)
    while left > k:
        gain = np.minimum(cover.count - 1, left - k)
        best = int(gain.argmax())
        if gain[best] < 1:
            if not np.isfinite(radius):
                break
            radius *= 2
            cover.go_to(radius)
            continue
        new, own = len(into), center_of(int(first[best]))
        into.append(new), point.append(int(first[best]))
        for p in [p for p in cover.near_to(best).tolist() if nodes[p]]:
            left -= len(nodes[p])
            cover.change(p, -float(len(nodes[p])))
            for node in nodes[p]:
                into[node] = new
            nodes[p] = []
        if into[own] == own:
            nodes[place[point[own]]].remove(own)
            cover.change(int(place[point[own]]), -1.0)
            into[own] = new
            left -= 1
        nodes[best] = [new]
        cover.change(best, 1.0)
        left += 1
        radius = M.cover_radius(0.0, domain, dim, left, factor)
        cover.go_to(radius)
    to = np.empty(n, int)
    to[order] = order[[point[center_of(i)] for i in range(n)]]
    return order[np.sort([point[node] for some in nodes for node in some])], to


#: Factors of the cover radius in the bucketed rounds and in the last one.
COVER_FACTORS = {"ball": (1 / 5, 1.0), "box": (1 / 2, 1 / 2)}


def domain_of(points: DataFrame) -> float:
    """The widest range of all coordinates together; 1 where that is nothing."""
    low, high = points.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    return float(high - low) if low is not None and high > low and math.isfinite(high - low) else 1.0


def kcover(points: DataFrame, k: int, domain: float, cover: str = "ball", n_buckets: int | None = None, factor: float | None = None, by=None) -> DataFrame:
    """(id, v, weight): at most k centers of each bucket by greedy cover, with the points that went to each; a bucket of
    k points or fewer passes. by deals points to buckets, a hash of the id unless given."""
    if domain <= 0:
        raise ValueError("the domain must have a positive range")
    n_buckets = n_buckets or max(1, math.ceil(points.count() / (BUCKET_ROWS // 2)))
    bucket = F.pmod(F.xxhash64("id") if by is None else by, F.lit(n_buckets)).cast("int")
    factor = COVER_FACTORS[cover][0] if factor is None else factor

    def pick(i, v, w):
        rows, to = cover_greedily(i, v, k, domain, factor, cover == "box")
        return rows, np.bincount(to, w, len(i))[rows]

    weighted = points if "weight" in points.columns else points.withColumn("weight", F.lit(1.0))
    return _greedy(weighted.select("id", "v", "weight"), bucket, pick, _CENTERS)


def kcover_iterated(points: DataFrame, k: int, domain: float | None = None, cover: str = "box", every: int = 1, bucket_rows: int = BUCKET_ROWS // 2) -> DataFrame:
    """Systematic sample, then rounds of bucketed cover until one bucket holds the rest, then the final cover.

    Half a bucket's rows is the limit for k where there is more than one bucket, so every round has fewer rows.
    """
    from ..storage import shared_table

    rows = systematic_sample(points, every) if every > 1 else points
    domain = domain_of(rows) if domain is None else domain
    n = rows.count()
    if n > 1.5 * bucket_rows and 2 * k > bucket_rows:
        raise ValueError(f"{k} centers are too many for buckets of {bucket_rows} rows")
    while n > 1.5 * bucket_rows:
        rows = shared_table(kcover(rows, k, domain, cover, math.ceil(n / bucket_rows)))
        n = rows.count()
    return kcover(rows, k, domain, cover, 1, COVER_FACTORS[cover][1])


def kcover_of_grid(points: DataFrame, k: int, dim: int, width: float, per_dim: int, domain: float, max_rep: int, cover: str = "box", n_buckets: int = 1, by=None) -> DataFrame:
    """(id, v, weight): k-cover of the means of grid cells, in runs of max_rep points; an id is the last of its run."""
    from .spatial import grid_representatives

    means = grid_representatives(points, dim, width, per_dim, max_rep)
    means = means.select("id", F.array(*(F.col(f"m{c}") for c in range(dim))).alias("v"), F.col("n").cast("double").alias("weight"))
    return kcover(means, k, domain, cover, n_buckets, by=by)


def kmeans(points: DataFrame, centers: DataFrame, dim: int, max_iter: int = 20, tol: float = 0.01) -> DataFrame:
    """(cell_id, v) after Lloyd rounds from given centers; stops when the squared movement sums to less than tol.

    A center without points stays where it is. Only the centers come to the driver, one row each.
    """
    spark = points.sparkSession
    now = {r["cell_id"]: list(r["v"]) for r in centers.collect()}
    for _ in range(max_iter):
        frame = spark.createDataFrame(sorted(now.items()), "cell_id long, v array<double>")
        mean = assign(points, frame, dim).groupBy("cell_id").agg(*(F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(dim)))
        new = now | {r["cell_id"]: [r[f"m{k}"] for k in range(dim)] for r in mean.collect()}
        shift = sum((a - b) ** 2 for c in now for a, b in zip(now[c], new[c]))
        now = new
        if shift < tol:
            break
    return spark.createDataFrame(sorted(now.items()), "cell_id long, v array<double>")


#: Strategies by name: points, k, dim -> (cell_id, v). Others can be added.
STRATEGIES = {
    "random": lambda points, k, dim: sample_pivots(points, k),
    "best_of_sets": lambda points, k, dim: _renumbered(best_of_sets(points, 5, k, dim).select("id", "v")),
    "kcenter": lambda points, k, dim: _renumbered(kcenter(points, k)),
    "kcover": lambda points, k, dim: _renumbered(kcover_iterated(points, k)),
    "kmeans": lambda points, k, dim: kmeans(points, sample_pivots(points, k), dim),
}


def select_pivots(points: DataFrame, k: int, dim: int, strategy: str = "random") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](points, k, dim)
