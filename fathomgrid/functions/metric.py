"""Distances between vectors as column expressions, and the metric registry.

Points are rows (id long, v array<double>) with vectors of one length. Up to UNROLL dimensions a distance is one
arithmetic expression, which stays inside generated code; beyond, it is a fold over the zipped arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL = 8
Metric = Callable[[Column, Column, int], Column]


def _sum(a: Column, b: Column, dim: int, term: Callable[[Column, Column], Column]) -> Column:
    if dim <= UNROLL:
        return reduce(lambda x, y: x + y, (term(a[k], b[k]) for k in range(dim)))
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column, dim: int) -> Column:
    return _sum(a, b, dim, lambda x, y: F.abs(x - y))


def squared_l2(a: Column, b: Column, dim: int) -> Column:
    return _sum(a, b, dim, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column, dim: int) -> Column:
    return F.sqrt(squared_l2(a, b, dim))


def checked(metric: str, a: Column, b: Column, dim: int) -> Column:
    """The distance, or the largest double where the lengths differ."""
    return F.when(F.size(a) != F.size(b), F.lit(float(np.finfo(float).max))).otherwise(get(metric)(a, b, dim))


_METRICS: dict[str, Metric] = {"l1": l1, "l2": l2}
_NUMPY: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "l1": lambda a, b: np.abs(a - b).sum(-1),
    "l2": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
}


def register(name: str, column: Metric, vectorised: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Adds a metric; vectorised works on broadcastable arrays of vectors. It must satisfy the triangle inequality."""
    _METRICS[name.lower()], _NUMPY[name.lower()] = column, vectorised


def get(name: str) -> Metric:
    if name.lower() not in _METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(_METRICS))}")
    return _METRICS[name.lower()]


def vectorised(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    get(name)
    return _NUMPY[name.lower()]


def table(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all vectors of a to all of b. l1 and l2 add coordinates in their order, as the expressions do."""
    name = name.lower()
    if name not in ("l1", "l2", "linf") or a.shape[-1] > UNROLL:
        return vectorised(name)(a[:, None], b[None])
    out = None
    for k in range(a.shape[-1]):
        step = a[:, k, None] - b[None, :, k]
        step = np.multiply(step, step, out=step) if name == "l2" else np.abs(step, out=step)
        out = step if out is None else np.maximum(out, step, out=out) if name == "linf" else np.add(out, step, out=out)
    return np.sqrt(out, out=out) if name == "l2" else out


def rows_of(width: int, dim: int, cells: int = 2_000_000) -> int:
    """How many vectors may meet width others in one table of bounded memory."""
    return max(1, cells // max(1, width * (1 if dim <= UNROLL else dim)))


class Nearest:
    """The nearest of labelled vectors, the lowest label among equals.

    Of vectors with equal coordinates only the lowest label counts. The others are grouped around about as many heads
    as groups have members, and a point looks only into groups that the triangle inequality does not rule out.
    """

    def __init__(self, labels: np.ndarray, v: np.ndarray, metric: str):
        order = np.argsort(labels, kind="stable")
        v, first = np.unique(v[order], axis=0, return_index=True)
        order = np.argsort(first)
        self.labels, self.v, self.metric = np.sort(labels, kind="stable")[first[order]], v[order], metric
        self.groups, self.heads, self.reach = [], self.v[:0], np.zeros(0)
        finite = np.flatnonzero(np.isfinite(self.v).all(1))
        if len(finite):
            chosen, gap, nearest = [finite[0]], table(metric, self.v[finite], self.v[finite[:1]])[:, 0], np.zeros(len(finite), int)
            while len(chosen) ** 2 < len(finite) and gap.max() > 0:
                chosen.append(finite[int(gap.argmax())])
                d = table(metric, self.v[finite], self.v[chosen[-1:]])[:, 0]
                nearest[d < gap] = len(chosen) - 1
                gap = np.minimum(gap, d)
            self.heads = self.v[chosen]
            self.groups = [finite[nearest == g] for g in range(len(chosen))]
            self.reach = np.array([gap[nearest == g].max() for g in range(len(chosen))])
        self.others = np.flatnonzero(~np.isfinite(self.v).all(1))

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, distance) of each point; a point at no distance of any vector gets the lowest label."""
        rows = rows_of(max(1, len(self.heads)), points.shape[1])
        parts = [self._of(points[low : low + rows]) for low in range(0, len(points), rows)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))

    def _of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, best = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
        with np.errstate(invalid="ignore"):
            to_heads = table(self.metric, points, self.heads)
            bound = to_heads.min(1) if len(self.heads) else best.copy()
            wanted = [(g, np.flatnonzero(to_heads[:, k] - self.reach[k] <= bound + 1e-9 * (bound + to_heads[:, k]))) for k, g in enumerate(self.groups)]
            for group, who in [*wanted, (self.others, np.arange(len(points)))]:
                step = rows_of(len(group), points.shape[1])
                for some in (who[low : low + step] for low in range(0, len(who) if len(group) else 0, step)):
                    d = table(self.metric, points[some], self.v[group])
                    d[np.isnan(d)] = np.inf
                    near = d.argmin(1)
                    d, near = d[np.arange(len(some)), near], group[near]
                    closer = (d < best[some]) | ((d == best[some]) & (near < at[some]))
                    at[some[closer]], best[some[closer]] = near[closer], d[closer]
            none = np.isinf(best)
            best[none] = vectorised(self.metric)(points[none], self.v[at[none]])
        return self.labels[at], best


def reachability(dist: Column, kdist: Column) -> Column:
    return F.greatest(dist, kdist)


def grid_cell(v: Column, dim: int, width: float, per_dim: int) -> Column:
    """Number of the grid cell: sum of floor(x_i / width) * per_dim**i; -1 for a vector of another length."""
    cell = reduce(lambda x, y: x + y, (F.floor(v[k] / F.lit(width)).cast("long") * F.lit(per_dim**k) for k in range(dim)))
    return F.when(F.size(v) != dim, F.lit(-1).cast("long")).otherwise(cell)


def clamp_box(v: Column, dim: int, radius: float, low: float, high: float) -> tuple[list[Column], list[Column]]:
    """Corners of the box of a radius around v, cut to the domain."""
    return [F.greatest(F.lit(low), v[k] - radius) for k in range(dim)], [F.least(F.lit(high), v[k] + radius) for k in range(dim)]


def closest_in_box(v: Column, low: list[float], high: list[float]) -> Column:
    """The point of the box that is closest to v."""
    return F.array(*(F.greatest(F.lit(a), F.least(F.lit(b), v[k])) for k, (a, b) in enumerate(zip(low, high))))


def cover_radius(low: float, high: float, dim: int, n: int, factor: float = 1.0) -> float:
    """Side of the cell that each of n points would have in the domain, times a factor."""
    return float(((high - low) ** dim / max(1, n)) ** (1.0 / dim) * factor)
