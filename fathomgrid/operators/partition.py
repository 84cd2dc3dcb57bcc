"""Voronoi cells: assignment, summaries, triangle-inequality bounds and routing of support points.

Pivot sets are bounded by a parameter of whoever chose them, not by the data, and MAX_PIVOTS is checked before one
is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import metric as M

MAX_PIVOTS = 20_000
#: Up to so many pivots a point is compared with all of them in generated code.
FEW_PIVOTS = 32
#: Up to so many bounds are broadcast.
BROADCAST_BOUNDS = 400_000
#: Relative slack on bounds, so that rounding cannot keep a boundary point out.
SLACK = 1e-9


def _checked(pivots: DataFrame) -> DataFrame:
    n = pivots.count()
    if n > MAX_PIVOTS:
        raise ValueError(f"{n} pivots; at most {MAX_PIVOTS} can be broadcast")
    return pivots


def vectors(column) -> np.ndarray:
    """The rows of an Arrow column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _collected(rows: DataFrame) -> pa.Table:
    """Rows of which there is at most one per pivot."""
    found = rows.limit(MAX_PIVOTS + 1).toArrow()
    if found.num_rows > MAX_PIVOTS:
        raise ValueError(f"more than {MAX_PIVOTS} pivots; at most {MAX_PIVOTS} can be broadcast")
    return found


def assign(points: DataFrame, pivots: DataFrame, dim: int, metric: str = "l2") -> DataFrame:
    """points + (cell_id, dist_to_pivot): the nearest pivot, the lowest cell_id among equals. No shuffle.

    A few pivots are compared in generated code; more are searched by batches of points, see Nearest.
    """
    found = _collected(pivots.select("cell_id", "v"))
    if found.num_rows > FEW_PIVOTS:
        index = points.sparkSession.sparkContext.broadcast(M.Nearest(found.column("cell_id").to_numpy(), vectors(found.column("v")), metric))
        at, names = points.columns.index("v"), [*points.columns, "cell_id", "dist_to_pivot"]

        def run(it):
            for batch in it:
                cell, dist = index.value.of(vectors(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(dist, pa.float64())], names=names)

        return points.mapInArrow(run, StructType([*points.schema.fields, StructField("cell_id", LongType()), StructField("dist_to_pivot", DoubleType())]))
    packed = pivots.agg(F.array_sort(F.collect_list(F.struct("cell_id", "v"))).alias("pivots"))
    near = F.array_min(F.transform("pivots", lambda p: F.struct(M.get(metric)(F.col("v"), p["v"], dim).alias("d"), p["cell_id"].alias("c"))))
    return points.crossJoin(F.broadcast(packed)).withColumn("near", near).select(*points.columns, F.col("near.c").alias("cell_id"), F.col("near.d").alias("dist_to_pivot"))


def cell_summary(assigned: DataFrame, k: int, far: float | None = None) -> DataFrame:
    """(cell_id, min_r, max_r, n, n_far, first_k): first_k are the k + 1 smallest pivot distances, ascending.

    A cell's k + 1 smallest come from a window with a rank limit, which Spark applies before the shuffle.
    """
    from pyspark.sql import Window

    limit = F.lit(float("inf")) if far is None else F.lit(float(far))
    base = assigned.groupBy("cell_id").agg(F.min("dist_to_pivot").alias("min_r"), F.max("dist_to_pivot").alias("max_r"), F.count("*").alias("n"), F.count_if(F.col("dist_to_pivot") > limit).alias("n_far"))
    w = Window.partitionBy("cell_id").orderBy("dist_to_pivot")
    first = assigned.select("cell_id", "dist_to_pivot", F.row_number().over(w).alias("rn")).where(F.col("rn") <= k + 1).groupBy("cell_id").agg(F.array_sort(F.collect_list("dist_to_pivot")).alias("first_k"))
    return base.join(first, "cell_id")


def global_stats(summary: DataFrame, k: int) -> DataFrame:
    """One row: points, cells, cells with fewer than k points, cells and points beyond the far limit, sum of radii."""
    return summary.agg(F.sum("n").alias("n_points"), F.count("*").alias("n_cells"), F.count_if(F.col("n") < k).alias("n_small"), F.count_if(F.col("n_far") > 0).alias("n_far_cells"), F.sum("n_far").alias("n_far_points"), F.sum("max_r").alias("sum_radius"))


def pivot_matrix(pivots: DataFrame, dim: int, metric: str = "l2") -> DataFrame:
    """(src_cell, dst_cell, dist) for all ordered pairs of different pivots; pivots are few."""
    a, b = (_checked(pivots).select(F.col("cell_id").alias(f"{s}_cell"), F.col("v").alias(f"{s}_v")) for s in ("src", "dst"))
    return a.crossJoin(F.broadcast(b)).where("src_cell <> dst_cell").select("src_cell", "dst_cell", M.get(metric)(F.col("src_v"), F.col("dst_v"), dim).alias("dist"))


def _pairwise(summary: DataFrame, pivots: DataFrame, extra: list[str], each, schema: str, metric: str) -> DataFrame:
    """each(number of the cell, distances to all cells, columns) for every cell of the summary, which has at most one row
    per pivot; cells without points have none. Neither the driver nor a task holds the distances of more than one cell."""
    found = _collected(summary.join(pivots.select("cell_id", "v"), "cell_id").select("cell_id", "v", *extra).orderBy("cell_id"))
    spark = summary.sparkSession
    columns = {c: found.column(c).to_pylist() if c == "first_k" else found.column(c).to_numpy() for c in ("cell_id", *extra)}
    shared = spark.sparkContext.broadcast((vectors(found.column("v")), columns))

    def run(it):
        v, columns = shared.value
        for batch in it:
            held, rows = [], 0
            for i in batch.column(0).to_pylist():
                out = each(i, M.table(metric, v[i : i + 1], v)[0], columns)
                held.append(out)
                rows += out.num_rows
                if rows > 50_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows = [], 0
            if rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    n = found.num_rows
    return spark.range(0, n, 1, max(1, min(n // 256, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def kdist_upper_bound(summary: DataFrame, pivots: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(cell_id, ub): no point of the cell has a k-distance above ub.

    The (k+1)-th smallest, over the k + 1 innermost points x of all cells j, of d(x, pivot j) + D(j, cell) + max_r.
    One more than k because a point is no neighbour of itself. Infinity where fewer points exist.
    """

    def each(i, dist, columns):
        if "inner" not in columns:
            columns["inner"] = np.array([x[: k + 1] + [np.inf] * (k + 1 - len(x)) for x in columns["first_k"]])
        inner = columns["inner"]
        # The k + 1 cells with the nearest innermost points bound what is wanted, and leave few cells to look at.
        least = dist + inner[:, 0]
        some = least <= np.partition(least, k)[k] if len(least) > k + 1 else np.ones(len(least), bool)
        d = (dist[some, None] + inner[some]).ravel()
        ub = np.partition(d, k)[k] + columns["max_r"][i]
        return pa.RecordBatch.from_pydict({"cell_id": pa.array(columns["cell_id"][i : i + 1], pa.int64()), "ub": pa.array([ub], pa.float64())})

    return _pairwise(summary, pivots, ["max_r", "first_k"], each, "cell_id long, ub double", metric)


def support_bounds(summary: DataFrame, pivots: DataFrame, ub: DataFrame, metric: str = "l2") -> DataFrame:
    """(src_cell, dst_cell, lb): a point of src can matter to dst only if its pivot distance is at least lb.

    Pairs that no point of src can satisfy are left out.
    """

    def each(i, dist, columns):
        lb = np.maximum(columns["min_r"], dist - columns["max_r"][i] - columns["ub"][i])
        src = np.flatnonzero(lb * (1 - SLACK) <= columns["max_r"])
        src = src[src != i]
        cell = columns["cell_id"]
        return pa.RecordBatch.from_pydict({"src_cell": pa.array(cell[src], pa.int64()), "dst_cell": pa.array(np.full(len(src), cell[i]), pa.int64()), "lb": pa.array(lb[src], pa.float64())})

    return _pairwise(summary.join(ub, "cell_id"), pivots, ["min_r", "max_r", "ub"], each, "src_cell long, dst_cell long, lb double", metric)


def route(assigned: DataFrame, bounds: DataFrame) -> DataFrame:
    """(cell_id, is_core) and the points' columns: every point in its own cell, and as support where bounds ask for it.

    Bounds are packed into an array per source cell. Up to BROADCAST_BOUNDS of them (counted; there can be pivots**2) are
    broadcast, so routing is a filter and an explode without a shuffle; more are joined.
    """
    few = bounds.limit(BROADCAST_BOUNDS + 1).count() <= BROADCAST_BOUNDS
    packed = bounds.groupBy("src_cell").agg(F.collect_list(F.struct("dst_cell", "lb")).alias("targets"))
    joined = assigned.join(F.broadcast(packed) if few else packed, F.col("cell_id") == F.col("src_cell"), "left")
    wanted = F.filter(F.coalesce("targets", F.array().cast("array<struct<dst_cell:bigint,lb:double>>")), lambda t: F.col("dist_to_pivot") >= t["lb"] * (1 - SLACK))
    cells = F.concat(F.array(F.struct(F.col("cell_id").alias("c"), F.lit(True).alias("core"))), F.transform(wanted, lambda t: F.struct(t["dst_cell"].alias("c"), F.lit(False).alias("core"))))
    rest = [c for c in assigned.columns if c != "cell_id"]
    return joined.select(F.explode(cells).alias("to"), *rest).select(F.col("to.c").alias("cell_id"), F.col("to.core").alias("is_core"), *rest)


def replication(routed: DataFrame) -> DataFrame:
    """One row (n_core, n_support, most_support): rows of route by kind, and the support rows of the cell with the most."""
    cells = routed.groupBy("cell_id").agg(F.count_if("is_core").alias("core"), F.count_if(~F.col("is_core")).alias("support"))
    total = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return cells.agg(total(F.sum("core")).alias("n_core"), total(F.sum("support")).alias("n_support"), total(F.max("support")).alias("most_support"))
