"""Queries on copies of the parts, so that a place has many points and most pivots share theirs."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid import registry
from fathomgrid.functions import metric as M
from fathomgrid.operators import knn as K
from fathomgrid.operators import partition as P
from fathomgrid.operators import pivots as V
from fathomgrid.operators import spatial as S
from fathomgrid.plans import queries as Q
from test_outliers import greedy_cover
from test_registry import DATA, rows

#: Queries that must do without a row for each pair of pivots, or of point and pivot.
WITHOUT_PAIRS = [
    "voronoi_assign",
    "cell_summary",
    "cell_global_stats",
    "kdist_upper_bound",
    "core_support_routing",
    "support_lower_bound",
    "support_replication",
    "knn_l1",
    "knn_pruned",
    "knn_l2",
    "knn_pivot",
    "lof_pivot",
    "kdist",
    "lof",
    "lof_pruned",
    "lrd",
    "lof_top20",
]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("copies"))
    part = spark.read.parquet(f"{DATA}/part.parquet")
    part.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.expr("p_partkey + copy * 200")).drop("copy").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.fixture(scope="module")
def db(copies):
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{copies}/part.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_copies_match_sql_without_pairs(spark, db, copies, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("all pairs of pivots")

    monkeypatch.setattr(P, "pivot_matrix", refuse)
    monkeypatch.setattr(K, "ALL_PAIRS_ROWS", 100)
    found = registry.queries()[name](spark, copies)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_rounds_of_centers_match_sql_beyond_one_bucket(spark, db, copies, monkeypatch):
    whole, cover = Q._centers(70), registry.oracle_sql()["cover_outliers"]
    monkeypatch.setattr(V, "BUCKET_ROWS", 100)
    wanted = {"kcenter_rounds": f"with recursive {Q._centers(25)} select id, w as weight from centers", "cover_outliers": cover.replace(whole, Q._centers(70))}
    for limit in (V.ONE_TASK, 10):
        monkeypatch.setattr(V, "ONE_TASK", limit)
        for name, sql in wanted.items():
            assert rows(registry.queries()[name](spark, copies).toPandas()) == rows(db.sql(sql).df())


COUNTED = [
    "box_cover_count",
    "ball_range_count",
    "kcover_step",
    "weighted_cover_step",
]


@pytest.mark.parametrize("name", COUNTED)
def test_counts_match_sql_without_pairs(spark, db, copies, monkeypatch, name):
    def refuse(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(S, "radius_pairs", refuse)
    assert rows(registry.queries()[name](spark, copies).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_blocks_of_a_cell_count_all(spark):
    points = spark.range(300).selectExpr("id", "array(id % 20 * 1.0D, id % 7 * 1.0D) as v")
    places = points.groupBy("v").agg(F.count("*").alias("w"))
    whole, blocks = (S.weights_near(places, points, 30.0, 2, block=b).toPandas() for b in (8_192, 16))
    assert len(whole) == 140 and set(whole["total"]) == {300.0} and rows(whole.assign(v=whole["v"].map(str))) == rows(blocks.assign(v=blocks["v"].map(str)))


@pytest.mark.parametrize("pairs", [0, 300, 4_000_000])
def test_cover_by_any_number_of_pairs_held(monkeypatch, pairs):
    monkeypatch.setattr(V, "COVER_PAIRS", pairs)
    g = np.random.default_rng(pairs)
    for box, factor in ((False, 0.2), (False, 1.0), (True, 0.5)):
        v, ids = g.integers(0, 12, (80, 2)).astype(float), g.permutation(80) * 3
        want = greedy_cover({int(i): tuple(p) for i, p in zip(ids, v)}, 4, 50.0, factor, box)
        rows, to = V.cover_greedily(ids, v, 4, 50.0, factor, box)
        assert {int(i): int(ids[t]) for i, t in zip(ids, to)} == want and set(ids[rows].tolist()) == set(want.values())


def test_cover_memory_is_not_the_square_of_the_points():
    v = np.random.default_rng(2).integers(0, 20, (12_000, 2)).astype(float)
    tracemalloc.start()
    rows, to = V.cover_greedily(np.arange(12_000), v, 5, 250.0, 0.2, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) <= 5 and set(to) == set(rows) and peak < 300e6


@pytest.mark.parametrize("metric", ["l1", "l2", "linf"])
def test_strips_weigh_as_all_pairs_do(metric):
    S._linf()
    g = np.random.default_rng(5)
    for dim, radius, scale in ((1, 2.0, 1.0), (2, 0.0, 1.0), (2, 2.5, 0.5), (2, 5.0, 0.1), (2, 3.0, 0.37)):
        for closed in (False, True):
            own, near = (g.integers(0, 20, (n, dim)) * scale for n in (60, 200))
            near[:3], own[:2], w = np.nan, np.inf, g.integers(-1, 4, 200).astype(float)
            with np.errstate(invalid="ignore"):
                d = M.table(metric, own, near)
            hit = d <= radius if closed else d < radius
            for most in (4, 256):
                total, hits = S._in_strips(own, near, w, radius, metric, closed, most)
                assert (total == hit.astype(float) @ w).all() and (hits == hit.any(1)).all()


def test_ball_counts_compare_few_of_the_pairs_of_different_places(monkeypatch):
    """ball_range_count: 20,000 places that are all different, in the area of the parts."""
    compared, gaps = [], S._gaps
    monkeypatch.setattr(S, "_gaps", lambda metric, a, b: compared.append(len(a)) or gaps(metric, a, b))
    g = np.random.default_rng(6)
    v = np.column_stack((g.integers(1, 51, 20_000), g.uniform(900, 1000, 20_000))).astype(float)
    total, _ = S._in_strips(v, v, np.ones(len(v)), 15.0, "l2", False)
    some = M.table("l2", v[::500], v) < 15.0
    assert (total[::500] == some.sum(1)).all() and sum(compared) < 1_000_000 < total.sum() / 10


@pytest.mark.parametrize("closed, radius", [(False, 25.0)])
def test_cover_step_compares_few_of_the_pairs_of_different_places(monkeypatch, closed, radius):
    """kcover_step: neither coordinate has few values."""
    compared, gaps = [], S._gaps
    monkeypatch.setattr(S, "_gaps", lambda metric, a, b: compared.append(len(a)) or gaps(metric, a, b))
    v = np.random.default_rng(7).uniform((0, 900), (50, 1000), (10_000, 2))
    total, _ = S._in_strips(v, v, np.ones(len(v)), radius, "l2", closed)
    some = M.table("l2", v[::100], v) < radius
    assert (total[::100] == some.sum(1)).all() and sum(compared) < total.sum() / 10


def test_weights_that_doubles_do_not_add_exactly_are_weighed_pair_by_pair(spark):
    """weighted_cover_step: runs of strips only for whole weights, with the same totals."""
    g = np.random.default_rng(8)
    v, w = g.uniform(0, 50, (2_000, 2)), g.integers(1, 51, 2_000).astype(float)
    total, _ = S._in_strips(v, v, w, 20.0, "l2", True)
    assert (total == (M.table("l2", v, v) <= 20.0).astype(float) @ w).all()
    assert S._strips_do("l2", 2, 20.0, w) and not S._strips_do("l2", 2, 20.0, w + 0.1) and not S._strips_do("l2", 2, 20.0, w * 2.0**50)
    assert not S._strips_do("l2", 3, 20.0, w) and not S._strips_do("other", 2, 20.0, w)
    points = spark.range(40).selectExpr("id", "array(id * 1.0D, 0.0D) as v", "id % 7 + 0.1D as weight")
    best = S.weighted_cover_step(points, 1.0, 2).first()
    sums = [sum(j % 7 + 0.1 for j in range(40) if abs(i - j) <= 5) for i in range(40)]
    assert best["center_id"] in [i for i in range(40) if abs(sums[i] - max(sums)) < 1e-9] and abs(best["weight"] - max(sums)) < 1e-9


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_places_are_handed_to_few_cells(spark, metric):
    """knn_l2: cells far smaller than needed are merged, and only places near the rim of their cell look into others."""
    g = np.random.default_rng(9)
    points = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(g.uniform(0, 50, (20_000, 2)))], "id long, v array<double>")
    pivots = points.where("id % 50 = 0").select(F.col("id").alias("cell_id"), "v")
    few = K.few_pivots(pivots, 20_000)
    assert few.count() == K.LEAST_PIVOTS
    assigned = P.assign(points, few, 2, metric)
    routed = K.reaching(assigned, few, 7, 2, metric)
    assert routed.count() < 2 * 20_000 and routed.select("id").distinct().count() == 20_000
    v = np.array(points.orderBy("id").toPandas()["v"].tolist())
    reach = dict(routed.select("id", "reach").distinct().collect())
    seventh = np.sort(M.table(metric, v[::200], v), axis=1)[:, 6]
    assert all(seventh[i] <= reach[i * 200] for i in range(100))
