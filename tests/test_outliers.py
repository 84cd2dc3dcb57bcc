import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid import registry
from fathomgrid.functions import metric as M
from fathomgrid.operators import knn as K
from fathomgrid.operators import lof as L
from fathomgrid.operators import partition as P
from fathomgrid.operators import pivots as V
from fathomgrid.operators import spatial as S
from fathomgrid.sources import points as R


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def brute(rows, k, metric):
    dist = M.vectorised(metric)
    v = np.array(rows, float)
    out = {}
    for i, p in enumerate(v):
        d = dist(v, p)
        out[i] = sorted((x, j) for j, x in enumerate(d) if j != i)[:k]
    return out


def as_dict(knn):
    out = {}
    for r in knn.orderBy("id", "rn").collect():
        out.setdefault(r["id"], []).append((r["dist"], r["nbr_id"]))
    return out


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_plans_agree_with_brute_force(spark, metric):
    g = np.random.default_rng(1)
    rows = [*g.normal(0, 5, (120, 2)).round(1), *g.uniform(-40, 40, (60, 2)).round(1), (0.0, 0.0), (0.0, 0.0)]
    p = frame(spark, rows)
    # Pivots inside and outside the data, one of them without points.
    pivots = spark.createDataFrame([(0, [0.0, 0.0]), (1, [20.0, 20.0]), (2, [-30.0, 5.0]), (3, [900.0, 900.0])], "cell_id long, v array<double>")
    want = brute(rows, 5, metric)
    for got in (K.all_pairs(p, 5, 2, metric), K.cells(p, pivots, 5, 2, metric, prune=False), K.cells(p, pivots, 5, 2, metric, block=16)):
        found = as_dict(got)
        assert {i: [(round(d, 9), j) for d, j in v] for i, v in found.items()} == {i: [(round(d, 9), j) for d, j in v] for i, v in want.items()}


def test_few_points_and_one_point(spark):
    p = frame(spark, [(0, 0), (1, 0), (0, 3)])
    assert {i: len(v) for i, v in as_dict(K.all_pairs(p, 6, 2)).items()} == {0: 2, 1: 2, 2: 2}
    one = frame(spark, [(0, 0)])
    assert K.all_pairs(one, 6, 2).count() == 0
    assert L.lof_of(K.all_pairs(one, 6, 2), 6).count() == 0


def test_duplicates_give_infinite_density_without_an_error(spark):
    p = frame(spark, [(1, 1)] * 4 + [(5, 5), (9, 1)])
    out = {r["id"]: r for r in L.lof_of(K.all_pairs(p, 3, 2).cache(), 3).collect()}
    assert all(math.isinf(out[i]["lrd"]) and math.isnan(out[i]["lof"]) for i in range(4))
    assert math.isinf(out[4]["lof"])


def test_lattice_and_invariance(spark):
    rows = [(x, y) for x in range(9) for y in range(9)]
    base = {r["id"]: r["lof"] for r in L.lof_of(K.all_pairs(frame(spark, rows), 4, 2), 4).collect()}
    assert abs(base[40] - 1) < 1e-9
    moved = {r["id"]: r["lof"] for r in L.lof_of(K.all_pairs(frame(spark, [(4 * x + 7, 4 * y - 3) for x, y in rows]), 4, 2), 4).collect()}
    assert all(abs(base[i] - moved[i]) < 1e-9 for i in base)


def test_planted_outlier_is_first(spark):
    g = np.random.default_rng(3)
    rows = [*g.normal(0, 1, (80, 2)), *g.normal(20, 1, (80, 2)), (10.0, 10.0)]
    p = frame(spark, rows)
    top = L.top_outliers(L.lof_of(K.cells(p, V.sample_pivots(p, 6), 6, 2), 6), 1).collect()
    assert top[0]["id"] == 160


def test_nearest_pivot_tie_goes_to_the_lowest_cell(spark):
    pivots = spark.createDataFrame([(7, [1.0, 0.0]), (2, [-1.0, 0.0])], "cell_id long, v array<double>")
    assert P.assign(frame(spark, [(0, 5)]), pivots, 2).first()["cell_id"] == 2


def test_metric_registry(spark):
    with pytest.raises(ValueError):
        M.get("cosine")
    wide = frame(spark, [range(12), range(1, 13)])
    a = wide.select(M.get("L2")(F.col("v"), F.array(*(F.lit(0.0) for _ in range(12))), 12).alias("d")).collect()
    assert abs(a[0]["d"] - math.sqrt(sum(x * x for x in range(12)))) < 1e-9
    assert M.cover_radius(0, 100, 2, 100) == pytest.approx(10)


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in").write_text("1, 2.5,3\n2,4,5,name\nbad\n3,abc,4.0\nx,1,2\n")
    p = R.read_text(spark, str(tmp_path / "in"), 2)
    assert sorted(map(tuple, p.collect())) == [(1, [2.5, 3.0]), (2, [4.0, 5.0])]
    assert sorted(r[0] for r in R.as_lines(p).collect()) == ["1,2.5,3.0", "2,4.0,5.0"]
    R.write_text(p.select("id", F.col("v")[0].alias("x")), str(tmp_path / "out"), "id")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\t2.5", "2\t4.0"]
    lines = spark.createDataFrame([("1,2,3,17",)], "value string")
    assert R.weighted(lines).first() == ("1,2,3", 17)


def test_pivot_selection(spark):
    g = np.random.default_rng(5)
    p = frame(spark, [*g.normal(0, 1, (60, 2)), *g.normal(30, 1, (60, 2)), (500.0, 500.0)])
    centers = V.kcenter(p, 3).collect()
    assert len(centers) == 3 and any(r["id"] == 120 for r in centers) and sum(r["weight"] for r in centers) == 121
    pivots, outliers = V.cover_with_outliers(V.kcenter(p, 8, extra=4), 2, 2.0)
    assert [o[0] for o in outliers] == [120] and len(pivots) == 2
    assert V.kcover(p, 5, 600.0, n_buckets=1).agg(F.sum("weight")).first()[0] == 121
    rounds = V.kcover_iterated(p, 4, bucket_rows=30).collect()
    assert len(rounds) <= 4 and sum(r["weight"] for r in rounds) == 121
    with pytest.raises(ValueError):
        V.kcover_iterated(p, 20, bucket_rows=30)
    with pytest.raises(ValueError):
        V.kcover(p, 5, 0.0)
    for name in V.STRATEGIES:
        assert 1 <= V.select_pivots(p, 4, 2, name).count() <= 4
    with pytest.raises(ValueError):
        V.select_pivots(p, 4, 2, "nope")


def greedy_cover(points, k, domain, factor, box):
    """Center of every point, counting every ball or box anew in every step."""
    side = lambda m: (domain**2 / m) ** 0.5 * factor
    inside = lambda p, q, r: max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= r if box else math.dist(p, q) < r
    center = {i: i for i in points}
    radius = side(len(points))
    while len(left := set(center.values())) > k:
        held = {i: {j for j in left if inside(points[i], points[j], radius)} for i in sorted(points)}
        gain = {i: min(len(h) - 1, len(left) - k) for i, h in held.items()}
        best = max(gain, key=gain.get)
        if gain[best] < 1:
            radius *= 2
            continue
        gone = held[best] | {center[best]}
        center = {i: best if c in gone else c for i, c in center.items()}
        radius = side(len(set(center.values())))
    return center


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cover,factor", [("ball", 0.2), ("ball", 1.0), ("box", 0.5)])
def test_cover_steps_against_brute_force(seed, cover, factor):
    g = np.random.default_rng(seed)
    n, k = int(g.integers(3, 90)), int(g.integers(1, 9))
    v, ids = g.integers(0, 40, (n, 2)).astype(float), g.permutation(n) * 3
    want = greedy_cover({int(i): tuple(p) for i, p in zip(ids, v)}, k, 50.0, factor, cover == "box")
    rows, to = V.cover_greedily(ids, v, k, 50.0, factor, cover == "box")
    assert {int(i): int(ids[t]) for i, t in zip(ids, to)} == want and set(ids[rows].tolist()) == set(want.values())


def test_cover_of_points_without_distances_ends():
    rows, _ = V.cover_greedily(np.arange(4), np.array([[np.nan, 1.0], [0, 0], [0, 0], [np.nan, np.nan]]), 1, 10.0, 0.5, True)
    assert rows.tolist() == [0, 1, 3]


def test_weighted_cover_against_brute_force(spark):
    g = np.random.default_rng(8)
    for _ in range(4):
        v, w = g.integers(0, 60, (50, 2)).astype(float), g.integers(1, 6, 50).astype(float)
        left, chosen = set(range(50)), []
        while len(chosen) < 4:
            total = {i: sum(w[j] for j in left if math.dist(v[i], v[j]) <= 10) for i in range(50) if i not in chosen}
            best = max(total, key=total.get)
            if total[best] <= 5:
                break
            chosen.append(best)
            left -= {j for j in left if math.dist(v[best], v[j]) <= 22}
        pivots, outliers = V.cover_with_outliers(spark.createDataFrame([(i, v[i].tolist(), float(w[i])) for i in range(50)], "id long, v array<double>, weight double"), 1, 2.0, max_pivots=4)
        assert [p[0] for p in pivots] == chosen and [o[0] for o in outliers] == sorted(left)


def test_rounds_of_cover_read_all_points(spark, tmp_path):
    g = np.random.default_rng(11)
    points = {i: (float(x), float(y)) for i, x, y in zip(range(1470, 1530), g.integers(1, 50, 60), g.integers(900, 1400, 60))}
    spark.createDataFrame([(i, int(x), y) for i, (x, y) in points.items()], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: r["weight"] for r in registry.queries()["kcover_full"](spark, str(tmp_path)).collect()}
    want = list(greedy_cover(points, 10, 250.0, 1.0, False).values())
    assert got == {c: want.count(c) for c in want}
    rounds = V.kcover_iterated(frame(spark, points.values()), 3, 250.0, "box", bucket_rows=8).collect()
    assert len(rounds) <= 3 and sum(r["weight"] for r in rounds) == 60


def test_spatial_against_brute_force(spark):
    g = np.random.default_rng(9)
    rows = g.uniform(-20, 20, (150, 2)).round(1)
    p = frame(spark, rows)
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    got = {r["center_id"]: r["n"] for r in S.ball_counts(p, p, 6.0, 2).collect()}
    assert got == {i: int((d[i] < 6).sum()) for i in range(150)}
    box = {r["center_id"]: r["n"] for r in S.box_counts(p, p, 6.0, 2).collect()}
    assert box == {i: int((np.abs(rows - rows[i]).max(1) <= 6.0).sum()) for i in range(150)}
    left = {r["id"] for r in S.remove_near(p, p.where("id < 3"), 1.0, 2).collect()}
    assert left == {i for i in range(150) if d[i, :3].min() > 5}


def test_cover_counts_have_every_part_as_a_center(spark, tmp_path):
    g = np.random.default_rng(13)
    rows = np.column_stack([g.integers(1, 51, 60), g.integers(900, 960, 60)]).astype(float)
    spark.createDataFrame([(i, int(x), float(y)) for i, (x, y) in enumerate(rows)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {n: {r["center_id"]: r["n"] for r in registry.queries()[n](spark, str(tmp_path)).collect()} for n in ("box_cover_count", "ball_range_count")}
    gap = np.abs(rows[:, None] - rows[None])
    assert got["box_cover_count"] == {i: int((gap[i].max(1) <= 5).sum()) for i in range(60)}
    assert got["ball_range_count"] == {i: int((np.sqrt((gap[i] ** 2).sum(1)) < 15).sum()) for i in range(60)}


def test_one_dimension_beyond_the_all_pairs_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "ALL_PAIRS_ROWS", 5_000)
    g = np.random.default_rng(17)
    balance = g.uniform(-1000, 10000, K.ALL_PAIRS_ROWS + 200).round(2)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(balance)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = as_dict(registry.queries()["knn_one_dimension"](spark, str(tmp_path)))
    assert len(got) == len(balance)
    for i, x in enumerate(balance):
        d = np.abs(balance - x)
        d[i] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:3]
        assert [n for _, n in got[i]] == want.tolist() and np.allclose([y for y, _ in got[i]], d[want], atol=1e-6)


def test_empty_points(spark):
    p = frame(spark, []).where("id >= 0")
    assert K.all_pairs(p, 3, 2).count() == 0 and S.ball_counts(p, p, 1.0, 2).count() == 0
