import duckdb
import pytest

import __spark_entry__ as entry
from fathomgrid import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("nation", "part", "supplier", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["knn_l1", "knn_pruned", "lof", "lof_embeddings", "core_support_routing", "kmeans_fixed_iters", "kcenter_bucketed", "kcenter_rounds", "cover_outliers", "kcover_bucketed", "kcover_grid", "kcover_step", "weighted_cover_step", "remove_outlier_neighbourhood", "grid_representatives", "best_pivot_set", "box_cover_count", "ball_range_count", "delete_points", "kmeans_until_still", "support_replication", "points_from_text", "pivots_from_text", "pivots_numbered", "pivot_groups", "weighted_records", "boxes_around", "distance_of_unequal_lengths", "point_lookup"])
def test_query_matches_its_sql(spark, db, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "lof_embeddings" in entry.queries()
