import duckdb
import pytest

import corpus_pipeline
from fathomgrid.llm import decontaminate, jaccard_join, quality_classifier, secret_scan
from fathomgrid.llm.oracles import ORACLES
from fathomgrid.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_act_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            want = {r["doc_id"] for r in quality_classifier.quality_scores(before, labels).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if name == "near_duplicates":
            again = jaccard_join.ngram_jaccard_join(docs)
            assert again.where("n_links > 0").count() == 0
        if name == "benchmark":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert decontaminate.decontaminate(docs, items).where("contaminated").count() == 0
        if name == "secrets":
            assert docs.count() == before.count() and secret_scan.find_secrets(docs).where("size(spans) > 0").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[0] > counts[1] and counts[1] > counts[2]
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_stages_reach_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    copy, other = " ".join(f"word{k}" for k in range(30)), " ".join(f"term{k}" for k in range(30))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    docs = frame([(3, copy), (3, copy), (9, copy), (None, copy), (None, other), (None, other), (5, item)])
    assert ids(corpus_pipeline.near_duplicates(spark, docs, DATA)) == sorted([(3, copy), (5, item), (None, other)], key=str)
    docs = frame([(None, item), (None, other), (4, item), (4, other), (7, copy)])
    assert ids(corpus_pipeline.benchmark(spark, docs, DATA)) == sorted([(None, other), (4, other), (7, copy)], key=str)
    docs = frame([(None, "a password=hunter22 b"), (None, other), (6, "a token=abcdefgh"), (6, copy)])
    assert ids(corpus_pipeline.secrets(spark, docs, DATA)) == sorted([(None, "a [SECRET] b"), (None, other), (6, "a [SECRET]"), (6, copy)], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
