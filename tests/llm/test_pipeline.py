import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries, secrets
from tests.llm.brute import classes, contamination
from tests.test_queries import TABLES, cells


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small)
    names = sorted(got.columns)
    rows = sorted(map(cells, got.select(*(f"`{n}`" for n in names)).toPandas().itertuples(index=False)), key=str)
    assert rows
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(want.columns) == names
        assert rows == sorted(map(cells, want[names].itertuples(index=False)), key=str)


def test_stages_one_after_the_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small).cache()
        if name == "best-fit packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality classifier":
            assert all(d in now for d in before if labels.get(d) == 1) and sum(d in now for d in before if labels.get(d) == 0) <= 3
        elif name == "n-gram Jaccard join":
            assert set(now) == {d for d, (_, c) in classes(list(before.items())).items() if d == c}
        elif name == "benchmark decontamination":
            assert set(now) == {d for d, x in contamination(before.items(), items).items() if not x[4]}
        else:
            assert set(now) == set(before) and all(not secrets.base_spans(t) for t in now.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        before = now


def test_pipeline_on_odd_rows(spark, odd, empty, small):
    for rows in (odd, empty):
        docs = rows
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, small)
        assert docs.count() >= (8 if rows is odd else 0)
