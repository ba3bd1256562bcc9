"""All queries over empty tables, and over tables of repeated rows and nulls."""

from __future__ import annotations

import pytest
from conftest import HARD

from thermolith.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


def write(spark, sf_dir, folder, change):
    for t in TABLES:
        change(t, spark.read.parquet(f"{sf_dir}/{t}.parquet")).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    return write(spark, sf_dir, tmp_path_factory.mktemp("none") / "sf", lambda t, df: df.where("false"))


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """Every row twice, a row of nulls, and the hard documents."""

    def change(t, df):
        nulls = spark.createDataFrame([tuple([None] * len(df.columns))], df.schema)
        more = df.unionByName(df).unionByName(nulls)
        if t == "documents":
            more = more.unionByName(spark.createDataFrame([(i, x, None, s, None) for i, x, s in HARD], df.schema))
        return more

    return write(spark, sf_dir, tmp_path_factory.mktemp("odd") / "sf", change)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op5") else 0)  # op5 adds a conversation of its own


def test_empty_pipeline(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_on_repeated_rows_and_nulls(spark, odd):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, odd).collect()
    ids = [r["doc_id"] for r in rows if r["piece"] == 0]
    texts = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("translate(coalesce(text, ''), ' \t\n\u000b\f\r', '') t").distinct().count()
    assert 0 < len(ids) <= texts and max(r["length"] for r in rows) <= 2048  # ids may repeat beside other texts


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_repeated_rows_and_nulls(spark, odd, name):
    found = QUERIES[name](spark, odd).cache()
    documents = spark.read.parquet(f"{odd}/documents.parquet").count()
    n = found.count()
    if name.split("_")[0] in ("op3", "op4", "op6", "op7", "op8", "op9"):
        assert n == documents
    elif name.startswith("op10"):
        assert n == spark.read.parquet(f"{odd}/pages.parquet").count()
    elif name.startswith("op1_"):
        assert found.where("piece = 0").count() == documents
    elif name.startswith("op2"):
        assert n == 10 * spark.read.parquet(f"{odd}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").distinct().count()
    elif name.startswith("op5"):
        assert n == spark.read.parquet(f"{odd}/conversations.parquet").select("conv_id").distinct().count() + 1
    found.unpersist()
