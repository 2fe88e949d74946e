"""The registered queries on the small tables, those with SQL against DuckDB; the pipeline against its stages' plain rules."""

import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from axisflow.llm import queries
from tests.llm import brute as B

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def in_order(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    pd.testing.assert_frame_equal(in_order(got), in_order(want), check_dtype=False)


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_a_document(spark, documents, name):
    ids = [r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert set(ids) == set(documents.doc_id) and (len(ids) == len(documents) or name == "op3_packing")


def test_pipeline_by_stages(spark, documents):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), list(documents.columns)
    text = dict(zip(documents.doc_id, documents.text, strict=True))
    bench = [tuple(r) for r in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        if name == "near_dedup":
            assert {r.doc_id for r in after.collect()} == {d for d, _, _, kept in B.near_duplicates(before) if kept}
        elif name == "decontamination":
            assert {r.doc_id for r in after.collect()} == {r[0] for r in B.contamination(before, bench) if not r[-1]}
        elif name == "secrets":
            assert {r.doc_id for r in after.collect()} == {d for d, _ in before}
            assert not any(B.secrets(r.text)[0][1] for r in after.collect())
        elif name == "packing":
            for d, t in before:
                assert sum(r.length for r in after.where(f"doc_id = {d}").collect()) == len(B.ids_of(t, [1])) if d % 40 == 0 else True
        else:
            clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
            kept = {r.doc_id for r in after.collect()}
            assert kept <= set(text) and len(clean & kept) >= 0.9 * len(clean & set(text))
        if name != "packing":
            assert after.columns == columns
        docs = after
