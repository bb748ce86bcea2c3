"""Registered queries against their SQL, and the pipeline, on the smallest tables."""

import pathlib

import duckdb
import pytest

import corpus_pipeline
from litsieve.llm.oracle import ORACLE
from litsieve.llm.queries import QUERIES

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="test tables are absent")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    database = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = QUERIES[name](spark, str(FOLDER))
    answer = database.execute(ORACLE[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    order = [names.index(c) for c in found.columns]
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    assert [kinds[t] for _, t in found.dtypes] == [str(answer.description[i][1]) for i in order]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in answer.fetchall())
    assert sorted(tuple(map(plain, r)) for r in found.collect()) == expected


def test_pipeline(spark):
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(FOLDER)), name)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= ids
        ids = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(FOLDER)).orderBy("start").collect()
    assert len(out) == docs.count() and [r.doc_id for r in out] == sorted(r.doc_id for r in docs.collect())
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_classifier_on_held_out_rows(spark):
    folder = str(FOLDER.parent / "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op9_quality_rules"](spark, folder).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.9 * len(found)


def test_language_on_held_out_rows(spark):
    folder = str(FOLDER.parent / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op12_language"](spark, folder).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 100 and sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
