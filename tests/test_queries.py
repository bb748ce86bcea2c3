"""Registered queries against their SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

from litsieve.operators import metrics
from litsieve.plans import sweep
from litsieve.plans.dataset import index
from litsieve.queries import inputs
from litsieve.queries.oracle import ORACLE
from litsieve.queries.registry import QUERIES

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="test tables are absent")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    return value


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(plain(row[i])) for i in order) for row in table)


@pytest.mark.parametrize(
    "name",
    [
        "normalize_text_tagged", "remove_stopwords", "term_counts", "presence", "split_exact", "papers_kept",
        "link_normalize", "screening_tsv", "nb_predict", "nb_learning_curve", "knn_predict", "knn_small_blocks",
        "term_counts_stopped", "nb_metrics_stopped", "tuned_nb_holdout", "best_params",
        "screened_nb_metrics", "full_text_papers", "full_text_nb_curve", "result_table",
    ],
)
def test_equals_sql(spark, database, name):
    found = QUERIES[name](spark, str(FOLDER))
    answer = database.execute(ORACLE[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, answer.fetchall())


@pytest.mark.parametrize("name", ["sparse_linear_select", "nb_metrics_stemmed", "term_counts_stemmed"])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", ["title_merge", "sparse_vocab", "class_term_frequency"])
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_term_counts_read_two_columns_and_normalise_once(spark):
    plan = QUERIES["sparse_vocab"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[0-9]*[.]?[0-9]+") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["knn_feature_curve_full", "svm_feature_curve", "knn_learning_curve_full", "svm_learning_curve"])
def test_curves_have_all_points(spark, monkeypatch, name):
    perfect = lambda model, rows, *_: metrics.confusion_metrics(metrics.contingency(rows.rows.withColumn("predicted", rows.rows["flag"])))
    monkeypatch.setattr(sweep, "_model_metrics", perfect)
    found = {r.xvar for r in QUERIES[name](spark, str(FOLDER)).select("xvar").collect()}
    if "feature" in name:
        assert found == set(sweep.LEVELS)
    else:
        docs = index(inputs.labelled(spark, str(FOLDER))).docs
        assert found == {float(n) for n in sweep.prefix_sizes(docs, sweep.FRACTIONS) if n > 0}
