"""Terms counted within the rows."""

from pyspark.sql import functions as F

from litsieve.functions.text import tokens
from litsieve.operators.terms import term_counts


def grouped(df):
    found = df.select("doc_id", "flag", tokens(F.col("text")).alias("t")).withColumn("n_tokens", F.size("t").cast("long"))
    rows = found.select("doc_id", "flag", "n_tokens", F.explode("t").alias("term"))
    return rows.groupBy("doc_id", "flag", "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_rows_of_single_ids_are_not_shuffled(spark):
    texts = ["aaa bbb aaa ccc aaa", "zzz", "", None, "a bb", "bbb   bbb\nbbb", "ende mitte mitte ende aaa"]
    df = spark.createDataFrame([(i, i % 2 == 0, t) for i, t in enumerate(texts)], "doc_id long, flag boolean, text string")
    found = term_counts(df, ("flag",))
    assert found.columns == ["doc_id", "flag", "n_tokens", "term", "tf"] and dict(found.dtypes)["tf"] == "bigint"
    assert as_set(found) == as_set(grouped(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_repeated_and_null_ids_are_one_document(spark):
    rows = [(1, True, "aaa bbb"), (1, True, "bbb ccc"), (1, False, "aaa bbb"), (1, True, "ddd"), (None, True, "xxx xxx yyy"),
            (None, True, "yyy yyy zzz"), (2, None, "aaa aaa"), (3, None, "aaa")]
    df = spark.createDataFrame(rows, "doc_id long, flag boolean, text string")
    assert as_set(term_counts(df, ("flag",))) == as_set(grouped(df))
    assert as_set(term_counts(df, ("flag",), ids=df.select("doc_id"))) == as_set(grouped(df))
