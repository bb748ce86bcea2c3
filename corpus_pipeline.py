"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm import decontaminate, jaccard_join, mixing, quality_rules, token_files
from litsieve.llm.queries import held_out, table, tokenizer_path
from litsieve.session import drop_scratch, materialize, scratch_mark, small_side

#: A stage's decisions depend on a trained model, so no SQL gives run()'s rows.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame, since: int) -> DataFrame:
    """The rows whose id is not in ``ids`` (one column); rows without an id stay.

    What the stage has written since ``since`` to find the ids goes as soon as the ids are written.
    """
    until = scratch_mark()
    ids = materialize(ids.toDF("__gone").filter("__gone IS NOT NULL").distinct(), "gone")
    drop_scratch(docs.sparkSession, since, until)
    return docs.join(small_side(ids), F.col("doc_id") == F.col("__gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns as in its query, held-out rows apart."""
    since = scratch_mark()
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = quality_rules.score_documents(docs, labels, threshold=0.3)
    return _without(docs, scored.filter("predicted = 0").select("doc_id"), since)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word similarity 0.8 or more connect, the smallest id stays."""
    since = scratch_mark()
    found = jaccard_join.jaccard_components(docs, n=5, num=80, den=100)
    return _without(docs, found.filter("component < doc_id").select("doc_id"), since)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go whole; others stay as they are."""
    since = scratch_mark()
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)
    return _without(docs, found.filter("n_hit > 0").select("doc_id"), since)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    found = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    copies = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    copies = small_side(materialize(copies, "copies"))
    joined = docs.join(copies, F.col("doc_id") == F.col("__id"), "left")
    times = F.array_repeat(F.lit(0), F.coalesce("__copies", F.lit(1)).cast("int"))
    return joined.withColumn("__time", F.explode(times)).drop("__time", "__id", "__copies")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files; what is read back from them."""
    root, files = token_files.write_tokens(docs, tokenizer_path(), end_id=1)
    return token_files.read_documents(spark, root, files, docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
