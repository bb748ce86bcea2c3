"""The given tables seen as the inputs of a screening project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.sources.tables import load_table, spread


def documents(spark: SparkSession, folder: str) -> DataFrame:
    scan = load_table(spark, folder, "documents").select("doc_id", "text")
    return spread(scan, scan, "doc_id")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, flag): documents with a decision on their quality."""
    labels = load_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    scan = load_table(spark, folder, "documents").select("doc_id", "text")
    return spread(scan.join(labels, "doc_id"), scan, "doc_id")


def screening(spark: SparkSession, folder: str) -> DataFrame:
    """Screening table; the second screener includes what is not toxic."""
    docs = load_table(spark, folder, "documents")
    labels = load_table(spark, folder, "labels")
    first, second = F.col("quality") == 1, F.col("toxic") == 0
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("int").alias("id"),
        F.col("lang").alias("type"),
        F.col("source").alias("author"),
        (2005 + F.col("n_chars") % 15).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        first.alias("s1_included"),
        (~first).alias("s1_excluded"),
        second.alias("s2_included"),
        (~second).alias("s2_excluded"),
    )


def bibliography(spark: SparkSession, folder: str) -> DataFrame:
    """Bibliography table: language stands for the kind of paper, two sources are books."""
    docs = load_table(spark, folder, "documents")
    empty = F.lit(None).cast("string")
    kind = (
        F.when(F.col("lang") == "en", "Article")
        .when(F.col("lang") == "fr", "Review")
        .when(F.col("lang") == "de", "Meeting")
    )
    issue = F.when(F.col("source") == "src3", "Book").when(F.col("source") == "src4", "Book Section")
    return docs.select(
        F.col("source").alias("author"),
        (2005 + F.col("n_chars") % 15).cast("int").alias("year"),
        F.substring_index("text", "\n", 1).alias("title"),
        empty.alias("journal"),
        empty.alias("volumn"),
        issue.alias("issue"),
        *(empty.alias(c) for c in ("pages", "blank", "month", "text", "refn", "type")),
        kind.alias("jatype"),
    )


def paper_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, flag, hlink): links as a reference manager leaves them, some in moved folders, some no PDF."""
    labels = load_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    ids = load_table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    place = (
        F.when(F.col("doc_id") % 4 == 0, "\\\\server\\share\\MS Clinical trial Study\\UpdatedSearch16thAug\\ISIEmbase Update References\\")
        .when(F.col("doc_id") % 4 == 1, "S:\\Multiple Sclerosis\\")
        .when(F.col("doc_id") % 4 == 2, "Reviews\\")
        .otherwise("S:\\Publications\\")
    )
    ending = F.when(F.col("doc_id") % 7 == 3, ".doc").when(F.col("doc_id") % 7 == 4, ".PDF").otherwise(".pdf")
    return ids.select("doc_id", "flag", F.concat(place, _paper_name(), ending).alias("hlink"))


def paper_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text): files of the labelled papers, below the folders where they really are."""
    place = (
        F.when(F.col("doc_id") % 4 == 0, "Publications/MS Clinical Trial/Journals/")
        .when(F.col("doc_id") % 4 == 1, "")
        .when(F.col("doc_id") % 4 == 2, "Reviews/")
        .otherwise("Publications/")
    )
    return labelled(spark, folder).select(F.concat(place, _paper_name(), F.lit(".txt")).alias("key"), "text")


def _paper_name():
    number = F.col("doc_id").cast("string")
    return (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("paper "), number))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("100% of %20"), number))
        .otherwise(F.concat(F.lit("a+b "), number))
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Dense vectors in the sparse layout; labels 0-4 against 5-9."""
    scan = load_table(spark, folder, "embeddings")
    table = spread(scan, scan, "vec_id")
    return table.select(
        F.col("vec_id").alias("doc_id"),
        (F.col("label") < 5).alias("flag"),
        F.sequence(F.lit(0), F.size("embedding") - 1).alias("idx"),
        F.col("embedding").cast("array<double>").alias("val"),
    )
