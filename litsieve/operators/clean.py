"""Cleaning, merging and agreement of screening tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the two cleaning passes keep or drop.
BOOK_TYPES = ("Book", "Book Section")
LAST_YEAR = 2014
PAPER_TYPES = ("article", "review")
MEETING_WORDS = ("meeting", "conference")
MIN_BODY_CHARS = 1000


def non_empty(column: str) -> Column:
    return F.col(column).isNotNull() & (F.length(column) > 0)


def clean_screening(screening: DataFrame) -> DataFrame:
    """Rows with a title; the title, which is the merge key, in lower case."""
    return screening.filter(non_empty("title")).withColumn("title", F.lower("title"))


def clean_bibliography(
    bibliography: DataFrame,
    last_year: int = LAST_YEAR,
    book_column: str = "issue",
    book_types: Sequence[str] = BOOK_TYPES,
) -> DataFrame:
    """(title, jatype), lower case: no empty rows, no rows after ``last_year``, no books.

    A null year or book column keeps the row.
    """
    kept = (
        bibliography.dropna(how="all")
        .filter(F.col("year").isNull() | (F.col("year") <= last_year))
        .filter(~F.coalesce(F.col(book_column).isin(list(book_types)), F.lit(False)))
    )
    return kept.select(F.lower("title").alias("title"), F.lower("jatype").alias("jatype"))


def merge_titles(screening: DataFrame, bibliography: DataFrame, expand: bool = False) -> DataFrame:
    """Full outer join on title.

    A title that repeats on both sides multiplies its rows. Equal bibliography rows are counted
    first and the multiple is kept in ``copies``, so that a title on a third of all rows does not
    square; ``expand`` writes the copies out. The outer join is a left join, whose skewed
    partitions adaptive execution can split, plus the titles that only the bibliography has.
    """
    counted = bibliography.groupBy("title", "jatype").agg(F.count(F.lit(1)).alias("copies"))
    matched = screening.join(counted, "title", "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1).cast("long"))
    )
    only_right = counted.join(screening.select("title").distinct(), "title", "left_anti")
    merged = matched.unionByName(only_right, allowMissingColumns=True)
    return expand_copies(merged) if expand else merged


def expand_copies(merged: DataFrame) -> DataFrame:
    """One row per pair of matching rows."""
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return merged.withColumn("copies", one).drop("copies")


def type_frequency(merged: DataFrame) -> DataFrame:
    count = F.sum("copies") if "copies" in merged.columns else F.count(F.lit(1))
    return merged.groupBy("jatype").agg(count.alias("n"))


def keep_papers(
    merged: DataFrame,
    paper_types: Sequence[str] = PAPER_TYPES,
    meeting_words: Sequence[str] = MEETING_WORDS,
) -> DataFrame:
    """Screened rows with text, of a paper type or none, whose title names no meeting."""
    kept = (
        merged.filter(non_empty("text"))
        .filter(F.col("jatype").isin(list(paper_types)) | F.col("jatype").isNull())
        .filter(F.col("id").isNotNull())
    )
    for word in meeting_words:
        kept = kept.filter(~F.col("title").contains(word))
    return kept


def screening_agreement(df: DataFrame, double_screening: bool = True) -> DataFrame:
    """Adds ``flag`` where both screeners decided alike; other rows are left out.

    One pass instead of a union of two selections; a null decision never agrees.
    """
    if not double_screening:
        return df
    return df.filter(F.col("s1_included") == F.col("s2_included")).withColumn(
        "flag", F.col("s1_included")
    )


def weighted_set(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc_id, text, flag, copies): one row per paper of a merged table, with the rows that it stands for.

    A paper whose title matches bibliography rows of several kinds has several merged rows; their copies
    add up. Rows that share an id are one paper: its text is the greatest, its flag TRUE if any is.
    """
    return df.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max("text").alias("text"), F.max("flag").alias("flag"), F.sum("copies").alias("copies")
    )


def agreed_by_union(df: DataFrame) -> DataFrame:
    """The same rows as ``screening_agreement``, as positives followed by negatives."""
    both_in = df.filter(F.col("s1_included") & F.col("s2_included")).withColumn("flag", F.lit(True))
    both_out = df.filter(~F.col("s1_included") & ~F.col("s2_included")).withColumn("flag", F.lit(False))
    return both_in.unionByName(both_out)


def clean_set(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc_id, text, flag), by name."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), "text", "flag")


def label_column(flag: str = "flag") -> Column:
    """1.0 for TRUE, the positive class."""
    return F.when(F.col(flag), 1.0).otherwise(0.0)


def attach_label(features: DataFrame, clean: DataFrame) -> DataFrame:
    return features.join(clean.select("doc_id", "flag"), "doc_id")


def long_bodies(df: DataFrame, min_chars: int = MIN_BODY_CHARS) -> DataFrame:
    return df.filter(F.length("text") > min_chars)
