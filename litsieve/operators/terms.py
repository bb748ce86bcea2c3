"""Document-term tables in long form: one row per (document, term), never one column per term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import tokens
from litsieve.session import materialize, small_side


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def document_count(docs: DataFrame) -> Column:
    """Number of documents as a scalar subquery, so the plan stays lazy and reads ids only."""
    return docs.agg(F.count(F.lit(1))).scalar()


def term_counts(clean: DataFrame, keep: Sequence[str] = (), ids: DataFrame | None = None, **token_options) -> DataFrame:
    """(doc_id, *keep, n_tokens, term, tf).

    ``n_tokens`` is the document's total over all its terms. The terms of a row are counted within the row, from
    its sorted tokens: nothing is shuffled or held beyond the row. Only rows whose ``doc_id`` is repeated
    are grouped, as rows of one id and equal kept columns are one document. ``ids`` is a cheaper table
    with the same ``doc_id`` column, where ``clean`` is costly.
    """
    repeated = (ids if ids is not None else clean).groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(repeated.filter("n > 1").select("__id"), "repeated-ids")
    if repeated.isEmpty():
        return _row_counts(clean, keep, token_options)
    again = small_side(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = _row_counts(clean.join(again, same, "left_anti"), keep, token_options)
    parts = _row_counts(clean.join(again, same, "left_semi"), keep, token_options)
    merged = parts.groupBy("doc_id", *keep, "n_tokens", "term").agg(F.sum("tf").alias("tf"))
    return once.unionByName(merged)


def _row_counts(clean: DataFrame, keep: Sequence[str], token_options: dict) -> DataFrame:
    """Term counts of each row: a term's number is the distance between its first place and the next term's."""
    found = clean.select("doc_id", *keep, tokens(F.col("text"), **token_options).alias("tokens"))
    # one projection a step: Spark then keeps an array that the next step reads twice as a column
    size = F.size("tokens").cast("long").alias("n_tokens")
    ordered = found.select("doc_id", *keep, size, F.sort_array("tokens").alias("tokens"))
    # place i where a term starts, and one place behind the last token
    shifted = F.concat(F.array(F.lit("")), F.col("tokens"))
    changed = F.zip_with("tokens", shifted, lambda word, before: word.isNull() | (word != before))
    places = F.filter(F.transform(changed, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
    starts = ordered.select("doc_id", *keep, "n_tokens", F.array_distinct("tokens").alias("terms"), places.alias("places"))
    ends = F.slice("places", F.lit(2), F.size("terms"))
    runs = F.zip_with("terms", F.zip_with(ends, F.slice("places", F.lit(1), F.size("terms")), lambda b, a: b - a),
                      lambda term, tf: F.struct(term.alias("term"), tf.cast("long").alias("tf")))
    counted = starts.select("doc_id", *keep, "n_tokens", runs.alias("runs"))
    # the outer form keeps Spark from adding a filter that would normalise twice
    exploded = counted.select("doc_id", *keep, "n_tokens", F.inline_outer("runs"))
    return exploded.filter(F.col("term").isNotNull())


def tally(condition: Column, weight: str | None = None) -> Column:
    """Rows that meet ``condition``; with ``weight``, the sum of that column over them."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long"))


def document_frequency(counts: DataFrame, weight: str | None = None) -> DataFrame:
    """(term, df). A term found in a third of all documents is combined before the shuffle."""
    return counts.groupBy("term").agg(tally(F.lit(True), weight).alias("df"))


def dense_enough(df: Column, n_docs: Column | int, level: Column | float) -> Column:
    """df > N * (1 - level), strictly and in double arithmetic."""
    as_column = F.lit(level) if not isinstance(level, Column) else level
    total = F.lit(n_docs) if not isinstance(n_docs, Column) else n_docs
    return df.cast("double") > total.cast("double") * (F.lit(1.0) - as_column.cast("double"))


def vocabulary(counts: DataFrame, n_docs: Column | int, level: float, weight: str | None = None) -> DataFrame:
    """(term, df) after sparse-term removal.

    The size does not grow with the collection: every kept term is in more than N(1 - level)
    documents, so there are fewer than (mean distinct terms per document) / (1 - level).
    """
    return document_frequency(counts, weight).filter(dense_enough(F.col("df"), n_docs, level))


def weigh(counts: DataFrame, vocab: DataFrame, n_docs: Column | int) -> DataFrame:
    """tf-idf: (tf / n_tokens) * log2(N / df), for the terms of ``vocab`` only."""
    total = F.lit(n_docs) if not isinstance(n_docs, Column) else n_docs
    return counts.join(vocab, "term").withColumn(
        "weight", F.col("tf") / F.col("n_tokens") * F.log2(total / F.col("df"))
    )


def present(weights: DataFrame) -> DataFrame:
    """Binary features: a term of every document has weight 0 and is nowhere present."""
    return weights.filter(F.col("weight") > 0)


def class_term_frequency(counts: DataFrame, floors: dict, class_col: str = "flag", floor: int = 1) -> DataFrame:
    """(class, term, freq) with a minimum frequency per class; ``floor`` holds for classes not named."""
    totals = counts.groupBy(class_col, "term").agg(F.sum("tf").alias("freq"))
    least = F.lit(floor)
    for value, own in floors.items():
        least = F.when(F.col(class_col) == F.lit(value), F.lit(own)).otherwise(least)
    return totals.filter(F.col("freq") >= least)


def feature_summary(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: number of documents and of features."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).withColumn(
        "n_features", vocab.agg(F.count(F.lit(1))).scalar()
    )


def document_vectors(weights: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, *keep, idx, val): sparse vectors sorted by index, from (doc_id, idx, weight).

    One group is one document and holds at most the vocabulary.
    """
    entries = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    grouped = weights.groupBy("doc_id", *keep).agg(entries.alias("entries"))
    return grouped.select(
        "doc_id", *keep, F.col("entries.idx").alias("idx"), F.col("entries.weight").alias("val")
    )
