"""From clean documents to the tables that every model reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litsieve.functions.keys import SHUFFLE_SEED, hash01
from litsieve.operators.split import split_column
from litsieve.operators.terms import dense_enough, document_vectors, tally, term_counts, vocabulary, weigh
from litsieve.session import materialize, small_side

KEPT = ("flag", "split", "h")


@dataclass
class Dataset:
    """``docs`` (doc_id, flag, split, h) and ``counts``, its term table.

    ``h`` orders the shuffled rows: h < x is the prefix for a learning curve. ``weight`` names a column of
    both tables that says how many equal rows a row stands for.
    """

    docs: DataFrame
    counts: DataFrame
    weight: str | None = None
    _n: int | None = None

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.docs.agg(tally(F.lit(True), self.weight)).first()[0]
        return self._n


def index(clean: DataFrame, written: bool = True, weight: str | None = None, **token_options) -> Dataset:
    """Document and term tables of (doc_id, text, flag[, weight]); written once when several passes follow."""
    kept = (*KEPT, weight) if weight else KEPT
    marked = clean.withColumn("split", split_column()).withColumn("h", hash01(SHUFFLE_SEED))
    docs = marked.select("doc_id", *kept)
    if written:
        docs = materialize(docs, "documents")
    counts = term_counts(marked, keep=kept, ids=docs, **token_options)
    return Dataset(docs, materialize(counts, "terms") if written else counts, weight)


@dataclass
class VectorSet:
    """``rows`` (doc_id, flag, split, h, idx, val) over ``terms``; documents without terms included."""

    rows: DataFrame
    vocab: DataFrame
    n_features: int
    weight: str | None = None


def _scope(data: Dataset, fit_scope: str) -> Dataset:
    """The rows that give document frequencies: all of them, or train rows only."""
    if fit_scope == "all":
        return data
    own = F.col("split") == "train"
    return Dataset(data.docs.filter(own), data.counts.filter(own), data.weight)


def indexed_vocabulary(data: Dataset, level: float) -> DataFrame:
    """(term, df, idx). The vocabulary is bounded, so one task may number it."""
    vocab = vocabulary(data.counts, data.n, level, data.weight)
    return vocab.withColumn("idx", F.row_number().over(W.orderBy("term")) - 1)


def vectors(data: Dataset, level: float, fit_scope: str = "all") -> VectorSet:
    """Sparse tf-idf vectors after sparse-term removal, written for the passes of a fit.

    ``fit_scope='train'`` takes vocabulary and document frequencies from train rows only, so that nothing
    of the other rows enters a model.
    """
    seen = _scope(data, fit_scope)
    return _over(data, materialize(indexed_vocabulary(seen, level), "vocabulary"), seen.n)


def _over(data: Dataset, vocab: DataFrame, n: int) -> VectorSet:
    weights = weigh(data.counts.select("doc_id", "n_tokens", "term", "tf"), small_side(vocab), n)
    rows = (
        data.docs.join(document_vectors(weights), "doc_id", "left")
        .withColumn("idx", F.coalesce("idx", F.array().cast("array<int>")))
        .withColumn("val", F.coalesce("val", F.array().cast("array<double>")))
    )
    return VectorSet(materialize(rows, "vectors"), vocab, vocab.count(), data.weight)


def nested_vectors(data: Dataset, levels: Sequence[float]) -> tuple[VectorSet, list[int]]:
    """Vectors over the largest vocabulary of ``levels``, and the size of each level's.

    Terms are numbered by falling document frequency: the vector of a level is the part below its size.
    """
    found = vocabulary(data.counts, data.n, max(levels), data.weight)
    numbered = found.withColumn("idx", F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1)
    vocab = materialize(numbered, "vocabulary")
    sizes = vocab.agg(*(F.count_if(dense_enough(F.col("df"), data.n, s)).alias(f"n{i}") for i, s in enumerate(levels))).first()
    return _over(data, vocab, data.n), list(sizes)
