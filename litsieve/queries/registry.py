"""Registered queries: name -> function of (spark, folder of parquet tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions import text as texts
from litsieve.functions.stemming import stem_word
from litsieve.functions.stopwords import default_stop_words
from litsieve.functions.text import tokens
from litsieve.operators import clean, links, metrics, sparse_svm, split, terms
from litsieve.operators.sparse_linear import scad_path, tfidf_vectors
from litsieve.operators.svm import svm_grid
from litsieve.plans import sweep
from litsieve.plans.dataset import index, indexed_vocabulary, vectors
from litsieve.plans.ledger import ResultLedger
from litsieve.queries import inputs
from litsieve.session import materialize, scratch_path, small_side
from litsieve.sources import bodies, tables

LEVEL = 0.95
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- text -----------------------------------------------------------------------------------


@query
def normalize_text(spark, folder):
    return inputs.documents(spark, folder).select("doc_id", texts.normalize_text(F.col("text")).alias("text"))


@query
def normalize_text_tagged(spark, folder):
    return inputs.documents(spark, folder).select(
        "doc_id", texts.normalize_text(F.col("text"), "tagged").alias("text")
    )


@query
def normalize_pages_tagged(spark, folder):
    scan = tables.load_table(spark, folder, "pages").select("page_id", "html")
    pages = tables.spread(scan, scan, "page_id")
    return pages.select("page_id", texts.normalize_text(F.col("html"), "tagged").alias("text"))


@query
def remove_stopwords(spark, folder):
    text = texts.normalize_text(F.col("text"), stop_words=default_stop_words())
    return inputs.documents(spark, folder).select("doc_id", text.alias("text"))


@query
def normalize_stemmed(spark, folder):
    text = texts.normalize_text(F.col("text"), stop_words=default_stop_words(), stem=True)
    return inputs.documents(spark, folder).select("doc_id", text.alias("text"))


@query
def stem_vocabulary(spark, folder):
    words = inputs.documents(spark, folder).select(F.explode(tokens(F.col("text"))).alias("term"))
    return words.distinct().select("term", stem_word(F.col("term")).alias("stem"))


# ---- document-term table ----------------------------------------------------------------------


def _labelled_counts(spark, folder, *keep):
    docs = inputs.labelled(spark, folder)
    return docs, terms.term_counts(docs, keep)


@query
def term_counts(spark, folder):
    return terms.term_counts(inputs.documents(spark, folder))


@query
def sparse_vocab(spark, folder):
    docs, counts = _labelled_counts(spark, folder)
    return terms.vocabulary(counts, terms.document_count(docs), 0.92)


def _weights(spark, folder, level):
    data = index(inputs.labelled(spark, folder))
    vocab = materialize(terms.vocabulary(data.counts, data.n, level), "vocabulary")
    return terms.weigh(data.counts, small_side(vocab), data.n)


@query
def tfidf(spark, folder):
    weights = _weights(spark, folder, 0.92)
    return weights.select("doc_id", "term", "tf", "n_tokens", F.round("weight", 6).alias("weight"))


@query
def presence(spark, folder):
    return terms.present(_weights(spark, folder, LEVEL)).select("doc_id", "flag", "term")


@query
def feature_summary(spark, folder):
    data = index(inputs.labelled(spark, folder))
    return terms.feature_summary(data.docs, terms.vocabulary(data.counts, data.n, LEVEL))


@query
def class_term_frequency(spark, folder):
    _, counts = _labelled_counts(spark, folder, "flag")
    return terms.class_term_frequency(counts, {True: 20, False: 60})


@query
def role_term_frequency(spark, folder):
    scan = tables.load_table(spark, folder, "conversations")
    turns = tables.spread(scan, scan, "conv_id")
    counts = terms.term_counts(
        turns.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "role", "text"), ("role",)
    )
    return terms.class_term_frequency(counts, {"user": 20, "assistant": 60}, "role")


@query
def class_counts(spark, folder):
    return metrics.class_counts(inputs.labelled(spark, folder))


@query
def class_weights(spark, folder):
    train = split.split_by_threshold(inputs.labelled(spark, folder)).filter(sweep.is_train())
    return metrics.class_weights(train).withColumn("weight", F.round("weight", 6))


# ---- sampling and splits ----------------------------------------------------------------------


def _ids(spark, folder):
    return tables.load_table(spark, folder, "documents").select("doc_id")


@query
def shuffle_key(spark, folder):
    return split.with_shuffle_key(_ids(spark, folder))


@query
def ratio_sample(spark, folder):
    return split.ratio_sample(_ids(spark, folder), 0.3)


@query
def split_train_validate_test(spark, folder):
    return split.split_by_threshold(_ids(spark, folder))


@query
def split_exact(spark, folder):
    return split.split_exact(_ids(spark, folder))


@query
def holdout_split(spark, folder):
    return split.holdout_split(_ids(spark, folder))


@query
def holdout_split_sampled(spark, folder):
    return split.holdout_split(_ids(spark, folder), ratio_train=0.5)


@query
def kfold_assign(spark, folder):
    return split.assign_folds(_ids(spark, folder), 10)


@query
def prefix_sizes(spark, folder):
    ids = _ids(spark, folder)
    h = split.hash01(split.SHUFFLE_SEED)
    counts = ids.agg(*(F.count_if(h < f).alias(f"n{i}") for i, f in enumerate(sweep.FRACTIONS)))
    rows = (
        F.struct(F.lit(f).alias("fraction"), F.col(f"n{i}").alias("n_rows"))
        for i, f in enumerate(sweep.FRACTIONS)
    )
    return counts.select(F.inline(F.array(*rows)))


# ---- screening tables -------------------------------------------------------------------------


@query
def screening_agreement(spark, folder):
    agreed = clean.screening_agreement(inputs.screening(spark, folder))
    return clean.clean_set(agreed)


@query
def screening_union(spark, folder):
    return clean.clean_set(clean.agreed_by_union(inputs.screening(spark, folder)))


@query
def bibliography_clean(spark, folder):
    return clean.clean_bibliography(inputs.bibliography(spark, folder))


def _merged(spark, folder):
    left = clean.clean_screening(inputs.screening(spark, folder))
    return clean.merge_titles(left, clean.clean_bibliography(inputs.bibliography(spark, folder)))


@query
def title_merge(spark, folder):
    return _merged(spark, folder).select("id", "title", "jatype", "copies")


@query
def papers_kept(spark, folder):
    # invented titles name no meeting, so two of their words stand in
    kept = clean.keep_papers(_merged(spark, folder), meeting_words=("erth", "tion"))
    return kept.select("id", "title", "jatype", "copies")


@query
def type_frequency(spark, folder):
    return clean.type_frequency(_merged(spark, folder))


@query
def merged_agreement(spark, folder):
    """The whole preparation of the first driver: clean, merge, keep papers, agree, normalise."""
    agreed = clean.screening_agreement(clean.keep_papers(_merged(spark, folder)))
    return agreed.select("id", "flag", "copies", texts.normalize_text(F.col("text"), "tagged").alias("text"))


@query
def link_normalize(spark, folder):
    manifest = tables.load_table(spark, folder, "pages").select(
        "page_id", F.col("url").alias("hlink")
    )
    return links.normalize_links(
        manifest,
        extension=".html$",
        condition="(?i)^http://[a-z]+[.]",
        rules=(("/en/", "/english/"), ("/fr/", "/french/"), ("example", "sample")),
        folders=("/es", "/de"),
        drive="https:",
        share="http:",
        base="https://library/",
    )


# ---- files ------------------------------------------------------------------------------------


@query
def screening_tsv(spark, folder):
    path = scratch_path(spark, "screening")
    tables.write_tsv(inputs.screening(spark, folder), path)
    return clean.clean_screening(tables.read_screening(spark, path))


@query
def bibliography_tsv(spark, folder):
    path = scratch_path(spark, "bibliography")
    tables.write_tsv(inputs.bibliography(spark, folder), path, header=False)
    return clean.clean_bibliography(tables.read_bibliography(spark, path))


def _links(spark, folder):
    return tables.load_table(spark, folder, "pages").select(
        (F.col("page_id") % 3 == 0).alias("flag"), F.col("url").alias("hlink")
    )


@query
def manifest_tsv(spark, folder):
    path = scratch_path(spark, "manifest")
    tables.write_tsv(_links(spark, folder), path)
    return links.keep_extension(tables.read_manifest(spark, path), pattern=".html$")


#: Folders of the bodies; a task lists a folder, so their number bounds its share of the files.
BODY_FOLDERS = 1024


@query
def load_bodies(spark, folder):
    """Bodies exist for the labelled documents only; the manifest names all documents."""
    path = scratch_path(spark, "bodies")
    # rows of one document are the lines of one file; folders hold a bounded share of the files
    lines = F.concat(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))), "\n"), F.lit("\n"))
    # a fixed number of tasks: files cost more than their bytes, by which Spark would merge tasks
    tasks = 4 * spark.sparkContext.defaultParallelism
    own = inputs.labelled(spark, folder).repartition(tasks, "doc_id").groupBy("doc_id").agg(lines.alias("text"))
    name = F.concat(F.pmod("doc_id", F.lit(BODY_FOLDERS)).cast("string"), F.lit("/doc_id="), F.col("doc_id").cast("string"))
    bodies.write_named_bodies(own.select(F.concat(name, F.lit(".txt")).alias("key"), "text"), path)
    found = bodies.read_bodies(spark, path)
    key = F.regexp_extract(bodies.path_key(F.col("path"), path), "(doc_id=-?[0-9]+)[.]txt$", 1)
    manifest = _ids(spark, folder).withColumn("key", F.concat(F.lit("doc_id="), F.col("doc_id").cast("string")))
    return bodies.load_bodies(manifest, found.withColumn("key", key)).select("doc_id", "text")


def _full_text_papers(spark, folder):
    root = scratch_path(spark, "papers")
    bodies.write_named_bodies(inputs.paper_files(spark, folder), root)
    repaired = links.normalize_links(inputs.paper_manifest(spark, folder))
    named = repaired.withColumn("key", bodies.path_key(F.col("txtlink"), "S:"))
    found = bodies.load_bodies(named, bodies.read_named_bodies(named, root))
    return clean.long_bodies(found)


@query
def full_text_papers(spark, folder):
    """The second driver's input: manifest, link repair, bodies by name, long ones kept."""
    return _full_text_papers(spark, folder).select("doc_id", "flag", "hlink", "text")


@query
def full_text_nb_curve(spark, folder):
    """The second driver's levels over the papers that its manifest names."""
    data = index(_full_text_papers(spark, folder).select("doc_id", "text", "flag"))
    return metrics.rounded(sweep.nb_feature_curve(data, sweep.FULL_TEXT_LEVELS))


@query
def long_bodies(spark, folder):
    return clean.long_bodies(inputs.documents(spark, folder)).select("doc_id", F.length("text").cast("long").alias("n"))


@query
def write_series(spark, folder):
    path = scratch_path(spark, "series")
    tables.write_series(metrics_long(spark, folder), path)
    return tables.read_series(spark, path)


# ---- naive Bayes ------------------------------------------------------------------------------


def _data(spark, folder):
    return index(inputs.labelled(spark, folder))


@query
def nb_predict(spark, folder):
    found = sweep.nb_predictions(_data(spark, folder), LEVEL)
    return found.select(
        "doc_id",
        "flag",
        "split",
        F.round("score_true", 6).alias("score_true"),
        F.round("score_false", 6).alias("score_false"),
        "predicted",
    )


@query
def nb_metrics(spark, folder):
    found = sweep.nb_predictions(_data(spark, folder), LEVEL)
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found)))


@query
def nb_train_scope(spark, folder):
    found = sweep.nb_predictions(_data(spark, folder), LEVEL, fit_scope="train")
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found)))


@query
def nb_feature_curve(spark, folder):
    return metrics.rounded(sweep.nb_feature_curve(_data(spark, folder)))


@query
def nb_learning_curve(spark, folder):
    return metrics.rounded(sweep.nb_learning_curve(_data(spark, folder), LEVEL))


@query
def nb_kfold_tuning(spark, folder):
    found = sweep.tune_naive_bayes(_data(spark, folder), kfold=5)
    return metrics.rounded(found, ("sensitivity", "specificity", "balanced_accuracy"))


@query
def best_params(spark, folder):
    curve = sweep.nb_feature_curve(_data(spark, folder)).filter("split = 'validate'")
    best = metrics.best_parameters(curve, ["xvar"], by=["split"])
    return metrics.rounded(best, ("sensitivity", "specificity", "balanced_accuracy"))


@query
def best_balanced(spark, folder):
    """As ``best_params`` without a least sensitivity."""
    curve = sweep.nb_feature_curve(_data(spark, folder)).filter("split = 'validate'")
    best = metrics.best_parameters(curve, ["xvar"], min_sensitivity=-1.0, by=["split"])
    return metrics.rounded(best, ("sensitivity", "specificity", "balanced_accuracy"))


@query
def result_table(spark, folder):
    """Curves of naive Bayes through a ledger: two levels, then all, of which the ledger fits the rest; then the prefixes."""
    ledger = ResultLedger(spark, scratch_path(spark, "results"))
    data = _data(spark, folder)
    ledger.evaluate(data, "feature_curve", "NB", values=sweep.LEVELS[:2])
    ledger.evaluate(data, "feature_curve", "NB")
    ledger.evaluate(data, "learning_curve", "NB", level=LEVEL)
    return metrics.rounded(ledger.table().drop("fingerprint"), ("value",))


@query
def tuned_nb_holdout(spark, folder):
    """Sparse level chosen by five folds of the train rows; metrics of the refitted model on the test rows.

    Empty when no level is sensitive enough. All levels are scored in one pass, so the choice stays a join.
    """
    data = _data(spark, folder)
    tuned = sweep.tune_naive_bayes(sweep.train_rows(data), kfold=5)
    best = metrics.best_parameters(metrics.rounded(tuned, ("balanced_accuracy",), 9), ["sparselevel"])
    scored = sweep.nb_feature_curve(data, sweep.TUNE_LEVELS).filter("split = 'test'")
    chosen = best.select(F.col("sparselevel").alias("xvar"))  # one row
    return metrics.rounded(scored.join(F.broadcast(chosen), "xvar"))


@query
def metrics_long(spark, folder):
    long = metrics.series(sweep.nb_feature_curve(_data(spark, folder)))
    return metrics.rounded(long, ("value",))


@query
def series_view(spark, folder):
    return metrics.series_view(metrics_long(spark, folder), "validate")


# ---- with the words that the drivers keep ------------------------------------------------------

PREPARED = {"preset": "tagged", "stop_words": default_stop_words()}


@query
def term_counts_stopped(spark, folder):
    return terms.term_counts(inputs.documents(spark, folder), **PREPARED)


@query
def term_counts_stemmed(spark, folder):
    return terms.term_counts(inputs.documents(spark, folder), **PREPARED, stem=True)


@query
def nb_metrics_stopped(spark, folder):
    found = sweep.nb_predictions(index(inputs.labelled(spark, folder), **PREPARED), LEVEL)
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found)))


@query
def nb_metrics_stemmed(spark, folder):
    found = sweep.nb_predictions(index(inputs.labelled(spark, folder), **PREPARED, stem=True), LEVEL)
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found)))


def _screened(spark, folder):
    """The first driver's input: merged, kept and agreed papers, weighted by the merged rows that each stands for."""
    agreed = clean.screening_agreement(clean.keep_papers(_merged(spark, folder)))
    return index(clean.weighted_set(agreed), weight="copies", **PREPARED)


@query
def screened_nb_metrics(spark, folder):
    """The first driver from its tables to metrics: every merged row counts, without writing the copies out."""
    found = sweep.nb_predictions(_screened(spark, folder), LEVEL)
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found, weight="copies")))


# ---- nearest neighbours -----------------------------------------------------------------------


def _votes(frame):
    return frame.select(
        "doc_id", "flag", "split", "k", "votes_true", "votes_false", F.round("probability", 6).alias("probability"), "predicted"
    )


@query
def knn_predict(spark, folder):
    return _votes(sweep.knn_predictions(vectors(_data(spark, folder), LEVEL), [3]))


@query
def knn_small_blocks(spark, folder):
    """As ``knn_predict``, with blocks so small that queries meet many cells and blocks."""
    return _votes(sweep.knn_predictions(vectors(_data(spark, folder), LEVEL), [3], block_rows=32))


@query
def knn_train_scope(spark, folder):
    """Vocabulary and weights from the train rows only."""
    return _votes(sweep.knn_predictions(vectors(_data(spark, folder), LEVEL, "train"), [3]))


@query
def screened_knn_metrics(spark, folder):
    """As ``screened_nb_metrics`` with three neighbours; each merged row is a neighbour."""
    found = sweep.knn_predictions(vectors(_screened(spark, folder), LEVEL), [3])
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found, weight="copies")))


@query
def knn_feature_curve(spark, folder):
    """The two points of its SQL; ``knn_feature_curve_full`` has all."""
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "feature_curve", "kNN", values=(LEVEL, 0.9)))


@query
def svm_feature_curve(spark, folder):
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "feature_curve", "SVM"))


@query
def knn_feature_curve_full(spark, folder):
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "feature_curve", "kNN"))


@query
def knn_learning_curve(spark, folder):
    """The two points of its SQL; ``knn_learning_curve_full`` has all."""
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "learning_curve", "kNN", values=(0.5, 1.0)))


@query
def knn_learning_curve_full(spark, folder):
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "learning_curve", "kNN"))


@query
def svm_learning_curve(spark, folder):
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "learning_curve", "SVM"))


@query
def knn_k_curve(spark, folder):
    return metrics.rounded(sweep.curve_metrics(_data(spark, folder), "k_curve", "kNN", level=LEVEL))


@query
def knn_embeddings(spark, folder):
    rows = split.split_by_threshold(inputs.embeddings(spark, folder))
    return _votes(sweep.knn_predictions(rows, sweep.NEIGHBOURS))


# ---- support vector machines ------------------------------------------------------------------


@query
def svm_metrics(spark, folder):
    rows = vectors(_data(spark, folder), 0.92)
    point = [{"cost": 2.0, "gamma": 0.002}]
    return sweep.by_point(sweep.svm_predictions(rows.rows, rows.n_features, point, sweep.is_train()), "cost", "gamma")


@query
def svm_cost_curve(spark, folder):
    return sweep.evaluate(_data(spark, folder), "cost_curve", "SVM")


@query
def svm_gamma_curve(spark, folder):
    return sweep.evaluate(_data(spark, folder), "gamma_curve", "SVM")


@query
def svm_cost_gamma(spark, folder):
    return sweep.cost_gamma_metrics(_data(spark, folder))


@query
def svm_grid_search(spark, folder):
    rows = vectors(_data(spark, folder), 0.92)
    return svm_grid(rows.rows.filter(sweep.is_train()), rows.n_features)


@query
def tune_model(spark, folder):
    return sweep.tune_svm(sweep.train_rows(_data(spark, folder)))


@query
def tuned_svm_holdout(spark, folder):
    """Sparse level, cost and gamma chosen on a fifth of the train rows; metrics of the refitted model on the test rows.

    Empty when no point is sensitive enough.
    """
    return metrics.rounded(sweep.tuned_svm_holdout(_data(spark, folder)))


@query
def sparse_linear_select(spark, folder):
    docs = inputs.labelled(spark, folder)
    data = index(docs)
    vocab = indexed_vocabulary(data, 0.9).withColumn("idf", F.log2(F.lit(data.n) / F.col("df")))
    kept = vocab.orderBy("idx").select("term", "idf").collect()  # bounded vocabulary
    words = docs.select("doc_id", "flag", split.split_column().alias("split"), tokens(F.col("text")).alias("tokens"))
    rows = tfidf_vectors(words, [r["term"] for r in kept], [r["idf"] for r in kept])
    _, found = scad_path(rows, sweep.is_train())
    return sweep.by_point(found, "lambda", "n_selected")


def _sparse_path(spark, folder):
    rows = vectors(_data(spark, folder), 0.92)
    validate = F.col("split") == "validate"
    return rows, sparse_svm.sparse_svm_path(rows.rows, rows.n_features, sweep.is_train(), validate)


@query
def sparse_svm_terms(spark, folder):
    """Terms that the SCAD path of the SVM selects; ``chosen`` marks those of the penalty that the validation rows prefer."""
    rows, path = _sparse_path(spark, folder)
    return sparse_svm.path_terms(rows.vocab, path).withColumn("weight", F.round("weight", 6))


@query
def sparse_svm_lambdas(spark, folder):
    """Each penalty of the path: number of terms and metrics on the validation rows."""
    rows, path = _sparse_path(spark, folder)
    return metrics.rounded(sparse_svm.path_summary(rows.vocab, path))


@query
def sparse_svm_holdout(spark, folder):
    """Metrics by split of the chosen penalty's model; empty when nothing is chosen."""
    rows, path = _sparse_path(spark, folder)
    if path is None or path.chosen is None:
        found = rows.rows.withColumn("predicted", F.lit(None).cast("boolean")).limit(0)
    else:
        found = sparse_svm.predict(rows.rows, path.weights(path.chosen))
    return metrics.rounded(metrics.confusion_metrics(metrics.contingency(found)))
