import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.operators import hinge, metrics, split, terms
from litsieve.operators.bayes import Variant, naive_bayes
from litsieve.operators.knn import knn_votes
from litsieve.operators.sparse_linear import scad_path, scad_weight, selected_terms, tfidf_vectors
from litsieve.operators.svm import (
    FourierMap, Scaling, fit_scaling, random_weights, svm_grid, svm_predictions, svm_tallies,
)
from litsieve.plans import sweep
from litsieve.plans.dataset import index, vectors


def test_sparse_level_is_strict_in_doubles(spark):
    # 'eighty' is in 80 of 1000 documents, 'fewer' in 79, 'every' in all
    df = spark.range(1000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("every"), F.when(F.col("id") < 80, " eighty").otherwise(""), F.when(F.col("id") < 79, " fewer").otherwise("")).alias("text"),
    )
    counts = terms.term_counts(df)
    vocab = terms.vocabulary(counts, 1000, 0.92)
    assert {r["term"]: r["df"] for r in vocab.collect()} == {"every": 1000, "eighty": 80}
    weights = terms.weigh(counts, vocab, 1000)
    assert weights.filter("term = 'every' and weight <> 0").count() == 0
    assert {r["term"] for r in terms.present(weights).collect()} == {"eighty"}
    assert weights.filter("term = 'eighty' and doc_id = 0").first()["weight"] == pytest.approx(math.log2(12.5) / 3)


def test_counts_and_class_frequency(spark):
    df = spark.createDataFrame([(1, "aaa aaa bb ccc", True), (2, "aaa", False), (3, "", False)], "doc_id long, text string, flag boolean")
    counts = terms.term_counts(df, ["flag"])
    assert sorted((r["doc_id"], r["term"], r["tf"], r["n_tokens"]) for r in counts.collect()) == [
        (1, "aaa", 2, 3), (1, "ccc", 1, 3), (2, "aaa", 1, 1),
    ]
    found = terms.class_term_frequency(counts, {True: 2, False: 1}).collect()
    assert sorted((r["flag"], r["term"], r["freq"]) for r in found) == [(False, "aaa", 1), (True, "aaa", 2)]
    summary = terms.feature_summary(df, terms.vocabulary(counts, 3, 0.5)).first()
    assert (summary["n_docs"], summary["n_features"]) == (3, 1)


def test_splits(spark):
    df = spark.range(101).toDF("doc_id")
    exact = {r["split"]: r["n"] for r in split.split_exact(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert exact == {"train": 61, "validate": 20, "test": 20}
    a = split.split_exact(df).collect()
    b = split.split_exact(df.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert set(r["split"] for r in split.split_by_threshold(df).collect()) == {"train", "validate", "test"}
    small = {r[0] for r in split.prefix_subset(df, 0.2).collect()}
    assert small < {r[0] for r in split.prefix_subset(df, 0.5).collect()}
    assert split.holdout_split(df).filter("split is null").count() == 0
    assert split.holdout_split(df, 0.5, 0.2).filter("split is null").count() > 0
    assert {r["fold"] for r in split.assign_folds(df, 5).collect()} == {0, 1, 2, 3, 4}
    assert split.half_even(0.5) == 0 and split.half_even(1.5) == 2


def test_confusion_metrics(spark):
    row = metrics.confusion_metrics(spark.createDataFrame([(8, 2, 1, 9)], "tp long, fp long, fn long, tn long")).first()
    assert row["sensitivity"] == pytest.approx(8 / 9) and row["specificity"] == pytest.approx(9 / 11)
    assert row["balanced_accuracy"] == pytest.approx((8 / 9 + 9 / 11) / 2)
    assert row["ppv"] == 0.8 and row["npv"] == 0.9 and row["accuracy"] == 0.85
    assert row["no_information_rate"] == pytest.approx(11 / 20)
    assert row["kappa"] == pytest.approx((0.85 - 0.5) / 0.5) and row["mcnemar"] == 0.0
    none = metrics.confusion_metrics(spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")).first()
    assert none["sensitivity"] is None and none["ppv"] is None and none["balanced_accuracy"] is None
    assert none["mcnemar"] is None and none["specificity"] == 1.0


def test_recorded_triples_are_means():
    for tpr, accuracy, tnr in ((0.674076607387141, 0.789605432640162, 0.905134257893184),):
        assert (tpr + tnr) / 2 == pytest.approx(accuracy, abs=1e-12)
    assert split.half_even(27467 * 0.2) == 5493 and split.half_even(3901 * 0.6) == 2341


def test_best_parameters(spark):
    schema = "cost double, gamma double, sensitivity double, specificity double, balanced_accuracy double"
    rows = [(2.0, 1.0, 0.9, 0.7, 0.8), (1.0, 2.0, 0.9, 0.7, 0.8), (1.0, 1.0, 0.9, 0.7, 0.8), (0.1, 0.1, 0.8, 1.0, 0.9)]
    best = metrics.best_parameters(spark.createDataFrame(rows, schema), ["cost", "gamma"]).collect()
    assert [(r["cost"], r["gamma"]) for r in best] == [(1.0, 1.0)]
    none = metrics.best_parameters(spark.createDataFrame(rows[3:], schema), ["cost", "gamma"])
    assert none.count() == 0


def test_class_weights_and_views(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (False,), (False,)], "flag boolean")
    assert {r["flag"]: r["weight"] for r in metrics.class_weights(df).collect()} == {True: 1.0, False: 0.25}
    long = spark.createDataFrame([("train_tpr",), ("validate_tpr",), ("test_tpr",)], "variable string")
    assert {r[0] for r in metrics.series_view(long, "test").collect()} == {"train_tpr", "test_tpr"}


def bayes_by_hand(docs, train, vocab):
    """docs: id -> (flag, set of terms). Scores with the floor, straight from the definition."""
    out = {}
    for i, (_, own) in docs.items():
        score = {}
        for c in (True, False):
            members = [docs[j][1] for j in train if docs[j][0] == c]
            s = math.log(len(members) / len(train))
            for t in vocab:
                p = sum(t in m for m in members) / len(members)
                p = p if t in own else 1 - p
                s += math.log(p if p > 0 else 0.001)
            score[c] = s
        out[i] = score
    return out


def test_naive_bayes_against_definition(spark):
    texts = {
        1: (True, "red green"), 2: (True, "red blue"), 3: (True, "red"), 4: (False, "blue green"),
        5: (False, "blue"), 6: (False, "green blue"), 7: (True, "none"), 8: (False, ""), 9: (True, "red blue green"),
    }
    clean = spark.createDataFrame([(i, t, f) for i, (f, t) in texts.items()], "doc_id long, text string, flag boolean")
    clean = clean.withColumn("fold", (F.col("doc_id") > 6).cast("int"))
    counts = terms.term_counts(clean, ["flag", "fold"])
    found = naive_bayes(
        clean.select("doc_id", "flag", "fold"), counts,
        {"a": F.col("fold") == 0, "one": F.col("doc_id") <= 3, "zero": F.col("doc_id") < 0},
        [Variant({"v": 0}, "a", 0.7), Variant({"v": 1}, "a", 0.5)],
    ).collect()
    sets = {i: (f, set(t.split())) for i, (f, t) in texts.items()}
    train = [1, 2, 3, 4, 5, 6]
    for v, vocab in ((0, {"red", "green", "blue"}), (1, {"blue"})):
        # level 0.5: more than 4.5 of 9 documents
        expected = bayes_by_hand(sets, train, vocab)
        for r in (r for r in found if r["v"] == v):
            assert r["score_true"] == pytest.approx(expected[r["doc_id"]][True])
            assert r["score_false"] == pytest.approx(expected[r["doc_id"]][False])
            assert r["predicted"] == (round(r["score_true"] - r["score_false"], 9) >= 0)
    assert len(found) == 18


def test_naive_bayes_with_one_class_or_no_rows(spark):
    clean = spark.createDataFrame([(1, "red", True), (2, "red", True), (3, "blue", False)], "doc_id long, text string, flag boolean")
    counts = terms.term_counts(clean.withColumn("n", F.col("doc_id")), ["flag", "n"])
    docs = clean.select("doc_id", "flag", F.col("doc_id").alias("n"))
    found = naive_bayes(
        docs, counts, {"one": F.col("n") <= 2, "none": F.col("n") < 0},
        [Variant({"v": "one"}, "one", 0.9), Variant({"v": "none"}, "none", 0.9)],
    )
    assert {r["predicted"] for r in found.filter("v = 'one'").collect()} == {True}
    assert {r["predicted"] for r in found.filter("v = 'none'").collect()} == {None}


def sparse_rows(spark, points):
    """points: (doc_id, flag, dense list)"""
    rows = [
        (i, f, [j for j, v in enumerate(x) if v], [float(v) for v in x if v]) for i, f, x in points
    ]
    return spark.createDataFrame(rows, "doc_id long, flag boolean, idx array<int>, val array<double>")


def knn_by_hand(points, train, k):
    out = {}
    for i, _, x in points:
        d = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y)), 9), f) for _, f, y in train)
        bound = d[min(k, len(d)) - 1][0]
        voters = [f for dist, f in d if dist <= bound]
        out[i] = (sum(voters), len(voters) - sum(voters))
    return out


def test_knn_ties_vote_and_tied_vote_is_false(spark):
    points = [(1, True, [1, 0]), (2, False, [-1, 0]), (3, True, [5, 5]), (4, True, [0, 0])]
    df = sparse_rows(spark, points)
    votes = knn_votes(df.filter("doc_id = 4"), df.filter("doc_id < 4"), [1]).first()
    assert (votes["votes_true"], votes["votes_false"], votes["predicted"]) == (1, 1, False)
    assert votes["probability"] == 0.5


@pytest.mark.parametrize("block_rows", [4, 9, 2048])
def test_knn_is_exact_for_any_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    # few distinct coordinates: many ties, many copies, one heavy point
    points = [(i, bool(rng.random() < 0.4), [0, 0, 0] if i % 3 == 0 else rng.integers(0, 4, 3).tolist()) for i in range(60)]
    train = points[:40]
    df = sparse_rows(spark, points)
    found = knn_votes(df, df.filter("doc_id < 40"), [1, 3, 7], block_rows).collect()
    assert len(found) == 180
    for k in (1, 3, 7):
        expected = knn_by_hand(points, train, k)
        assert {r["doc_id"]: (r["votes_true"], r["votes_false"]) for r in found if r["k"] == k} == expected


def test_knn_without_train_rows(spark):
    df = sparse_rows(spark, [(1, True, [1, 0]), (2, False, [0, 1])])
    assert knn_votes(df, df.filter("doc_id > 5"), [1]).count() == 0


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 5))
    df = sparse_rows(spark, [(i, True, row.tolist()) for i, row in enumerate(x)])
    scaling = fit_scaling(df, 5)
    assert scaling.mean == pytest.approx(x.mean(0)) and scaling.sd == pytest.approx(x.std(0, ddof=1))
    rows = df.orderBy("doc_id").toPandas()
    s = (x - x.mean(0)) / x.std(0, ddof=1)
    for gamma, z in zip((0.05, 0.2), FourierMap(scaling, (0.05, 0.2), 4096)(rows["idx"], rows["val"]), strict=True):
        kernel = np.exp(-gamma * ((s[:, None] - s[None]) ** 2).sum(-1))
        assert np.abs(z @ z.T - kernel).max() < 0.1
    assert random_weights(5, 8, 1)[0] == pytest.approx(random_weights(5, 8, 1)[0])
    assert isinstance(scaling, Scaling)


@pytest.fixture(scope="module")
def rings(spark):
    """Not linearly separable: TRUE inside, FALSE outside."""
    rng = np.random.default_rng(1)
    points = []
    for i in range(160):
        angle, inside = rng.uniform(0, 2 * np.pi), i % 4 == 0
        r = rng.uniform(0, 0.8) if inside else rng.uniform(1.6, 2.2)
        points.append((i, inside, [r * np.cos(angle) + 1e-9, r * np.sin(angle) + 1e-9]))
    return sparse_rows(spark, points).withColumn("split", split.split_column())


def test_svm_learns_a_curved_border(rings):
    points = [{"cost": 10.0, "gamma": 0.5}, {"cost": 1.0, "gamma": 0.5}]
    found = svm_predictions(rings, 2, points, sweep.is_train(), components=128)
    result = metrics.confusion_metrics(metrics.contingency(found, ("cost", "split"))).collect()
    assert len(result) == 6
    assert min(r["balanced_accuracy"] for r in result if r["cost"] == 10.0) > 0.9


def test_svm_with_one_class_predicts_nothing(rings):
    found = svm_predictions(rings.filter("flag"), 2, [{"cost": 1.0, "gamma": 1.0}], F.lit(True))
    assert found.count() == 40 and found.filter("predicted is not null").count() == 0


def plain_fit(x, sign, weight, steps=4000):
    """Accelerated gradient descent on the same objective, one fit at a time."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rate = 1.0 / (1.0 + (weight[:, None] * x * x).sum() / (2 * hinge.BEND))
    w = seen = np.zeros(x.shape[1])
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - seen)
        loss, slope = hinge.bent_hinge(sign * (x @ ahead))
        seen, w = w, ahead - rate * (x.T @ (weight * slope * sign) + np.append(ahead[:-1], 0.0))
    return w, (weight * hinge.bent_hinge(sign * (x @ w))[0]).sum() + 0.5 * w[:-1] @ w[:-1]


def test_fits_side_by_side_equal_separate_fits(rings):
    folds = [split.fold_column(3) != f for f in range(3)]
    marked = rings.withColumn("member", hinge.member_bits(folds))
    sizes = hinge.subset_sizes(marked, 3)
    project = FourierMap(fit_scaling(rings, 2), (0.3, 1.0), 24)
    blocks = hinge.feature_blocks(marked, project).persist()
    fits = [hinge.Fit(space, k, cost) for space in (0, 1) for k in range(3) for cost in (0.5, 4.0)]
    states = hinge.solve(blocks, fits, sizes, tolerance=1e-7)
    cells = hinge.tallies(blocks, fits, states)
    rows = marked.toPandas()
    features = [f.astype(np.float32).astype(float) for f in project(rows["idx"], rows["val"])]
    sign, member = np.where(rows["flag"], 1.0, -1.0), rows["member"].to_numpy()
    for fit, state, cell in zip(fits, states, cells, strict=True):
        inside = (member >> fit.subset) & 1
        least = sizes[fit.subset].min()
        weight = fit.cost * inside * np.where(sign > 0, least / sizes[fit.subset][1], least / sizes[fit.subset][0])
        w, value = plain_fit(features[fit.space], sign, weight)
        assert state.converged and state.value == pytest.approx(value, rel=1e-3)
        positive = features[fit.space] @ state.w[:-1] + state.w[-1] >= 0
        told = [(positive & (sign > 0)), (positive & (sign < 0)), (~positive & (sign > 0)), (~positive & (sign < 0))]
        assert cell.tolist() == [int((t & (inside == 0)).sum()) for t in told]
    blocks.unpersist()


def test_fits_that_stop_early_are_reported(rings):
    with pytest.warns(UserWarning, match="have not converged"):
        svm_predictions(rings, 2, [{"cost": 10.0, "gamma": 0.5}], sweep.is_train(), components=32, max_iter=2)


def test_tallies_of_parts_with_spaces_of_their_own(rings):
    points = [{"cost": c, "gamma": g} for c in (1.0, 8.0) for g in (0.2, 0.5)]
    folds = [split.fold_column(2) != f for f in range(2)]
    both = svm_tallies([(rings, 2), (rings.filter("doc_id < 120"), 2)], points, folds, components=32)
    one = svm_tallies([(rings.filter("doc_id < 120"), 2)], points, folds, components=32)
    assert [c | {"part": 0} for c in both if c["part"] == 1] == one
    assert len(both) == 16 and all(sum(c[x] for x in ("tp", "fp", "fn", "tn")) > 40 for c in one)


def test_svm_prefixes_in_one_go(rings):
    marked = rings.withColumn("h", F.col("doc_id") / 160)
    trains = [sweep.is_train() & (F.col("h") < f) for f in (0.01, 0.5, 1.0)]
    found = svm_predictions(marked, 2, [{"cost": 10.0, "gamma": 0.5}], trains, components=64)
    assert found.filter("subset = 0 AND predicted IS NOT NULL").count() == 0  # too few rows for both classes
    whole = metrics.confusion_metrics(metrics.contingency(found, ("subset",))).filter("subset = 2").first()
    assert whole["balanced_accuracy"] > 0.9


def test_svm_grid(rings):
    grid = svm_grid(rings, 2, gammas=(0.5,), costs=(1.0, 10.0), folds=3, components=64).collect()
    assert len(grid) == 2 and min(r["error"] for r in grid) < 0.1


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_scad_selects_the_telling_term(spark, loss):
    rng = np.random.default_rng(5)
    words = ["signal", "noisea", "noiseb", "noisec"]
    rows = []
    for i in range(200):
        flag = bool(i % 2)
        text = [w for w in words[1:] if rng.random() < 0.5] + (["signal"] if flag == (rng.random() < 0.95) else [])
        rows.append((i, flag, "train", [*text, "other"]))
    df = spark.createDataFrame(rows, "doc_id long, flag boolean, split string, tokens array<string>")
    fits, found = scad_path(tfidf_vectors(df, words, [1.0] * 4), sweep.is_train(), lambdas=(0.1, 5.0), steps=2, loss=loss)
    chosen = dict(selected_terms(words, *fits[0.1]))
    assert max(chosen, key=lambda t: abs(chosen[t])) == "signal"
    assert selected_terms(words, *fits[5.0]) == []
    accuracy = metrics.confusion_metrics(metrics.contingency(found, ("lambda",))).filter("lambda = 0.1").first()
    assert accuracy["balanced_accuracy"] > 0.85


def test_tfidf_vectors_match_the_term_table(spark):
    df = spark.createDataFrame([(1, True, ["aaa", "aaa", "bbb", "zzz"]), (2, False, [])], "doc_id long, flag boolean, tokens array<string>")
    rows = {r["doc_id"]: r["raw"].toArray().tolist() for r in tfidf_vectors(df, ["aaa", "bbb"], [2.0, 3.0]).collect()}
    assert rows == {1: [1.0, 0.75], 2: [0.0, 0.0]}


def test_scad_weight_shape():
    w = scad_weight(np.array([0.0, 0.1, 0.2, 0.37, 1.0]), 0.1)
    assert w == pytest.approx([1.0, 1.0, 1.7 / 2.7, 0.0, 0.0])


def test_curves_of_each_model(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        flag = bool(rng.random() < 0.5)
        own = ["pain"] * int(rng.random() < (0.9 if flag else 0.1)) + ["other"] * int(rng.random() < 0.5)
        rows.append((i, " ".join(own + ["common"]), flag))
    data = index(spark.createDataFrame(rows, "doc_id long, text string, flag boolean"))
    k_curve = sweep.evaluate(data, "k_curve", "kNN", level=0.95, values=[1, 3])
    assert k_curve.count() == 18
    assert sweep.evaluate(data, "feature_curve", "NB", values=[0.5, 0.9]).count() == 18
    assert sweep.evaluate(data, "learning_curve", "kNN", values=[0.5, 1.0], level=0.95).count() == 18
    assert sweep.evaluate(data, "feature_curve", "SVM", values=[0.9]).count() == 9
    with pytest.raises(ValueError):
        sweep.evaluate(data, "k_curve", "SVM", level=0.95)
    tuned = sweep.tune_svm(data, levels=[0.9], costs=[1, 10], gammas=[0.1])
    assert tuned.count() == 2
    chosen = sweep.tuned_svm_holdout(data, 0.5, levels=[0.9], costs=[1, 10], gammas=[0.1]).collect()
    assert [r["split"] for r in chosen] == ["test"] and chosen[0]["balanced_accuracy"] > 0.6
    assert sweep.tuned_svm_holdout(data, 2.0, levels=[0.9], costs=[1], gammas=[0.1]).count() == 0
    learning = sweep.nb_learning_curve(data, 0.95, [0.02, 1.0])
    assert learning.filter("fraction = 1.0").first()["xvar"] == 80.0
    whole = sweep.by_point(sweep.nb_predictions(data, 0.95)).drop("split").collect()
    assert {r["n"] for r in [vectors(data, 0.95).rows.agg(F.count("*").alias("n")).first()]} == {80}
    assert len(whole) == 3
