"""Rows that stand for several equal rows, and cuts by radix refinement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsieve.functions.keys import hash_key
from litsieve.operators import clean, metrics, split
from litsieve.operators.knn import knn_votes
from litsieve.plans import sweep
from litsieve.plans.dataset import index, vectors

PAPERS = [
    (i, f"{'alpha beta' if i % 3 else 'gamma delta'} word{i % 5} common {'beta ' * (i % 4)}", i % 3 > 0, 1 + (i % 4) * (i % 2))
    for i in range(60)
]


def plain(rows):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def pair(spark):
    """The same papers as weighted rows and as written-out copies; copies keep the place of their paper."""
    papers = spark.createDataFrame(PAPERS, "doc_id long, text string, flag boolean, copies long")
    one = index(papers, weight="copies")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    number = F.col("doc_id") * 100 + F.col("copy")
    places = one.docs.select("doc_id", "split", "h")
    many = index(papers.withColumn("copy", copies).drop("copies"))
    assert many.n == one.n == sum(p[3] for p in PAPERS)
    written = papers.withColumn("copy", copies).select(number.alias("doc_id"), "text", "flag")
    full = index(written)
    back = lambda df: df.drop("split", "h").withColumn("paper", F.floor(F.col("doc_id") / 100)).join(
        places.withColumnRenamed("doc_id", "paper"), "paper"
    ).drop("paper")
    return one, type(full)(back(full.docs), back(full.counts))


def test_naive_bayes_counts_copies(pair):
    one, many = pair
    found = metrics.confusion_metrics(metrics.contingency(sweep.nb_predictions(one, 0.95), weight="copies"))
    wanted = metrics.confusion_metrics(metrics.contingency(sweep.nb_predictions(many, 0.95)))
    assert plain(found.collect()) == plain(wanted.collect())


def test_curves_count_copies(pair):
    one, many = pair
    for curve, model in (("feature_curve", "NB"), ("learning_curve", "NB"), ("k_curve", "kNN")):
        found = sweep.curve_metrics(one, curve, model, values=(0.8, 0.95) if curve == "feature_curve" else (1, 3) if model == "kNN" else (0.5, 1.0))
        wanted = sweep.curve_metrics(many, curve, model, values=(0.8, 0.95) if curve == "feature_curve" else (1, 3) if model == "kNN" else (0.5, 1.0))
        assert plain(found.select(sorted(found.columns)).collect()) == plain(wanted.select(sorted(found.columns)).collect())


def test_weights_of_a_merged_table(spark):
    rows = [(1, "a", True, 2), (1, "a", True, 3), (2, None, False, 1)]
    found = clean.weighted_set(spark.createDataFrame(rows, "id int, text string, flag boolean, copies long"))
    assert sorted(map(tuple, found.collect())) == [(1, "a", True, 5), (2, None, False, 1)]
    assert clean.weighted_set(spark.createDataFrame([], "id int, text string, flag boolean, copies long")).count() == 0


def test_train_scope_ignores_other_rows(spark):
    papers = spark.createDataFrame(PAPERS, "doc_id long, text string, flag boolean, copies long").drop("copies")
    data = index(papers)
    train = data.docs.filter(sweep.is_train()).count()
    frequency = {r["term"]: r["df"] for r in data.counts.filter(sweep.is_train()).groupBy("term").agg(F.count("*").alias("df")).collect()}
    vocab = {r["term"]: r["df"] for r in vectors(data, 0.95, "train").vocab.collect()}
    assert vocab == {t: n for t, n in frequency.items() if n > train * (1 - 0.95)}


@pytest.mark.parametrize(("digits", "max_rows"), [(1, 1), (2, 3), (3, 4096)])
def test_cut_keys_by_refinement(spark, digits, max_rows):
    ids = spark.range(700).toDF("doc_id")
    keys = sorted(r[0] for r in ids.select(hash_key(5)).collect())
    for rank in (1, 2, 350, 699, 700):
        assert split.key_at_rank(ids, rank, 5, digits, max_rows) == keys[rank - 1]
    same = ids.select((F.col("doc_id") % 2).alias("doc_id"))  # whole keys that many rows share
    keys = sorted(r[0] for r in same.select(hash_key(5)).collect())
    assert [split.key_at_rank(same, r, 5, digits, max_rows) for r in (1, 350, 351, 700)] == [keys[r - 1] for r in (1, 350, 351, 700)]


@pytest.mark.parametrize("block_rows", [4, 2048])
def test_nested_subsets_from_one_search(spark, block_rows):
    rows = [(i, i % 3 == 0, [0, 1], [float(i % 11), float(i % 4)], (i * 7) % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, flag boolean, idx array<int>, val array<double>, first int")
    train = df.filter("doc_id < 45")
    found = knn_votes(df, train, [1, 5, 40], block_rows, subsets=3)
    for subset in range(3):
        alone = knn_votes(df, train.filter(F.col("first") <= subset).drop("first"), [1, 5, 40])
        assert plain(found.filter(F.col("subset") == subset).drop("subset").collect()) == plain(alone.drop("subset").collect())


def test_curve_over_nothing(spark, pair):
    one, _ = pair
    empty = type(one)(one.docs.limit(0), one.counts.limit(0), one.weight)
    assert sweep.curve_metrics(empty, "learning_curve", "kNN", values=(0.5, 1.0)).count() == 0


def test_neighbours_are_not_shuffled_by_block(spark):
    """Vectors of very different lengths: single precision alone would miss the order; null flags vote for nothing."""
    rng = np.random.default_rng(5)
    scale = 10.0 ** rng.integers(-3, 3, 90)
    points = [(i, [True, False, None][i % 7 % 3], list(range(6)), (rng.random(6) * scale[i]).tolist()) for i in range(90)]
    points += [(100 + i, True, list(range(6)), [v + 1e-4 * (i + 1) for v in points[2][3]]) for i in range(4)]
    df = spark.createDataFrame(points, "doc_id long, flag boolean, idx array<int>, val array<double>")
    found = knn_votes(df.select("doc_id", "idx", "val"), df.filter("flag IS NOT NULL"), [1, 4], 8)
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    own = {(r["doc_id"], r["k"]): (r["votes_true"], r["votes_false"]) for r in found.collect()}
    for i, _, _, x in points:
        d = sorted((round(float(((np.array(x) - y) ** 2).sum()), 9), f) for _, f, _, y in points if f is not None)
        for k in (1, 4):
            voters = [f for dist, f in d if dist <= d[k - 1][0]]
            assert own[i, k] == (sum(voters), len(voters) - sum(voters))
