"""Neighbours over nested vocabularies from one search."""

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from litsieve import session
from litsieve.operators import knn, nested_knn
from litsieve.plans import sweep
from litsieve.plans.dataset import index, nested_vectors

SIZES = [0, 3, 3, 10, 40]


def points(n):
    """Rows of two groups with few shared columns, with copies, rows that are equal over few columns, and rows that are almost equal."""
    rng = np.random.default_rng(23)
    out = np.where(rng.random((n, 40)) < 0.25, rng.random((n, 40)), 0.0)
    out[::2, 1:40:2] = 0.0
    out[1::2, 4:40:2] = 0.0
    out[5::20] = out[3]
    out[7::25, :10] = out[11, :10]
    out[9::30] = out[12]
    out[9::30, 39] += rng.random(len(out[9::30])) * 2e-5
    out[13::50] = 0.0
    return out


def expected(rows, train, flag, times, size, k):
    """Votes of each row by its distances to all train rows."""
    found = []
    for p in rows[:, :size]:
        d2 = np.round(((rows[train, :size] - p) ** 2).sum(axis=1), knn.DIGITS)
        order = np.argsort(d2, kind="stable")
        nearer = np.array([times[train][d2 < d].sum() for d in d2])
        near = (nearer < k) & (d2 <= d2[order].max())
        found.append((int(times[train][near & flag[train]].sum()), int(times[train][near & ~flag[train]].sum())))
    return found


def search(rows, train, sizes):
    """Levels of each query over each vocabulary from one task's search of one file."""
    def table(points, **more):
        entries = [np.flatnonzero(p) for p in points]
        return pa.table({
            "q": [str(i) for i in range(len(points))],
            "idx": pa.array([e.tolist() for e in entries], pa.list_(pa.int32())),
            "val": pa.array([p[e].tolist() for p, e in zip(points, entries)], pa.list_(pa.float64())),
            "first": pa.array(np.zeros(len(points), np.int32)),
            "cell": pa.array(np.zeros(len(points), np.int32)),
            **more,
        })

    folder = tempfile.mkdtemp(prefix="knn-file-")
    ones = pa.array([[1] * len(sizes)] * len(train), pa.list_(pa.int64()))
    pq.write_table(table(train, n_true=ones, n_false=ones), f"{folder}/a.parquet")
    run = nested_knn._search(folder, [("a.parquet", 0, 0)], sizes, 1, 512)
    return sorted(tuple(r.values()) for batch in run(iter(table(rows).to_batches())) for r in batch.to_pylist())


def test_rare_columns_are_multiplied_entry_by_entry(monkeypatch):
    rows = points(900)
    votes = []
    for thin, few, entries, full in ((0.0, 1, 1 << 20, 0.6), (2.0, 1, 1 << 20, 0.6), (0.05, 1, 700, -1.0), (2.0, 1, 1 << 20, 1.0)):
        for name, value in (("THIN", thin), ("FEW", few), ("SLICE_ENTRIES", entries), ("FULL", full)):
            monkeypatch.setattr(nested_knn, name, value)
        votes.append(search(rows[:400], rows[400:], SIZES))
    assert all(v == votes[0] for v in votes) and len(votes[0]) == 400 * len(SIZES)


@pytest.mark.parametrize(("k", "weighted", "block"), [(1, False, 256), (1, True, 16), (3, False, 16)])
def test_votes_equal_those_of_all_pairs(spark, monkeypatch, k, weighted, block):
    monkeypatch.setattr(knn, "PRODUCT_ROWS", block)
    rows = points(500)
    train, flag = np.arange(500) % 5 < 3, np.arange(500) % 7 < 3
    times = 1 + np.arange(500) % 3 if weighted else np.ones(500, int)
    data = [(i, bool(flag[i]), bool(train[i]), np.flatnonzero(p).tolist(), p[np.flatnonzero(p)].tolist(), int(times[i])) for i, p in enumerate(rows)]
    frame = spark.createDataFrame(data, "doc_id long, flag boolean, train boolean, idx array<int>, val array<double>, copies long")
    found = nested_knn.nested_votes(frame, SIZES, k, "copies" if weighted else None).collect()
    got = {(r["subset"], r["doc_id"]): (r["votes_true"], r["votes_false"]) for r in found}
    assert len(found) == len(got) == 500 * len(SIZES)
    for subset, size in enumerate(SIZES):
        assert [got[subset, i] for i in range(500)] == expected(rows, train, flag, times, size, k), size


def test_rows_without_train_rows_have_no_votes(spark):
    schema = "doc_id long, flag boolean, train boolean, idx array<int>, val array<double>"
    assert nested_knn.nested_votes(spark.createDataFrame([(1, True, False, [0], [1.0])], schema), [0, 1], 1).count() == 0
    assert nested_knn.nested_votes(spark.createDataFrame([], schema), [0, 1], 1).count() == 0
    # a null flag is a neighbour without a vote
    only = nested_knn.nested_votes(spark.createDataFrame([(1, None, True, [0], [1.0]), (2, True, False, [], [])], schema), [0, 1], 1)
    assert sorted(map(tuple, only.collect())) == [(i, s, 0, 0, False) for i in (1, 2) for s in (0, 1)]


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


def texts(spark):
    rows = [(i, " ".join(WORDS[j] for j in range(6) if (i >> j) & 1 or j == i % 3), i % 3 == 0) for i in range(96)]
    return index(spark.createDataFrame(rows, "doc_id long, text string, flag boolean"))


def test_a_level_is_the_first_columns_of_the_widest(spark):
    data = texts(spark)
    rows, sizes = nested_vectors(data, [0.3, 0.45, 0.6])
    vocab = rows.vocab.orderBy("idx").collect()
    assert sizes == [sum(r["df"] > data.n * (1 - s) for r in vocab) for s in (0.3, 0.45, 0.6)]
    assert len(set(sizes)) > 1 and sizes[-1] == rows.n_features == len(vocab)
    assert [r["df"] for r in vocab] == sorted((r["df"] for r in vocab), reverse=True)


def test_feature_curve_writes_and_searches_once(spark):
    data = texts(spark)
    since = session.scratch_mark()
    found = sweep.curve_metrics(data, "feature_curve", "kNN", values=(0.6, 0.3, 0.45))
    made = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._MADE[since:]]
    assert made.count("knn-files") == made.count("vectors") == made.count("vocabulary") == 1
    assert {r["xvar"] for r in found.collect()} == {0.3, 0.45, 0.6}
    own = sweep.curve_metrics(data, "k_curve", "kNN", values=(1,), level=0.45)
    keys = ["split", "tp", "fp", "fn", "tn"]
    assert sorted(map(tuple, found.filter("xvar = 0.45").select(keys).collect())) == sorted(map(tuple, own.select(keys).collect()))
