"""Order and blocks of the neighbour search."""

import pathlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from litsieve.operators import knn
from litsieve.plans import sweep
from litsieve.plans.dataset import index
from litsieve.session import scratch_root


def rows(spark, points):
    data = [(i, [int(j) for j in np.flatnonzero(p)], [float(v) for v in p[np.flatnonzero(p)]]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "doc_id long, idx array<int>, val array<double>")


def test_cell_is_the_pivot_of_the_nearest_direction(spark):
    # the second pivot is nearer to every row, as it is short; only the last two rows point its way
    points = np.array([[3.0, 1.0, 0, 0], [0.5, 0, 0, 0], [0, 0, 0.4, 0.1], [0, 0, 0, 5.0], [0, 0, 0, 0]])
    pivots = [(np.array([0, 1]), np.array([2.0, 2.0])), (np.array([2, 3]), np.array([0.1, 0.1]))]
    found = {r["doc_id"]: r for r in knn._assign(rows(spark, points), pivots).collect()}
    assert [found[i]["cell"] for i in range(4)] == [0, 0, 1, 1]
    for i, p in enumerate(points):
        expected = [np.linalg.norm(p - [2, 2, 0, 0]), np.linalg.norm(p - [0, 0, 0.1, 0.1]), np.linalg.norm(p)]
        assert found[i]["pivot_d"] == pytest.approx(expected, abs=1e-4)


def test_small_blocks_are_joined_for_a_product():
    class Train:
        n = 1000

    parts, runs = knn._products(Train, 32)
    assert [p.start for p in parts] == list(range(0, 1000, 32)) and parts[-1].stop == 1000
    assert len(runs) == 4 and runs[0] == slice(0, 8) and runs[-1].stop == len(parts)
    parts, runs = knn._products(Train, 2048)
    assert [p.stop for p in parts] == [256, 512, 768, 1000] and len(runs) == 4


@pytest.mark.parametrize("block_rows", [5, 2048])
def test_values_of_both_signs_and_far_groups(spark, block_rows):
    rng = np.random.default_rng(5)
    points = np.zeros((700, 24))
    for group in range(3):  # groups without common columns, of very different lengths
        own = np.arange(group, 700, 3)
        points[np.ix_(own, range(8 * group, 8 * group + 8))] = rng.normal(size=(len(own), 8)) * 10.0 ** rng.integers(-3, 2, (len(own), 1))
    frame = rows(spark, points)
    train = frame.filter("doc_id < 500").selectExpr("doc_id", "doc_id % 2 = 0 AS flag", "idx", "val")
    got = {r["doc_id"]: (r["votes_true"], r["votes_false"]) for r in knn.knn_votes(frame, train, [3], block_rows).collect()}
    for i, p in enumerate(points):
        d2 = np.round(((points[:500] - p) ** 2).sum(axis=1), knn.DIGITS)
        near = np.flatnonzero(d2 <= np.sort(d2)[2])
        assert got[i] == ((near % 2 == 0).sum(), (near % 2 == 1).sum()), i


def scratch(spark, *names):
    folder = pathlib.Path(scratch_root(spark))
    return sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir() if any(p.name.startswith(n) for n in names) and p.is_dir()) if folder.exists() else []


def test_search_keeps_only_the_tables_that_it_reads(spark):
    rng = np.random.default_rng(7)
    frame = rows(spark, rng.random((60, 6)))
    train = frame.selectExpr("doc_id", "doc_id % 2 = 0 AS flag", "idx", "val")
    before = scratch(spark, "knn-")
    found = knn.knn_votes(frame, train, [3], 16)
    added = scratch(spark, "knn-")
    for name in before:
        added.remove(name)
    assert added == ["knn-cells-query", "knn-files", "knn-query"]
    assert found.count() == 60


def test_feature_curve_drops_the_tables_of_each_level(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(i, " ".join(words[j] for j in range(4) if (i >> j) & 1 or j == i % 4), i % 3 == 0) for i in range(48)]
    data = index(spark.createDataFrame(texts, "doc_id long, text string, flag boolean"))
    before = scratch(spark, "knn-", "vectors", "vocabulary")
    found = sweep.curve_metrics(data, "feature_curve", "kNN", values=(0.9, 0.8))
    assert scratch(spark, "knn-", "vectors", "vocabulary") == before
    points = {(r["xvar"], r["split"]) for r in found.collect()}
    assert points == {(x, s) for x in (0.9, 0.8) for s in ("train", "validate", "test")}


def test_products_of_all_queries_and_of_few_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frame = rows(spark, np.where(rng.random((300, 30)) < 0.3, rng.random((300, 30)), 0.0))
    train = frame.filter("doc_id < 200").selectExpr("doc_id", "doc_id % 2 = 0 AS flag", "idx", "val", "int(doc_id % 3) AS first")
    got = [sorted(map(tuple, knn.knn_votes(frame, train, [3], 16, subsets=3).collect())) for share in (0.0, 2.0) if not monkeypatch.setattr(knn, "COPIED_SHARE", share)]
    assert got[0] == got[1] and len(got[0]) == 900


def two_tongues(n):
    """Rows of two groups without common columns, and every fiftieth of both: values, whether mixed."""
    rng = np.random.default_rng(11)
    points, mixed = np.zeros((n, 40)), np.arange(n) % 50 == 49
    for i in range(n):
        for tongue in (0, 1) if mixed[i] else (i % 2,):
            points[i, 20 * tongue + rng.choice(20, 6, replace=False)] = rng.random(6) + 0.2
    return points, mixed


def test_centres_part_the_directions():
    points, mixed = two_tongues(600)
    sample = [(np.flatnonzero(p), p[np.flatnonzero(p)]) for p in points[~mixed]]
    centres = knn._centres(sample, 4)
    assert len(centres) == 4
    tongues = [{int(c) // 20 for c in idx} for idx, _ in centres]
    assert sorted(map(sorted, tongues)) in ([[0], [0], [1], [1]], [[0], [1], [1], [1]], [[0], [0], [0], [1]])
    # near centres are neighbours: the order changes the group once
    assert sum(a != b for a, b in zip(tongues, tongues[1:])) == 1
    assert len(knn._centres([(np.zeros(0, np.int64), np.zeros(0))], 3)) == 1


def test_rows_are_multiplied_over_the_columns_of_their_cell():
    points, mixed = two_tongues(2400)
    cells = np.sort(np.arange(2400) % 2)
    order = np.argsort(np.arange(2400) % 2, kind="stable")
    entries = [np.flatnonzero(p) for p in points[order]]
    table = pa.table({
        "idx": pa.array([list(map(int, e)) for e in entries], pa.list_(pa.int32())),
        "val": pa.array([list(p[e]) for p, e in zip(points[order], entries)], pa.list_(pa.float64())),
        "pivot_d": pa.array([[float(np.linalg.norm(p))] for p in points[order]], pa.list_(pa.float64())),
    })
    train = knn._Vectors(table)
    train.place(np.arange(40))
    groups = knn._groups(train, cells, 40)
    assert [len(main) for _, main, _, _ in groups] == [20, 20, 40]
    assert {int(c) // 20 for c in groups[0][1]} == {0} and {int(c) // 20 for c in groups[1][1]} == {1}
    assert np.array_equal(np.sort(groups[2][0]), np.flatnonzero(mixed[order]))
    for rows_, main, own, rest in groups:
        assert own == pytest.approx((points[order][np.ix_(rows_, main)] ** 2).sum(axis=1))
        assert rest == pytest.approx((points[order][rows_] ** 2).sum(axis=1) - own, abs=1e-12)


@pytest.mark.parametrize("rare", [0.03, 0.6])
def test_columns_left_out_of_products_change_no_result(monkeypatch, rare):
    points, _ = two_tongues(900)
    monkeypatch.setattr(knn, "PRODUCT_QUERIES", 100)
    queries, train = points, points[:600]
    votes = []
    for value in (rare, -1.0):
        monkeypatch.setattr(knn, "RARE", value)
        votes.append(search(queries, train))
    assert votes[0] == votes[1]
    d2 = np.round(((queries[:, None] - train[None]) ** 2).sum(axis=2), knn.DIGITS)
    third = np.sort(d2, axis=1)[:, 2]
    for i, near in enumerate(d2 <= third[:, None]):
        assert sum(t + f for _, t, f in votes[0][i]) == near.sum()


def search(queries, train):
    """Levels (distance, true, false) of each query, from one task's search of one file."""
    def table(points, **more):
        entries = [np.flatnonzero(p) for p in points]
        return pa.table({
            "q": [str(i) for i in range(len(points))],
            "idx": pa.array([e.tolist() for e in entries], pa.list_(pa.int32())),
            "val": pa.array([p[e].tolist() for p, e in zip(points, entries)], pa.list_(pa.float64())),
            "pivot_d": pa.array([[float(np.linalg.norm(p))] for p in points], pa.list_(pa.float64())),
            **more,
        })

    order = np.argsort(np.arange(len(train)) % 2, kind="stable")
    votes = np.arange(len(train))[order] % 3 == 0
    counts = {"cell": pa.array((order % 2).astype(np.int32)), "first": pa.array(np.zeros(len(train), np.int32)), "n_true": pa.array(votes.astype(np.int64)), "n_false": pa.array((~votes).astype(np.int64))}
    folder = tempfile.mkdtemp(prefix="knn-file-")
    pq.write_table(table(train[order], **counts), f"{folder}/a.parquet")
    lengths = np.linalg.norm(train, axis=1)
    run = knn._levels(folder, [("a.parquet", (float(lengths.min()),), (float(lengths.max()),))], 3, 32, 1, 512)
    found = [[] for _ in queries]
    for batch in run(iter(table(queries).to_batches())):
        for r in batch.to_pylist():
            found[int(r["q"])].append((round(r["d2"], 7), r["n_true"], r["n_false"]))
    return [sorted(f) for f in found]
