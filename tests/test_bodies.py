"""Bodies that executors open by the names of the manifest."""

import pathlib

from litsieve.sources import bodies


def test_named_bodies(spark, tmp_path):
    root = tmp_path / "papers with space"
    names = ["Journals/paper 1.txt", "100% of %20 2.txt", "a+b 3.txt", "é/ü.txt", "empty.txt"]
    rows = [(n, f"text of {n}\nline") for n in names[:-1]] + [(names[-1], None), (None, "lost"), ("../out.txt", "lost")]
    assert bodies.write_named_bodies(spark.createDataFrame(rows, "key string, text string"), str(root)) == 5
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == sorted(names)
    (root / "raw.txt").write_bytes(b"ab\xffc")
    (root / "unnamed.txt").write_text("no row names it")
    wanted = [*names, "raw.txt", "missing.txt", "Journals", "../papers with space/raw.txt", "/etc/hostname", None, names[0]]
    manifest = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], "id int, key string")
    for task_bytes in (1, 1 << 20):
        found = bodies.read_named_bodies(manifest, f"file:{root}", task_bytes)
        assert {r.key: r.text for r in found.collect()} == {
            **{n: f"text of {n}\nline" for n in names[:-1]}, "empty.txt": "", "raw.txt": "ab�c",
        }
    joined = {r.id: r.text for r in bodies.load_bodies(manifest, found).collect()}
    assert joined[0] == joined[len(wanted) - 1] == f"text of {names[0]}line"
    assert [joined[i] for i in range(6, 11)] == [""] * 5
    assert bodies.read_named_bodies(manifest.limit(0), str(root)).count() == 0


def test_long_bodies_pass_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bodies, "CHUNK_BYTES", 100)
    texts = {f"{i}.txt": "x" * (i * 60) for i in range(8)}
    for name, text in texts.items():
        pathlib.Path(tmp_path, name).write_text(text)
    manifest = spark.createDataFrame([(k,) for k in texts], "key string")
    assert {r.key: r.text for r in bodies.read_named_bodies(manifest, str(tmp_path)).collect()} == texts


def test_bodies_are_not_broadcast(spark, tmp_path):
    """Spark takes the texts for as small as their names."""
    rows = [(f"{i}.txt", "text " * 50) for i in range(20)]
    bodies.write_named_bodies(spark.createDataFrame(rows, "key string, text string"), str(tmp_path))
    manifest = spark.createDataFrame([(i, f"{i}.txt") for i in range(30)], "id int, key string")
    joined = bodies.load_bodies(manifest, bodies.read_named_bodies(manifest, str(tmp_path)))
    assert len([r for r in joined.collect() if r.text]) == 20
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_listed_bodies(spark, tmp_path):
    """Files at any depth, hidden ones left out, and no task for each few files."""
    root = tmp_path / "all bodies"
    names = [f"{i % 3}/doc_id={i}.txt" for i in range(100)] + ["top 100%.txt", "a/b/c+d.txt", "_x=1/e.txt"]
    for name in [*names, "_hidden.txt", "a/.part", "_tmp/f.txt"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"{name}\n")
    (root / "none").mkdir()
    found = bodies.read_bodies(spark, str(root))
    assert {r.path: r.text for r in found.collect()} == {f"file://{root}/{n}": f"{n}\n" for n in names}
    assert found.rdd.getNumPartitions() == 1
