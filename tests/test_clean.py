import pytest
from pyspark.sql import functions as F

from litsieve.operators import clean, links
from litsieve.sources import bodies, tables


def screening(spark, rows):
    """rows: (id, title, text, s1, s2)"""
    full = [
        (i, "journal", "x", 2000, title, text, s1, None if s1 is None else not s1, s2, None if s2 is None else not s2)
        for i, title, text, s1, s2 in rows
    ]
    return spark.createDataFrame(full, tables.SCREENING)


def bibliography(spark, rows):
    """rows: (title, year, issue, jatype)"""
    full = [(None, y, t, None, None, issue, None, None, None, None, None, None, kind) for t, y, issue, kind in rows]
    return spark.createDataFrame(full, tables.BIBLIOGRAPHY)


def test_agreement_keeps_equal_decisions_only(spark):
    rows = [(1, True, True), (2, False, False), (3, True, False), (4, False, True), (5, None, True), (6, None, None)]
    df = screening(spark, [(i, "t", "x", a, b) for i, a, b in rows])
    agreed = {r["id"]: r["flag"] for r in clean.screening_agreement(df).collect()}
    assert agreed == {1: True, 2: False}
    assert {r["id"]: r["flag"] for r in clean.agreed_by_union(df).collect()} == agreed
    assert clean.screening_agreement(df, double_screening=False).count() == 6


def test_bibliography_cleaning(spark):
    df = bibliography(
        spark,
        [
            (None, None, None, None), ("A", 2014, None, "Article"), ("B", 2015, None, "x"), ("C", None, None, None),
            ("D", 2000, "Book", "x"), ("E", 2000, "Book Section", "x"), ("F", 2000, "12", "Review"),
        ],
    )
    assert sorted(tuple(r) for r in clean.clean_bibliography(df).collect()) == [
        ("a", "article"), ("c", None), ("f", "review"),
    ]
    by_type = clean.clean_bibliography(df, book_column="jatype", book_types=["Article"])
    assert "a" not in {r["title"] for r in by_type.collect()}


def test_merge_multiplies_repeated_titles(spark):
    left = clean.clean_screening(
        screening(
            spark,
            [(1, "Same", "x", True, True), (2, "same", "x", True, True), (3, "left", "x", True, True),
             (4, "", "x", True, True), (5, None, "x", True, True)],
        )
    )
    right = clean.clean_bibliography(bibliography(spark, [("SAME", 2000, None, "Article")] * 3 + [("right", 2000, None, "Review")]))
    merged = clean.merge_titles(left, right, expand=True).select("id", "title", "jatype")
    assert sorted(map(str, (tuple(r) for r in merged.collect()))) == sorted(
        map(str, (tuple(r) for r in left.join(right, "title", "full").select("id", "title", "jatype").collect()))
    )
    assert merged.filter("title = 'same'").count() == 6
    compact = clean.merge_titles(left, right)
    assert compact.agg(F.sum("copies")).first()[0] == merged.count()
    assert {r["jatype"]: r["n"] for r in clean.type_frequency(compact).collect()} == {
        "article": 6, "review": 1, None: 1,
    }


def test_paper_filters(spark):
    left = screening(
        spark,
        [(1, "a study", "x", True, True), (2, "the meeting", "x", True, True), (3, "no text", "", True, True),
         (4, "a conference", "x", True, True), (5, "letter", "x", True, True)],
    )
    right = spark.createDataFrame([("letter", "letter"), ("alone", "article")], "title string, jatype string")
    kept = clean.keep_papers(clean.merge_titles(left, right))
    assert [r["id"] for r in kept.collect()] == [1]
    # a word that no title has keeps all rows
    assert clean.keep_papers(clean.merge_titles(left, right), meeting_words=("zzz",)).count() == 3


def test_links(spark):
    moved = r"S:\lib\MS Clinical trial Study\UpdatedSearch16thAug\ISIEmbase Update References\New Folder\a.pdf"
    rows = [
        (1, moved), (2, r"\\SERVER\share\lib\Multiple Sclerosis\b.PDF"), (3, r"c\Journals\Alzheimers disease\d.pdf"),
        (4, r"S:\x.doc"), (5, ""), (6, r"s:\MS Clinical trial Study\other\e.pdf"), (7, None),
    ]
    df = links.normalize_links(
        spark.createDataFrame(rows, "id int, hlink string"), share=r"\\server\share", base="S:\\base\\"
    )
    assert {r["id"]: (r["hlink"], r["txtlink"]) for r in df.collect()} == {
        1: (r"S:\lib\Publications\MS Clinical Trial\Journals\a.pdf", r"S:\lib\Publications\MS Clinical Trial\Journals\a.txt"),
        2: (r"S:\lib\b.PDF", r"S:\lib\b.txt"),
        3: (r"S:\base\c\d.pdf", r"S:\base\c\d.txt"),
        6: (r"s:\MS Clinical trial Study\other\e.pdf", r"s:\MS Clinical trial Study\other\e.txt"),
    }
    strict = links.text_link(F.lit("a.PDF"), strict=True)
    assert spark.range(1).select(strict).first()[0] == "a.PDF"


def test_bodies(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("one\ntwo\r\nthree\n")
    (root / "sub" / "b.txt").write_text("x" * 1001)
    (root / "c.txt").write_text("x" * 1000)
    found = bodies.read_bodies(spark, str(root)).withColumn("key", bodies.path_key(F.col("path"), str(root)))
    manifest = spark.createDataFrame([("a.txt",), ("sub/b.txt",), ("c.txt",), ("gone.txt",)], "key string")
    loaded = {r["key"]: r["text"] for r in bodies.load_bodies(manifest, found).collect()}
    assert loaded["a.txt"] == "onetwothree" and loaded["gone.txt"] == ""
    spaced = {r["key"]: r["text"] for r in bodies.load_bodies(manifest, found, " ").collect()}
    assert spaced["a.txt"] == "one two three"
    assert [r["key"] for r in clean.long_bodies(bodies.load_bodies(manifest, found)).collect()] == ["sub/b.txt"]


def test_tsv_round_trip(spark, tmp_path):
    df = screening(spark, [(1, 'say "hi"', "two\nlines\tand tab ", True, None), (2, "", " x", False, False)])
    path = str(tmp_path / "s")
    tables.write_tsv(df, path)
    assert sorted(map(tuple, tables.read_screening(spark, path).collect())) == sorted(map(tuple, df.collect()))


def test_bibliography_file_has_nulls_and_no_header(spark, tmp_path):
    file = tmp_path / "b.txt"
    file.write_text("\t".join(["me", "2001", "Title"] + [""] * 9 + ["article"]) + "\n" + "\t" * 12 + "\n")
    df = tables.read_bibliography(spark, str(file))
    assert df.count() == 2 and df.dropna(how="all").count() == 1
    assert df.first()["journal"] is None


def test_manifest_keeps_backslashes(spark, tmp_path):
    file = tmp_path / "m.txt"
    file.write_text("flag\tlink\nTRUE\tS:\\a\\b.pdf\n")
    assert tuple(tables.read_manifest(spark, str(file)).first()) == (True, "S:\\a\\b.pdf")


def test_series_file(spark, tmp_path):
    df = spark.createDataFrame([(39.0, "train_tpr", 0.5), (39.0, "validate_tpr", None)], tables.SERIES)
    path = tmp_path / "series"
    tables.write_series(df.coalesce(1), str(path))
    text = next(path.glob("part-*")).read_text()
    assert text.splitlines() == ["xvar\tvariable\tvalue", "39.0\ttrain_tpr\t0.5", "39.0\tvalidate_tpr\tNA"]
    assert sorted(map(str, tables.read_series(spark, str(path)).collect())) == sorted(map(str, df.collect()))
    named = df.withColumn("curve", F.lit("learning_curve")).withColumn("model", F.lit("NB"))
    tables.write_series(named, str(tmp_path / "named"), ("curve", "model"))
    assert (tmp_path / "named" / "curve=learning_curve" / "model=NB").is_dir()


def test_cached_table_is_written_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert tables.cached_table(spark.range(3).toDF("a"), path).count() == 3
    assert tables.cached_table(spark.range(5).toDF("a"), path).count() == 3


def test_scratch_needs_shared_folder(spark):
    from litsieve.session import scratch_root

    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("flag, label", [(True, 1.0), (False, 0.0)])
def test_label(spark, flag, label):
    df = spark.createDataFrame([(1, flag)], "doc_id long, flag boolean")
    joined = clean.attach_label(spark.createDataFrame([(1, "x")], "doc_id long, term string"), df)
    assert joined.select(clean.label_column()).first()[0] == label
