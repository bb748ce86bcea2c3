"""Compaction of line runs: merged runs are read, and nothing is merged that is not."""

from litsieve.llm import line_dedup


def test_merged_run_is_read(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    batch = lambda day, *more: spark.createDataFrame([(day, "\n".join([f"line of the day {day}", *more]))], "doc_id long, text string")
    for day in range(2):
        assert index.process(batch(day)).first().n_dropped == 0
    assert [len(level) for level in index.levels] == [2]
    # both older lines are now in one merged run, the only one
    assert index.process(batch(2, "line of the day 0", "LINE of the day 1")).first().n_dropped == 2
    assert [len(level) for level in index.levels] == [1, 1]
    merged = spark.table(index.levels[1][0])
    assert merged.count() == 2 and {r["first"] for r in merged.collect()} == {0, 1}


def test_last_batch_merges_nothing(spark, monkeypatch):
    written = []
    write = line_dedup.LineIndex._write
    monkeypatch.setattr(line_dedup.LineIndex, "_write", lambda self, keys: written.append(1) or write(self, keys))
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a line of number ', id % 7) AS text")
    found = line_dedup.dedup_lines(docs).collect()
    assert sum(r.n_dropped for r in found) == 33 and len(written) == 4 + 1  # a run for each batch and one merge
