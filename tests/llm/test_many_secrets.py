"""Texts with many matches, against Python's own regular expressions."""

import re

from pyspark.sql import functions as F

from litsieve.llm.secret_ledger import ASSIGN, BASE, spans


def test_spans_of_any_number_equal_python(spark):
    line = "é password: hunter%d token=abc hex %024x AKIA%s 💡\n"
    sizes = (0, 1, 2, 3, 4, 5, 8, 9, 10, 17, 99)
    rows = [(n, "".join(line % (k, k, "Q" * (14 + k % 5)) for k in range(n))) for n in sizes]
    found = spark.createDataFrame(rows, "n int, text string").select("n", "text", *(spans(F.col("text"), r).alias(r.name) for r in BASE))
    for row in found.collect():
        assert [tuple(s) for s in row["assign"]] == [m.span() for m in re.finditer(ASSIGN, row.text) if len(m[1]) >= 6]
        assert [tuple(s) for s in row["access"]] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", row.text) if len(m[0]) >= 20]
        assert [tuple(s) for s in row["hex"]] == [m.span() for m in re.finditer("[0-9a-f]+", row.text) if len(m[0]) >= 24]


def test_text_of_100000_matches(spark):
    n = 100_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lpad(F.hex(k), 24, "0")), "\n")
    row = spark.range(1).select(F.lower(text).alias("text")).select(spans(F.col("text"), BASE[2]).alias("s"))
    last = row.select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert last["n"] == n and tuple(last["last"]) == (25 * (n - 1), 25 * n - 1)
