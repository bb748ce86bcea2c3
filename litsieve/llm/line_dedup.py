"""Line dedup over batches: levelled sorted runs of line hashes.

A run is a table of (h1, h2, first) bucketed and sorted by the 128-bit hash of a line's key. A batch
is reduced to its distinct keys with their smallest document, merge-anti-joined with every run (bucketed
alike, so runs are neither shuffled nor sorted again), and the keys that are left become its own
run. Before a batch, ``fanout`` runs of a level are merged into one of the next, so n batches leave O(log n) runs and
nothing is merged that no batch reads.

DataFrame functions only. Batches must come in ascending order of ids for "the smallest id keeps the
line" to hold over all batches. A line repeated within the document that keeps it stays there.
Null texts are one empty line. Rows with a null id count as one document behind all others;
rows that share an id count as one document when lines are kept. Extra columns are ignored. An empty table is one
empty batch; very long texts are split whole, each in one row.
"""

from __future__ import annotations

import contextlib
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.session import scratch_path

SPACES = " \t\n\x0b\x0c\r"
_SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(line: Column, min_chars: int) -> Column:
    """(h1, h2) of a line's key, null for a key that is too short."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(17), key).alias("h2")))


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession):
    """Lets Spark use that a bucket of one file is sorted: no sort before the merge join."""
    before = spark.conf.get(_SORTED_BUCKETS, None)
    spark.conf.set(_SORTED_BUCKETS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SORTED_BUCKETS) if before is None else spark.conf.set(_SORTED_BUCKETS, before)


class LineIndex:
    """The runs of all batches so far; ``levels[k]`` holds the names of the tables of level k."""

    def __init__(self, spark: SparkSession, min_chars: int = 10, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            (
                keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
                .option("path", scratch_path(self.spark, name)).saveAsTable(name)
            )
        return name

    def _add(self, name: str, level: int = 0) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self) -> None:
        """Merges the levels that are full, from the lowest on."""
        level = 0
        while level < len(self.levels):
            if len(full := self.levels[level]) >= self.fanout:
                merged = self.spark.table(full[0])
                for other in full[1:]:
                    merged = merged.unionByName(self.spark.table(other))
                self._add(self._write(merged.repartition(self.buckets, "h1", "h2")), level + 1)
                self.levels[level] = []
            level += 1

    def process(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_lines, n_dropped, kept_text) of every row of the batch; its new keys become a run."""
        self.compact()
        lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
        docs = batch.select(F.col(id_col).alias("id"), lines.alias("lines"))
        hashed = F.transform("lines", lambda line: _hashes(line, self.min_chars))
        distinct = F.array_distinct(F.filter(hashed, lambda h: h.isNotNull()))
        pairs = docs.select("id", F.explode(distinct).alias("h")).select("id", "h.h1", "h.h2")
        keys = pairs.groupBy("h1", "h2").agg(F.min("id").alias("first"))
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(keys)
        kept = self.spark.table(run).groupBy(F.col("first").alias("owner")).agg(F.collect_list("h1").alias("own"))
        self._add(run)
        # long lists are split by the remainder of the hash, so that a line is looked up in a short one
        parts = F.greatest(F.lit(1), F.sqrt(F.size("own") / 16).cast("int"))
        nested = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.filter("own", lambda h: F.pmod(h, parts) == p))
        kept = kept.select("owner", nested.alias("own"), parts.cast("long").alias("parts"))
        # hashed before the join, which keeps the hashes from being computed again in the filter
        marked = docs.withColumn("marks", F.transform("lines", lambda line: _hashes(line, self.min_chars)["h1"]))
        joined = marked.join(kept, F.col("id").eqNullSafe(F.col("owner")), "left")

        def stays(_, at):
            mark = F.get("marks", at)
            owned = F.array_contains(F.get("own", F.pmod(mark, F.col("parts")).cast("int")), mark)
            return mark.isNull() | F.coalesce(owned, F.lit(False))

        left = joined.select("id", F.size("lines").cast("long").alias("n_lines"), F.filter("lines", stays).alias("left"))
        return left.select(
            F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"),
            F.array_join("left", "\n").alias("kept_text"),
        )


def id_ranges(docs: DataFrame, batches: int, id_col: str = "doc_id") -> list[DataFrame]:
    """The rows in ``batches`` ranges of ascending ids of similar size; null ids are in the last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id_col, shares, 1000)).first()[0] or [] if shares else []
    cuts = sorted(set(cuts))
    if not cuts:
        return [docs]
    low, high, at = [None, *cuts], [*cuts, None], F.col(id_col)
    parts = []
    for a, b in zip(low, high, strict=True):
        rows = docs if a is None else docs.filter((at > a) | at.isNull() if b is None else at > a)
        parts.append(rows if b is None else rows.filter(at <= b))
    return parts


def dedup_lines(
    docs: DataFrame, batches: int = 4, min_chars: int = 10, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The whole table through one index, in ranges of ascending ids."""
    index = LineIndex(docs.sparkSession, min_chars, fanout)
    done = [index.process(part, id_col, text_col) for part in id_ranges(docs, batches, id_col)]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found
