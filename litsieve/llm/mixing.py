"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies. Within its source the documents are put in
one order, the expected copies are summed up from a random offset, and a document is emitted once for
each whole number that the running sum crosses in it. In order of size, neighbours are alike, so
the words taken come close to the target.

The running sum is made from sums of ranges: rows are range-partitioned by (source, size, id) and
written; each task numbers its own rows, and a small table of rows per (partition, source) says how
many came before. A source of any size spreads over many partitions.

A null source is a source of its own, the last. Null and empty texts have size 0 and cost nothing.
Rows with equal source, size and id stand next to each other in any order. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.session import materialize, small_side

#: Denominator of the random offset: a power of 2, so that sums with it are exact.
_STEPS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def offset(source: Column, seed: str) -> Column:
    """Uniform in [0, 1), from the source's name."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed}-"))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / _STEPS


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    The total is ``share`` of all sizes, split by weight; nobody gets more than ``most`` times its
    size, and what is over goes to the others by weight. Sorted by the level (target per
    weight) at which a source is full, the full ones come first; the common level of the others is
    what is left over their weights, at the first place where it is below the next one's own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    weighed = sources.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn))
    weighed = weighed.withColumn("full", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    # the first source that its level does not fill settles it; later levels, which take it for full, are lower
    fits = F.when(F.col("level") <= F.col("full") / F.col("weight"), F.col("level"))
    common = levelled.withColumn("common", F.max(fits).over(everything))
    target = F.least(F.col("full"), F.coalesce(F.col("common") * F.col("weight"), F.col("full")))
    return common.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row; copies may be 0."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = materialize(sized, "sizes")
    ordered = sized.repartitionByRange("source", "size", "id").sortWithinPartitions("source", "size", "id")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    counts = materialize(ordered.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n")), "counts")
    # sorted by source, the partitions and sources alternate: no more rows than both together
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = bases.alias("b").join(wanted.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    plan = plan.select("part", F.col("b.source").alias("s"), "base", "source_size", "target", offset(F.col("b.source"), seed).alias("u"))
    plan = small_side(materialize(plan, "plan"))
    own = Window.partitionBy("part", "source").orderBy("size", "id")
    ranked = ordered.withColumn("rank", F.row_number().over(own) - 1).withColumnRenamed("part", "p")
    joined = ranked.join(plan, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("base") + F.col("rank")
    copies = F.floor(F.col("u") + rate * (rank + 1)) - F.floor(F.col("u") + rate * rank)
    return joined.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.cast("long").alias("copies"),
    )
