"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger says which rule versions have
seen which blob; a scan takes each blob with a pair that is not yet in the ledger once, whatever the number of
its paths, runs only the rules it has not seen, and adds findings and pairs as a new commit.
Findings are joined back to all paths of a blob. A rule is (name, version, pattern, value group,
fewest characters of that group); raising the version has all blobs scanned for that rule again.

DataFrame functions only. Places of matches come from the pieces between them: ``split`` gives the text between
the matches and ``regexp_extract_all`` the matches, so a running sum of lengths gives starts and ends. The sum runs over blocks of
about sqrt(n) of a text's n matches and then over the blocks, as an array that grows by one is copied each time.

Null texts count as empty. Very long texts with any number of matches are scanned whole, each in one row. Rows with equal paths are versions of their own. Extra columns are ignored.
An empty table writes an empty commit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.session import scratch_path

_SPANS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = (
    "(?:" + "|".join(_ANY_CASE(w) for w in ("password", "passwd", "secret", "token")) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", 1, ASSIGN, 1, 6),
    # a run of 4 + n characters that is long enough is a match of the rule without a length, and no other is
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Further kinds that the scan adds.
MORE = (
    Rule("private", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("bearer", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", 1, "(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
)
RULES = BASE + MORE


def _running(pieces: Column) -> Column:
    """(at, out): summed length and (start, end) of the matches of a block, from the block's own beginning."""
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda so_far, x: F.struct(
            (so_far["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(
                so_far["out"],
                F.array(F.struct((so_far["at"] + x["gap"]).alias("start"), (so_far["at"] + x["gap"] + x["size"]).alias("end"))),
            ).alias("out"),
        ),
    )


def _shifted(places: Column, by: Column) -> Column:
    return F.transform(places, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def spans(text: Column, rule: Rule) -> Column:
    """(start, end) of the matches of a rule, in code points; leftmost, without overlaps, too short ones dropped."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(found, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    pieces = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"))

    def in_blocks(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own))).cast("int")
        return F.transform(F.sequence(F.lit(0), width - 1), lambda k: _running(F.slice(own, k * width + 1, width)))

    # as a lambda's variable the pieces are computed once, and not again for each block
    relative = F.get(F.transform(F.array(pieces), in_blocks), F.lit(0))
    blocks = F.aggregate(
        relative,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")),
        lambda so_far, block: F.struct(
            (so_far["at"] + block["at"]).alias("at"), F.concat(so_far["out"], F.array(_shifted(block["out"], so_far["at"]))).alias("out")
        ),
    )
    places = F.flatten(blocks["out"])
    if rule.least <= 1:
        kept = places
    else:
        values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
        long_enough = F.filter(F.arrays_zip(places.alias("place"), values.alias("size")), lambda x: x["size"] >= rule.least)
        kept = F.transform(long_enough, lambda x: x["place"])
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), kept).otherwise(F.array().cast(_SPANS))


def _named(places: Column, rule: Rule) -> Column:
    return F.transform(
        places, lambda s: F.struct(F.lit(rule.name).alias("kind"), F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end"))
    )


class Ledger:
    """Commits of (blob, rules) and of (blob, kind, start, end) below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")

    def _read(self, table: str, schema: str) -> DataFrame:
        """All commits of a table; empty before the first."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        there = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}") if there else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", "blob string, rules array<string>")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, kind string, version int, start long, end long")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Adds what the rules find in the blobs of (blob, text) that they have not seen."""
        keys = [r.key for r in rules]
        blobs = versions.groupBy("blob").agg(F.any_value("text").alias("text"))
        seen = self.seen().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
        todo = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("known", F.array().cast("array<string>")))
        unseen = blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)
        empty = F.array().cast(_SPANS)
        found = [F.when(F.array_contains("todo", r.key), spans(F.col("text"), r)).otherwise(empty).alias(f"s{i}") for i, r in enumerate(rules)]
        commit = scratch_path(self.spark, "commit")
        # one pass over the texts; both tables of the commit come from what it wrote
        unseen.select("blob", "todo", *found).write.parquet(commit)
        new = self.spark.read.parquet(commit)
        marked = F.flatten(F.array(*(_named(F.col(f"s{i}"), r) for i, r in enumerate(rules))))
        rows = new.select("blob", F.explode(marked).alias("m")).select("blob", "m.*")
        # findings first: without the pairs in the ledger, a run that breaks off here is scanned again
        rows.write.mode("append").parquet(f"{self.path}/findings")
        new.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{self.path}/seen")

    def report(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, found) of every version (path, blob): all spans of its blob by the rules' versions.

        ``found`` is sorted by start, then by the order of the rules.
        """
        order = F.lit(None).cast("int")
        for i, r in enumerate(rules):
            order = F.when((F.col("kind") == r.name) & (F.col("version") == r.version), F.lit(i)).otherwise(order)
        rows = self.findings().withColumn("rank", order).filter("rank IS NOT NULL").distinct()
        grouped = rows.groupBy(F.col("blob").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found"))
        joined = paths.join(grouped, F.col("blob") == F.col("of"), "left")
        return joined.select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")).alias("found"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, path: str | None = None
) -> DataFrame:
    """(id, blob, found) of every row, after a scan of the blobs that the ledger at ``path`` has not seen."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    versions = docs.select(F.col(id_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    ledger = Ledger(docs.sparkSession, path)
    ledger.scan(versions.select("blob", "text"), rules)
    return ledger.report(versions.select("path", "blob"), rules).withColumnRenamed("path", id_col)
