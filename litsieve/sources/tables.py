"""Tab-separated inputs and result series, and the driver's parquet tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCREENING = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("s1_included", T.BooleanType()),
        T.StructField("s1_excluded", T.BooleanType()),
        T.StructField("s2_included", T.BooleanType()),
        T.StructField("s2_excluded", T.BooleanType()),
    ]
)
_BIBLIOGRAPHY_COLUMNS = (
    "author", "year", "title", "journal", "volumn", "issue", "pages", "blank", "month", "text",
    "refn", "type", "jatype",
)
BIBLIOGRAPHY = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == "year" else T.StringType())
        for c in _BIBLIOGRAPHY_COLUMNS
    ]
)
MANIFEST = T.StructType(
    [T.StructField("flag", T.BooleanType()), T.StructField("hlink", T.StringType())]
)
SERIES = T.StructType(
    [
        T.StructField("xvar", T.DoubleType()),
        T.StructField("variable", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _tsv(spark: SparkSession, path: str, schema: T.StructType, header: bool, multi_line: bool, **options):
    reader = spark.read.schema(schema).options(
        sep="\t", header=header, quote='"', escape='"', multiLine=multi_line, enforceSchema=True, **options
    )
    return reader.csv(path)


def read_screening(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Screening table with header; columns are taken by position, empty texts stay empty.

    ``multi_line`` lets a quoted text hold line ends, but makes a file one task: pass False for
    files without such texts, which Spark then splits.
    """
    # the reader gives null for an empty field
    return _tsv(spark, path, SCREENING, True, multi_line).na.fill("")


def read_bibliography(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Bibliography table without header; empty fields are null."""
    return _tsv(spark, path, BIBLIOGRAPHY, False, multi_line, nullValue="")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    # no escape character: links are full of backslashes
    return _tsv(spark, path, MANIFEST, True, False)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    # the writer trims fields unless told not to
    df.write.options(
        sep="\t",
        header=header,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_series(series: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Result series as unquoted TSV with header; null is written as NA.

    ``partition_by`` names the run (curve, model, fixed parameters) in the folder names.
    """
    writer = series.write.options(sep="\t", header=True, nullValue="NA", quote="")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES).options(sep="\t", header=True, nullValue="NA").csv(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing a table to ``path``."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def fingerprint(*tables: DataFrame) -> str:
    """Digest of the tables' columns and rows, whatever their order; one aggregation each, without a shuffle of rows.

    Two sums of 64-bit row hashes, the second of other seeds, tell repeated rows apart from missing ones.
    """
    parts = []
    for table in tables:
        columns = [F.col(f"`{c}`") for c in table.columns]
        wide = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
        row = table.agg(
            F.count(F.lit(1)).alias("n"),
            wide(F.xxhash64(F.lit(1), *columns)).alias("a"),
            wide(F.xxhash64(F.lit(2), *columns)).alias("b"),
        ).first()
        parts.append(f"{table.schema.simpleString()}|{row['n']}|{row['a']}|{row['b']}")
    return hashlib.md5("||".join(parts).encode()).hexdigest()


def cached_table(df: DataFrame, path: str, inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """Writes a table as parquet unless it is there already, and reads it.

    With ``inputs``, the tables that ``df`` is computed from, it lies in a folder named by their fingerprint:
    changed inputs are computed anew. Without them a table once written is never renewed.
    """
    spark = df.sparkSession
    if inputs:
        path = f"{path.rstrip('/')}/{fingerprint(*inputs)}"
    if not is_written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """Spreads ``df`` over ``key`` when the scan below it has fewer partitions than cores.

    A large table has enough partitions already and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() < cores:
        return df.repartition(cores, F.col(key))
    return df
