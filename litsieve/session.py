"""Session, shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import functools
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast table may hold at most this many bytes (rows times row width; checked, never assumed).
BROADCAST_BYTES = 32 << 20
#: Assumed bytes of a value of variable length; fixed types count by their width.
_WIDTH = {"boolean": 1, "byte": 1, "short": 2, "int": 4, "float": 4, "long": 8, "double": 8, "date": 4, "timestamp": 8}


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("litsieve")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="litsieve-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


@functools.cache
def _ship(application_id: str) -> None:
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="litsieve-code-")) / "litsieve.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    SparkSession.getActiveSession().sparkContext.addPyFile(str(archive))


def ship_package() -> None:
    """Sends this package's code to the Python workers, once per application."""
    _ship(SparkSession.getActiveSession().sparkContext.applicationId)


#: Scratch paths of this process, in the order in which they were named.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def scratch_mark() -> int:
    """Number of scratch paths that this process has named so far."""
    return len(_MADE)


def drop_scratch(spark: SparkSession, since: int, until: int) -> None:
    """Removes this process's own scratch tables named between two marks; nothing may read them any more."""
    for path in _MADE[since:until]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation, and lets
    several passes share one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_width(table: DataFrame, text_width: int = 32) -> int:
    """Bytes of a row, with ``text_width`` for a value without a fixed width."""
    return 8 + sum(_WIDTH.get(field.dataType.typeName(), text_width) for field in table.schema)


def small_side(table: DataFrame, max_bytes: int = BROADCAST_BYTES, text_width: int = 32) -> DataFrame:
    """Hint a broadcast for a written table when its row count (from the footers) allows it.

    Above ``max_bytes`` the table is returned as it is: Spark then shuffles the join, and
    adaptive execution splits skewed partitions.
    """
    return F.broadcast(table) if table.count() * row_width(table, text_width) <= max_bytes else table


def compact(df: DataFrame, n_rows: int, rows_per_partition: int = 20_000) -> DataFrame:
    """Merges partitions that hold too few rows to be worth a task per training iteration.

    Only narrows: a large table keeps all its partitions, a small one keeps a task per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(cores, n_rows), -(-n_rows // rows_per_partition)))
