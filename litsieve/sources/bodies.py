"""Extracted document bodies: one text file per paper, named by the manifest."""

from __future__ import annotations

import math
import posixpath
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.session import materialize, ship_package

#: Texts that a task holds at a time, besides the one file it is reading.
CHUNK_BYTES = 16 << 20
#: Files that a task opens.
TASK_FILES = 2_000


def read_bodies(spark: SparkSession, path: str, task_bytes: int = 128 << 20) -> DataFrame:
    """(path, text), one row per file at any depth; hidden files (``.x``, ``_x``) are left out, as Spark's readers do.

    Executors list the folders, one round for each depth, and open the files: neither names nor sizes
    reach the driver. A folder is listed by one task, so very many files belong in several. File systems
    that pyarrow cannot open are left to Spark's reader, which lists on the driver.
    """
    try:
        place, base = open_root(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return files.select(file_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    if isinstance(place, fs.LocalFileSystem):
        path = f"file://{base}"
    found = _texts(list_files(spark, path), path, task_bytes)
    return found.select(F.concat(F.lit(path.rstrip("/") + "/"), "key").alias("path"), "text")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(key, size) of all files below ``root``, by their path below it."""
    ship_package()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = open_root(root)
        for batch in batches:
            for folder in batch["key"]:
                infos = place.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                for start in range(0, len(infos), 10_000):
                    named = [i for i in infos[start : start + 10_000] if not _hidden(i.base_name)]
                    yield pd.DataFrame({
                        "key": [f"{folder}/{i.base_name}" if folder else i.base_name for i in named],
                        "size": [i.size if i.type == fs.FileType.File else -1 for i in named],
                    })

    folders, n_folders, files = spark.createDataFrame([("",)], "key string"), 1, None
    while n_folders:
        spread = folders.repartition(min(n_folders, 4 * spark.sparkContext.defaultParallelism), "key")
        listed = materialize(spread.mapInPandas(look, "key string, size long"), "body-names")
        own = listed.filter("size >= 0")
        files = own if files is None else files.unionByName(own)
        folders = listed.filter("size < 0").select("key")
        n_folders = folders.count()
    return files


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def file_path(encoded: Column) -> Column:
    """Spark names files by percent-encoded paths; a plus sign in them stands for itself."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def path_key(link: Column, root: str) -> Column:
    """Part of a path below ``root``, with forward slashes."""
    forward = F.replace(link, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.substring_index(forward, root.rstrip("/") + "/", -1), "^/+", "")


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder; names below it are taken literally, not as parts of a URI."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", root.rstrip("/")))


def _inside(key: str | None) -> bool:
    """Whether a key names something below the root."""
    return bool(key) and not key.startswith("/") and ".." not in key.split("/")


def body_sizes(keys: DataFrame, root: str) -> DataFrame:
    """(key, size): bytes of the file ``root``/key; a name without file, or one that leaves the root, has no row."""
    ship_package()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = open_root(root)
        for batch in batches:
            named = [k for k in batch["key"] if _inside(k)]
            infos = place.get_file_info([f"{base}/{k}" for k in named]) if named else []
            found = [(k, i.size) for k, i in zip(named, infos, strict=True) if i.type == fs.FileType.File]
            yield pd.DataFrame(found, columns=["key", "size"])

    return keys.select("key").mapInPandas(look, "key string, size long")


def read_named_bodies(manifest: DataFrame, root: str, task_bytes: int = 128 << 20) -> DataFrame:
    """(key, text) of the files below ``root`` that the manifest's ``key`` column names, each once.

    Executors open the files themselves: no folder is listed, and files that no row names cost nothing. A first
    pass asks for sizes; they give the number of tasks, about ``task_bytes`` or ``TASK_FILES`` each. A task passes texts on in
    chunks of ``CHUNK_BYTES``, so its memory depends on its largest file alone. Names may hold any character.
    Bytes that are no UTF-8 become replacement characters; null keys and missing files have no row.
    """
    ship_package()
    sizes = materialize(body_sizes(manifest.select("key").distinct(), root), "body-sizes")
    return _texts(sizes, root, task_bytes)


def _texts(sizes: DataFrame, root: str, task_bytes: int) -> DataFrame:
    """(key, text) of the files ``root``/key, from a written table of their names and sizes."""
    row = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).first()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = open_root(root)
        for batch in batches:
            texts, held = [], 0
            for key in batch["key"]:
                with place.open_input_stream(f"{base}/{key}") as file:
                    raw = file.read()
                texts.append((key, raw.decode("utf-8", "replace")))
                held += len(raw)
                if held >= CHUNK_BYTES:
                    yield pd.DataFrame(texts, columns=["key", "text"])
                    texts, held = [], 0
            if texts:
                yield pd.DataFrame(texts, columns=["key", "text"])

    tasks = max(1, math.ceil(row["bytes"] / task_bytes), math.ceil(row["files"] / TASK_FILES))
    return sizes.repartition(tasks, "key").select("key").mapInPandas(read, "key string, text string")


def write_named_bodies(bodies: DataFrame, root: str) -> int:
    """Writes each (key, text) to ``root``/key and returns the number of files; keys are unique.

    A task writes beside the target and moves the file, so a repeated task leaves whole files. Null keys and
    keys that leave the root are not written; a null text is an empty file.
    """
    ship_package()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, base = open_root(root)
        made = set()
        for batch in batches:
            done = 0
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if not _inside(key):
                    continue
                folder = posixpath.dirname(f"{base}/{key}")
                if folder not in made:
                    place.create_dir(folder, recursive=True)
                    if len(made) >= 10_000:
                        made.clear()
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with place.open_output_stream(draft) as file:
                    file.write((text or "").encode())
                place.move(draft, f"{base}/{key}")
                done += 1
            yield pd.DataFrame({"n": [done]})

    written = bodies.select("key", "text").mapInPandas(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_bodies(manifest: DataFrame, bodies: DataFrame, separator: str = "") -> DataFrame:
    """Manifest rows with ``text``; both sides have a ``key`` column.

    Lines are joined with ``separator``. The default glues words across line ends; a space is
    the better choice for new work. A missing file gives an empty text.

    The hint keeps texts off the driver: Spark takes the size of what a Python function returns for
    that of the names that went in, and would broadcast whole bodies.
    """
    joined = F.regexp_replace(F.regexp_replace("text", r"(\r?\n|\r)$", ""), r"\r?\n|\r", separator)
    texts = bodies.select("key", joined.alias("text")).hint("merge")
    return manifest.join(texts, "key", "left").withColumn("text", F.coalesce("text", F.lit("")))
