"""Benchmark decontamination: a broadcast set of test n-grams against the windows of every text.

Benchmark items become windows of ``n`` words (an item of fewer words is one window). Their hashes are
broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, whatever the size of the benchmark: each
block is one pass over the documents. A document window whose hash is in the set is verified word by
word before it counts.

Nulls and texts without words have no windows. Rows with equal ids are separate rows. Extra
columns are ignored. An empty benchmark hits nothing. Items with a null id count under the id ''.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import materialize, ship_package

#: Windows broadcast at once: about 100 bytes each in a Python worker.
BLOCK_WINDOWS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text):
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = 10) -> DataFrame:
    """(item, size, window): distinct windows of each item, words joined by a space."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(ascii_lower(F.coalesce(text_col, F.lit(""))), F.lit(_WORD), F.lit(0)).alias("w"),
    ).filter(F.size("w") > 0)
    size = F.least(F.lit(n), F.size("w"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " ")
    )
    return items.select("item", size.alias("size"), F.explode(windows).alias("window")).distinct()


class _Block:
    """One block of windows in the form that the tasks search."""

    def __init__(self, rows) -> None:
        self.items: dict[bytes, list[str]] = {}
        sizes: dict[int, set[bytes]] = {}
        for item, size, window in rows:
            key = window.encode()
            self.items.setdefault(key, []).append(item)
            sizes.setdefault(size, set()).add(key)
        self.hashes = {size: np.unique(self._hash(sorted(keys), size)) for size, keys in sizes.items()}

    @staticmethod
    def _hash(keys: list[bytes], size: int) -> np.ndarray:
        data, offsets = arrays.text_bytes(pa.array([k.decode() for k in keys]))
        starts, ends, rows = arrays.words(data, offsets, arrays.ALNUM)
        found = arrays.window_hashes(arrays.word_hashes(data, starts, ends), size)
        return found[arrays.same_row(rows, size)]

    def hits(self, data, starts, ends, rows):
        """(first word, number of words, items) of every verified window."""
        hashes = arrays.word_hashes(data, starts, ends)
        raw = data.tobytes()
        for size, known in self.hashes.items():
            found = arrays.window_hashes(hashes, size)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for i in np.flatnonzero((known[at] == found) & arrays.same_row(rows, size)).tolist():
                text = b" ".join([raw[s:e] for s, e in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)])
                if items := self.items.get(text):
                    yield i, size, items


_RANGES = "array<struct<start:long,end:long>>"
_SCHEMA = f"id {{id}}, text string, n_words long, items array<string>, spans {_RANGES}"


def _scan(block, schema: pa.Schema):
    def run(batches):
        for batch in arrays.slices(batches, "text"):
            data, offsets = arrays.text_bytes(batch.column(1))
            lowered = arrays.LOWER[data]
            starts, ends, rows = arrays.words(lowered, offsets, arrays.ALNUM)
            n = batch.num_rows
            first = np.searchsorted(rows, np.arange(n))
            items = [set(x) for x in batch.column(3).to_pylist()]
            change = np.zeros(len(starts) + 1, np.int64)
            for i, spans in enumerate(batch.column(4).to_pylist()):
                for span in spans:  # of earlier blocks
                    change[first[i] + span["start"]] += 1
                    change[first[i] + span["end"]] -= 1
            for i, size, names in block.value.hits(lowered, starts, ends, rows):
                change[i] += 1
                change[i + size] -= 1
                items[rows[i]].update(names)
            hit = np.cumsum(change)[:-1] > 0
            begins = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (rows[1:] == rows[:-1])])) if len(hit) else []
            stops = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (rows[1:] == rows[:-1]), [False]])) + 1 if len(hit) else []
            spans = [[] for _ in range(n)]
            for a, b in zip(begins, stops, strict=True):
                row = rows[a]
                spans[row].append({"start": int(a - first[row]), "end": int(b - first[row])})
            yield arrays.batch_of(
                schema, id=batch.column(0), text=batch.column(1), n_words=np.bincount(rows, minlength=n),
                items=[sorted(x) for x in items], spans=spans,
            )

    return run


def _cut(schema: pa.Schema):
    """Removes the bytes from the first to the last word of every span."""

    def run(batches):
        for batch in arrays.slices(batches, "text"):
            data, offsets = arrays.text_bytes(batch.column(1))
            starts, ends, rows = arrays.words(data, offsets, arrays.ALNUM)
            first = np.searchsorted(rows, np.arange(batch.num_rows))
            texts = batch.column(1).to_pylist()
            for i, spans in enumerate(batch.column(4).to_pylist()):
                if spans:
                    at, kept = offsets[i], []
                    for span in spans:
                        kept.append(data[at : starts[first[i] + span["start"]]].tobytes())
                        at = ends[first[i] + span["end"] - 1]
                    texts[i] = b"".join([*kept, data[at : offsets[i + 1]].tobytes()]).decode()
            yield arrays.batch_of(schema, id=batch.column(0), text=texts, n_words=batch.column(2), items=batch.column(3), spans=batch.column(4))

    return run


def _arrow_schema(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", rewrite: bool = False, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(id, text, n_words, n_hit, items, spans) of every row, with the texts as they were.

    ``spans`` are merged word ranges that lie inside benchmark windows, ``items`` the sorted ids of the
    items hit. With ``rewrite`` the spans are removed from ``text``.
    """
    ship_package()
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, n), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = _SCHEMA.format(id=id_type)
    found = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast(_RANGES).alias("spans"),
    )
    arrow = _arrow_schema(found)
    for k in range(blocks):
        # a block holds about block_windows rows: windows are spread by their hash
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).select("item", "size", "window")
        block = spark.sparkContext.broadcast(_Block([tuple(r) for r in rows.collect()]))
        found = found.mapInArrow(_scan(block, arrow), schema)
        if k + 1 < blocks:
            found = materialize(found, "scanned")  # one block in a worker at a time
    if rewrite:
        found = found.mapInArrow(_cut(arrow), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", hit.alias("n_hit"), "items", "spans")
