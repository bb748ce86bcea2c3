"""Exact dedup: composable polynomial fingerprints, then a chunkwise comparison.

A text without its white space is cut into chunks of ``CHUNK`` bytes. A chunk's fingerprint is a
polynomial in four bases modulo 2^31 - 1; fingerprints of neighbours combine by
f(a + b) = f(a) + base^|a| * f(b), so chunks are hashed side by side and in any grouping. Texts with equal
fingerprint and length are candidates. Their chunks are then compared: for each (fingerprint, chunk
number) the smallest and the largest chunk must be the same bytes, which each task settles for its
own rows before anything is shuffled, so a group of copies of any size stays cheap. Should a
fingerprint hold different texts, its rows are told apart by the text itself.

Nulls count as empty texts and equal each other. Rows with equal id and text are kept or dropped
together. Null ids are ordinary; a null keep_id means that the row that stays has none. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import materialize, ship_package, small_side

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 92_821_337, 715_827_881, 1_618_033_987)
CHUNK = 4096
#: Bytes of a piece in the comparison.
COMPARED = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    power = 1
    for i in range(n):
        out[i] = power
        power = power * base % int(PRIME)
    return out


_CACHE: dict[int, np.ndarray] = {}


def chunk_prints(data: np.ndarray, cuts: np.ndarray, base: int) -> np.ndarray:
    """Fingerprints of the byte ranges that begin at ``cuts`` (each at most ``CHUNK`` long, none empty)."""
    if base not in _CACHE:
        _CACHE[base] = _powers(base, CHUNK)
    within = np.arange(len(data)) - np.repeat(cuts, np.diff(np.append(cuts, len(data))))
    terms = (data.astype(np.uint64) + np.uint64(1)) * _CACHE[base][within]
    return np.add.reduceat(terms, cuts) % PRIME


def combine(left: int, left_bytes: int, right: int, base: int) -> int:
    """Fingerprint of two neighbours from theirs: the right one shifted by the left one's length."""
    return (left + pow(base, left_bytes, int(PRIME)) * right) % int(PRIME)


def text_prints(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each base the fingerprint of every text."""
    sizes = np.diff(offsets)
    chunks = -(-sizes // CHUNK)
    owner = np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    cuts = offsets[owner] + number * CHUNK
    out = []
    for base in BASES:
        total = np.zeros(len(sizes), np.uint64)
        if len(cuts):
            parts = chunk_prints(data, cuts, base)
            shift = np.array([pow(base, CHUNK * k, int(PRIME)) for k in range(int(chunks.max()))], np.uint64)
            heads = np.flatnonzero(number == 0)
            total[owner[heads]] = np.add.reduceat(parts * shift[number] % PRIME, heads) % PRIME
        out.append(total)
    return out


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without white space."""
    keep = arrays.NOT_SPACE[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[offsets]


def _prints(schema: pa.Schema, with_text: bool):
    def run(batches):
        for batch in arrays.slices(batches, "text"):
            data, offsets = squeeze(*arrays.text_bytes(batch.column(1)))
            a, b, c, d = text_prints(data, offsets)
            texts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
            )
            more = {"bytes": texts} if with_text else {"id": batch.column(0), "n_chars": batch.column(2), "text_sha256": batch.column(3)}
            yield arrays.batch_of(
                schema, f1=((a << np.uint64(31)) | b).astype(np.int64), f2=((c << np.uint64(31)) | d).astype(np.int64),
                size=np.diff(offsets), **more,
            )

    return run


def _run(frame: DataFrame, with_text: bool, head: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = head + "f1 long, f2 long, size long" + (", bytes binary" if with_text else ", n_chars long, text_sha256 string")
    return frame.mapInArrow(_prints(to_arrow_schema(StructType.fromDDL(ddl)), with_text), ddl)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f1, f2, size, n_chars, text_sha256): fingerprint, bytes and digest of the text without white space."""
    ship_package()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(F.translate(text, arrays.SPACES, ""), 256)
    rows = rows.withColumn("n_chars", F.length(text).cast("long")).withColumn("text_sha256", sha)
    return _run(rows, False, f"id {docs.schema[id_col].dataType.simpleString()}, ")


def differing(docs: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """Fingerprints of ``candidates`` under which not all texts are the same bytes."""
    rows = docs.select(F.lit(0).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = _run(rows, True, "").join(candidates, ["f1", "f2", "size"], "left_semi")
    number = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(COMPARED)))
    chunks = texts.select("f1", "f2", "size", number.alias("at"), "bytes").select(
        "f1", "f2", "size", "at", F.substring("bytes", F.col("at").cast("int") + 1, F.lit(COMPARED)).alias("chunk")
    )
    compared = chunks.groupBy("f1", "f2", "size", "at").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    return compared.filter(F.col("low") != F.col("high")).select("f1", "f2", "size").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Of equal texts the row with most characters stays, then the smallest id (a null id comes last).
    """
    key = ["f1", "f2", "size"]
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    found = prints.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = materialize(found.filter("group_size > 1"), "groups")
    unequal = materialize(differing(docs, small_side(groups.select(key)), text_col), "unequal")
    rows, variant = prints.withColumn("variant", F.lit(None).cast("string")), []
    if not unequal.isEmpty():
        rows, groups, variant = _told_apart(docs, prints, groups, unequal, id_col, text_col, best), None, ["variant"]
        groups = materialize(
            rows.groupBy(*key, "variant").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).filter("group_size > 1"),
            "groups",
        )
    groups = groups.select(*(F.col(c).alias(f"g_{c}") for c in key + variant), "group_size", "best")
    match = F.lit(True)
    for c in key + variant:
        match = match & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    joined = rows.join(small_side(groups), match, "left")
    one = F.col("group_size").isNull()
    keep = F.when(one, F.col("id")).otherwise(F.col("best.id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (one | (keep.eqNullSafe(F.col("id")) & (F.col("best.less") == -F.col("n_chars")))).alias("kept"),
        "text_sha256",
    )


def _told_apart(docs, prints, groups, unequal, id_col, text_col, best) -> DataFrame:
    """The rows, with the text itself as ``variant`` where equal fingerprints hold different texts."""
    key = ["f1", "f2", "size"]
    squeezed = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), arrays.SPACES, "")
    again = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), squeezed.alias("variant"))
    known = prints.join(unequal, key, "left_semi").select(*key, F.col("id").alias("p_id"), "n_chars", "text_sha256").distinct()
    texts = again.join(known, F.col("id").eqNullSafe(F.col("p_id")) & (F.length("text") == F.col("n_chars")))
    texts = texts.filter(F.octet_length("variant") == F.col("size"))
    rest = prints.join(unequal, key, "left_anti").withColumn("variant", F.lit(None).cast("string"))
    return rest.unionByName(texts.select("id", *key, "n_chars", "text_sha256", "variant"))
