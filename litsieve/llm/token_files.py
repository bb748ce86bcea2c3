"""Token ids as Arrow files of fixed-size lists.

Documents are range-partitioned and sorted by id; each task encodes its documents, appends the end
id to each, packs the stream of ids into sequences of ``length`` and writes them to one Arrow file (IPC
file format) of record batches whose columns have fixed widths:

    ids   fixed_size_list<uint16>[length]   the ids, padded with 0 at the end of a file (uint32 for
                                            vocabularies of more than 65,536)
    mask  fixed_size_list<bool>[length]     true for an id, false for padding; a bit each
    docs  list<struct<key, at, n, last>>    the pieces of documents in the sequence: id, place, number of
                                            ids, and whether the document ends here

Sequence k of a file is row k % ``BATCH_ROWS`` of batch k // ``BATCH_ROWS``; a memory map gives both as Arrow
arrays without a copy, and the ids as a numpy view. A table written by Spark lists the files with their sequences, ids
and documents. A document never spans two files.

A task writes under a name of its own attempt and moves the file when it is whole, so a lost executor
leaves no half file and a second attempt gives the same bytes. Files go to the folder that
``spark.checkpoint.dir`` names (or ``path``), through the file system of that address.

Null and empty texts are the end id alone. A null id comes first. Rows with equal ids follow each other
by text. Extra columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import materialize, scratch_path, ship_package

LENGTH = 2048
#: Sequences of a record batch: 2 MB of ids.
BATCH_ROWS = 256
#: Distinct words, and units of words, that a generation of a worker's memory holds (about 200 bytes each).
#: Two generations are kept; what was not used during a whole one is forgotten.
REMEMBERED = 250_000
_SPLIT = 4 << 20
#: Letters of ASCII and Latin-1, then printable ASCII marks without the apostrophe.
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of texts, by their words.

    The tokenizer never joins what white space separates, so a text's ids are those of its words in
    turn, and each distinct word is encoded once. A word of ASCII or Latin-1 letters, with or
    without ASCII marks behind, is one or two units of the tokenizer's own splitting; these are
    lower-cased, written in its byte letters and go to its merge table directly. Any other word (digits,
    apostrophes, other scripts, combining marks) goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.letters = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        #: Ids as the bytes of 32-bit integers: this generation and the one before.
        self.words: list[dict[str, bytes]] = [{}, {}]
        self.units: list[dict[str, bytes]] = [{}, {}]

    def _unit(self, text: str) -> bytes:
        now, before = self.units
        found = now.get(text)
        if found is None:
            found = before.get(text)
            if found is None:
                written = text if text.isascii() else "".join([self.letters[c] for c in text])
                found = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
            now[text] = found
            if len(now) >= REMEMBERED:
                self.units = [{}, now]
        return found

    def _encode_words(self, distinct: list[str]) -> list[bytes]:
        now, before = self.words
        ids: list[bytes | None] = []
        rest = []
        for word in distinct:
            found = now.get(word)
            if found is None:
                found = before.get(word)
                if found is None:
                    if simple := _SIMPLE.fullmatch(word):
                        letters, marks = simple.groups()
                        found = self._unit(letters.lower()) + self._unit(marks) if marks else self._unit(letters.lower())
                    else:
                        rest.append(len(ids))
                if found is not None:
                    now[word] = found
            ids.append(found)
        for at, found in zip(rest, self.tokenizer.encode_batch([distinct[i] for i in rest], add_special_tokens=False), strict=True):
            ids[at] = now[distinct[at]] = array("I", found.ids).tobytes()
        if len(now) >= REMEMBERED:
            self.words = [{}, now]
        return ids

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each), with ``end_id`` after each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten().dictionary_encode()
        # the end id is one more word behind the words of each text
        parts = [*self._encode_words(words.dictionary.to_pylist()), array("I", [end_id]).tobytes()]
        flat = np.frombuffer(b"".join(parts), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        heads = np.cumsum(sizes) - sizes
        ends = np.asarray(split.offsets)[1:] - np.asarray(split.offsets)[0]
        codes = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(parts) - 1)
        own = sizes[codes]
        total = np.concatenate([[0], np.cumsum(own)])
        places = np.arange(total[-1])
        places += np.repeat(heads[codes] - total[:-1], own)
        bounds = total[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return flat[places], np.diff(bounds)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _filesystem(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _vocabulary(tokenizer: str):
    def run(batches):
        from tokenizers import Tokenizer

        for batch in batches:
            size = Tokenizer.from_file(tokenizer).get_vocab_size()
            yield pa.RecordBatch.from_arrays([pa.array([size] * batch.num_rows, pa.int64())], names=["size"])

    return run


def id_width(spark: SparkSession, tokenizer: str) -> pa.DataType:
    """Two bytes where they hold every id of the vocabulary and the end id, else four; an executor reads the file."""
    size = spark.range(1, numPartitions=1).mapInArrow(_vocabulary(tokenizer), "size long").first()["size"]
    return pa.uint16() if size <= 1 << 16 else pa.uint32()


def file_schema(id_type: pa.DataType, length: int, width: pa.DataType) -> pa.Schema:
    piece = pa.struct([("key", id_type), ("at", pa.int32()), ("n", pa.int32()), ("last", pa.bool_())])
    return pa.schema([
        ("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", pa.list_(piece)),
    ])


class SequenceWriter:
    """Packs a stream of documents into batches of fixed-size sequences."""

    def __init__(self, sink, schema: pa.Schema, length: int) -> None:
        self.out = pa.ipc.new_file(sink, schema)
        self.schema, self.length, self.held = schema, length, []
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.pieces: list[list[dict]] = [[]]
        self.fill = self.sequences = self.tokens = self.docs = 0

    def add(self, keys: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        for key, size in zip(keys, sizes.tolist(), strict=True):
            left = size
            while left:
                take = min(left, self.length - self.fill)
                left -= take
                self.pieces[-1].append({"key": key, "at": self.fill, "n": take, "last": not left})
                self.fill += take
                if self.fill == self.length:
                    self.pieces.append([])
                    self.fill = 0
        self.tokens += int(sizes.sum())
        self.docs += len(keys)
        self._flush(BATCH_ROWS)

    def _flush(self, least: int) -> None:
        while len(self.pieces) > least:
            self._write(BATCH_ROWS)

    def _write(self, rows: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        size = rows * self.length
        now, self.held = ids[:size], [ids[size:]]
        mask = np.arange(size) < len(now)
        now = np.concatenate([now, np.zeros(size - len(now), self.dtype)])
        fixed = lambda values: pa.FixedSizeListArray.from_arrays(pa.array(values), self.length)
        docs = pa.array(self.pieces[:rows], self.schema.field("docs").type)
        self.out.write_batch(pa.RecordBatch.from_arrays([fixed(now), fixed(mask), docs], schema=self.schema))
        self.pieces = self.pieces[rows:]
        self.sequences += rows

    def close(self) -> None:
        self._flush(BATCH_ROWS)
        rows = len(self.pieces) - (not self.pieces[-1])
        if rows:
            self._write(rows)
        self.out.close()


_MANIFEST = "part int, file string, sequences long, n_tokens long, n_docs long"


def _writer(root: str, tokenizer: str, end_id: int, length: int, schema: pa.Schema):

    def run(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        writer = None
        for batch in arrays.slices(batches, "text", _SPLIT):
            if writer is None:
                fs, folder = _filesystem(root)
                fs.create_dir(folder, recursive=True)
                own, final = f"{folder}/_{part:06d}-{attempt}", f"part-{part:06d}.arrow"
                sink = fs.open_output_stream(own)
                writer = SequenceWriter(sink, schema, length)
            ids, sizes = encoder(tokenizer).encode(batch.column(1), end_id)
            writer.add(batch.column(0).to_pylist(), sizes, ids)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, f"{folder}/{final}")
            names = [x.split()[0] for x in _MANIFEST.split(", ")]
            row = [part, final, writer.sequences, writer.tokens, writer.docs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names
            )

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, length: int = LENGTH,
    id_col: str = "doc_id", text_col: str = "text",
) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the table of files in order."""
    ship_package()
    root = path or scratch_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    width = pa.uint32() if end_id >= 1 << 16 else id_width(docs.sparkSession, tokenizer)
    schema = file_schema(_id_type(rows), length, width)
    manifest = ordered.mapInArrow(_writer(root, tokenizer, end_id, length, schema), _MANIFEST)
    return root, materialize(manifest, "files")


def _id_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def _reader(root: str, schema: pa.Schema):
    def run(batches):
        fs, folder = _filesystem(root)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{file}") as source:
                    opened = pa.ipc.open_file(source)
                    crc, size, at = 0, 0, base
                    for k in range(opened.num_record_batches):
                        found = opened.get_batch(k)
                        ids = found.column(0).flatten().to_numpy()
                        length = found.schema.field(0).type.list_size
                        out = []
                        for row, pieces in enumerate(found.column(2).to_pylist()):
                            for piece in pieces:
                                begin = row * length + piece["at"]
                                crc = zlib.crc32(np.ascontiguousarray(ids[begin : begin + piece["n"]], "<u4"), crc)
                                size += piece["n"]
                                if piece["last"]:
                                    out.append((piece["key"], at, size, crc))
                                    at, crc, size = at + size, 0, 0
                        if out:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                            )

    return run


def read_documents(spark: SparkSession, root: str, files: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package()
    # one row for each file: their number, not that of documents, goes through this window
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    ddl = f"{id_col} {id_type}, start long, n_tokens long, ids_crc32 long"
    spread = based.repartition(max(1, files.count()), "file")
    return spread.mapInArrow(_reader(root, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def sequence(root: str, file: str, number: int) -> tuple[pa.Array, pa.Array]:
    """(ids, mask) of one sequence of a local file, as slices of its memory map."""
    opened = pa.ipc.open_file(pa.memory_map(f"{_filesystem(root)[1]}/{file}"))
    batch = opened.get_batch(number // BATCH_ROWS)
    row, length = number % BATCH_ROWS, batch.schema.field(0).type.list_size
    return tuple(batch.column(k).values.slice(row * length, length) for k in (0, 1))
