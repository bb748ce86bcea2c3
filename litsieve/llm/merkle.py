"""Merkle manifest of a table by time-forward processing, with an inclusion proof for every row.

The nodes of all trees carry labels (group, level, number) in which children come before their parents. A first
sweep visits labels in ascending order: a node's digest is a message that waits, ordered by the parent's label, until
the sweep gets there. A second sweep visits them in descending order and sends every child the siblings that
its own path needs, in front of what its parent has received: the proof's suffix. Spark's sorted shuffle is the external
queue: a message goes to the block of ``fanout ** block_levels`` neighbouring nodes that holds its receiver, and waits there
in order; inside a block, which is bounded, a heap takes the messages of the levels between. So a tree of n leaves takes
log(n) / log(4096) shuffles each way, a source of any size is spread over blocks, and neither a group nor a level is ever in
one place. The leaves of the second tree are the roots of the groups.

Positions come from a range partitioning by (group, id) and a small table of rows per partition.

Null fields are encoded as ``-``. A null group is a group of its own, the first; null ids come first in theirs and are
never tampered with. Rows of equal id are ordered by their digest; equal rows are leaves of their own. Empty texts are texts
of length 0. Very long texts are hashed where they are read, and no later step sees a text. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import string
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.session import materialize, ship_package, small_side

Chain = tuple[str, ...]
#: Rows of an output batch.
_ROWS = 2048


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``bytes:value``, or ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def height(nodes: int, fanout: int, most: int) -> int:
    """Levels above ``nodes`` nodes until one is left, ``most`` at most."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def upward(digests: Sequence[str], levels: int, fanout: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """(digest of the last node, the children's digests by label (level, number)): the first sweep over one block."""
    queue = [(1, i // fanout, i, d) for i, d in enumerate(digests)] if levels else []
    received: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        level, node = queue[0][:2]
        got = received[level, node] = []
        while queue and queue[0][:2] == (level, node):
            got.append(heapq.heappop(queue)[3])
        top = digest(*got)
        if level < levels:
            heapq.heappush(queue, (level + 1, node // fanout, node, top))
    return top, received


def downward(received: dict[tuple[int, int], list[str]], levels: int, fanout: int, chain: Chain) -> Iterator[tuple[int, Chain]]:
    """(number, chain) of every leaf of a block whose last node got ``chain``: the reversed sweep.

    A chain holds, level by level from the receiver upward, what is left and what is right of its path.
    """
    queue = [(-levels, 0, chain)]
    while queue:
        level, node, chain = heapq.heappop(queue)
        if level == 0:
            yield node, chain
            continue
        got = received[-level, node]
        for k in range(len(got)):
            own = ("".join(got[:k]), "".join(got[k + 1 :]), *chain)
            heapq.heappush(queue, (level + 1, node * fanout + k, own))


def fold(leaf: str, chain: Chain) -> str:
    """The root that a leaf and its proof give."""
    for left, right in zip(chain[::2], chain[1::2], strict=True):
        leaf = digest(left, leaf, right)
    return leaf


def _grouped(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """Runs of neighbouring rows that agree in ``keys``, whatever batches they lie in."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and any(run[-1][k] != row[k] for k in keys):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        waiting.append(row)
        if len(waiting) == _ROWS:
            yield batch()
            waiting = []
    if waiting:
        yield batch()


def _climb(fanout: int, levels: int, schema: pa.Schema):
    def run(batches):
        def rows():
            for block in _grouped(batches, ("grp", "block")):
                first = block[0]
                top, _ = upward([r["digest"].hex() for r in block], height(first["n"], fanout, levels), fanout)
                yield first["grp"], first["block"], -(-first["n"] // fanout**levels), bytes.fromhex(top)

        yield from _batched(rows(), schema)

    return run


def _descend(fanout: int, levels: int, schema: pa.Schema, result: Callable[[dict, dict, Chain], tuple]):
    """The first row of a block is the message to its last node, the others are its leaves."""

    def run(batches):
        def rows():
            for message, *block in _grouped(batches, ("grp", "block")):
                height_ = height(block[0]["n"], fanout, levels)
                _, received = upward([r["digest"].hex() for r in block], height_, fanout)
                for number, chain in downward(received, height_, fanout, tuple(message["chain"])):
                    yield result(message, block[number], chain)

        yield from _batched(rows(), schema)

    return run


def _arrow(ddl_or_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl_or_schema) if isinstance(ddl_or_schema, str) else ddl_or_schema)


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (grp, id, digest, ...) with their position ``pos`` in their group and the group's number of rows ``n``."""
    order = ("grp", "id", "digest")
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = materialize(ordered.withColumns({"part": F.spark_partition_id(), "at": number}), "placed")
    counts = ordered.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    # sorted by group, partitions and groups alternate: no more rows than both together
    group = Window.partitionBy("grp")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(
        F.col("part").alias("p"), F.col("grp").alias("g"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"),
        F.sum("rows").over(group).alias("n"),
    )
    bases = small_side(materialize(bases, "bases"))
    joined = ordered.join(bases, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return joined.withColumn("pos", F.col("base") + F.col("at")).drop("part", "at", "p", "g", "base")


class Forest:
    """The trees over all groups of a table of placed leaves."""

    def __init__(self, leaves: DataFrame, fanout: int, block_levels: int) -> None:
        self.spark, self.fanout, self.block_levels = leaves.sparkSession, fanout, block_levels
        self.width = fanout**block_levels
        most = leaves.agg(F.max("n")).first()[0] or 0
        #: The nodes at every block_levels-th level, lowest first.
        self.rounds = [leaves]
        while most > 1:
            self.rounds.append(self._up(self.rounds[-1]))
            most = -(-most // self.width)

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("pos") / self.width))

    def _up(self, nodes: DataFrame) -> DataFrame:
        rows = self._blocks(nodes).select("grp", "block", "pos", "n", "digest")
        rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        ddl = "grp string, pos long, n long, digest binary"
        return materialize(rows.mapInArrow(_climb(self.fanout, self.block_levels, _arrow(ddl)), ddl), "nodes")

    def tops(self) -> DataFrame:
        """(grp, digest): the root of every group."""
        return self.rounds[-1].select("grp", "digest")

    def deliver(self, messages: DataFrame, payload: Sequence[str], schema, result: Callable[[dict, dict, Chain], tuple]) -> DataFrame:
        """What ``result(message, leaf, chain)`` gives for every leaf, from messages (grp, chain, top), one per group."""
        messages = messages.withColumn("pos", F.lit(0).cast("long"))
        for nodes in reversed(self.rounds[1:]):
            ddl = "grp string, pos long, chain array<string>, top binary"
            onward = lambda m, r, chain: (r["grp"], r["pos"], list(chain), m["top"])
            messages = materialize(self._down(messages, nodes, (), ddl, onward), "messages")
        return self._down(messages, self.rounds[0], payload, schema, result)

    def _down(self, messages: DataFrame, nodes: DataFrame, payload: Sequence[str], schema, result) -> DataFrame:
        to = messages.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "chain", "top")
        rows = self._blocks(nodes).select("grp", "block", "pos", "n", "digest", *payload)
        both = to.unionByName(rows, allowMissingColumns=True)
        both = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        return both.mapInArrow(_descend(self.fanout, self.block_levels, _arrow(schema), result), schema)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 16, block_levels: int = 3,
    id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tamper_every: int = 5,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, digests as lower-case hex.

    Every group is a tree over its rows in ascending order of ids, and the groups' roots, in ascending order of groups,
    are the leaves of the whole tree. ``proof_sha256`` is the digest of the siblings on a row's path. ``folded_root`` is the root that
    a row's proof gives for the row as it is or, where ``tamper_every`` divides the CRC-32 of its id, with a lower-cased text.
    """
    from pyspark.sql.types import BinaryType, StructType

    ship_package()
    columns = {c: F.col(c) for c in fields}
    lowered = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    changed = F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_every == 0
    leaves = docs.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf_digest(columns.values()).alias("digest"),
        F.when(changed, leaf_digest((columns | {text_col: lowered}).values())).alias("tampered"),
    )
    # written before ranges are sampled: the texts are read once
    trees = Forest(placed(materialize(leaves, "leaves")), fanout, block_levels)
    tops = trees.tops().select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest")
    whole = Forest(placed(materialize(tops, "tops")), fanout, block_levels)
    found = whole.tops().first()
    root = bytes(found["digest"]) if found else b""
    start = docs.sparkSession.createDataFrame([("", [], root)] if found else [], "grp string, chain array<string>, top binary")
    onward = lambda m, r, chain: (r["id"], list(chain), r["digest"])
    messages = materialize(whole.deliver(start, ("id",), "grp string, chain array<string>, top binary", onward), "messages")
    schema = StructType().add("id", leaves.schema["id"].dataType)
    for name in ("leaf", "top", "proof", "folded"):
        schema = schema.add(name, BinaryType())
    found = trees.deliver(messages, ("id", "tampered"), schema, _proof)
    hexed = lambda name: F.lower(F.hex(name))
    return found.select(
        F.col("id").alias(id_col), hexed("leaf").alias("leaf"), hexed("top").alias("subroot"), F.lit(root.hex()).alias("root"),
        hexed("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified"),
    )


def _proof(message: dict, row: dict, chain: Chain) -> tuple:
    leaf = row["digest"] if row["tampered"] is None else row["tampered"]
    return row["id"], row["digest"], message["top"], bytes.fromhex(digest(*chain)), bytes.fromhex(fold(leaf.hex(), chain))
