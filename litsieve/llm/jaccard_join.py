"""N-gram Jaccard join with count vectors in an R-tree.

A document is its set of hashed word n-grams. The n-grams are hashed into groups, and the number of n-grams in
each group makes the document a point. Two documents share at most the sum, over the groups, of
the smaller count; a box of points is bounded by its largest counts in the same way. Pairs whose bound
reaches the overlap that the similarity needs are verified on the sets.

One tree over all points would compare nearly every box with every other: counts of long texts lie close
together. So the tree's root branches by fine groups, one n-gram each: two sets that are similar
enough share one of the first n - ceil(t n) + 1 n-grams in any common order, so each document belongs to
the subtrees of those n-grams and no link is lost. The order puts n-grams that are frequent in the
corpus last (by a count sketch over all texts, whose bitmap of fixed size is broadcast), so a passage
that many documents share makes no large subtree. Within a subtree points are packed into boxes.

Groups of copies cost no pairs: equal sets are one point. In a subtree the point that shares most with
the others is compared with each of them; only points that are then still in different components are
compared with each other, in blocks of bounded size, so a group of near copies of any size stays linear
and no link between components is missed.

Texts without words, and null texts, have empty sets, which link with nothing. Rows with a null id are not
linked. Rows that share an id are one node, linked by any of its texts. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litsieve.llm import arrays
from litsieve.llm.components import connected_components
from litsieve.session import drop_scratch, materialize, scratch_mark, ship_package, small_side

#: Coordinates of a point, and of the finer point that a pair is tried on before its sets are compared.
GROUPS = 64
FINE = 1024
#: Points of a box, boxes of a box one level up.
FANOUT = 32
#: Rows of a block of a subtree.
BLOCK = 4096
#: Bytes (rows times width) of ids that may be broadcast; the hashed form takes about five times as much. All other
#: joins are left to Spark's own sizes.
SMALL = 8 << 20
#: Counters of a row of the sketch, as a power of 2.
SKETCH_BITS = 20
_SKETCH_PART = 1 << 14
_PAIRS = 1 << 17


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


# ---- n-grams -------------------------------------------------------------------------------


def all_ngrams(batch: pa.RecordBatch, column: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram; a text of fewer words, but not none, is one n-gram."""
    data, offsets = arrays.text_bytes(batch.column(column))
    data = arrays.LOWER[data]
    starts, ends, rows = arrays.words(data, offsets, arrays.NOT_SPACE)
    hashes = arrays.word_hashes(data, starts, ends)
    found = arrays.window_hashes(hashes, n)
    ok = arrays.same_row(rows, n)
    all_rows, all_hashes = [rows[: len(found)][ok]], [found[ok]]
    sizes = np.bincount(rows, minlength=batch.num_rows)
    first = np.searchsorted(rows, np.arange(batch.num_rows))
    for size in range(1, n):
        short = np.flatnonzero(sizes == size)
        if len(short):
            all_rows.append(short)
            all_hashes.append(arrays.mix(arrays.window_hashes(hashes, size)[first[short]] + np.uint64(size)))
    return np.concatenate(all_rows), np.concatenate(all_hashes)


def ngram_sets(batch: pa.RecordBatch, column: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams, sorted."""
    rows, hashes = all_ngrams(batch, column, n)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


# ---- frequent n-grams ------------------------------------------------------------------------


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of an n-gram."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)


def _sketch(n: int, bits: int):
    def run(batches):
        counts = np.zeros(2 << bits, np.int64)
        for batch in arrays.slices(batches, "text"):
            for cells in _cells(all_ngrams(batch, 0, n)[1], bits):
                counts += np.bincount(cells, minlength=len(counts))
        parts = counts.reshape(-1, _SKETCH_PART) if len(counts) >= _SKETCH_PART else counts[None]
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[i].astype("<i8").tobytes() for i in used], pa.binary())], names=["part", "counts"]
        )

    return run


def _add_up(batches):
    """Sums the parts; rows of a part are neighbours."""
    part, total = None, None
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(raw, "<i8")
            if at != part and part is not None:
                yield _counted(part, total)
            part, total = at, counts if at != part else total + counts
    if part is not None:
        yield _counted(part, total)


def _counted(part, total):
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])


def frequent(texts: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bitmap of the counters that stand well above the mean: a fixed size, whatever the corpus."""
    ddl = "part int, counts binary"
    sums = texts.mapInArrow(_sketch(n, bits), ddl).repartition("part").sortWithinPartitions("part").mapInArrow(_add_up, ddl)
    counts = np.zeros(2 << bits, np.int64)
    size = min(_SKETCH_PART, len(counts))
    for row in sums.collect():
        counts[row["part"] * size :][:size] += np.frombuffer(row["counts"], "<i8")
    return np.packbits(counts > max(24, 4 * counts.mean()))


# ---- points ----------------------------------------------------------------------------------


def prefix_size(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Any two similar sets share one of so many first elements of a common order."""
    return sizes - -(-sizes * num // den) + 1


def _points(n: int, num: int, den: int, bitmap, bits: int, schema: pa.Schema):
    def run(batches):
        hot = np.unpackbits(bitmap.value).astype(bool)
        for batch in arrays.slices(batches, "text"):
            count = batch.num_rows
            rows, hashes = ngram_sets(batch, 1, n)
            sizes = np.bincount(rows, minlength=count)
            first = np.cumsum(sizes) - sizes
            grid = counts_of(rows, hashes, count, GROUPS)
            a, b = _cells(hashes, bits)
            order = np.lexsort((hashes, hot[a] & hot[b], rows))
            ranked = hashes[order]
            keep = np.arange(len(rows)) - first[rows] < prefix_size(sizes, num, den)[rows]
            sums = [np.zeros(count, np.uint64), np.zeros(count, np.uint64)]
            full = np.flatnonzero(sizes)
            for i, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                if len(full):
                    sums[i][full] = np.add.reduceat(arrays.mix(hashes ^ np.uint64(seed)), first[full])
            yield arrays.batch_of(
                schema, id=batch.column(0), size=sizes, p1=sums[0].view(np.int64), p2=sums[1].view(np.int64),
                point=[pack(row) for row in grid], keys=arrays.ragged(ranked[keep].view(np.int64), rows[keep], count, pa.int64()),
            )

    return run


def counts_of(rows: np.ndarray, hashes: np.ndarray, n_rows: int, groups: int) -> np.ndarray:
    """(row, group) counts; the top bits of a hash are its group, so a finer grid splits each group."""
    group = (hashes >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    return np.bincount(rows * groups + group, minlength=n_rows * groups).reshape(n_rows, groups)


def pack(counts: np.ndarray) -> bytes:
    """One byte for a count where all fit, else four."""
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpack(points: list[bytes], groups: int) -> np.ndarray:
    if all(len(p) == groups for p in points):
        return np.frombuffer(b"".join(points), "u1").reshape(-1, groups)
    return np.stack([np.frombuffer(p, "u1" if len(p) == groups else "<u4").astype(np.uint32) for p in points])


def reaches(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sum of the smaller counts admits enough common elements, for pairs of rows."""
    bound = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (bound * (num + den) >= num * (size_a + size_b)) & (least * den >= num * most)


class CountTree:
    """Points packed by size into boxes, boxes into boxes; a box has the largest counts of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        points, low = points[self.order], sizes[self.order]
        self.levels = [(points, low, low)]
        while len(self.levels[-1][0]) > FANOUT:
            points, low, high = self.levels[-1]
            heads = np.arange(0, len(points), FANOUT)
            self.levels.append((np.maximum.reduceat(points, heads), np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)))


def joined(left: CountTree, right: CountTree, num: int, den: int, differ=None):
    """Pairs (i, j) of point numbers whose bound reaches the need, found from the top boxes down."""
    depth = max(len(left.levels), len(right.levels)) - 1
    # a lower tree stays at its top level until the other one has come down to it
    at = lambda tree, level: min(level, len(tree.levels) - 1)
    la, lb = len(left.levels[at(left, depth)][0]), len(right.levels[at(right, depth)][0])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(la), np.arange(lb), indexing="ij"))
    todo = [(depth, i, j)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > _PAIRS:
            todo += [(level, i[_PAIRS:], j[_PAIRS:])]
            i, j = i[:_PAIRS], j[:_PAIRS]
        if not level and differ is not None:
            ok = differ(left.order[i], right.order[j])
            i, j = i[ok], j[ok]
        a, low_a, high_a = left.levels[at(left, level)]
        b, low_b, high_b = right.levels[at(right, level)]
        ok = (high_a[i] * den >= num * low_b[j]) & (high_b[j] * den >= num * low_a[i])
        i, j = i[ok], j[ok]
        ok = np.minimum(a[i], b[j]).sum(axis=1, dtype=np.int64) * (num + den) >= num * (low_a[i] + low_b[j])
        i, j = i[ok], j[ok]
        if not level:
            if len(i):
                yield left.order[i], right.order[j]
            continue
        down_a, down_b = len(left.levels) > level, len(right.levels) > level
        i, j = _children(i, j, len(left.levels[level - 1][0])) if down_a else (i, j)
        j, i = _children(j, i, len(right.levels[level - 1][0])) if down_b else (j, i)
        if len(i):
            todo.append((level - 1, i, j))


def _children(boxes: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    inner = boxes[:, None] * FANOUT + np.arange(FANOUT)
    ok = inner < n
    return inner[ok], np.broadcast_to(others[:, None], inner.shape)[ok]


# ---- pairs -----------------------------------------------------------------------------------


def _bounded(num: int, den: int, groups: int, schema: pa.Schema):
    """Keeps the pairs (a, b, size and point of each) whose bound reaches the need."""

    def run(batches):
        for batch in batches:
            step = (_PAIRS * 8) // groups
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                pa_, pb = (unpack(part.column(k).to_pylist(), groups) for k in (4, 5))
                ok = reaches(pa_, pb, part.column(2).to_numpy(), part.column(3).to_numpy(), num, den)
                yield arrays.batch_of(schema, a=part.column(0).filter(pa.array(ok)), b=part.column(1).filter(pa.array(ok)))

    return run


def _crossed(num: int, den: int, schema: pa.Schema):
    """Pairs within a block, or between two blocks, of a subtree; its rows are neighbours.

    Rows are (key, i, j, side, id, component, size, point). The subtree of a key is cut into
    blocks; (i, j) is a pair of blocks and ``side`` says to which of the two a row belongs.
    """

    def pairs(rows: pa.Table):
        group = _group_numbers(rows)
        counts = np.bincount(group)
        sizes, side = rows.column("size").to_numpy(), rows.column("side").to_numpy()
        component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        ids = rows.column("id").combine_chunks()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        # groups of a single box: all neighbours at a distance, side by side
        small = np.flatnonzero((counts <= FANOUT)[group])
        points = unpack(rows.column("point").take(pa.array(small)).to_pylist(), GROUPS) if len(small) else None
        for step in range(1, FANOUT):
            x = np.flatnonzero(group[small[:-step]] == group[small[step:]])
            if not len(x):
                break
            i, j = small[x], small[x + step]
            ok = component[i] != component[j]
            x, i, j = x[ok], i[ok], j[ok]
            ok = reaches(points[x], points[x + step], sizes[i], sizes[j], num, den)
            found.append((i[ok], j[ok]))
        for k in np.flatnonzero(counts > FANOUT):
            own = np.flatnonzero(group == k)
            points = unpack(rows.column("point").take(pa.array(own)).to_pylist(), GROUPS)
            left, right = np.flatnonzero(side[own] == 0), np.flatnonzero(side[own] == 1)
            part, size = component[own], sizes[own]
            if len(right) and len(left):
                trees = [CountTree(points[x], size[x]) for x in (left, right)]
                near = joined(*trees, num, den, lambda i, j, p=part, a=left, b=right: p[a[i]] != p[b[j]])
                found += [(own[left[i]], own[right[j]]) for i, j in near]
            elif not len(right):
                tree = CountTree(points, size)
                near = joined(tree, tree, num, den, lambda i, j, p=part: (i < j) & (p[i] != p[j]))
                found += [(own[i], own[j]) for i, j in near]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return arrays.batch_of(schema, a=ids.take(pa.array(i)), b=ids.take(pa.array(j)))

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            group = _group_numbers(held)
            if len(group) and group[-1]:
                done = int(np.searchsorted(group, group[-1]))
                yield pairs(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _group_numbers(rows: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal (key, i, j)."""
    new = np.zeros(rows.num_rows, bool)
    for name in ("key", "i", "j"):
        values = rows.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _sets(n: int, schema: pa.Schema):
    def run(batches):
        for batch in arrays.slices(batches, "text"):
            rows, hashes = ngram_sets(batch, 1, n)
            yield arrays.batch_of(
                schema, id=batch.column(0), size=np.bincount(rows, minlength=batch.num_rows),
                point=[pack(row) for row in counts_of(rows, hashes, batch.num_rows, FINE)],
                grams=arrays.ragged(hashes.view(np.int64), rows, batch.num_rows, pa.int64()),
            )

    return run


def _within_bound(pairs: DataFrame, points: DataFrame, num: int, den: int, groups: int, id_type: str) -> DataFrame:
    """The pairs (a, b) whose points admit the similarity."""
    one = points.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("point").alias("point_a"))
    two = points.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("point").alias("point_b"))
    sized = (F.col("size_a") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size_a") * num)
    both = pairs.join(one, "a").join(two, "b").filter(sized).select("a", "b", "size_a", "size_b", "point_a", "point_b")
    ddl = f"a {id_type}, b {id_type}"
    return both.mapInArrow(_bounded(num, den, groups, _arrow(ddl)), ddl).distinct()


def verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int, id_type: str) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are similar enough: by finer points, then by their sets."""
    named = pairs.select(F.col("a").alias("named")).unionByName(pairs.select(F.col("b").alias("named"))).distinct()
    ids = materialize(named, "ids")
    ddl = f"id {id_type}, size long, point binary, grams array<bigint>"
    # ids are few against texts: broadcast while they are, so that texts are not shuffled
    texts = docs.join(small_side(ids, SMALL), F.col("id") == F.col("named"), "left_semi")
    sets = materialize(texts.mapInArrow(_sets(n, _arrow(ddl)), ddl), "sets")
    close = materialize(_within_bound(pairs, sets.select("id", "size", "point"), num, den, FINE, id_type), "close")
    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
    both = close.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    union = (F.size("grams_a") + F.size("grams_b")).cast("long") - common
    return both.select("a", "b", (common * den >= union * num).alias("linked")).filter("linked").select("a", "b").distinct()


# ---- the join --------------------------------------------------------------------------------


def jaccard_links(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows (id, size, rep), and links (a, b) between representatives.

    ``size`` is that of the set; ``rep`` the smallest id with an equal set. The links have the same
    components as the links of all pairs with at least ``num`` / ``den`` similarity.
    """
    ship_package()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    bitmap = spark.sparkContext.broadcast(frequent(rows.select("text"), n))
    ddl = f"id {id_type}, size long, p1 long, p2 long, point binary, keys array<bigint>"
    since = scratch_mark()
    points = materialize(rows.mapInArrow(_points(n, num, den, bitmap, SKETCH_BITS, _arrow(ddl)), ddl), "points")
    same = ["size", "p1", "p2"]
    linkable = points.filter("size > 0 AND id IS NOT NULL")
    classes = materialize(linkable.groupBy(same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    until = scratch_mark()
    # joined by the id as well, so that a large class is spread
    chosen = linkable.join(classes.select(*same, F.col("rep").alias("id")), ["id", *same], "left_semi").dropDuplicates(["id", *same])
    known = materialize(chosen.select("id", "size", "point", "keys"), "chosen")
    copied = classes.filter("copies > 1").select(*(F.col(c).alias(f"c_{c}") for c in same), "rep")
    match = (F.col("size") == F.col("c_size")) & (F.col("p1") == F.col("c_p1")) & (F.col("p2") == F.col("c_p2"))
    members = points.select("id", *same).join(copied, match & F.col("id").isNotNull(), "left")
    members = materialize(members.select("id", "size", F.coalesce("rep", "id").alias("rep")), "members")
    drop_scratch(spark, since, until)
    bitmap.unpersist()

    inner = scratch_mark()
    listed = known.select(F.explode("keys").alias("key"), "id")
    counted = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    subtrees = materialize(listed.join(counted, "key"), "subtrees")
    known = known.select("id", "size", "point")
    texts = rows.filter("id IS NOT NULL")

    # each subtree's best connected point against the others
    fame = subtrees.groupBy("id").agg(F.sum("n").alias("fame"))
    heads = subtrees.join(fame, "id").groupBy("key").agg(F.max(F.struct("fame", "id")).getField("id").alias("head"))
    star = subtrees.join(heads, "key").filter("id <> head")
    star = star.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    links = _verified_links(texts, _within_bound(star, known, num, den, GROUPS, id_type), n, num, den, id_type)

    # what is then still apart within a subtree, in blocks
    parts = connected_components(links)
    labelled = subtrees.join(parts, F.col("id") == F.col("node"), "left")
    labelled = materialize(labelled.select("key", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
    apart = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = labelled.join(apart.filter("low <> high").select("key"), "key").join(known, "id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "component", "size", "point",
    )
    ddl = f"a {id_type}, b {id_type}"
    placed = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = placed.mapInArrow(_crossed(num, den, _arrow(ddl)), ddl).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verified_links(texts, near.distinct(), n, num, den, id_type)
    links = materialize(links.unionByName(more), "all-links")
    drop_scratch(spark, inner, scratch_mark() - 1)
    return members, links


def _verified_links(texts: DataFrame, pairs: DataFrame, n: int, num: int, den: int, id_type: str) -> DataFrame:
    """The links among candidate pairs, written; the tables on the way to them are removed."""
    since = scratch_mark()
    found = verified(texts, materialize(pairs, "near"), n, num, den, id_type)
    until = scratch_mark()
    links = materialize(found, "links")
    drop_scratch(texts.sparkSession, since, until)
    return links


def jaccard_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_ngrams, component) of every row: the smallest id that its links lead to."""
    members, links = jaccard_links(docs, n, num, den, id_col, text_col)
    parts = materialize(connected_components(links), "components")
    joined_ = members.join(parts, F.col("rep") == F.col("node"), "left")
    return joined_.select(F.col("id").alias(id_col), F.col("size").alias("n_ngrams"), F.coalesce("component", "rep").alias("component"))
