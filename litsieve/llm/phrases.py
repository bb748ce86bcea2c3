"""Phrase collocations, counted in HAT-tries.

A task reads its texts into a trie whose inner nodes branch by word ids (hashes), a byte at a time, and whose leaves are hash containers of
phrases of 1 to ``longest`` words; a container that grows beyond ``BURST`` phrases bursts into a node with containers for the next byte. When
the trie holds more than ``LIMIT`` phrases, whole subtrees below the root, the largest first, are spilled as runs sorted by
phrase until half of it is left. The runs of all tasks are written, cut into partitions by ranges of prefixes (a frequent
prefix spreads over several) and merged there.

Most phrases occur once, and need no place in a trie. So two passes before it count 64-bit hashes of phrases: of one and two words, then of
more words in texts' stretches whose neighbouring words are all frequent pairs. Hashes go in sorted blocks to parts of bounded size, by
their top bits, where equal ones are added up. A Bloom filter (of ``FILTER_BITS`` at most, whatever the number) of the hashes with
``least`` occurrences or more then decides what enters the tries. Collisions only let through more than needed: it is counted
exactly there, by its text, and dropped.

Everything is counted per language. Null texts are empty; a null language is ``und``. Rows are not told apart, so repeated rows and null
ids count like others. A text longer than a slice is cut where a piece ends, which no phrase crosses. Ties in score and count are broken by
the phrase's bytes. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import drop_scratch, materialize, scratch_mark, ship_package

#: Characters that end a piece, and those that end a word as well.
BREAKS = ".,;:!?\n\x0b\x0c\r"
WORD = arrays.byte_table(BREAKS + " \t")
_BREAK = ~arrays.byte_table(BREAKS)
#: Phrases of a container, and of a trie.
BURST, LIMIT = 4096, 800_000
FILTER_BITS = 1 << 27
#: Text bytes that are worked on at once.
SLICE = 1 << 20
#: Hashes that a task holds before it sends them, and text bytes whose hashes make one part.
_HELD, PART_BYTES = 1 << 20, 16 << 20
#: Parts that hashes are dealt out to in one step.
_RADIX = 4096
_RUN = "lang string, phrase string, f long"
_BLOCK = "part long, hashes binary, counts binary"


class HatTrie:
    """Counts of phrases of at most ``longest`` words: a shallow trie over word ids above hash containers.

    A path is two bytes of each word's id in turn, and a node branches by one of them, so a container holds the phrases of many
    words until it bursts. The subtrees below the root are those of a language and a first byte.
    """

    def __init__(self, longest: int, burst: int = BURST, limit: int = LIMIT) -> None:
        self.depth, self.burst, self.limit = 2 * longest, burst, limit
        self.root: dict[tuple[str, int], Container | Node] = {}
        self.held = 0

    def add(self, lang: str, path: bytes, phrase: bytes, count: int) -> None:
        holder, name, depth = self.root, (lang, path[0]), 1
        below = holder.get(name)
        while type(below) is Node:
            holder, name = below.children, path[depth] if depth < len(path) else -1
            below, depth = holder.get(name), depth + 1
        if below is None:
            below = holder[name] = Container()
        old = below.counts.get(phrase)
        if old is None:
            self.held += 1
            below.counts[phrase] = count
            if len(below.counts) > self.burst and depth < self.depth and name != -1:
                holder[name] = below.split(depth)
        else:
            below.counts[phrase] = old + count

    def full(self) -> bool:
        return self.held > self.limit

    def spill(self, keep: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        """Takes out subtrees, the largest first, until at most ``keep`` phrases are left: (language, sorted run)."""
        sizes = sorted(((len(below), key) for key, below in self.root.items()), key=lambda x: -x[0])
        for size, key in sizes:
            if self.held <= keep:
                return
            yield key[0], sorted(self.root.pop(key).phrases())
            self.held -= size


class Container:
    __slots__ = ("counts",)

    def __init__(self) -> None:
        self.counts: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.counts)

    def phrases(self) -> Iterator[tuple[bytes, int]]:
        return iter(self.counts.items())

    def split(self, depth: int) -> Node:
        """A node with a container for each byte at ``depth`` of the paths; child -1 has the phrases that end before."""
        node = Node()
        data, offsets = arrays.text_bytes(pa.array(list(self.counts), pa.large_binary()).cast(pa.large_string()))
        starts, ends, rows = arrays.words(data, offsets, WORD)
        ids = arrays.word_hashes(data, starts, ends)
        first = np.searchsorted(rows, np.arange(len(self.counts) + 1))
        more = np.diff(first) > depth // 2
        following = np.full(len(self.counts), -1, np.int64)
        following[more] = path_bytes(ids[first[:-1][more] + depth // 2])[:, depth % 2]
        for byte, (phrase, count) in zip(following.tolist(), self.counts.items(), strict=True):
            below = node.children.get(byte)
            if below is None:
                below = node.children[byte] = Container()
            below.counts[phrase] = count
        return node


class Node:
    __slots__ = ("children",)

    def __init__(self) -> None:
        self.children: dict[int, Container | Node] = {}

    def __len__(self) -> int:
        return sum(map(len, self.children.values()))

    def phrases(self) -> Iterator[tuple[bytes, int]]:
        for below in self.children.values():
            yield from below.phrases()


def path_bytes(ids: np.ndarray) -> np.ndarray:
    """(words, 2): the two highest bytes of each word's id."""
    return np.stack([(ids >> np.uint64(56)).astype(np.uint8), (ids >> np.uint64(48)).astype(np.uint8)], axis=1)


class Filter:
    """A Bloom filter with two bits for a hash."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.shift, self.words = np.uint64(64 - bits.bit_length() + 1), words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in places(hashes, self.shift):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def places(hashes: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> shift, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> shift


def stretches(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that begin and end with a text or, in a longer text, with a piece."""
    begin, total = 0, int(offsets[-1])
    while begin < total:
        end = int(offsets[np.searchsorted(offsets, begin + limit, side="right") - 1])
        if end <= begin:
            last = int(offsets[np.searchsorted(offsets, begin, side="right")])
            end, at = last, begin + limit
            while at < last:
                found = np.flatnonzero(_BREAK[data[at : min(at + limit, last)]])
                if len(found):
                    end = at + int(found[0]) + 1
                    break
                at += limit
        yield begin, end
        begin = end


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the same words with one space between neighbours."""
    sizes = ends - starts
    new = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    target = np.ones(len(out), bool)
    target[new + sizes] = False
    out[target] = data[mask]
    return out, new, new + sizes


def lang_hashes(langs: list[str]) -> np.ndarray:
    raw = pa.array(langs, pa.large_string())
    data, offsets = arrays.text_bytes(raw)
    return arrays.word_hashes(data, offsets[:-1], offsets[1:])


def phrase_hashes(words: np.ndarray, length: int, salt: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``length`` words; ``salt`` is the language's, for every word."""
    found = arrays.window_hashes(words, length)
    return arrays.mix(found ^ (salt[: len(found)] + np.uint64(length)))


class Slice:
    """The words of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray) -> None:
        self.data = arrays.LOWER[data]
        self.starts, self.ends, self.rows = arrays.words(self.data, offsets, WORD)
        self.ids = arrays.word_hashes(self.data, self.starts, self.ends)
        self.salt = salts[self.rows]
        # pieces are numbered through all texts
        self.piece = np.cumsum(_BREAK[self.data], dtype=np.int32)[self.starts] + self.rows.astype(np.int32)

    def within(self, length: int) -> np.ndarray:
        """Whether the window that begins at a word lies in one piece."""
        count = len(self.ids) - length + 1
        return self.piece[:count] == self.piece[length - 1 :] if count > 0 else np.zeros(0, bool)

    def hashes(self, length: int) -> np.ndarray:
        return phrase_hashes(self.ids, length, self.salt)

    def chained(self, length: int, pairs: np.ndarray) -> np.ndarray:
        """Windows of one piece, of words that are all neighbours in frequent pairs."""
        alive = self.within(length)
        for k in range(length - 1):
            alive = alive & pairs[k : k + len(alive)]
        return alive


def _slices(batches) -> Iterator[tuple[list[str], Slice]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        salts = lang_hashes(langs)
        data, offsets = arrays.text_bytes(batch.column(1))
        for begin, end in stretches(data, offsets):
            yield langs, Slice(data[begin:end], np.clip(offsets - begin, 0, end - begin), salts)


# ---- which phrases may be frequent -------------------------------------------------------------


def _dealt(hashes: np.ndarray, counts: np.ndarray, parts: int, schema: pa.Schema) -> pa.RecordBatch:
    """Sorted hashes in blocks, by ``parts`` equal ranges."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    tails = np.append(heads[1:], len(hashes))
    counts = np.minimum(counts, 255).astype(np.uint8)
    return arrays.batch_of(
        schema, part=part[heads].astype(np.int64), hashes=[hashes[a:b].tobytes() for a, b in zip(heads, tails, strict=True)],
        counts=[counts[a:b].tobytes() for a, b in zip(heads, tails, strict=True)],
    )


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, weights = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
    order = np.argsort(found)
    found = found[order]
    heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[heads], np.add.reduceat(weights[order], heads)


def _hashed(lengths: tuple[int, ...], shared, parts: int, schema: pa.Schema):
    """Blocks of the hashes of all phrases of ``lengths`` words, counted within the task as far as it holds them."""

    def run(batches):
        held, size = [], 0
        for _, words in _slices(batches):
            pairs = shared.value.has(words.hashes(2)) if shared is not None else None
            for length in lengths:
                alive = words.within(length) if pairs is None else words.chained(length, pairs)
                held.append(words.hashes(length)[alive])
                size += len(held[-1])
            if size >= _HELD:
                yield _dealt(*np.unique(np.concatenate(held), return_counts=True), parts, schema)
                held, size = [], 0
        if size:
            yield _dealt(*np.unique(np.concatenate(held), return_counts=True), parts, schema)

    return run


def _parts(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part, hashes, counts in zip(*(batch.column(k) for k in range(3)), strict=True):
            yield part.as_py(), np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint8)


def _redealt(parts: int, schema: pa.Schema):
    """The same hashes in blocks for more parts; rows of a part are neighbours."""

    def run(batches):
        last, hashes, counts, size = None, [], [], 0
        for part, h, c in _parts(batches):
            if size and (part != last or size >= 4 * _HELD):
                yield _dealt(*_summed(hashes, counts), parts, schema)
                hashes, counts, size = [], [], 0
            last, size = part, size + len(h)
            hashes.append(h)
            counts.append(c)
        if size:
            yield _dealt(*_summed(hashes, counts), parts, schema)

    return run


def _often(least: int, schema: pa.Schema):
    """The hashes of a part with ``least`` occurrences or more."""

    def chosen(hashes, counts):
        found, sums = _summed(hashes, counts)
        return arrays.batch_of(schema, hash=found[sums >= least].view(np.int64))

    def run(batches):
        last, hashes, counts = None, [], []
        for part, h, c in _parts(batches):
            if hashes and part != last:
                yield chosen(hashes, counts)
                hashes, counts = [], []
            last = part
            hashes.append(h)
            counts.append(c)
        if hashes:
            yield chosen(hashes, counts)

    return run


def often(rows: DataFrame, lengths: tuple[int, ...], least: int, parts: int, shared=None) -> DataFrame:
    """(hash) of the phrases that may occur ``least`` times or more, for ``least`` up to 255.

    With more than ``_RADIX`` parts the hashes are dealt out in two steps, so that blocks do not get tiny.
    """
    block = pa.schema([("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    first = min(parts, _RADIX)
    found = rows.mapInArrow(_hashed(lengths, shared, first, block), _BLOCK)
    if parts > first:
        found = found.repartition("part").sortWithinPartitions("part").mapInArrow(_redealt(parts, block), _BLOCK)
    found = found.repartition("part").sortWithinPartitions("part")
    return materialize(found.mapInArrow(_often(min(least, 255), pa.schema([("hash", pa.int64())])), "hash long"), "hashes")


def _bits(shift: np.uint64, schema: pa.Schema):
    """(word, bits) of a Bloom filter's words for batches of hashes."""

    def run(batches):
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), shift))
            word, index = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, index, np.uint64(1) << (at & np.uint64(63)))
            yield arrays.batch_of(schema, word=word.astype(np.int64), bits=bits.view(np.int64))

    return run


def bloom(hashes: DataFrame, most_bits: int = FILTER_BITS) -> Filter:
    """16 bits for each hash, a power of two in all and ``most_bits`` at most."""
    size = min(most_bits, 1 << max(10, (16 * hashes.count() - 1).bit_length()))
    empty = Filter(size, np.zeros(size // 64, np.uint64))
    ddl, schema = "word long, bits long", pa.schema([("word", pa.int64()), ("bits", pa.int64())])
    # no more rows than the filter has words
    merged = hashes.mapInArrow(_bits(empty.shift, schema), ddl).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.words[merged.column("word").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return empty


# ---- counts ------------------------------------------------------------------------------------


def _counter(longest: int, shared, schema: pa.Schema, burst: int, limit: int):
    """Runs of the phrases that pass the filter; the empty phrase counts all words of a language."""

    def run(batches):
        trie, totals = HatTrie(longest, burst, limit), Counter()

        def spilled(keep: int) -> Iterator[pa.RecordBatch]:
            langs, found = [], []
            for lang, part in trie.spill(keep):
                langs += [lang] * len(part)
                found += part
                if len(found) >= 1 << 15:
                    yield _run_batch(langs, found, schema)
                    langs, found = [], []
            yield _run_batch(langs, found, schema)

        for langs, words in _slices(batches):
            if not len(words.ids):
                continue
            for row, count in enumerate(np.bincount(words.rows).tolist()):
                if count:
                    totals[langs[row]] += count
            text, begins, stops = joined(words.data, words.starts, words.ends)
            raw, alive = text.tobytes(), None
            for length in range(1, longest + 1):
                hashes = words.hashes(length)
                # a frequent phrase's parts are frequent
                possible = words.within(length)
                possible = possible if alive is None else possible & alive[: len(possible)] & alive[1:][: len(possible)]
                at = np.flatnonzero(possible)
                at = at[shared.value.has(hashes[at])]
                alive = np.zeros(len(hashes), bool)
                alive[at] = True
                if not len(at):
                    break
                _, first, counts = np.unique(hashes[at], return_index=True, return_counts=True)
                at = at[first]
                steps = np.concatenate([path_bytes(words.ids[at + k]) for k in range(length)], axis=1).tobytes()
                paths = [steps[k : k + 2 * length] for k in range(0, len(steps), 2 * length)]
                ends = stops[at + length - 1].tolist()
                for row, a, b, n, path in zip(words.rows[at].tolist(), begins[at].tolist(), ends, counts.tolist(), paths, strict=True):
                    trie.add(langs[row], path, raw[a:b], n)
                    if trie.full():
                        yield from spilled(limit // 2)
        yield from spilled(0)
        yield _run_batch(list(totals), [(b"", n) for n in totals.values()], schema)

    return run


def _run_batch(langs: list[str], found: list[tuple[bytes, int]], schema: pa.Schema) -> pa.RecordBatch:
    phrases = pa.array([p for p, _ in found], pa.binary()).cast(pa.string())
    return arrays.batch_of(schema, lang=langs, phrase=phrases, f=[n for _, n in found])


def frequent_phrases(
    docs: DataFrame, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", burst: int = BURST, limit: int = LIMIT,
    filter_bits: int = FILTER_BITS, part_bytes: int = PART_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f), (lang, n)): phrases that occur ``least`` times or more, and the words of a language."""
    ship_package()
    spark, since = docs.sparkSession, scratch_mark()
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // part_bytes)
    hashes = often(rows, tuple(range(1, min(longest, 2) + 1)), least, parts)
    if longest > 2:
        shared = spark.sparkContext.broadcast(bloom(hashes, filter_bits))
        hashes = hashes.unionByName(often(rows, tuple(range(3, longest + 1)), least, parts, shared))
        shared.unpersist()
    shared = spark.sparkContext.broadcast(bloom(hashes, filter_bits))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    # a trie for much text meets a phrase once where tries for little would each write it: two for a core, not one for a split
    wide = rows.coalesce(2 * spark.sparkContext.defaultParallelism)
    runs = materialize(wide.mapInArrow(_counter(longest, shared, schema, burst, limit), _RUN), "runs")
    until = scratch_mark()
    totals = materialize(runs.filter("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    ranges = runs.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    merged = ranges.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) & (F.col("phrase") != ""))
    merged = materialize(merged, "frequent")
    drop_scratch(spark, since, until)
    shared.unpersist()
    return merged, totals


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, cover: int = 80, top: int = 2000, text_col: str = "text",
    lang_col: str = "lang", **counting: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases of 2 to ``longest`` words.

    A phrase that occurs a times is cut after every word; l and r are the counts of the parts, and the cut with the least
    floor(scale * a / (l + r)), the first among equals, gives the score. Phrases inside a longer one that has at least ``cover`` per
    cent of their count are left out.
    """
    counts, totals = frequent_phrases(docs, longest, least, text_col, lang_col, **counting)
    words = F.split("phrase", " ", -1)
    some = counts.withColumn("words", words).withColumn("m", F.size("words")).filter("m > 1")
    part = lambda first, size: F.concat_ws(" ", F.slice("words", first, size))
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("lp"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rp"))
    left = counts.select("lang", F.col("phrase").alias("lp"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rp"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "lp"]).join(right, ["lang", "rp"])
    score = F.expr(f"(cast(a AS decimal(20,0)) * {scale}) div (cast(l AS decimal(20,0)) + r)").cast("long")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), worst)
    # the parts of two words or more that a longer phrase covers
    longer = some.filter("m > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1)))
    longer = longer.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    inner = longer.select("lang", part(F.col("first"), F.col("size")).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    covered = _exact(F.col("most")) * 100 >= _exact(F.col("a")) * cover
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    flat = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language's best are among the best of its shares: no task sees a whole language
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    flat = flat.withColumn("share", share).withColumn("own", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    best = flat.filter(F.col("own") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    best = best.filter(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
