"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a sample of its labelled texts. A text is parsed greedily into phrases, the
longest matches with the sample: follow the automaton until a byte has no transition, then begin a new phrase at its root. c phrases
against a sample of n bytes cost c * log2(n) bits, which over the text's length is the cross entropy of Ziv and Merhav; the language
that needs fewest bits wins, the first by name among equals.

Texts are lower-cased (A-Z), and runs of ASCII characters other than letters become one space. Whole texts are parsed, in stretches of
``STRETCH`` bytes that are parsed side by side in every automaton at once; a phrase ends with its stretch. Transitions of a
state are a bitmap over the byte codes and a rank into one array of targets, so that a step is a few array operations for all
stretches.

The sample of a language consists of distinct pieces of ``PIECE_WORDS`` words from its labelled texts, about
``sample_bytes`` in all, chosen by the hash of the piece; languages together get ``total_bytes`` at most, which bounds the models (below
30 bytes a sample byte) that are broadcast. Copies collapse before a language's pieces meet in one task.

A text that is null or has no letter has language ``und`` and score 0; so have all texts if there is nothing to learn from. Empty texts
are such texts. Rows of equal text get equal results. A null language is not learned; rows without an id are ordinary. Very long texts
are many stretches. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import ship_package

UNKNOWN = "und"
SAMPLE_BYTES, TOTAL_BYTES = 1 << 17, 1 << 20
PIECE_WORDS = 24
STRETCH = 512
#: Text bytes that are parsed at once.
_SLICE = 1 << 20
_SPACE = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CODE = np.where(_LETTER, arrays.LOWER, _SPACE).astype(np.uint8)


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with one space for each run of other ASCII characters."""
    codes = _CODE[data]
    space = codes == _SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[heads] = ~space[heads]
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[offsets]


class Automaton:
    """Suffix automaton of byte strings, which it holds one after another with a mark between them that no text contains.

    ``words[state * width + w]`` tells which codes of the w-th 64 have a transition, ``first`` where these begin in ``targets``.
    """

    def __init__(self, pieces: list[bytes]) -> None:
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for piece in pieces:
            for code in (*piece, 0):
                moves.append({})
                link.append(0)
                length.append(length[last] + 1)
                now, p = len(moves) - 1, last
                while p >= 0 and code not in moves[p]:
                    moves[p][code] = now
                    p = link[p]
                if p >= 0:
                    q = moves[p][code]
                    if length[q] == length[p] + 1:
                        link[now] = q
                    else:
                        copy = len(moves)
                        moves.append(dict(moves[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        while p >= 0 and moves[p].get(code) == q:
                            moves[p][code] = copy
                            p = link[p]
                        link[q] = link[now] = copy
                last = now
        sizes = np.fromiter((len(m) for m in moves), np.int64, len(moves))
        state = np.repeat(np.arange(len(moves)), sizes)
        code = np.fromiter((c for m in moves for c in m), np.int64, len(state))
        target = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
        order = np.lexsort((code, state))
        self.state, self.code, self.target, self.states = state[order], code[order], target[order], len(moves)


class Model:
    """The automata of all languages in common arrays."""

    def __init__(self, languages: list[str], samples: list[list[bytes]]) -> None:
        self.languages = languages
        self.bits = np.log2(np.array([sum(map(len, s)) + 2 for s in samples], float))
        built = [Automaton(s) for s in samples]
        bases = np.cumsum([0, *(a.states for a in built)])
        state = np.concatenate([a.state + b for a, b in zip(built, bases, strict=False)])
        code = np.concatenate([a.code for a in built])
        target = np.concatenate([a.target + b for a, b in zip(built, bases, strict=False)])
        used = np.unique(code[code > 0])
        #: Compact numbers of the bytes that occur; others and the mark have none.
        self.codes = np.full(256, -1, np.int16)
        self.codes[used] = np.arange(len(used))
        code, inner = self.codes[code], code > 0
        state, code, target = state[inner], code[inner].astype(np.int64), target[inner]
        self.width = -(-len(used) // 64) or 1
        cell = state * self.width + (code >> 6)
        self.words = np.zeros(int(bases[-1]) * self.width, np.uint64)
        np.bitwise_or.at(self.words, cell, np.uint64(1) << (code & 63).astype(np.uint64))
        counts = np.bincount(cell, minlength=len(self.words))
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.targets = target.astype(np.int32)
        self.roots = bases[:-1].astype(np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, or -1."""
        cell = state.astype(np.int64) * self.width + (code >> 6)
        words = self.words[cell]
        bit = np.uint64(1) << (code & 63).astype(np.uint64)
        rank = np.bitwise_count(words & (bit - np.uint64(1)))
        there = ((words & bit) != 0) & (code >= 0)
        at = np.minimum(self.first[cell] + rank, len(self.targets) - 1)
        return np.where(there, self.targets[at], -1)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): the number of phrases of every text."""
        sizes = np.diff(offsets)
        parts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = offsets[owner] + number * STRETCH
        length = np.minimum(offsets[owner + 1] - start, STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        codes = self.codes[data].astype(np.int64)
        k = len(self.languages)
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        # the phrase under way is counted when it begins
        counts = np.zeros((k, len(owner)), np.int64)
        alive = np.searchsorted(-length, -np.arange(int(length.max()) if len(length) else 0), side="left")
        roots = np.broadcast_to(self.roots[:, None], state.shape)
        for at, rows in enumerate(alive):
            code = np.broadcast_to(codes[start[:rows] + at], (k, rows))
            now = state[:, :rows]
            onward = self.step(now, code)
            fresh = self.step(roots[:, :rows], code)
            ends = (onward < 0) | (now == roots[:, :rows])
            counts[:, :rows] += ends
            state[:, :rows] = np.where(onward >= 0, onward, np.where(fresh >= 0, fresh, roots[:, :rows]))
        total = np.zeros((k, len(sizes)), np.int64)
        for row in range(k):
            total[row] = np.bincount(owner, weights=counts[row], minlength=len(sizes))
        return total.T

    def bits_per_byte(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, offsets = plain(data, offsets)
        return self.phrases(data, offsets) * self.bits / np.maximum(np.diff(offsets), 1)[:, None]


def _pieces(rates: dict[str, float], schema: pa.Schema):
    """Pieces of whole words whose hash is below their language's rate."""

    def run(batches):
        for batch in arrays.slices(batches, "text"):
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = plain(*arrays.text_bytes(batch.column(1)))
            starts, ends, rows = arrays.words(data, offsets, _LETTER)
            if not len(starts):
                continue
            within = np.arange(len(rows)) - np.searchsorted(rows, rows)
            heads = np.flatnonzero(within % PIECE_WORDS == 0)
            tails = np.append(heads[1:], len(rows)) - 1
            begin, end, owner = starts[heads], ends[tails], rows[heads]
            hashes = arrays.word_hashes(data, begin, end)
            limit = np.array([rates[lang] for lang in langs[owner]])
            chosen = np.flatnonzero((hashes >> np.uint64(11)).astype(float) / (1 << 53) < limit)
            raw = data.tobytes()
            yield arrays.batch_of(
                schema, lang=list(langs[owner[chosen]]), hash=hashes[chosen].view(np.int64),
                piece=[raw[a:b] for a, b in zip(begin[chosen], end[chosen], strict=True)],
            )

    return run


def samples(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, list[bytes]]:
    """About ``sample_bytes`` of distinct pieces for every language of (lang, text)."""
    ship_package()
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    # one row for each language
    sizes = {r["lang"]: r["bytes"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not sizes:
        return {}
    budget = min(sample_bytes, total_bytes // len(sizes))
    # twice the budget, so that copies leave enough; the documents in question hold about 64 times as much
    share = {lang: min(1.0, 64 * budget / max(size, 1)) for lang, size in sizes.items()}
    rates = {lang: min(1.0, 2 * budget / max(size * share[lang], 1)) for lang, size in sizes.items()}
    spark = labelled.sparkSession
    shares = F.broadcast(spark.createDataFrame(list(share.items()), "lang string, share double"))
    uniform = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    some = known.join(shares, "lang").filter(uniform < F.col("share")).select("lang", "text")
    ddl = "lang string, hash long, piece binary"
    schema = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("piece", pa.binary())])
    pieces = some.mapInArrow(_pieces(rates, schema), ddl).distinct()

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hash", "piece"])
        return frame[frame["piece"].str.len().cumsum() <= budget]

    chosen = pieces.groupBy("lang").applyInPandas(cut, ddl).collect()
    found: dict[str, list[bytes]] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["hash"], bytes(r["piece"]))):
        found.setdefault(row["lang"], []).append(bytes(row["piece"]))
    return found


def _scorer(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]):
        model = None
        for batch in arrays.slices(batches, "text", _SLICE):
            model = model or shared.value
            bits = model.bits_per_byte(*arrays.text_bytes(batch.column(1)))
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(bits)), best]
            rest = np.where(np.arange(bits.shape[1]) == best[:, None], np.inf, bits).min(axis=1)
            score = np.where(np.isinf(rest), 1.0, rest / np.maximum(low + rest, 1e-300))
            langs = [model.languages[k] for k in best]
            yield arrays.batch_of(schema, id=batch.column(0), lang_pred=langs, score=score, bits=low, lettered=batch.column(2))

    return run


def identify(
    docs: DataFrame, labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, lang_pred, score, bits) of every row of ``docs``, learned from ``labelled`` (lang, text).

    The score compares the two best languages: 0.5 if they need equally many bits, nearer to 1 the fewer the best one needs; 1
    with one language alone. ``bits`` are the best language's bits for a byte.
    """
    ship_package()
    spark = docs.sparkSession
    found = samples(labelled, sample_bytes, total_bytes)
    lettered: Column = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lettered.alias("lettered"))
    if not found:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    shared = spark.sparkContext.broadcast(Model(list(found), list(found.values())))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType().add("id", kind).add("lang_pred", StringType()).add("score", DoubleType()).add("bits", DoubleType())
    schema = schema.add("lettered", BooleanType())
    scored = rows.mapInArrow(_scorer(shared, to_arrow_schema(schema)), schema)
    known = F.col("lettered")
    return scored.select(
        F.col("id").alias(id_col), F.when(known, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score"), F.when(known, F.col("bits")).otherwise(F.lit(0.0)).alias("bits"),
    )
