"""Phrases, language identification and the manifest on awkward rows and empty tables, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from litsieve.llm import language, merkle, phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns named like the operators' own.
EXTRA = "id long, grp string, digest string, pos long, n int, block int, chain string, phrase string, f int, k int, rank int, score int, bits int"
OWN = (-1, "g", "d", 2, 3, 4, "c", "p", 5, 6, 7, 8, 9)
DOCS = f"doc_id long, source string, lang string, n_chars long, text string, {EXTRA}"
RANDOM = random.Random(7)
WORDS = [["".join(RANDOM.choices(letters, k=RANDOM.randint(2, 5))) for _ in range(40)] for letters in ("abcde", "fghij", "klmnöü")]


def sentence(kind, n):
    return " ".join(RANDOM.choices(WORDS[kind], k=n))


SPECIAL = [
    None, "", " \t\n ", "12 34, ...", "a", "A\tb a b. a b;a b\x0ba b", "don't stop Don't  Stop", "Été \x00 nul\x85x", "日本 語 日本 語",
    "the end" * 3, ", ".join(["new york city"] * 50), "\n".join(sentence(0, 9) for _ in range(900)), "x y " * 700,
]
LANGS = ["aa", "ff", "kk"]


def row(i, source, lang, text):
    return (i, source, lang, None if text is None else len(text), text, *OWN)


@pytest.fixture(scope="module")
def rows():
    found = [row(i, ["s1", None, "", "é"][i % 4], LANGS[i % 3], sentence(i % 3, 30) + ". " + sentence(i % 3, 20)) for i in range(60)]
    found += [row(100 + i, "hot", [None, "aa", "ff"][i % 3], text) for i, text in enumerate(SPECIAL)]
    found += [row(None, "hot", "aa", "No Id"), row(None, None, None, None), row(7, "s1", "ff", "Same Id"), row(7, "s1", "ff", "Same Id")]
    return found + [row(200 + i, "hot", "kk", "Copy " + sentence(2, 3)) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def plain_collocations(rows, longest, least, scale, cover, top):
    counts, totals = Counter(), Counter()
    for _, _, lang, _, text, *_ in rows:
        lang = lang or "und"
        totals[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    some = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    out = []
    for (lang, *w), a in some.items():
        score, _, left, right = min(
            (scale * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w))
        )
        longer = [
            f for (other, *v), f in some.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))
        ]
        if not any(100 * f >= cover * a for f in longer):
            out.append((lang, score, a, " ".join(w), left, right))
    found = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))
        found += [(lang, i + 1, r[3], r[2], r[4], r[5], totals[lang], r[1]) for i, r in enumerate(best[:top])]
    return sorted(found)


@pytest.mark.parametrize(("least", "top", "counting"), [(4, 2000, {}), (2, 7, {"burst": 3, "limit": 40, "filter_bits": 1 << 10, "part_bytes": 64}), (30, 2000, {})])
def test_collocations(docs, rows, least, top, counting):
    found = phrases.collocations(docs, least=least, top=top, **counting)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 4, least, 2_000_000, 80, top)


def test_collocations_of_nothing(nothing):
    assert phrases.collocations(nothing).count() == 0


def test_hashes_in_two_steps(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "_RADIX", 3)
    found = phrases.collocations(docs, least=4, part_bytes=256)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 4, 4, 2_000_000, 80, 2000)


def test_slices_end_with_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 64)
    text = "a b c. " * 200 + "d " * 300
    data = np.frombuffer(text.encode(), np.uint8)
    cuts = list(phrases.stretches(data, np.array([0, len(data)]), 64))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[-1][1] == len(data)
    assert all(text[b - 1] == "." for _, b in cuts[:-1])


def test_trie_bursts_and_spills():
    trie = phrases.HatTrie(2, burst=2, limit=6)
    path = {w: phrases.path_bytes(h[None]).tobytes() for w, h in zip("abcde", _ids("abcde"), strict=True)}
    for w in "bcde":
        trie.add("x", path["a"] + path[w], f"a {w}".encode(), 1)
    assert isinstance(trie.root["x", path["a"][0]], phrases.Node)
    trie.add("x", path["a"], b"a", 9)
    trie.add("x", path["a"] + path["c"], b"a c", 4)
    trie.add("x", path["b"] + path["c"], b"b c", 1)
    trie.add("y", path["b"] + path["c"], b"b c", 1)
    assert trie.full()
    # the largest subtree goes whole and sorted
    assert list(trie.spill(2)) == [("x", [(b"a", 9), (b"a b", 1), (b"a c", 5), (b"a d", 1), (b"a e", 1)])]
    assert trie.held == 2 and sorted(trie.spill(0)) == [("x", [(b"b c", 1)]), ("y", [(b"b c", 1)])]


def _ids(letters):
    data = np.frombuffer(letters.encode(), np.uint8)
    return phrases.arrays.word_hashes(data, np.arange(len(data)), np.arange(len(data)) + 1)


def plain_phrases(text, sample):
    """Greedy longest matches with any piece of the sample, by searching."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at : at + size + 1] in piece for piece in sample):
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_of_automata():
    texts = [sentence(k, n) for k in range(3) for n in (1, 5, 40)] + ["", "zz", "a" * 700]
    samples = [[sentence(k, 12).encode() for _ in range(6)] for k in range(3)]
    model = language.Model(LANGS, samples)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found = model.phrases(np.frombuffer(b"".join(raw), np.uint8), offsets)
    step = language.STRETCH
    for t, counts in zip(raw, found, strict=True):
        assert list(counts) == [sum(plain_phrases(t[i : i + step], s) for i in range(0, len(t), step)) for s in samples]


def test_automaton_holds_all_parts():
    pieces = [b"abcbc", b"bcbca", b"aab"]
    found = language.Automaton(pieces)
    moves = {(s, c): t for s, c, t in zip(found.state.tolist(), found.code.tolist(), found.target.tolist(), strict=True)}

    def accepts(part):
        state = 0
        for code in part:
            state = moves.get((state, code))
            if state is None:
                return False
        return True

    parts = {p[i:j] for p in pieces for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    assert all(map(accepts, parts))
    assert not any(accepts(p) for p in (b"ac", b"bb", b"cc", b"caa", b"abca"))


def test_identify(spark, docs, rows):
    labelled = docs.filter("doc_id % 2 = 0").select("lang", "text")
    found = language.identify(docs, labelled)
    assert found.columns == ["doc_id", "lang_pred", "score", "bits"]
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    for i, _, lang, _, text, *_ in rows:
        if i is None or i == 7:
            continue
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
        elif i < 100:
            assert got[i].lang_pred == lang
        assert 0 <= got[i].score <= 1 and math.isfinite(got[i].score)
    assert {r.lang_pred for r in got.values()} <= {*LANGS, "und"}


def test_identify_without_labels(docs, nothing, rows):
    none = language.identify(docs, nothing).collect()
    assert len(none) == len(rows) and {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(nothing, docs).count() == 0
    one = language.identify(docs, docs.filter("lang = 'aa'")).collect()
    assert {r.lang_pred for r in one} == {"aa", "und"}


def test_samples_are_bounded_and_reproducible(docs):
    few = language.samples(docs, sample_bytes=500)
    assert few == language.samples(docs.repartition(7), sample_bytes=500)
    assert all(0 < sum(map(len, pieces)) <= 500 and len(set(pieces)) == len(pieces) for pieces in few.values())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, fanout):
    groups = {}
    for i, source, lang, n, text, *_ in rows:
        groups.setdefault(source, []).append((i, source, lang, n, text))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in own]) for s, own in groups.items()}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for i, r in enumerate(groups[source]):
            sides = []
            for levels, at in ((trees[source], i), (upper, k)):
                for level in levels[:-1]:
                    head = at // fanout * fanout
                    sides.append((level[head:at], level[at + 1 : head + fanout]))
                    at //= fanout
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], r[4] and r[4].translate(LOW))) if changed else leaf(r)
            for left, right in sides:
                folded = digest(*left, folded, *right)
            root = upper[-1][0]
            proof = digest(*(d for left, right in sides for d in left + right))
            out.append((r[0], leaf(r), trees[source][-1][0], root, proof, folded, folded == root))
    return out


def by_value(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize(("fanout", "block_levels"), [(16, 3), (3, 2), (2, 1)])
def test_manifest(docs, rows, fanout, block_levels):
    found = merkle.manifest(docs, fanout=fanout, block_levels=block_levels)
    assert by_value(found.collect()) == by_value(plain_manifest(rows, fanout))


def test_manifest_of_few_rows(spark, nothing, rows):
    assert merkle.manifest(nothing).count() == 0
    one = spark.createDataFrame(rows[:1], DOCS)
    assert by_value(merkle.manifest(one).collect()) == by_value(plain_manifest(rows[:1], 16))
    found = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    lowered = [r for r in found if not r.verified]
    assert lowered and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in lowered)


def test_sweeps_of_a_block():
    digests = [digest(str(i)) for i in range(23)]
    top, received = merkle.upward(digests, merkle.height(23, 3, 9), 3)
    for number, chain in merkle.downward(received, merkle.height(23, 3, 9), 3, ()):
        assert merkle.fold(digests[number], chain) == top
        assert merkle.fold(digest("other"), chain) != top
