"""Every operator on awkward rows and on empty tables, against plain Python."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from litsieve.llm import (
    decontaminate, exact_dedup, html_templates, jaccard_join, line_dedup, mixing, quality_rules, secret_ledger, token_files, url_rules,
)
from litsieve.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns named like the operators' own.
DOCS = "doc_id long, text string, source string, id long, h1 long, key string, size int, part int, copies int, n int, label string, gone long"
RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choices("abcdefgh", k=4)) for _ in range(60)]


def sentence(n):
    return " ".join(RANDOM.choices(WORDS, k=n))


LONG = "\n".join(sentence(12) for _ in range(1500))
BASE = sentence(80)
LEAK = "Alpha beta-gamma delta, epsilon zeta eta theta iota kappa lambda mu nu."
TEXTS = [
    None, "", " \t\n ", "one", "ONE  two", "a b c d", BASE, BASE, BASE.upper(), BASE.replace(" ", "\n"), BASE + " extra words",
    "x " + BASE, LONG, LONG + " end", sentence(30) + " " + LEAK + " " + sentence(5), LEAK, "alpha beta", "shared footer line of text\nown " + sentence(4),
    "Shared Footer line of text \nother\n\n" + sentence(9), "shared footer line of text", "é́ ñandú Été d'été 12 can't 日本語 \U0001f600 ǅ İß",
    "password = hunter2hunter2 AKIA" + "A1B2" * 5 + " " + "0a" * 15, "secret= token: abcdef", "\x00nul \x1f\x85 line sep", LEAK.lower(),
]
SOURCES = ["b", "a", None, "hot", "hot", "hot", "", "a"]


@pytest.fixture(scope="module")
def rows():
    found = [(i, text, SOURCES[i % len(SOURCES)]) for i, text in enumerate(TEXTS)]
    return [*found, (3, "one", "hot"), (40, BASE, "hot"), (41, BASE, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, -1, 2, "k", 3, 4, 5, 6, "l", 7) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("block_windows", [200_000, 2])
def test_decontaminate(spark, docs, rows, nothing, block_windows):
    items = [(1, LEAK), (2, "alpha beta"), (3, None), (4, ""), (10, "alpha beta")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, items string")
    found = decontaminate.decontaminate(docs, benchmark, n=10, rewrite=True, block_windows=block_windows).collect()
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(len(w) - min(10, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    expected = []
    for doc, text, _ in rows:
        w, hit, names = plain_words(text), set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[i : i + size]) in windows and i + size <= len(w):
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(w[i : i + size])]
        expected.append((doc, len(w), len(hit), tuple(sorted(names))))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == Counter(expected)
    texts = {r.doc_id: r.text for r in found}
    assert texts[15] == "." and texts[6] == BASE and texts[0] is None
    assert "epsilon" not in texts[14] and len(plain_words(texts[14])) == 35
    assert decontaminate.decontaminate(nothing, benchmark).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(docs, benchmark.limit(0)).collect())


def test_lines(spark, docs, rows, nothing):
    found = line_dedup.dedup_lines(docs, batches=5, fanout=2).collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    first = {}
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(doc, first.get(key(line), doc))
    expected = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == doc]
        expected.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert Counter(tuple(r) for r in found) == Counter(expected)
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_line_index_keeps_few_runs(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    for day in range(5):
        batch = spark.createDataFrame([(day, f"the same long line\nline of day {day}")], "doc_id long, text string")
        assert index.process(batch).first().n_dropped == (day > 0)
    assert [len(level) for level in index.levels] == [1, 0, 1]
    late = spark.createDataFrame([(None, "the same long line")], "doc_id long, text string")
    assert index.process(late).first().n_dropped == 1


def test_exact(spark, docs, rows, nothing):
    found = exact_dedup.exact_dedup(docs).collect()
    own = lambda text: re.sub(r"[\x20\x09-\x0D]", "", text or "")
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(own(text), []).append((-len(text or ""), doc))
    expected = []
    for doc, text, _ in rows:
        group = groups[own(text)]
        expected.append((doc, min(group)[1], len(group), (-len(text or ""), doc) == min(group), hashlib.sha256(own(text).encode()).hexdigest()))
    assert Counter(tuple(r) for r in found) == Counter(expected)
    assert exact_dedup.exact_dedup(nothing).collect() == []


def test_fingerprints_combine_and_collisions_are_told_apart(spark, monkeypatch):
    data = np.frombuffer(bytes(RANDOM.choices(range(256), k=30_000)), np.uint8)
    whole = [int(x[0]) for x in exact_dedup.text_prints(data, np.array([0, len(data)]))]
    parts = [[int(y) for y in x] for x in exact_dedup.text_prints(data, np.array([0, 7, 9000, len(data)]))]
    for base, one, (a, b, c) in zip(exact_dedup.BASES, whole, parts, strict=True):
        ab = exact_dedup.combine(a, 7, b, base)
        assert one == exact_dedup.combine(ab, 9000, c, base)
    frame = spark.createDataFrame([(1, "abcd"), (2, "a bcd"), (3, "dcba"), (4, "xyz")], "doc_id long, text string")
    prints = exact_dedup.fingerprints
    blind = lambda *a: prints(*a).selectExpr("id", "0L AS f1", "0L AS f2", "size", "n_chars", "text_sha256")
    run = exact_dedup._run
    monkeypatch.setattr(exact_dedup, "fingerprints", blind)
    monkeypatch.setattr(exact_dedup, "_run", lambda f, t, h: run(f, t, h).selectExpr("0L AS f1", "0L AS f2", "size", "bytes") if t else run(f, t, h))
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame).orderBy("doc_id").collect()] == [
        (1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1)
    ]


def test_token_files(spark, docs, rows, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    root, files = token_files.write_tokens(docs, path, length=64)
    found = [tuple(r) for r in token_files.read_documents(spark, root, files).orderBy("start").collect()]
    whole, expected, at = Tokenizer.from_file(path), [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == expected
    first = files.orderBy("part").first()
    ids, mask = token_files.sequence(root, first.file, 1)
    assert len(ids) == len(mask) == 64 and ids.type == pa.uint16()
    masks = [token_files.sequence(root, r.file, k)[1] for r in files.collect() for k in range(r.sequences)]
    assert sum(sum(m.to_pylist()) for m in masks) == at
    assert token_files.read_documents(spark, *token_files.write_tokens(nothing, path)).collect() == []


def test_mix(spark, docs, rows, nothing):
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, _ in rows)
    assert all(r.copies in (0, 1, 2) for r in found)
    sizes, target = Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert Counter(found) == Counter(mixing.mix(docs.repartition(2)).collect())
    assert mixing.mix(nothing).collect() == []


def test_mix_comes_near_its_targets(spark):
    rows = [(i, sentence(1 + i % 97), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)


def brute_components(texts, n, num, den):
    sets, parent = {}, {}
    for doc, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.setdefault(doc, []).append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return Counter((doc, len(s), root(doc)) for doc in sets for s in sets[doc])


def test_jaccard(spark, docs, rows, nothing):
    found = jaccard_join.jaccard_components(docs, 4, 85, 100).collect()
    assert Counter(tuple(r) for r in found) == brute_components([r[:2] for r in rows], 4, 85, 100)
    assert jaccard_join.jaccard_components(nothing).collect() == []
    lost = spark.createDataFrame([(None, BASE), (None, BASE), (2, BASE)], "doc_id long, text string")
    assert Counter(tuple(r)[::2] for r in jaccard_join.jaccard_components(lost).collect()) == Counter({(None, None): 2, (2, 2): 1})


@pytest.mark.parametrize("block", [4096, 7])
def test_jaccard_chains_and_shared_passages(spark, monkeypatch, block):
    """Near copies that only a chain connects, and a passage in texts that are otherwise different."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base, passage, texts = [f"w{i}" for i in range(120)], sentence(60), []
    for i in range(60):
        texts.append((i, " ".join([*base[i:], *(f"v{k}" for k in range(i))])))
    for i in range(60, 140):
        own = base.copy()
        for k in RANDOM.sample(range(120), 2):
            own[k] = f"x{i}-{k}"
        texts.append((i, " ".join(own)))
    texts += [(i, " ".join([passage, *(f"y{i}-{k}" for k in range(RANDOM.randint(1, 30)))])) for i in range(140, 240)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 85, 100).collect()
    assert Counter(tuple(r) for r in found) == brute_components(texts, 4, 85, 100)


def test_tree_finds_all_pairs_in_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(rng.choice([1, 2, 9], (300, 1)), (300, jaccard_join.GROUPS))
    points[150:] = points[:150] + (rng.random((150, jaccard_join.GROUPS)) < 0.1)
    sizes = points.sum(axis=1)
    a, b = jaccard_join.CountTree(points[:200], sizes[:200]), jaccard_join.CountTree(points[200:], sizes[200:])
    found = {(i, j) for x, y in jaccard_join.joined(a, b, 85, 100) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    every = itertools.product(range(200), range(100))
    assert found == {
        (i, j) for i, j in every if jaccard_join.reaches(points[[i]], points[[200 + j]], sizes[[i]], sizes[[200 + j]], 85, 100)[0]
    }


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (91, 100), (90, 91), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 91: 90, 100: 90}


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>'
    '<div class="ad">buy</div><div class="cookie-notice">cookies</div><%s><h1>Head &amp; tail</h1><p>First  para<br>more<p>Second &lt;b&gt;<form>f<input></form>'
    '<div class="comments">nice</div></%s><aside>side</aside><footer>&copy; me</footer></body></html>'
)


def test_pages(spark):
    rows = [(i, f"https://a.example/{i}", PAGE % ("article", "article")) for i in range(3)]
    rows += [(i, f"https://b.example/{i}", PAGE % ('div class="post"', "div")) for i in range(3, 6)]
    rows += [(6, None, None), (7, "x", ""), (8, "http://c.example/", "<p>only <!-- open"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, slots int")
    found = Counter((r.page_id, r.text) for r in html_templates.extract_text(frame).collect())
    text = "Head & tail\n\nFirst para more\n\nSecond <b>"
    assert found == Counter([(i, text) for i in (0, 0, 1, 2, 3, 4, 5)] + [(6, ""), (7, ""), (8, "only")])
    assert html.unescape("&amp") == "&"
    assert html_templates.extract_text(frame.limit(0)).collect() == []


SPREAD = (
    '<html><body><nav>menu</nav><div class="post"><p>Para %d<p>More %d<ul><li>a long item of the list %d<li>and one more %d</ul>'
    '<table><tr><td>cell %d</table><section><h2>Part %d</h2></section></div><div class="body">Body %d</div></body></html>'
)


def test_pages_spread_over_containers(spark):
    rows = [(i, f"https://s.example/{i}", SPREAD.replace("%d", str(i))) for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    parts = ["Para", "More", "a long item of the list", "and one more", "cell", "Part", "Body"]
    found = {r.page_id: r.text for r in html_templates.extract_text(frame).collect()}
    assert found == {i: "\n\n".join(f"{p} {i}" for p in parts) for i in range(4)}


BOILERPLATE = (
    '<html><body><div class="topbar">call us any time of the day, we are glad to hear from you</div><div class="intro">Intro %d</div><main><article><h1>Head %d</h1>'
    '<p>Para %d<p>Shared by hand<div class="row">Row %d<p>Read on</div><div class="row">Row two %d<p>Read on</div></article><article class="comment-body">'
    'reader %d</article></main><div class="werbung">kauft</div></body></html>'
)


def test_pages_with_repeated_text(spark):
    rows = [(i, f"https://t.example/{i}", BOILERPLATE.replace("%d", str(i))) for i in range(5)]
    rows += [(9, "https://alone.example/9", BOILERPLATE.replace("%d", "9")), (10, "https://t.example/10", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_templates.extract_text(frame).collect()}
    assert {i: found[i] for i in range(5)} == {i: f"Intro {i}\n\nHead {i}\n\nPara {i}\n\nRow {i}\n\nRow two {i}" for i in range(5)}
    assert found[9] == "Head 9\n\nPara 9\n\nShared by hand\n\nRow 9\n\nRead on\n\nRow two 9\n\nRead on" and found[10] == ""


def test_urls(spark):
    urls = ["http://Example.com/en/1", "http://www.example.com/en/1?q=1", "https://x.net/es/2#a", None, "no url", "http://notexample.com", "http://com/"]
    urls += ["http://a.spam.org/pills/1"] * 30 + ["http://a.good.org/news/1"] * 30 + ["http://b.spam.org/news/7"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    labelled = pages.selectExpr("url", "url LIKE '%pills%' AS bad").filter("url LIKE '%.org%'")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    found = {r.page_id: tuple(r)[2:] for r in url_rules.filter_urls(pages, labelled, rules, min_support=0.1).collect()}
    assert len(found) == len(urls)
    assert found[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert found[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert found[2] == ("x.net", "/es/2", "net/es/", "block")
    assert found[3] == found[4] == ("", "", None, "allow")
    assert found[5] == ("notexample.com", "", None, "allow") and found[6][2] == "com/"
    assert found[7] == ("a.spam.org", "/pills/1", None, "block") and found[40][3] == "allow"
    assert found[67][3] == "block"  # the host alone is a rule: 30 of its 31 labelled urls are bad
    none = url_rules.filter_urls(pages, labelled.limit(0), rules)
    assert {r.verdict for r in none.filter("rule IS NULL").collect()} == {"allow"}
    assert url_rules.filter_urls(pages.limit(0), labelled, rules).collect() == []


def brute_rules(urls, least, confidence):
    """Token sets of any size that are sure enough."""
    sets = {frozenset(c) for tokens, bad in urls if bad for k in range(1, len(tokens) + 1) for c in itertools.combinations(sorted(tokens), k)}
    held = {s: [bad for tokens, bad in urls if s <= tokens] for s in sets}
    return {s for s, bads in held.items() if sum(bads) >= least and sum(bads) >= confidence * len(bads)}


def test_url_rules_of_any_size(spark):
    names = ["a", "b", "c", "d", "e"]
    urls = [("https://h.example/" + "".join(f"{x}/" for x in names) + "1", True)] * 10
    for gone in names:
        urls += [("https://h.example/" + "".join(f"{x}/" for x in names if x != gone) + "1", False)] * 10
    urls += [(f"https://h.example/en/{i}-free-bets.html", True) for i in range(10)] + [(f"https://h.example/en/{i}-fresh-news.html", False) for i in range(10)]
    slug = "-".join(f"word{chr(97 + i)}" for i in range(24))  # 2 ** 24 sets if its words were mined one by one
    urls += [(f"https://h.example/en/{slug}", True)] * 10
    labelled = spark.createDataFrame(urls, "url string, bad boolean")
    probes = [urls[0][0], "https://x.example/a/b/c/d/e/7", urls[10][0], "https://x.example/a/b/c/d/7", "http://y.example/free", "http://y.example/fresh.html", "http://y.example/wordq"]
    pages = spark.createDataFrame(list(enumerate(probes)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labelled).collect()}
    assert found == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "block"}


def test_few_bad_urls_make_no_rule(spark):
    urls = [(f"https://one.example/x/{i}", True) for i in range(4)] + [(f"https://two.example/y/{i}", True) for i in range(5)]
    urls += [(f"https://good.example/z/{i}", False) for i in range(30)]
    labelled = spark.createDataFrame(urls, "url string, bad boolean")
    pages = labelled.selectExpr("monotonically_increasing_id() AS page_id", "url")
    blocked = {r.url for r in url_rules.filter_urls(pages, labelled).filter("verdict = 'block'").collect()}
    assert blocked == {u for u, _ in urls if "two" in u}
    lower = url_rules.filter_urls(pages, labelled, min_bad_urls=1).filter("verdict = 'block'").collect()
    assert {r.url for r in lower} == {u for u, bad in urls if bad}


def test_url_rules_against_plain_python(spark):
    urls = []
    for _ in range(150):
        tokens = {f"dir:{x}" for x in "pqrstu" if RANDOM.random() < 0.6} | {f"host:{RANDOM.choice('xyz')}"}
        tokens |= {"end:x", "key:x"} if RANDOM.random() < 0.3 else set()
        urls.append((frozenset(tokens), RANDOM.random() < (0.9 if {"dir:p", "dir:q", "dir:r", "host:x"} <= tokens else 0.4)))
    labelled = spark.createDataFrame([(sorted(t), b) for t, b in urls], "tokens array<string>, bad boolean")
    found = [frozenset(r["items"]) for r in url_rules.mine_rules(labelled, 0.05, 0.8).collect()]
    every = brute_rules(urls, 8, 0.8)
    assert len(set(found)) == len(found) and set(found) <= every
    probes = {t for t, _ in urls} | every
    assert {p for p in probes if any(r <= p for r in found)} == {p for p in probes if any(r <= p for r in every)}


def test_quality(spark, docs, nothing):
    good = [(i, sentence(30) + ".", 1) for i in range(0, 300)]
    bad = [(i, " | ".join(RANDOM.choices(WORDS, k=30)), 0) for i in range(300, 400)]
    frame = spark.createDataFrame([*good, *bad, (999, None, None)], "doc_id long, text string, label int")
    labels = frame.filter("doc_id % 2 = 0 OR doc_id = 999").selectExpr("doc_id", "label AS quality", "0 AS score")
    found = {r.doc_id: r for r in quality_rules.score_documents(frame, labels).collect()}
    assert len(found) == 401 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(found[d].predicted == label for d, _, label in [*good, *bad])
    assert {r.predicted for r in quality_rules.score_documents(docs, labels.filter("quality = 1")).collect()} == {1}
    assert {r.predicted for r in quality_rules.score_documents(docs, labels.limit(0)).collect()} == {1}
    assert quality_rules.score_documents(nothing, labels).collect() == []


def plain_spans(text):
    rules = [
        ("assign", r"(?:(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?i:passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ]
    found = [(m.start(), i, kind, m.end()) for i, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_secrets(spark, docs, rows, nothing, tmp_path):
    base = [r.name for r in secret_ledger.BASE]
    found = secret_ledger.find_secrets(docs).collect()
    expected = Counter((d, tuple(plain_spans(t or ""))) for d, t, _ in rows)
    assert Counter((r.doc_id, tuple((f.kind, f.start, f.end) for f in r.found if f.kind in base)) for r in found) == expected
    path = str(tmp_path / "ledger")
    assert secret_ledger.find_secrets(nothing, path=path).collect() == []
    secret_ledger.find_secrets(docs, path=path).count()
    ledger = secret_ledger.Ledger(spark, path)
    blobs = ledger.seen().count()
    assert blobs == len({t or "" for _, t, _ in rows})
    secret_ledger.find_secrets(docs, path=path).count()
    assert ledger.seen().count() == blobs  # nothing is scanned twice
    raised = secret_ledger.Rule("hex", 2, "[0-9a-f]{30,}")
    again = secret_ledger.find_secrets(docs, rules=(secret_ledger.BASE[0], raised), path=path).collect()
    assert ledger.seen().count() == 2 * blobs and {len(r.rules) for r in ledger.seen().collect()} == {1, len(secret_ledger.RULES)}
    assert {f.kind for r in again for f in r.found} == {"assign", "hex"}
