"""Template deduction where pages of a host share article text, and names inside articles."""

from collections import Counter, defaultdict

import pytest

from litsieve.llm import html_templates
from litsieve.llm.html_templates import blocks, clean_path, is_noise

PAGE = '<html><body><div class="top">Welcome to the site</div>%s<div class="imprint">All rights reserved</div></body></html>'


def texts(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_templates.extract_text(frame).collect()}


def plain_template(pages):
    """Blocks of one host's template, from whole occurrence vectors held in one place."""
    counts = [Counter() for _ in pages]
    direct = Counter()
    for k, page in enumerate(pages):
        counts[k]["", None] += 1
        for path, text in blocks(page):
            if text is None:
                counts[k]["/".join(path), None] += 1
            elif clean_path(path):
                counts[k]["/".join(path), text] += 1
                direct["/".join(path)] += 1
    vectors = defaultdict(lambda: [0] * len(pages))
    for k, c in enumerate(counts):
        for token, n in c.items():
            vectors[token][k] = n
    common = {t: v for t, v in vectors.items() if 2 * sum(x > 0 for x in v) >= len(pages) and (t[1] is None or sum(x > 0 for x in v) > 1)}
    found = set()
    for (path, text), v in common.items():
        if text is None:
            continue
        parts = path.split("/") if path else []
        for j in range(len(parts) + 1):
            c = common.get(("/".join(parts[:j]), None))
            if c and sum(v) % sum(c) == 0 and v == [x * (sum(v) // sum(c)) for x in c]:
                found.add((path, text))
    shared = lambda path: sum(sum(vectors[t]) for t in found if t[0] == path)
    own = lambda path: direct[path] - sum(sum(v) for t, v in common.items() if t[0] == path and t[1] is not None)
    inside = lambda path: path.rpartition("/")[2].split(".")[0] not in ("", "html", "body")
    slots = {p for p, text in common if text is None and inside(p) and shared(p) > own(p) >= len(pages) / 2}
    return {t for t in found if t[0] not in slots}


def test_near_copies_keep_their_article(spark):
    body = "".join(f"<p>Paragraph {k} of both</p>" for k in range(5))
    pages = [(k, "http://two.example/%d" % k, PAGE % f"<div class=story>{body}<p>Edited {k}</p></div>") for k in range(2)]
    whole = "\n\n".join(f"Paragraph {k} of both" for k in range(5))
    assert texts(spark, pages) == {k: f"{whole}\n\nEdited {k}" for k in range(2)}


def test_closing_sentence_of_some_pages_stays(spark):
    ends = ["", "<p>To be continued</p>", "<p>To be continued</p>"]
    pages = [(k, "http://end.example/%d" % k, PAGE % f"<div class=story><p>Story {k}</p>{end}</div>") for k, end in enumerate(ends)]
    assert texts(spark, pages) == {0: "Story 0", 1: "Story 1\n\nTo be continued", 2: "Story 2\n\nTo be continued"}


def test_template_goes_without_names_and_with_long_html(spark):
    long = " ".join(["word"] * 300_000)
    pages = [(k, "http://plain.example/%d" % k, PAGE % f"<div class=story><p>Story {k}</p></div>") for k in range(3)]
    pages.append((9, "http://plain.example/9", PAGE % f"<div class=story><p>{long}</p></div>"))
    found = texts(spark, pages)
    assert found == {0: "Story 0", 1: "Story 1", 2: "Story 2", 9: long}
    # a page alone on its host has no template
    assert texts(spark, pages[:1]) == {0: "Welcome to the site\n\nStory 0\n\nAll rights reserved"}


@pytest.mark.parametrize(
    ("part", "noise"),
    [
        ("div.related-work", False), ("section.comments-on-the-law", False), ("div.share-of-voice", False), ("p.lead", False),
        ("div.comment-list", True), ("section.comments", True), ("div.related-posts", True), ("div.share-buttons", True), ("div.ad-slot", True),
        ("div.comment.comment-17", True), ("div.newsletter-signup", True), ("aside", True), ("form", True),
    ],
)
def test_names_inside_an_article(part, noise):
    assert is_noise(part, in_main=True) is noise


def test_names_of_articles_and_outside():
    assert is_noise("article.comment", False) and is_noise("article.comment-body", True)
    assert not is_noise("article.has-comments", False) and not is_noise("article.related-work", False)
    assert is_noise("div.site-nav", False) and is_noise("div.related-work", False) and not is_noise("div.header-image", True)


def test_article_sections_stay_in_whole_pages(spark):
    inner = '<article><p>Text %d</p><div class="related-work"><p>Earlier %d</p></div><section id="comments-on-the-law"><p>Law %d</p></section>'
    inner += '<div class="comment-list"><p>reader %d</p></div></article>'
    pages = [(k, "http://law.example/%d" % k, PAGE % (inner % (k, k, k, k))) for k in range(3)]
    assert texts(spark, pages) == {k: f"Text {k}\n\nEarlier {k}\n\nLaw {k}" for k in range(3)}


def test_equals_plain_template(spark):
    def page(k):
        menu = "<div class=bar><p>One</p><p>Two</p></div>" if k % 4 else "<div class=bar><p>One</p></div>"
        cards = "".join(f"<div class=card><p>Read on</p><p>Card {k} {j}</p></div>" for j in range(k % 3))
        return PAGE % f"{menu}<div class=story><p>Same start</p><p>Story {k}</p>{cards}</div>"

    pages = [page(k) for k in range(9)]
    template = plain_template(pages)
    assert {t for _, t in template} == {"Welcome to the site", "All rights reserved", "One", "Same start", "Read on"}
    want = {k: "\n\n".join(t for p, t in blocks(html) if t is not None and clean_path(p) and ("/".join(p), t) not in template) for k, html in enumerate(pages)}
    assert texts(spark, [(k, "http://same.example/%d" % k, html) for k, html in enumerate(pages)]) == want
