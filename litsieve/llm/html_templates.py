"""Main text of web pages by deducing each host's template from equivalence classes.

A page's tokens are its container tags, each with its place (the path of open containers, with
classes and ids), and its blocks of text with theirs. Over the pages of a host a token has an occurrence
vector: how often it is on each page. Tokens with equal vectors form an equivalence class. Classes of
containers, the page itself among them, that are on at least half of the host's pages are valid; a block of
text that is as often as one of its own containers there, or a fixed number of times as often, belongs to such a class
and so to the template: it is the same wherever the container stands. Vectors are compared by two sums of
page hashes times counts, which tasks add up before the shuffle, so a host with any number of
pages costs a few rows per task and repeated token.

Near copies share article text, which is no template: a container (below the body) in which every other page or more has rare blocks of its own
keeps its shared blocks too if those are the greater part. A few blocks that all pages repeat within such a container
go, closing sentences too; text that stands in the body itself has no slot around it.

Template text goes, and so do slots of menus, headers, footers, sidebars, notices, adverts, forms, and
comments, whose text may differ by page; they are told by tags and English names. Inside an article, and on article elements, a name is told
only by a class or id all of whose words are such names or words of layout: "comment-list" is one, "related-work" is not. All other slots stay. A page with
nothing left, as where all pages of a host are copies, or whose host has no second page or no valid class, is
judged by names alone: its article or main elements stay, or else all that is not noise.

Null or empty html has an empty text, an empty table none. Very long pages are read whole, one at a time. Null urls belong to the host ''. Rows with equal ids are
rows of their own. Extra columns are ignored. Unclosed tags, comments and scripts end with the page.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.llm import arrays
from litsieve.session import materialize, ship_package, small_side

_SCAN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose nesting is followed; paragraphs, items and inline marks are often left open.
CONTAINERS = frozenset("html head body header nav main article section aside footer div form fieldset menu dialog ul ol table figure".split())
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd blockquote pre hr tr td th caption figcaption address details summary".split())
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
_NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices newsletter subscribe "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus social share sharing "
    "related popup modal widget login signup search contentinfo complementary".split()
)
_LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons card cards container content count entry feed footer form group header icons "
    "inner inline item items left link links list panel post posts right row section slot stories story text thread title top unit user users "
    "widgets wrap wrapper".split()
)
_WORDS = re.compile(r"[a-z]+")
_MAIN = ("article", "main")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def segment(tag: str, attributes: str) -> str:
    """A container's name in paths: the tag, its classes, id and role."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    names = sorted(found.get("class", "").split()) + [x for k in ("id", "role") if (x := found.get(k, ""))]
    return ".".join([tag, *names]).replace("/", "-")


def is_noise(part: str, in_main: bool) -> bool:
    tag, _, names = part.partition(".")
    if tag in _NOISE_TAGS or tag == "header" and not in_main:
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    if tag == "article" or in_main:  # "comment" or "comment-body", but neither "has-comments" nor "comments-on-the-law"
        own = [set(_WORDS.findall(name)) for name in names.lower().split(".")]
        return any(words & _NOISE_WORDS and words <= _NOISE_WORDS | _LAYOUT_WORDS for words in own)
    words = set(_WORDS.findall(names.lower()))
    return bool(words & _NOISE_WORDS) or "header" in words


def is_main(part: str) -> bool:
    tag, _, names = part.partition(".")
    return tag in _MAIN or "main" in names.lower().split(".")


def clean_path(path: tuple[str, ...]) -> bool:
    """Whether no container of the path is noise."""
    in_main = False
    for part in path:
        if is_noise(part, in_main):
            return False
        in_main = in_main or is_main(part)
    return True


def blocks(page: str) -> list[tuple[tuple[str, ...], str | None]]:
    """(path of containers, text) of the blocks of a page in order; a text of None opens a container."""
    out, stack, text = [], [], []

    def flush():
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((tuple(stack), joined))
        text.clear()

    at = 0
    for m in _SCAN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag not in CONTAINERS or attributes.endswith("/") and tag != "html":
            continue
        if not closing:
            stack.append(segment(tag, attributes))
            out.append((tuple(stack), None))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition(".")[0] == tag:
                    del stack[k:]
                    break
    text.append(page[at:])
    flush()
    return out


def main_slots(tokens: Iterable[str]) -> list[str]:
    """Of container paths, the outermost articles; none without an article: then every slot that is not noise stays."""
    main = [t for t in tokens if is_main(t.rpartition("/")[2]) and clean_path(tuple(t.split("/")))]
    return sorted(t for t in main if not any(t.startswith(o + "/") for o in main))


def block_hash(path: tuple[str, ...], text: str) -> int:
    """64 bits that stand for a block of text at its place."""
    return int.from_bytes(hashlib.blake2b(f"{'/'.join(path)}\n{text}".encode(errors="replace"), digest_size=8).digest(), signed=True)


def page_text(page: str, template: Collection[int] | None) -> str:
    """The text outside of the template, given as hashes of its blocks; None where a host has no template."""
    found = [(path, text) for path, text in blocks(page) if text is None or clean_path(path)]
    clean, texts = [block for block in found if block[1] is not None], []
    if template is not None:
        texts = [text for path, text in clean if block_hash(path, text) not in template]
    if not texts:
        slots = main_slots({"/".join(path) for path, _ in found if path})
        texts = [text for path, text in clean if any("/".join(path[: s.count("/") + 1]) == s for s in slots)]
    return "\n\n".join(texts or [text for _, text in clean])


_TOKENS = "host string, path string, block long, pages long, total long, s1 long, s2 long, texts long"
#: Column types of the first pass; a block of null is the container itself, and its path of '' the page. ``texts`` counts the blocks
#: that stand in the container itself; a block has none.
_TOKEN_SCHEMA = pa.schema([("host", pa.string()), ("path", pa.string()), *((n, pa.int64()) for n in ("block", "pages", "total", "s1", "s2", "texts"))])


def _count(batches):
    """Sums over the pages of a slice, by host and token."""
    for batch in arrays.slices(batches, "html", 8 << 20):
        sums: dict[tuple[str, str, int | None], list[int]] = {}
        for host, key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, texts = Counter([("", None)]), Counter()
            for path, text in blocks(page or ""):
                if text is None:
                    counts["/".join(path), None] += 1
                elif clean_path(path):
                    counts["/".join(path), block_hash(path, text)] += 1
                    texts["/".join(path), None] += 1
            h1, h2 = zlib.crc32(key.encode()) & 0x3FFFFFFF, zlib.crc32(b"2" + key.encode()) & 0x3FFFFFFF
            for token, n in counts.items():
                s = sums.setdefault((host, *token), [0] * 5)
                for i, v in enumerate((1, n, n * h1, n * h2, texts[token])):
                    s[i] += v
        if sums:
            yield arrays.batch_of(
                _TOKEN_SCHEMA, host=[h for h, _, _ in sums], path=[p for _, p, _ in sums], block=[b for _, _, b in sums],
                **{f: [v[i] for v in sums.values()] for i, f in enumerate(_TOKEN_SCHEMA.names[3:])},
            )


_TEMPLATE_SCHEMA = pa.schema([("template_host", pa.string()), ("template", pa.list_(pa.int64()))])


def template_blocks(tokens: list[dict]) -> list[int] | None:
    """Blocks of the template among the common tokens of a host; None without a valid class."""
    vector = lambda t, times=1: (t["pages"], *(times * t[n] for n in ("total", "s1", "s2")))
    containers = {t["path"]: t for t in tokens if t["block"] is None}
    found = []
    for t in tokens:
        if t["block"] is None:
            continue
        parts = t["path"].split("/") if t["path"] else []
        around = [containers[p] for k in range(len(parts) + 1) if (p := "/".join(parts[:k])) in containers]
        if any(t["total"] % c["total"] == 0 and vector(t) == vector(c, t["total"] // c["total"]) for c in around):
            found.append(t)
    shared, common = Counter(), Counter()
    for t in found:
        shared[t["path"]] += t["total"]
    for t in tokens:
        common[t["path"]] += 0 if t["block"] is None else t["total"]
    host_pages = containers[""]["pages"]
    slots = {
        path for path, c in containers.items()
        if path and path.rpartition("/")[2].partition(".")[0] not in ("html", "body") and shared[path] > c["texts"] - common[path] >= host_pages / 2
    }
    found = [t["block"] for t in found if t["path"] not in slots]
    classes = Counter(vector(c) for path, c in containers.items() if path)
    return found if found or any(n > 1 for n in classes.values()) else None


def _choose(batches):
    for batch in batches:
        found = [(host, template_blocks(tokens)) for host, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found = [(host, template) for host, template in found if template is not None]
        yield arrays.batch_of(_TEMPLATE_SCHEMA, template_host=[h for h, _ in found], template=[t for _, t in found])


def templates(pages: DataFrame) -> DataFrame:
    """(template_host, template) from (host, page, html): blocks of the hosts' templates."""
    vectors = pages.mapInArrow(_count, _TOKENS).groupBy("host", "path", "block").agg(*(F.sum(c).alias(c) for c in _TOKEN_SCHEMA.names[3:]))
    vectors = materialize(vectors.filter("block IS NULL OR pages > 1"), "vectors")  # a block of one page is no template
    sizes = materialize(vectors.filter("path = '' AND block IS NULL AND pages > 1").select(F.col("host").alias("of"), F.col("pages").alias("host_pages")), "hosts")
    # on half of the pages or more: a host keeps at most twice the mean number of tokens of a page
    common = vectors.join(small_side(sizes), F.col("host") == F.col("of")).filter("2 * pages >= host_pages")
    nested = common.groupBy("host").agg(F.collect_list(F.struct("path", "block", "pages", "total", "s1", "s2", "texts")).alias("tokens"))
    return nested.mapInArrow(_choose, "template_host string, template array<long>")


def _extract(schema: pa.Schema):
    def run(batches):
        for batch in arrays.slices(batches, "html", 8 << 20):
            known = [None if t is None else frozenset(t) for t in batch.column(3).to_pylist()]
            texts = [page_text(page or "", template) for page, template in zip(batch.column(2).to_pylist(), known, strict=True)]
            yield arrays.batch_of(schema, id=batch.column(0), url=batch.column(1), text=texts)

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    page = F.coalesce(F.concat_ws(" ", F.col("id").cast("string"), "url"), F.lit(""))
    known = materialize(templates(rows.select(url_host(F.col("url")).alias("host"), page.alias("page"), "html")), "templates")
    joined = rows.join(small_side(known, text_width=128), url_host(F.col("url")) == F.col("template_host"), "left").select("id", "url", "html", "template")
    schema = to_arrow_schema(rows.select("id", "url", F.col("html").alias("text")).schema)
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string"
    found = joined.mapInArrow(_extract(schema), ddl)
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
