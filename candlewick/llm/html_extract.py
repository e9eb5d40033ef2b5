"""Main text of web pages, with the host's template taken out.

A page is read into a flat list of events with well-nested elements, whatever
the markup. Elements that are never part of an article go by tag or role, and boxes
go by name, never headings, paragraphs or other text blocks; inside an article a
box goes by a name that says nothing else, as ids made from headings do not
(a form or a named box that wraps most of a page without any other article stays).
What is left of the page's article (its ``<article>`` elements, else ``<main>``,
else the body) may still hold parts of the site's template. So each element of
the whole page, text blocks included, is hashed with all below it, hashes are
counted per host over different pages in Spark, and a subtree that recurs on
``MIN_PAGES`` of them is deleted, however large the host. A plain text block has
to recur on ``MIN_SHARE`` of its host too, as short ones recur by chance, or with
``LONG`` words on ``TEXT_PAGES`` pages; inside ``<article>`` or ``<main>`` on
``TEXT_PAGES`` and ``TEXT_SHARE``: a paragraph that some articles share is text. Equal pages count once, so copies of an article do
not make it a template. Inline elements and table cells go with what holds them.

Blocks of the rest, white space inside them made one space, are joined by line
feeds in page order; character references are decoded.

Null, empty and markup-only pages give an empty text. Rows that share an id and
differ in their html are told apart by its hash; repeated rows get equal texts.
Pages are read whole, however long or deep. Only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .url_filter import host_of

#: A subtree is template if at least so many different pages of its host hold it; a text block if this share of them does too.
MIN_PAGES = 5
MIN_SHARE = 0.2
#: The same for a text block inside an article; outside, one of ``LONG`` words needs the pages alone.
TEXT_PAGES = 30
TEXT_SHARE = 0.5
LONG = 8

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset("td th".split())
GONE = frozenset(
    "head nav footer aside form script style noscript template iframe object svg math canvas audio video map button select textarea input label "
    "fieldset dialog menu title xmp noembed noframes datalist progress meter applet embed".split()
)
ROOTS = ("article", "main")
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class and id names that mark what is no article.
GONE_NAMES = frozenset(
    "nav navbar navigation menu masthead topbar footer sidebar sidebars widget widgets ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments commentlist respond disqus related recommended recommendations breadcrumb "
    "breadcrumbs pagination pager toolbar skip skiplink".split()
)
#: These too, outside the article.
GONE_OUTSIDE = frozenset("header head top bottom copyright search".split())
#: What may stand beside such words in a name, if it is to go inside an article.
PLAIN_NAMES = frozenset(
    "area article bar block bottom box button buttons container content entry form group header inline inner item items left link links list main outer page "
    "panel post right row section site slot title top unit wrap wrapper".split()
)
#: Opening one of the former closes an open one of the latter, up to a border.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html"),
    "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
P_BORDER = frozenset("table td th caption button object article section div main body html li dd".split())
P_CLOSERS = BLOCK - {"br", "option", "optgroup", "caption", "tr", "tbody", "thead", "tfoot", "body", "html"}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr caption figcaption summary br hr".split()) | INLINE
#: Text blocks that are counted by themselves.
COUNTED = TEXT_BLOCKS - INLINE - {"td", "th", "tr", "br", "hr"}
#: Low bits of a subtree's hash: it is a text block; it stands inside an article; it has ``LONG`` words.
IS_TEXT, IS_INSIDE, IS_LONG = 1, 2, 4

#: Quoted values open after ``=`` and run to their closing quote, however far; no step is tried twice.
_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_PARTS = re.compile(r"[a-z]+")

OPEN, CLOSE, TEXT = 0, 1, 2
#: Whether an element goes by itself: not at all, by its name or as a form, or for good.
KEPT, SOFT, HARD = 0, 1, 2


class Page:
    """Events ``(kind, element or text)``; per element its tag, parent, whether it goes by itself or
    with a parent, and whether an article holds it."""

    __slots__ = ("events", "tag", "parent", "own", "gone", "inside")

    def __init__(self):
        self.events: list[tuple[int, object]] = []
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.own: list[int] = []
        self.gone: list[bool] = []
        self.inside: list[bool] = []


def _names(attributes: str) -> tuple[list[set[str]], str, bool]:
    """The words of each class name and of the id, role, and whether the element is hidden."""
    parts: list[set[str]] = []
    role, hidden = "", False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            role = value.strip()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.strip() == "true"
        else:
            for word in (m[2] or m[3] or m[4] or "").split():
                parts.append(set(_PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word).lower())))
    return parts, role, hidden


def parse(source: str) -> Page:
    page = Page()
    events, stack = page.events, []  # of element numbers
    tags, gone, inside = page.tag, page.gone, page.inside

    def close(count: int) -> None:
        for _ in range(count):
            events.append((CLOSE, stack.pop()))

    def close_open(names: frozenset, border: frozenset) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            t = tags[stack[depth]]
            if t in names:
                close(len(stack) - depth)
                return
            if t in border:
                return

    at, end, search = 0, len(source), _TAG.search
    while at < end:
        m = search(source, at)
        if m is None:
            break
        if m.start() > at:
            events.append((TEXT, source[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                events.append((TEXT, "<br>"))
                continue
            for depth in range(len(stack) - 1, -1, -1):
                t = tags[stack[depth]]
                if t == tag:
                    close(len(stack) - depth)
                    break
                if tag in INLINE and t not in INLINE or t in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "html", "body"):
                    break  # an end tag without a start here
            continue
        if tag in P_CLOSERS:
            close_open(frozenset(("p",)), P_BORDER)
        if tag in CLOSES:
            close_open(*CLOSES[tag])
        up = stack[-1] if stack else -1
        held = up >= 0 and inside[up]
        drop = HARD if tag in GONE or tag == "header" and not held else KEPT
        if tag == "form" or tag == "fieldset":
            drop = SOFT
        elif not drop and (attributes := m[3]) and tag not in ("html", "body"):
            low = attributes.lower()
            if "class" in low or "id" in low or "role" in low:
                parts, role, hidden = _names(attributes)
                every = set().union(*parts)
                if hidden or role in GONE_ROLES or tag == "article" and not every.isdisjoint(("comment", "comments", "teaser", "related")):
                    drop = HARD
                elif tag in ROOTS or tag in TEXT_BLOCKS:
                    pass
                elif held:
                    if any(not x.isdisjoint(GONE_NAMES) and x <= GONE_NAMES | PLAIN_NAMES for x in parts):
                        drop = SOFT
                elif not every.isdisjoint(GONE_NAMES) or not every.isdisjoint(GONE_OUTSIDE):
                    drop = SOFT
        number = len(tags)
        tags.append(tag)
        page.parent.append(up)
        page.own.append(drop)
        gone.append(drop != KEPT or up >= 0 and gone[up])
        inside.append(held or tag in ROOTS and not drop)
        events.append((OPEN, number))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in INLINE:
            events.append((CLOSE, number))
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else end
            events.append((CLOSE, number))
        else:
            stack.append(number)
    if at < end:
        events.append((TEXT, source[at:]))
    close(len(stack))
    if not any(t in ROOTS and not g for t, g in zip(tags, gone)):
        _revive(page)
    return page


def _revive(page: Page) -> None:
    """On a page without an article of its own: an element that goes by its name, or a form, but holds
    more than half of the text, is a wrapper around the article and stays."""
    size, total, stack = [0] * len(page.tag), 0, []
    for kind, x in page.events:
        if kind == OPEN:
            stack.append(x)
        elif kind == CLOSE:
            stack.pop()
            if stack and page.own[x] != HARD:
                size[stack[-1]] += size[x]
        elif stack and page.own[stack[-1]] != HARD:
            size[stack[-1]] += len(x.strip())
    for x, up in enumerate(page.parent):
        if up < 0 and page.own[x] != HARD:
            total += size[x]
    for x, up in enumerate(page.parent):  # parents come first
        if page.own[x] == SOFT and 2 * size[x] > total:
            page.own[x] = KEPT
        page.gone[x] = page.own[x] != KEPT or up >= 0 and page.gone[up]


def _root(page: Page) -> str:
    """The tag whose elements hold the article; empty: the whole page."""
    there = {t for t, g in zip(page.tag, page.gone) if t in ROOTS and not g}
    return next((t for t in ROOTS if t in there), "")


def _walk(page: Page) -> Iterator[tuple[int, object]]:
    """Events in the article that no dropped element holds."""
    root, depth, away = _root(page), 0, 0
    for kind, x in page.events:
        if kind == TEXT:
            if not away and (depth or not root):
                yield kind, x
            continue
        if page.gone[x]:
            away += 1 if kind == OPEN else -1
            continue
        if away:
            continue
        if root and page.tag[x] == root:
            depth += 1 if kind == OPEN else -1
        if depth or not root or page.tag[x] == root:
            yield kind, x


def subtrees(page: Page) -> Iterator[tuple[int, int]]:
    """Element and hash of each subtree of the page that may be template: its tags and its text, without
    what goes by itself in it. The low bits are ``IS_TEXT``, ``IS_INSIDE`` and ``IS_LONG``."""
    stack: list[tuple[int, list[str]]] = []
    words = [0] * len(page.tag)
    for kind, x in page.events:
        if kind == TEXT:
            if stack and x != "<br>" and (t := " ".join(x.split())):
                stack[-1][1].append(t)
                words[stack[-1][0]] += t.count(" ") + 1
        elif kind == OPEN:
            stack.append((x, [page.tag[x]]))
        else:
            _, parts = stack.pop()
            h = xxhash.xxh3_64_intdigest("\x1f".join(parts)) & 0x7FFFFFFFFFFFFFF8
            if stack and (not page.gone[x] or page.gone[stack[-1][0]]):
                stack[-1][1].append(f"\x1e{h:x}")
                words[stack[-1][0]] += words[x]
            tag = page.tag[x]
            if len(parts) > 1 and tag not in ROOTS and tag not in ("html", "body", "head") and (tag in COUNTED or tag not in TEXT_BLOCKS):
                yield x, h | (IS_TEXT if tag in COUNTED else 0) | (IS_INSIDE if page.inside[x] else 0) | (IS_LONG if words[x] >= LONG else 0)


def text_of(page: Page, template: frozenset | set = frozenset()) -> str:
    """Blocks of the article, one a line, without subtrees whose hash is template."""
    out: set[int] = {x for x, h in subtrees(page) if h in template} if template else set()
    blocks, now, away = [], [], 0

    def flush() -> None:
        if now:
            t = " ".join(entities.unescape("".join(now)).split())
            if t:
                blocks.append(t)
            now.clear()

    for kind, x in _walk(page):
        if kind == TEXT:
            if not away:
                flush() if x == "<br>" else now.append(x)
            continue
        if x in out:
            away += 1 if kind == OPEN else -1
            flush()
        elif not away:
            tag = page.tag[x]
            if tag in BLOCK:
                flush()
            elif tag in CELL:
                now.append(" ")
    flush()
    return "\n".join(blocks)


def _rows(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(source).alias("html"))


def candidates(rows: DataFrame) -> DataFrame:
    """``key, p, host, h, g, shown``: each page's distinct subtree hashes; ``p`` is a hash of its html, ``g`` of host and subtree; ``shown`` ones stand in its article. A row with null ``h`` stands for the page itself."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, p, h, g, shown = [], [], [], [], []
            for k, (host, source) in enumerate(zip(batch.column(1), batch.column(2))):
                source, seed = source.as_py() or "", xxhash.xxh3_64_intdigest(host.as_py())
                digest = xxhash.xxh3_64_intdigest(source) & 0x7FFFFFFFFFFFFFFF
                page = parse(source)
                walked = {x for kind, x in _walk(page) if kind == OPEN}
                found: dict[int, bool] = {}
                for x, y in subtrees(page):
                    found[y] = found.get(y, False) or x in walked
                at += [k] * (1 + len(found))
                p += [digest] * (1 + len(found))
                h += [None, *found]
                shown += [False, *found.values()]
                g += [None, *(xxhash.xxh3_64_intdigest((x & ~IS_INSIDE).to_bytes(8, "little"), seed) >> 1 for x in found)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(p, pa.int64()), batch.column(1).take(take), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(shown, pa.bool_())], ["key", "p", "host", "h", "g", "shown"])

    return rows.select("key", "host", "html").mapInArrow(run, f"key {kind}, p long, host string, h long, g long, shown boolean")


def templates(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, h`` of subtrees that recur on many different pages of their host, wherever they stand there.

    Most subtrees stand on one page: a count of single numbers, copies of a page included, leaves few for the exact one.
    Those that stand in no article of the host are counted no further, as no text holds them.
    """
    maybe = found.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.max("shown").alias("shown")).where((F.col("n") >= min_pages) & F.col("shown")).select("g")
    alike = found.join(written(maybe, "recurring"), "g").select("host", F.col("h").bitwiseAND(~IS_INSIDE).alias("h"), "p").distinct()
    counts = alike.groupBy("host", "h").agg(F.count("*").alias("n"))
    whole = found.where("h IS NULL").select("host", "p").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = counts.where(F.col("n") >= min_pages).join(whole, "host")
    block = F.col("h").bitwiseAND(IS_TEXT) == 0
    long = (F.col("h").bitwiseAND(IS_LONG) != 0) & (F.col("n") >= TEXT_PAGES)
    often = often.where(block | long | (F.col("n") >= min_share * F.col("pages")))
    strict = block | (F.col("n") >= TEXT_PAGES) & (F.col("n") >= TEXT_SHARE * F.col("pages"))
    inside = F.col("h").bitwiseOR(IS_INSIDE)
    return often.select("host", F.explode(F.when(strict, F.array("h", inside)).otherwise(F.array("h"))).alias("h"))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``key, url, text, n_chars, n_template``: the last counts the template's hashes that the page's article holds."""
    rows = _rows(pages, key, url, source)
    found = written(candidates(rows), "subtrees")
    gone = found.where("shown").join(templates(found, min_pages, min_share), ["host", "h"])
    # One page's own hashes: bounded by the page.
    per = written(gone.groupBy("key", "p").agg(F.collect_set("h").alias("template")).select(F.col("key").alias("k"), "p", "template"), "template")
    joined = rows.drop("host").join(per.groupBy("k").agg(F.collect_list(F.struct("p", "template")).alias("template")), F.col("key").eqNullSafe(F.col("k")), "left").select("key", "url", "html", "template")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, sizes, counts = [], [], []
            for s, t in zip(batch.column(2), batch.column(3)):
                s, t = s.as_py() or "", t.as_py()
                template = set()
                if t:
                    digest = xxhash.xxh3_64_intdigest(s) & 0x7FFFFFFFFFFFFFFF
                    template = {h for x in t if x["p"] == digest for h in x["template"]}
                text = text_of(parse(s), template)
                texts.append(text)
                sizes.append(len(text))
                counts.append(len(template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["key", "url", "text", "n_chars", "n_template"])

    return joined.mapInArrow(run, f"key {kind}, url string, text string, n_chars long, n_template long").withColumnRenamed("key", key)
