"""Main text of web pages by tag-path ratios.

A page is read as a tree of elements; its leaves are blocks, the runs of text
between block-level tags. Blocks with the same path of tags from the root (with
classes, which templates repeat) belong to the same part of a template. For each path
the lengths of its texts, without the text of links, and their punctuation are summed and divided by
the number of its blocks. Both ratios are smoothed along the page (a Gaussian over
neighbouring blocks, weighed by how much of the paths agrees), multiplied, and
raised for paths through an article or main element; paths whose mean reaches a
share of the standard deviation are content. The content node is the lowest element
that holds nearly all of the content paths' text; its blocks are the main text, but for what is
marked as something else: navigation, page headers and footers, asides, forms, scripts, styles, notices, adverts,
reader comments (by tag, role, class, id or the heading of the comments), hidden parts,
and paths that are lists of links.

Broken markup is read as browsers do in the cases that decide where a block ends: unclosed paragraphs and list items,
comments and tags cut off at the end, raw text of scripts, references without a semicolon.

Defined results: null or empty html gives an empty text; pages without a content
path give an empty text; rows that repeat a page_id each give a row; other columns
are ignored. Pages are independent, so no rows are shuffled.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Content paths reach this share of the standard deviation of the fused ratios.
LAMBDA = 0.3
#: The content node descends while one child holds so much of the content paths' text.
HOLDS = 0.85
#: Paths with so much of their text in links, and hardly any punctuation, are menus.
LINKED = 0.6
#: Weights of the neighbours one and two blocks away, for a deviation of one block.
NEAR = (math.exp(-0.5), math.exp(-2.0))
FOUND = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Text inside is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements whose text is never shown in the article.
NEVER = frozenset("head script style noscript template textarea title iframe noembed noframes xmp svg math canvas object audio video select option optgroup datalist button nav footer aside form menu dialog map applet frameset".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TITLES = frozenset(("h1", "h2"))
BLOCK = HEADINGS | frozenset("html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul br title script style noscript template textarea iframe select option button frameset".split())
#: A start tag of these ends an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul".split())
#: A start tag ends open elements of these kinds, up to the nearest of the second kinds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
#: An end tag does not reach through these.
SCOPE = frozenset(("table", "td", "th", "caption", "html", "template", "object", "button"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist status note".split())

_WORDS = "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promoted teaser nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager paging skip topbar masthead footer sidebar aside widget widgets rail cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations outbrain taboola toolbar search"
#: Parts of class and id names that say what an element is for.
HINTS = frozenset(_WORDS.split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion kommentare kommentar commentaires commentaire comentarios comentario".split())
#: With these before it, a header is the article's own.
OWN = frozenset("article entry post story content main page-content".split())
#: Layout names that speak of a part that is elsewhere.
ELSEWHERE = frozenset("with has no without layout wrapper wrap container page site body grid row col column columns inner outer js template".split())
_COMMENT_HEADING = re.compile(r"\W*(\d+\W+)?(reader |user |leser)?(comments?|kommentare?|commentaires?|comentarios?|responses?|replies|leave a (comment|reply)|join the (conversation|discussion))\b[\W\d]*$", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…¿¡]")
_SPACE = re.compile(r"[\s\x00]+")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Comments, declarations, tags and their attributes; a quote that never closes is not one.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    step: str
    parent: Element | None
    depth: int
    #: The element is no part of the article; the parent's state goes down.
    out: bool = False
    #: Within the article's own header, of which headings count.
    own_header: bool = False
    #: Within an article or main element.
    favoured: bool = False
    #: An article itself, not of comments.
    article: bool = False
    #: Reader comments follow in it.
    closed_to: bool = False


@dataclass(slots=True, eq=False)
class Block:
    at: Element
    text: str
    linked: int
    path: tuple = field(default=())


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _hint(value: str) -> str:
    """What the names in a class or id say: 'out', 'comments', 'own header' or nothing."""
    for name in value.split():
        parts = _PARTS.findall(_CAMEL.sub(" ", name).lower())
        if not parts or not ELSEWHERE.isdisjoint(parts):
            continue
        if not COMMENTS.isdisjoint(parts):
            return "comments"
        if parts[-1] in ("header", "head", "heading", "hd"):
            if len(parts) == 1 or parts[0] in ("top", "global", "main", "section", "blog", "the"):
                return "out" if parts[-1] == "header" else ""
            if not OWN.isdisjoint(parts):
                return "own header"
        if not HINTS.isdisjoint(parts):
            return "out"
    return ""


def _opened(tag: str, source: str, parent: Element) -> Element:
    out, own_header, favoured, step = parent.out, parent.own_header, parent.favoured, tag
    given = _attributes(source) if source and "=" in source or "hidden" in source else {}
    if tag in NEVER:
        out = True
    elif given:
        names = f"{given.get('class', '')} {given.get('id', '')}"
        step = f"{tag}.{given['class']}" if given.get("class") else tag
        hint = _hint(names) if tag not in ("html", "body", "main") else ""
        article = tag == "article" or given.get("itemprop") == "articleBody" or given.get("role") in ("main", "article")
        if hint == "comments" and not (article and not parent.favoured):
            out = True
        elif hint == "out" and not article:
            out = True
        elif hint == "own header":
            own_header = True
        if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search(given.get("style", "")):
            out = True
    if tag == "header":
        # The article's own header gives its headings, the page's none.
        out, own_header = out or not parent.favoured, True
    own_article = not out and (tag == "article" or given.get("itemprop") == "articleBody" or given.get("role") == "article")
    if not out and (own_article or tag == "main" or given.get("role") == "main"):
        favoured = True
    return Element(tag, step, parent, parent.depth + 1, out, own_header, favoured, own_article)


def blocks_of(source: str) -> list[Block]:
    """The blocks of a page that may be content, in page order."""
    root = Element("", "", None, 0)
    stack, out = [root], []
    texts: list[str] = []
    linked = links = pos = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", "".join(texts)).strip()
            if text:
                at = stack[-1]
                while at.tag not in BLOCK and at.parent is not None:
                    at = at.parent
                add(at, text)
            texts.clear()
        linked = 0

    def add(at: Element, text: str) -> None:
        if at.out or at.closed_to:
            return
        if at.tag in HEADINGS and _COMMENT_HEADING.match(text):
            # What follows the heading of the comments is theirs, in the element that it opens.
            host = at.parent
            while host.parent is not None and host.parent.parent is not None and host.tag not in ("article", "main", "body") and not (out and _inside(out[-1].at, host)):
                host.closed_to = True
                host = host.parent
            host.closed_to = True
            return
        if at.own_header and at.tag not in HEADINGS:
            return
        out.append(Block(at, text, min(linked, len(text))))

    def close(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            if e.tag == "a":
                links -= 1
        del stack[to:]

    size = len(source)
    while pos < size:
        m = _TOKEN.search(source, pos)
        if m is None or m.start() > pos:
            piece = _html.unescape(source[pos : m.start() if m else size])
            if piece and not stack[-1].out and not stack[-1].closed_to:
                texts.append(piece)
                if links:
                    linked += len(piece.strip())
            if m is None:
                break
        pos = m.end()
        name = m[2]
        if name is None or not m[4] and m[4] != ">":
            continue  # a comment, a declaration, or a tag cut off at the end
        tag = name.lower()
        if m[1]:
            if tag == "br":
                flush()
            elif tag == "p" and not any(e.tag == "p" for e in stack[-8:]):
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag or tag in HEADINGS and stack[k].tag in HEADINGS:
                        if any(e.tag in BLOCK for e in stack[k:]):
                            if tag not in BLOCK:
                                break  # an inline end tag closes no block
                            flush()
                        close(k)
                        break
                    if stack[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                        break
            continue
        if tag in BLOCK:
            flush()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            own, until = ENDS[tag]
            lowest = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in own:
                    lowest = k
            if lowest:
                close(lowest)
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(len(stack) - 1)
        elif tag == "a" and links:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "a":
                    if not any(e.tag in BLOCK for e in stack[k + 1 :]):
                        close(k)
                    break
        if tag in VOID or m[3].endswith("/") and tag in ("path", "circle", "rect", "use"):
            continue
        element = _opened(tag, m[3], stack[-1])
        element.closed_to = stack[-1].closed_to
        if tag in RAW:
            # Raw text up to its end tag; none of it is shown.
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, pos) if tag != "plaintext" else None
            if end is None:
                break
            closing = source.find(">", end.end())
            pos = size if closing < 0 else closing + 1
            continue
        if len(stack) > 256:  # deeper ones lie in the last
            continue
        links += tag == "a"
        stack.append(element)
    flush()
    return out


def _inside(e: Element | None, host: Element) -> bool:
    while e is not None and e.depth >= host.depth:
        if e is host:
            return True
        e = e.parent
    return False


def _path(e: Element) -> tuple:
    steps = []
    while e.parent is not None:
        steps.append(e.step)
        e = e.parent
    return tuple(reversed(steps))


def _alike(a: tuple, b: tuple) -> float:
    """Share of two paths that agrees from the root on."""
    if a == b:
        return 1.0
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n / max(len(a), len(b), 1)


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks of the main text: path ratios, smoothed, fused, thresholded; then the node that holds them."""
    known: dict[int, tuple] = {}
    for b in blocks:
        p = known.get(id(b.at))
        if p is None:
            p = known[id(b.at)] = _path(b.at)
        b.path = p
    sums: dict[tuple, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text) - b.linked
        s[2] += len(_PUNCTUATION.findall(b.text))
        s[3] += len(b.text)
    menus = {p for p, (n, plain, marks, size) in sums.items() if size - plain >= LINKED * size and marks <= n and size < 80 * n}
    own = [b for b in blocks if b.path not in menus]
    if not own:
        return []
    ratios = [(sums[b.path][1] / sums[b.path][0], sums[b.path][2] / sums[b.path][0]) for b in own]
    fused = []
    for i, b in enumerate(own):
        length, marks = ratios[i]
        total = 1.0
        for d, near in enumerate(NEAR, 1):
            for j in (i - d, i + d):
                if 0 <= j < len(own):
                    w = near * _alike(b.path, own[j].path)
                    length, marks, total = length + w * ratios[j][0], marks + w * ratios[j][1], total + w
        fused.append(length / total * (1 + marks / total) * (2.0 if b.at.favoured else 1.0))
    mean = sum(fused) / len(fused)
    least = LAMBDA * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    by_path: dict[tuple, list[float]] = {}
    for b, f in zip(own, fused):
        by_path.setdefault(b.path, []).append(f)
    content = {p for p, f in by_path.items() if sum(f) / len(f) >= least and sums[p][1] > 0}
    node = _content_node([b for b in own if b.path in content])
    if node is None:
        return []
    if node.tag in ("", "html", "body"):
        # No element holds the text alone: content paths, and what stands among their blocks.
        hosts = {id(b.at.parent) for b in own if b.path in content}
        places = [k for k, b in enumerate(own) if b.path in content]
        first, last = places[0], places[-1]
        while first and own[first - 1].at.tag in HEADINGS and id(own[first - 1].at.parent) in hosts:
            first -= 1
        return [b for k, b in enumerate(own) if b.path in content or first <= k <= last and id(b.at.parent) in hosts]
    held = [k for k, b in enumerate(own) if _inside(b.at, node)]
    first = held[0] if held else 0
    # Headings right before the node belong to it if they stand beside it or in the header beside it.
    while first and own[first - 1].at.tag in TITLES and _inside(node, _beside(own[first - 1].at)):
        first -= 1
        held.insert(0, first)
    return [own[k] for k in held]


def _beside(heading: Element) -> Element:
    """The element in which a heading, or the header that it stands in, lies."""
    host = heading.parent
    while host.own_header and host.parent is not None:
        host = host.parent
    return host


def _content_node(chosen: list[Block]) -> Element | None:
    """The lowest element that holds nearly all of the text of the blocks; of articles side by side the fullest, if it holds most."""
    if not chosen:
        return None
    children: dict[int, dict[int, Element]] = {}
    held: dict[int, float] = {}
    root = None
    # An article or main element with most of the text it has to share is the place to look in.
    favoured: dict[int, tuple[Element, float]] = {}
    for b in chosen:
        n, e, top = len(b.text), b.at, None
        while e is not None:
            held[id(e)] = held.get(id(e), 0) + n
            if e.parent is not None:
                children.setdefault(id(e.parent), {})[id(e)] = e
            else:
                root = e
            if e.favoured and (e.parent is None or not e.parent.favoured):
                top = e
            e = e.parent
        if top is not None:
            favoured[id(top)] = top, held[id(top)]
    node = root
    if favoured:
        best = max(favoured.values(), key=lambda x: x[1])
        if 2 * best[1] >= sum(x[1] for x in favoured.values()):
            node = best[0]
    while True:
        below = children.get(id(node))
        if not below:
            break
        fullest = max(below.values(), key=lambda e: held[id(e)])
        if held[id(fullest)] < HOLDS * held[id(node)] or fullest.tag in HEADINGS or fullest.tag not in BLOCK:
            break
        if node.article:
            break  # an article is all its own
        if node.favoured and fullest.tag in ("p", "li", "ul", "ol", "td", "tr", "blockquote", "pre", "dl", "dd", "table", "tbody", "figure"):
            break  # an article with one long paragraph is still all of it
        if fullest.tag in ("p", "li", "blockquote", "pre", "dd", "td", "tr", "tbody"):
            break
        node = fullest
    return node


def main_text(source: str | None) -> str:
    return " ".join(b.text for b in content_blocks(blocks_of(source or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, FOUND)
