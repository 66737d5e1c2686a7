"""Operator 3, main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with its path: tags from the root, with the words of their classes and ids.
Every path gets a ratio over all its blocks, text length times punctuation per block, less the share of linked text. The
ratio, on a log scale, is smoothed along the page over neighbouring blocks, fused with the path's own, and compared with
SHARE of the page's largest; paths above are content. The article is the smallest element around all content. Inside,
subtrees without content are left out where they are linked or stand before or after all content; headings, short
paragraphs and lists between content blocks stay, as do those among the content's own siblings. What markup names as no
part of the article (menus, footers, sidebars, notices, adverts, forms, comments) is left out after that, which decides
only where ratios are alike, as for comments; an element that holds most of the text is never left out for its name.

Where the page says itself what its article is, by article or main elements that hold half of its content or more, these
are taken whole, all outermost ones, with the heading that stands before them if they hold none. Named parts outside, forms
and named nested articles go; other named parts inside go only where the ratios agree.

Scripts, styles and elements that are not shown hold no text. The head ends where body or text begins. Tags need not be
closed or balanced, and work grows in proportion to the page, however deep. A null or empty page gives an empty text; so
does a page without content. Texts are read whole; blocks are joined by an empty line. Repeated rows are extracted each
on its own; columns named text or n_chars in the input are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import text_batches

# The classes of elements in the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|math|object|video|audio|canvas|select|xmp|noframes"
#: Of those, the ones that a "/>" ends; others stay open, as in browsers.
EMPTY_RAW = "iframe|svg|math|object|video|audio|canvas"
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table body html".split())

#: Elements and words in class, id or role that name parts beside the article.
BESIDE = frozenset("nav aside footer button dialog menu head".split())
#: Of these, the ones that hold no text of a page at all.
UNSEEN = frozenset("button dialog menu head".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices alert "
    "comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe "
    "subscription signup login popup modal overlay toolbar pagination pager widget skip hidden copyright search "
    "complementary contentinfo discussion adsbygoogle".split())
#: Stems that name such parts also inside longer words.
BESIDE_STEMS = re.compile(
    "sidebar|footer|comments?|cookie|advert|banner|breadcrumb|sponsor|newsletter|topnav|navbar|navigation|menubar|popup")
PAGE_HEAD = frozenset("header masthead topbar".split())
#: Their ids are targets of links; within an article they are text whatever they are named.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = PROSE - {"p"}
#: Elements that are text themselves, not containers of anything.
PROSE_BLOCKS = PROSE | frozenset("ul ol dl li dt dd blockquote pre table figure figcaption address hr".split())
#: A path is content from this share of the best path's ratio.
SHARE = 1 / 3

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?:{EMPTY_RAW})(?=[\s/])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
#: Marks that end words; those inside of numbers and addresses say nothing.
MARKS = re.compile(r"[.,;:!?…](?=\s|$)|[。、，！？]")
#: An a element that only names a place in the page is no link.
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.IGNORECASE)
ANCHOR = re.compile(r"(?:^|[\s\"'])(?:name|id)\s*=", re.IGNORECASE)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
HIDDEN_FLAG = re.compile(r"(?:^|\s)hidden(?![\w-])", re.IGNORECASE)


class Element:
    """An open tag on the way down; `beside` says its markup names it as no part of the article.

    Its path is numbered by its parent's path and its own tag, classes and id, so no path is ever spelled out.
    """

    __slots__ = ("tag", "parent", "path", "inside", "beside", "hidden", "sure", "holds_title", "holds_only_articles",
                 "own", "text", "linked", "content", "blocks", "prose", "mark", "top")

    def __init__(self, tag: str, parent: Element | None, attrs: str, paths: dict[tuple, int]):
        names = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAMES.finditer(attrs)]
        names = [(kind, name) for kind, name in names if tag not in PROSE or kind != "id"]
        words = {w.lower() for _, name in names for w in WORDS.findall(name)}
        # Ids are often numbered through, classes are not.
        tokens = frozenset(t for kind, name in names for t in (DIGITS.sub("", name) if kind == "id" else name).split())
        self.tag, self.parent, self.holds_title = tag, parent, False
        self.path = paths.setdefault((parent.path if parent else -1, tag, tokens), len(paths))
        self.holds_only_articles = tag != "form"
        self.inside = inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        named = bool(words & BESIDE_WORDS) or any(BESIDE_STEMS.fullmatch(w) or (
            len(w) > 6 and BESIDE_STEMS.search(w)) for w in words) or (not inside and (tag in PAGE_HEAD or bool(words & PAGE_HEAD)))
        unseen = tag in UNSEEN or bool(HIDDEN.search(attrs)) or bool(HIDDEN_FLAG.search(QUOTED.sub("''", attrs)))
        self.hidden = unseen or (parent is not None and parent.hidden)
        self.sure = tag in BESIDE or self.hidden or (parent is not None and parent.sure)
        self.beside = tag == "form" or named and tag not in ("html", "body", "main")
        self.own = self.text = self.linked = self.content = self.blocks = 0
        self.prose = self.mark = False
        self.top = None

    def named(self) -> bool:
        """A name such as "with-sidebar" on an element around the article itself leaves nothing out."""
        return self.beside and not self.holds_title


class Block:
    """A run of text without a block tag inside; `linked` counts characters of its links, decoded as in the text."""

    __slots__ = ("element", "text", "linked", "path")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked, self.path = element, text, min(linked, len(text)), element.path


def collapsed(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def outside_head(element: Element) -> Element:
    """The head holds no text and no element but those read as a whole: any other ends it."""
    return element.parent if element.tag == "head" else element


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """All elements, parents first, and all blocks, both in the order of the page."""
    paths: dict[tuple, int] = {}
    element = Element("#page", None, "", paths)
    elements, blocks = [element], []
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    links: list[list[str]] = []
    in_link, at = False, 0

    def up_to(parent: Element) -> None:
        """Close what is open below `parent`."""
        nonlocal element
        while element is not parent:
            opened[element.tag] -= 1
            element = element.parent

    def finish():
        nonlocal in_link
        text = collapsed(parts)
        if text:
            up_to(outside_head(element))
            blocks.append(Block(element, text, sum(len(collapsed(link)) for link in links)))
        parts.clear()
        links.clear()
        in_link = False

    def add(piece: str):
        parts.append(piece)
        if in_link:
            links[-1].append(piece)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = not closing and (bool(HREF.search(attrs)) or not ANCHOR.search(attrs))
                if in_link:
                    links.append([])
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in ("img", "wbr"):
            continue
        finish()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while element.tag != tag:
                    up_to(element.parent)
                up_to(element.parent)
            continue
        up_to(outside_head(element))
        # An open paragraph ends where another block begins, a list item where the next one does.
        ends = CLOSES.get(tag, set()) | {"p"}
        e = element
        while e.parent is not None and e.tag not in SCOPES:
            if e.tag in ends:
                up_to(e.parent)
                if e.tag == "p":
                    break
            elif e.tag not in CLOSES:
                break
            e = e.parent
        element = Element(tag, element, attrs, paths)
        elements.append(element)
        opened[tag] += 1
        if tag in ("h1", "article", "main"):
            e = element.parent
            # What is above an element that is marked already is marked as well.
            while e is not None and not (e.holds_title and (tag == "article" or not e.holds_only_articles)):
                e.holds_title = True
                e.holds_only_articles = e.holds_only_articles and tag == "article"
                e = e.parent
    add(page[at:])
    finish()
    return elements, blocks


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page but those that are not shown."""
    return [b for b in parsed(page)[1] if not b.element.hidden]


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused ratio of every path: its own, on a log scale, and that of its surroundings along the page."""
    length, marks, links, count = (defaultdict(float) for _ in range(4))
    for b in blocks:
        length[b.path] += len(b.text)
        marks[b.path] += len(MARKS.findall(b.text))
        links[b.path] += b.linked
        count[b.path] += 1
    ratio = {
        p: math.log1p(length[p] / count[p] * (1 + marks[p] / count[p]) * (1 - links[p] / length[p]) * math.sqrt(length[p]))
        for p in count
    }
    along = [ratio[b.path] for b in blocks]
    around = [along[0], *along, along[-1]]
    fused: dict[int, float] = defaultdict(float)
    for i, b in enumerate(blocks):
        smoothed = 0.25 * around[i] + 0.5 * around[i + 1] + 0.25 * around[i + 2]
        fused[b.path] += (ratio[b.path] + smoothed) / 2 / count[b.path]
    return fused


def content_limit(scores: dict[int, float]) -> float:
    """The score from which a path is content: SHARE of the best one's ratio, on the log scale of scores."""
    best = max(scores.values())
    return max(best + math.log(SHARE), best / 2) if best > 0 else math.inf


def summed(elements: list[Element], blocks: list[Block], content: list[bool]) -> None:
    """For every element what the blocks inside hold: text, its linked part, content, number and number of content."""
    for e in elements:
        e.own = e.text = e.linked = e.content = e.blocks = 0
        e.prose = False
    for b, is_content in zip(blocks, content):
        e, n = b.element, len(b.text)
        e.text, e.linked, e.own = e.text + n, e.linked + b.linked, e.own + n - b.linked
        e.prose = e.prose or is_content or e.tag in PROSE
        if is_content:
            e.content, e.blocks = e.content + n, e.blocks + 1
    for e in reversed(elements[1:]):
        up = e.parent
        up.text, up.linked, up.own = up.text + e.text, up.linked + e.linked, up.own + e.own
        up.content, up.blocks, up.prose = up.content + e.content, up.blocks + e.blocks, up.prose or e.prose


def carry_down(elements: list[Element], marks) -> None:
    """Mark elements that `marks` picks, and all inside them."""
    for e in elements:
        e.mark = (e.parent is not None and e.parent.mark) or marks(e)


def main_text(page: str | None) -> str:
    """Blocks of the article, with an empty line between."""
    elements, blocks = parsed(page) if page else ([], [])
    blocks = [b for b in blocks if not b.element.hidden]
    chosen = None
    if any(e.tag in ("article", "main") for e in elements):
        chosen = _by_element(elements, blocks)
    if chosen is None:
        chosen = _by_paths(elements, blocks)
    return "\n\n".join(b.text for b in chosen)


def _by_paths(elements: list[Element], blocks: list[Block]) -> list[Block]:
    """The article of a page that does not mark it: what paths above the limit hold, and what stands between.

    The article's element is the smallest around all content. In it, a subtree without content is left out if half of
    its text or more is linked, or if it stands before or after all content, unless it is a heading or other prose among
    the content's own siblings. Names decide only where ratios are alike: they take away content such as comments.
    """
    if not blocks:
        return []
    _mark_beside(elements, blocks)
    unnamed = [b for b in blocks if not b.element.mark]
    # If names take away all content, what they leave is compared with itself.
    for compared in (blocks, unnamed):
        scores = path_scores(compared) if compared else {}
        limit = content_limit(scores) if scores else 0
        content = [not b.element.mark and scores[b.path] >= limit for b in blocks]
        if any(content):
            break
    else:
        return []
    summed(elements, blocks, content)
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    beside = {id(b.element) for b in blocks if b.element.mark}
    root, total = blocks[first].element, sum(content)
    while root.blocks < total or (root.tag == "p" and root.parent is not None):
        root = root.parent
    carry_down(elements, lambda e: e is root)
    inside = {id(e) for e in elements if e.mark}
    # The largest subtree without content that an element is in.
    for e in elements:
        e.top = e.parent.top if e.parent is not None and e.parent.top is not None else (e if not e.blocks else None)
    holders = {id(b.element.parent) for b, c in zip(blocks, content) if c} | {id(b.element) for b, c in zip(blocks, content) if c}

    def kept(i: int, b: Block) -> bool:
        if id(b.element) not in inside or id(b.element) in beside:
            return False
        free = b.element.top
        if content[i]:
            return True
        if free is None:
            return first < i < last or b.linked * 2 < len(b.text)
        if free.tag in HEADINGS:
            return i < last
        if free.linked * 2 >= free.text:
            return False
        return first < i < last or (free.tag in PROSE_BLOCKS and id(free.parent) in holders)

    keep = [kept(i, b) for i, b in enumerate(blocks)]
    _with_title(blocks, keep, [root])
    return [b for b, k in zip(blocks, keep) if k]


def _mark_beside(elements: list[Element], blocks: list[Block]) -> None:
    """Mark what names leave out on a page without article or main: no element with nine tenths of the text, or with half
    of it where there is no h1."""
    summed(elements, blocks, [False] * len(blocks))
    total = elements[0].own
    titled = any(b.element.tag == "h1" for b in blocks)
    carry_down(elements, lambda e: e.tag in BESIDE or e.named() and not (
        e.own * 10 >= total * 9 or (e.own * 2 > total and not titled)))


def _by_element(elements: list[Element], blocks: list[Block]) -> list[Block] | None:
    """The article of a page with article or main elements, if they hold half of its content.

    A name leaves out what stands outside, but not an article with most of all articles' text. Within an article (or
    main, on a page without article) a name only counts if the ratios agree: at least half of the container's text is
    linked, or it has no paragraph, no heading and no block on a path above the limit.
    """
    blocks = [b for b in blocks if not b.element.sure]
    if not blocks:
        return []
    summed(elements, blocks, [False] * len(blocks))
    articles = [e for e in elements if e.tag == "article" and e.text]
    nested: set[int] = set()
    for e in elements[1:]:
        if e.parent.tag == "article" or id(e.parent) in nested:
            nested.add(id(e))
    in_articles = sum(e.own for e in articles if id(e) not in nested)
    for e in elements:
        # Such as a list of related articles; one around the article itself holds most of their text.
        if e.holds_title and e.holds_only_articles and e.own * 2 < in_articles:
            e.holds_title = False
    holders = {id(e) for e in articles if not e.named() or e.own * 2 > in_articles} or set(map(id, articles))
    scope = "article" if articles else "main"

    def is_scope(e: Element) -> bool:
        return e.tag == scope and (scope == "main" or id(e) in holders)

    scoped: set[int] = set()
    for e in elements:
        if (e.parent is not None and id(e.parent) in scoped) or is_scope(e):
            scoped.add(id(e))

    def within(e: Element) -> bool:
        """Named inside an outermost scope."""
        return (e.parent is not None and id(e.parent) in scoped and e.named() and id(e) not in holders
                and e.tag not in PROSE)

    # Outside, a name is enough; a form in an article is a form, and a nested article that is named none of it.
    carry_down(elements, lambda e: (
        within(e) and e.tag in ("form", "article")) or (
        (e.parent is None or id(e.parent) not in scoped) and e.named() and id(e) not in holders))
    free = [b for b in blocks if not b.element.mark]
    if not free:
        return []
    scores = path_scores(free)
    limit = content_limit(scores)
    summed(elements, free, [scores[b.path] >= limit for b in free])
    carry_down(elements, lambda e: within(e) and bool(e.text) and (e.linked * 2 >= e.text or not e.prose))
    blocks = [b for b in free if not b.element.mark]
    if not blocks:
        return []
    scores = path_scores(blocks)
    limit = content_limit(scores)
    content = [scores[b.path] >= limit for b in blocks]
    if not any(content):
        return []
    summed(elements, blocks, content)
    roots = [e for e in elements if e.tag in ("article", "main") and e.blocks and not e.inside]
    if sum(e.content for e in roots) * 2 < elements[0].content:
        return None
    held = set(map(id, roots))
    carry_down(elements, lambda e: id(e) in held)
    keep = [b.element.mark for b in blocks]
    _with_title(blocks, keep, roots)
    return [b for b, k in zip(blocks, keep) if k]


def _with_title(blocks: list[Block], keep: list[bool], roots: list[Element]) -> None:
    """Keep the heading beside the element of the text, within an element that holds both, if the text has none."""
    if any(k and b.element.tag == "h1" for b, k in zip(blocks, keep)) or True not in keep:
        return
    around: set[int] = set()
    for root in roots:
        e = root
        while e is not None and id(e) not in around:
            around.add(id(e))
            e = e.parent
    titles = [k for k in range(keep.index(True))
              if blocks[k].element.tag == "h1" and not blocks[k].element.sure and id(blocks[k].element.parent) in around]
    if titles:
        keep[titles[-1]] = True


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """`pages` without the markup, with `text` and `n_chars`, its code points."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    with_text = text_batches(pages).select(*kept, text_of(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return with_text.withColumn("n_chars", F.char_length("text").cast("long"))
