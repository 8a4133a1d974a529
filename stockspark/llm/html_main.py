"""Main text of web pages by tag-path ratios.

Each text node belongs to the path of tags from the root to it.  Per path,
text length and punctuation are summed and divided by the path's number of
nodes; both ratios are smoothed over the paths next to it in the page and under
the same parent, and fused.  Where there are article or main elements, the
scores choose among them and decide on what stands in them by a doubtful name;
on other pages paths over a threshold select the content region.  All blocks
of what is chosen are kept.

What is never the article takes no part: menus, page headers and footers,
sidebars, adverts, cookie notices, forms, scripts, styles, comments of
readers, hidden elements, and the unseen sources of formulas, by tag or by a
whole class, role or id that names them.  Single words of classes and ids
(``BOILERPLATE``) count outside the content only.

Null and empty html, and pages without content, give the empty text.  Broken
markup (open tags, cut entities, no end) is read as far as it goes; scripts,
styles and other raw elements end at their own end tag only.  Repeated rows
and extra columns have no effect, an empty table gives no rows; very long
pages take time in proportion.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from stockspark.llm.common import map_rows, prepare

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(/?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+)))?")
_NAME_PART = re.compile(r"[A-Za-z]+")
_PUNCT = re.compile(r"[.,;:!?…、。，！？؛،]")
#: White space of HTML texts, no-break spaces included.
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"))
#: Raw elements that don't end the block around them.
UNSEEN = RAW - {"xmp", "title"}
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
SKIP = frozenset(("head nav footer aside form script style noscript template iframe object svg canvas button "
                  "select option textarea input label title menu dialog audio video map noembed noframes annotation annotation-xml").split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark nobr q s samp small "
                    "span strike strong sub sup time tt u var wbr img "
                    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle "
                    "mspace mtable mtr mtd mpadded mphantom menclose merror mfenced mmultiscripts annotation annotation-xml").split())
#: Whole tokens of class, and whole ids of elements other than headings and inline ones, that name what is never the article.
NAMED = frozenset(("ad ads advert adverts advertisement advertisements nav navbar sidebar footer breadcrumb breadcrumbs "
                   "comments comment comment-list comments-area comments-section comment-section "
                   "cookie-banner cookie-notice cookie-consent").split())
NAMED_CLASSES = NAMED | {"navigation", "menu"}
NAMED_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar"))
#: Elements that are content only as a whole.
GROUPS = frozenset("ul ol dl li dt dd table thead tbody tfoot tr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class, id and role that may mark a subtree outside the content as no part of it.
BOILERPLATE = frozenset(("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos "
                         "promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay "
                         "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side "
                         "footer foot masthead topbar toolbar comment comments discussion disqus respond reply replies "
                         "share sharing social newsletter subscribe subscription signup login related recommended "
                         "recommendations outbrain taboola widget widgets pagination pager search complementary "
                         "contentinfo alert skip copyright disclaimer teaser").split())
#: Words that name what is never the article wherever they stand in a compound class.
NAMED_PARTS = frozenset("advert adverts advertisement advertisements sidebar navbar breadcrumb breadcrumbs".split())
#: Words of compound classes inside the article that path ratios decide on.
DOUBTFUL = frozenset(("ad ads sponsor sponsored promo promotion cookie consent newsletter subscribe subscription signup share "
                      "sharing social related recommended recommendations teaser widget widgets popup modal pagination "
                      "pager menu nav footer").split())
P_CLOSERS = frozenset(("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                       "h6 header hr main menu nav ol p pre section table ul").split())
#: A start tag of the key closes an open element of the values, up to the stop.
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def _attrs(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), "".join(values)) for name, *values in _ATTR.findall(attrs)]


def _skipped(tag: str, attrs: list, inside_article: bool, inside_section: bool) -> bool:
    """Whether tag or attributes name what is never the article."""
    if tag in SKIP or tag == "header" and not (inside_article or inside_section):
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if tag in ("html", "body", "main") or tag == "article" and not inside_article:
            continue
        if name in ("class", "role"):
            tokens = set(value.lower().split()) & (NAMED_CLASSES if name == "class" else NAMED_ROLES)
            if tokens - ({"comment"} if tag in INLINE else set()):
                return True
            if name == "class" and any(not NAMED_PARTS.isdisjoint(t) for t in _class_parts(value)) and inside_article:
                return True
        elif name == "id" and tag not in INLINE and tag not in HEADINGS and value.strip().lower() in NAMED:
            return True
    return False


def _hinted(tag: str, attrs: list) -> bool:
    """Whether a word of class, id or role hints at no part of the article."""
    return tag not in ("html", "body", "article", "main") and any(
        name in ("class", "id", "role") and
        not BOILERPLATE.isdisjoint(w.lower() for w in _NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
        for name, value in attrs)


def _class_parts(value: str) -> list[set]:
    """The words of each token of a class attribute that is made of several."""
    tokens = (set(map(str.lower, _NAME_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", t)))) for t in value.split())
    return [t for t in tokens if len(t) > 1]


def _doubtful(tag: str, attrs: list) -> bool:
    """Whether a compound class of a container names what may stand in an article without being part of it."""
    return tag not in INLINE and tag not in HEADINGS and tag != "p" and any(
        name == "class" and any(not DOUBTFUL.isdisjoint(t) for t in _class_parts(value)) for name, value in attrs)


class Node(NamedTuple):
    """A text node."""
    path: tuple          # tags from the root
    chain: tuple         # numbers of these elements
    block: int
    text: str
    region: bool         # inside article or main
    linked: bool         # inside a link
    hint: int | None     # number of the outermost hinted element around it, none opened inside article or main
    doubt: int | None    # number of the outermost doubtful element around it, opened inside article or main
    article: int | None  # number of the outermost article around it


def nodes_of(page: str) -> list[Node]:
    out: list = []
    stack: list[str] = []
    chain: list[int] = []
    n_elements, block, at, skip_depth, hint_depth, doubt_depth = 0, 0, 0, None, None, None

    def text_node(text: str) -> None:
        if skip_depth is None and text:
            region = "article" in stack or "main" in stack
            out.append(Node(tuple(stack), tuple(chain), block, html_lib.unescape(text), region, "a" in stack,
                            None if hint_depth is None else chain[hint_depth - 1],
                            None if doubt_depth is None else chain[doubt_depth - 1],
                            chain[stack.index("article")] if "article" in stack else None))

    def pop_to(i: int) -> None:
        nonlocal skip_depth, hint_depth, doubt_depth
        del stack[i:], chain[i:]
        if skip_depth is not None and len(stack) < skip_depth:
            skip_depth = None
        if hint_depth is not None and len(stack) < hint_depth:
            hint_depth = None
        if doubt_depth is not None and len(stack) < doubt_depth:
            doubt_depth = None
    while (m := _TOKEN.search(page, at)) is not None:
        text_node(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in stack:
                i = len(stack) - 1 - stack[::-1].index(tag)
                # an inline end tag doesn't close blocks
                if tag not in INLINE or all(t in INLINE for t in stack[i:]):
                    if tag not in INLINE and tag not in UNSEEN:
                        block += 1
                    pop_to(i)
            continue
        if tag not in INLINE and tag not in UNSEEN:
            block += 1
        if tag in P_CLOSERS and "p" in stack:
            i = len(stack) - 1 - stack[::-1].index("p")
            if not {"table", "td", "button", "object"} & set(stack[i:]):
                pop_to(i)
        if tag in SAME:
            closes, stops = SAME[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in stops:
                    break
                if stack[i] in closes:
                    pop_to(i)
                    break
        if tag == "br":
            text_node(" ")
        if tag in VOID or m[4]:
            continue
        inside = "article" in stack or "main" in stack
        section = "section" in stack
        stack.append(tag)
        chain.append(n_elements)
        n_elements += 1
        if skip_depth is None:
            attrs = _attrs(m[3]) if m[3] else ()
            if _skipped(tag, attrs, inside, section):
                skip_depth = len(stack)
            elif attrs and hint_depth is None and not inside and _hinted(tag, attrs):
                hint_depth = len(stack)
            elif attrs and doubt_depth is None and inside and _doubtful(tag, attrs):
                doubt_depth = len(stack)
        if tag in RAW:                             # no markup inside: on to its own end tag, or to the end
            end = _END[tag].search(page, at)
            at = end.start() if end else len(page)
    text_node(page[at:])
    return out


def _sums(nodes: list[Node], key) -> dict:
    """Per key of a node: nodes, characters, marks and linked characters."""
    sums: dict = {}
    for n in nodes:
        bare = _SPACE.sub(" ", n.text).strip()
        if bare:
            s = sums.setdefault(key(n), [0, 0, 0, 0])
            s[0] += 1
            s[1] += len(bare)
            s[2] += len(_PUNCT.findall(bare))
            s[3] += len(bare) if n.linked else 0
    return sums


def _fused(length: float, marks: float, link_share: float) -> float:
    return math.log1p(length) * (1 + math.log1p(marks)) * (1 - 0.9 * link_share)


def path_scores(nodes: list[Node]) -> dict[tuple, float]:
    """Fused, smoothed ratio of each tag path: text length and punctuation a node."""
    paths = _sums(nodes, lambda n: n.path)
    order = list(paths)
    length = [paths[p][1] / paths[p][0] for p in order]
    punct = [paths[p][2] / paths[p][0] for p in order]

    def smooth(x: list, kernel=(0.25, 0.5, 0.25)) -> list:
        out = []
        for i, p in enumerate(order):
            near = [(x[j], k) for j, k in zip((i - 1, i, i + 1), kernel)
                    if 0 <= j < len(x) and (j == i or order[j][:-1] == p[:-1] or order[j] == p[:len(order[j])]
                                            or p == order[j][:len(p)])]
            out.append(sum(v * k for v, k in near) / sum(k for _, k in near))
        return out
    return {p: _fused(a, b, paths[p][3] / paths[p][1]) for p, a, b in zip(order, smooth(length), smooth(punct))}


def _length(nodes) -> int:
    return sum(len(n.text.strip()) for n in nodes)


def article_nodes(nodes: list[Node], share: float, doubt_share: float = 0.6) -> list[Node]:
    """The nodes inside article or main that path ratios leave in.

    Those with hinted elements around them count if the others have less
    text.  Of several articles, one whose text, weighed by its paths' scores,
    is less than a share of the heaviest one's is a teaser.  A doubtful
    element (links to share, sign-up boxes, related posts) stays only if one
    of its paths, by its own ratios, scores near the best.
    """
    inside = [n for n in nodes if n.region]
    groups = [n for n in inside if n.hint is None], [n for n in inside if n.hint is not None]
    region = max(groups, key=_length)
    full = [n for n in region if n.text.strip()]
    scores = path_scores(full)
    best = max((scores[n.path] for n in full if n.doubt is None), default=0)
    own = _sums([n for n in full if n.doubt is not None], lambda n: (n.doubt, n.path))
    stays = {d for (d, _), (k, chars, marks, linked) in own.items()
             if _fused(chars / k, marks / k, linked / chars) >= doubt_share * best}
    weight: dict = {}
    for n in full:
        if n.doubt is None or n.doubt in stays:
            weight[n.article] = weight.get(n.article, 0) + scores[n.path] * len(n.text.strip())
    least = share * max((w for a, w in weight.items() if a is not None), default=0)
    return [n for n in region if (n.doubt is None or n.doubt in stays)
            and (n.article is None or weight.get(n.article, 0) >= least)]


def content_nodes(nodes: list[Node], share: float) -> list[Node]:
    """All nodes of the content region of a page without article and main.

    Paths from a share of the best score on are content; the region is the
    element that holds all their blocks, whole, and the elements beside it and
    beside those around it.  Of the latter, hinted ones without a content path
    and menus (mostly links, before or after all content, without a heading)
    are left out.
    """
    full = [n for n in nodes if n.text.strip()]
    scores = path_scores(full)
    bar = share * max((scores[n.path] for n in full if n.hint is None), default=max(scores.values()))
    good = [n for n in full if scores[n.path] >= bar]
    own = [n for n in good if n.hint is None] or good

    def around(n: Node) -> tuple:
        i = len(n.path)
        while i and n.path[i - 1] in INLINE:
            i -= 1
        return n.chain[:max(i - 1, 0)]

    top, tags = around(own[0]), own[0].path
    for n in own[1:]:
        a = around(n)
        k = next((i for i, (x, y) in enumerate(zip(top, a)) if x != y), min(len(top), len(a)))
        top = top[:k]
    while top and tags[len(top) - 1] in GROUPS:
        top = top[:-1]
    whole = bool(top) and tags[len(top) - 1] not in ("html", "body")
    inside = set(top)

    def beside(n: Node):
        """The element next to the region's that a node is in; None: in the region or in no such element."""
        if whole and n.chain[:len(top)] == top:
            return None
        return next((x for x, t in zip(n.chain, n.path) if x not in inside and t not in ("html", "body")), None)

    first, last = own[0].block, own[-1].block
    stats: dict = {}
    heads: dict = {}
    before = None
    for n in full:
        for key in {beside(n), n.hint} - {None}:
            s = stats.setdefault(key, [0, 0, False, n.block, n.block])
            s[0] += len(n.text.strip())
            s[1] += len(n.text.strip()) if n.linked else 0
            s[2] |= scores[n.path] >= bar
            s[4] = n.block
        key = beside(n)
        if key not in heads:
            heads[key] = before is not None and not HEADINGS.isdisjoint(before.path)
        before = n

    def menu(key, headed: bool) -> bool:
        chars, linked, good, start, end = stats[key]
        return 2 * linked >= chars and not good and not headed and (end < first or start > last)

    out = []
    for n in nodes:
        if whole and n.chain[:len(top)] == top:
            out.append(n)
            continue
        key = beside(n)
        if n.hint in stats and not stats[n.hint][2]:
            continue
        if key in stats and menu(key, heads.get(key, False)):
            continue
        out.append(n)
    return out


def main_text(page: str | None, share: float = 0.25) -> str:
    """The article's blocks in page order, joined by blank lines.

    Blocks of the article or main elements that path ratios choose; without
    these, of the region that holds the paths of a share of the page's best
    score.
    """
    if not page:
        return ""
    nodes = nodes_of(page)
    if any(n.region and n.text.strip() for n in nodes):
        nodes = article_nodes(nodes, share)
    elif any(n.text.strip() for n in nodes):
        nodes = content_nodes(nodes, share)
    blocks: dict[int, list] = {}
    for n in nodes:
        blocks.setdefault(n.block, []).append(n.text)
    out = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(text for text in out if text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(cols: dict) -> dict:
        texts = [main_text(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": list(map(len, texts))}
    return map_rows(pages.select("page_id", "url", "html"),
                    f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", run)
