"""Main text of web pages by composite text density of DOM nodes."""

from __future__ import annotations

import html
import math
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

# HTML's elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
            "tbody tfoot thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup header".split())
CLOSES_P = BLOCK - set("body caption html tbody tfoot thead tr".split())
SPACE = set("br td th option".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                  "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}}
LEFT_OUT = set("head script style noscript template iframe svg canvas button select textarea input object embed title xmp "
               "noembed noframes video audio".split())
ASIDE = set("nav aside footer form dialog menu".split())  # as header outside an article: left out unless they hold the article
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar "
                     "toolbar".split())
# Whole class names and ids, brought to lower case with hyphens and without a number at the end.
LEFT_OUT_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies reply cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations pagination pager toolbar widget widgets copyright disclaimer alert".split())
LEFT_OUT_NAMES |= {f"{a}-{b}" for a, bs in {
    "ad advert banner promo sponsor": "box slot unit banner container wrapper block",
    "cookie cookies consent gdpr": "notice banner bar consent popup modal overlay message dialog",
    "comment comments reply": "list section area box form respond thread wrapper container block",
    "share sharing social": "bar box buttons icons links list tools menu widget",
    "related recommended": "posts articles links stories items list content box",
    "newsletter subscribe subscription signup login": "form box banner popup modal signup",
    "nav navigation menu footer site page main top left right": "nav navigation menu navbar sidebar footer bar links",
    "sidebar": "left right primary secondary widget", "disqus": "thread", "modal popup": "overlay dialog window",
}.items() for a in a.split() for b in bs.split()}

# A name whose first or last part is one of these is that of reader comments, unless it only says whether there are any.
COMMENT_WORDS = set("comment comments commentlist commentary discussion discussions disqus feedback replies reply respond "
                    "responses talkback".split())
NOT_COMMENTS = set("closed count disabled enabled free no off on open without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|_+")
_NUMBER = re.compile(r"-?[0-9]+\Z")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "sum", "skip",
                 "aside", "inside", "talk")

    def __init__(self, tag: str, parent: "Node | None", skip: bool) -> None:
        self.tag, self.parent, self.skip, self.aside = tag, parent, skip, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ARTICLES)  # of an article or main element
        self.talk = parent is not None and parent.talk  # among reader comments
        self.children: list[Node] = []
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


ARTICLES = ("article", "main")
NO_TEXT, COMMENTS, BY_NAME, BY_TAG = 4, 3, 2, 1


def _is_comments(name: str) -> bool:
    parts = name.split("-")
    return not COMMENT_WORDS.isdisjoint((parts[0], parts[-1])) and NOT_COMMENTS.isdisjoint(parts)


def _left_out(tag: str, attributes: str, inside_article: bool) -> int:
    """Whether an element is never text (``NO_TEXT``), holds reader comments, is left out by name, role or as a form
    (``BY_NAME``), or by its tag."""
    if tag in LEFT_OUT:
        return NO_TEXT
    found = BY_NAME if tag == "form" else BY_TAG if tag in ASIDE or tag == "header" and not inside_article else 0
    if not attributes or tag in ("html", "body"):
        return found
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return NO_TEXT
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NO_TEXT
        if key in ("class", "id"):
            names = [_NUMBER.sub("", _CAMEL.sub("-", name).lower()) for name in value.split()]
            if any(map(_is_comments, names)):
                found = COMMENTS
            elif found < BY_NAME and tag not in ARTICLES and not LEFT_OUT_NAMES.isdisjoint(names):
                found = BY_NAME
        elif key == "role" and found < BY_NAME and tag not in ARTICLES and value.lower() in LEFT_OUT_ROLES:
            found = BY_NAME
    return found


class _Open:
    """The open elements, outermost first, and where those of each tag are."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def close(self, place: int) -> None:
        for node in self.nodes[place:]:
            self.places[node.tag].pop()
        del self.nodes[place:]


def parse(page: str) -> Node:
    """The tree of a page, its end tags completed as browsers do; what is not main text is marked to be skipped."""
    root = Node("html", None, False)
    open_, at, last_end = _Open(root), 0, page.rfind(">")

    def text(upto: int) -> None:
        if upto > at:
            open_.nodes[-1].parts.append(page[at:upto])

    while at <= last_end or page.startswith("<!--", page.find("<", at)):  # behind the last end of a tag there is only text
        match = _TOKEN.search(page, at)
        if match is None:
            break
        text(match.start())
        at = match.end()
        closing, tag, attributes = match.group(1), match.group(2), match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if place := open_.last((tag,)):
                open_.close(place)
            continue
        closed = CLOSED_BY_SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        bound = SCOPES.get(tag, set()) | {"table", "td", "th", "button", "article", "body"} - closed
        place = open_.last(closed)
        if place and place > open_.last(bound):
            open_.close(place)
        parent = open_.nodes[-1]
        node = Node(tag, parent, parent.skip)
        node.aside = _left_out(tag, attributes, node.inside)
        node.skip, node.talk = node.skip or node.aside == NO_TEXT, node.talk or node.aside == COMMENTS
        parent.children.append(node)
        parent.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if at <= last_end else None
            if tag in ("title", "textarea"):
                node.parts.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            open_.push(node)
    text(len(page))
    _skip_asides(root)
    return root


def _post_order(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(child for child in node.children if not child.skip)
    return order[::-1]


def _count(order: list[Node]) -> None:
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len(part) - part.count(" ") - part.count("\n")
            elif not part.skip:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1


def _unlinked(node: Node) -> int:
    return node.chars - node.link_chars


def _skip_asides(root: Node) -> None:
    """Skip what is beside the main text by name, role or tag, but never what holds it.

    An element is not skipped if it holds an article or main element, unless one outside it has more text beside it; nor,
    if its name or role is all that speaks against it, if it has most of the page's unlinked characters, unless such an
    element elsewhere has text. Articles among reader comments are comments, if there is any other; comments inside an
    article with text of its own are left out however long they are.

    Two passes: the largest article inside every node, children first; then, parents first, the largest one outside.
    """
    order = _post_order(root)
    if not any(node.aside for node in order):
        return
    _count(order)
    articles = [node for node in order if node.tag in ARTICLES and _unlinked(node) > 0]
    proper = {id(node) for node in articles if not node.talk} or {id(node) for node in articles}
    inside: dict[int, int] = {}
    for node in order:
        own = _unlinked(node) if id(node) in proper else 0
        inside[id(node)] = max([own, *(inside[id(child)] for child in node.children if not child.skip)])
    todo = [(root, 0, 0)]  # with the most text of an article that is neither inside nor above, and of one above
    while todo:
        node, elsewhere, above = todo.pop()
        if node.aside:
            within, beside = inside[id(node)], max(0, above - _unlinked(node))
            holds = within and within >= max(elsewhere, beside)
            most = node.aside in (BY_NAME, COMMENTS) and not elsewhere and 2 * _unlinked(node) > _unlinked(root)
            if not holds and (not most or node.aside == COMMENTS and beside):
                node.skip = True
                continue
        if id(node) in proper:
            above = max(above, _unlinked(node))
        children = [child for child in node.children if not child.skip]
        most_first = sorted((inside[id(child)] for child in children), reverse=True)[:2]
        for child in children:
            own = inside[id(child)]
            beside_child = most_first[1] if own == most_first[0] and len(most_first) > 1 else most_first[0] if own != most_first[0] else 0
            todo.append((child, max(elsewhere, beside_child), above))


def _density(root: Node, chars: float, tags: float, link_chars: float, link_tags: float) -> float:
    if not chars:
        return 0.0
    tags, links, other = max(1, tags), max(1, link_chars), max(1, chars - link_chars)
    base = math.log(chars * link_chars / other + root.link_chars / max(1, root.chars) * chars + math.e)
    ratio = chars / links * (tags / max(1, link_tags))
    return chars / tags * max(0.0, math.log(ratio)) / max(0.1, math.log(base))


def _density_at(root: Node, chars: int, node: Node | str) -> float:
    """Density of a node or text carried to at least so many characters: it grows with the size, whatever the text."""
    if isinstance(node, str):
        own, *rest = len("".join(node.split())), 1, 0, 0
    else:
        own, *rest = node.chars, max(1, node.tags), node.link_chars, node.link_tags
    return _density(root, *(n * max(1.0, chars / max(1, own)) for n in (own, *rest)))


def weigh(root: Node) -> list[Node]:
    """Set counts, composite densities and density sums; the nodes that count, children first.

    Density: characters per tag, times the logarithm of (characters / link characters) x (tags / link tags) to a base that
    grows with the share of link text in the node and in the page.
    """
    order = _post_order(root)
    _count(order)
    for node in order:
        node.density = _density(root, node.chars, node.tags, node.link_chars, node.link_tags)
        node.sum = sum(child.density for child in node.children if not child.skip)
    return order


def _copy(node: Node, parts: list[Node | str]) -> Node:
    copy = Node(node.tag, None, False)
    copy.parts = parts
    return copy


def _dense_parts(root: Node, parent: Node, own: Node, inner: Node, main: Node, threshold: float) -> list[Node | str]:
    """Parts of ``parent`` that belong to the main text if its child ``own``, reduced to ``inner``, does.

    These are the blocks and texts that are as dense as the threshold, what stands between them without being mainly
    links, and the headings before the first. A block without elements, or a bare text, is dense by being text at all: it
    must be half as dense as the ``main`` node, too.
    """
    parts = [part for part in parent.parts if isinstance(part, str) or not part.skip]

    def dense(part: Node | str) -> bool:
        plain = isinstance(part, str) or not part.tags
        return _density_at(root, main.chars, part) >= max(threshold, main.density / 2 if plain else 0) > 0

    kept = [i for i, part in enumerate(parts) if part is own or dense(part)]
    first, last = kept[0], kept[-1]
    at = first - 1
    while at >= 0 and (isinstance(parts[at], str) and not parts[at].strip() or getattr(parts[at], "tag", "") in HEADINGS):
        if not isinstance(parts[at], str):
            first = at
        at -= 1
    kept = set(kept)
    return [inner if part is own else part for i, part in enumerate(parts) if i in kept or first <= i <= last and (
        isinstance(part, str) or 2 * part.link_chars <= part.chars)]


def _dense_articles(root: Node, parent: Node, own: Node, inner: Node, main: Node, threshold: float) -> list[Node]:
    """``inner`` and, in page order, the other article and main elements in dense children of ``parent``."""
    out: list[Node] = []
    todo = [child for child in reversed(parent.children) if not child.skip]
    while todo:
        node = todo.pop()
        if node is own:
            out.append(inner)
        elif _density_at(root, main.chars, node) >= threshold > 0:
            if node.tag in ("article", "main"):
                out.append(node)
            else:
                todo.extend(child for child in reversed(node.children) if not child.skip)
    return out


def main_node(root: Node) -> Node:
    """The subtree of the largest density sum, widened to the ancestors that are as dense as the path to the body demands,
    and whatever else in the body is as dense.

    The threshold is the least density on the path from that node to the body. An ancestor below the body belongs to the
    main text while it exceeds it, and so does an enclosing article or main element. So do
    the children of every other ancestor, the body included, that reach it at the size of that node: with an article, only
    other articles. The result is a copy of the body that has these parts only.
    """
    order = weigh(root)
    best = max(reversed(order), key=lambda node: node.sum)  # the outermost and first of equals
    articles = [node for node in order if node.tag in ARTICLES]
    largest = max(articles, key=_unlinked, default=None)
    if largest is not None and 5 * _unlinked(largest) >= _unlinked(best) and _unlinked(largest) > 0:
        # With an article, the main text is in one or holds one. A teaser much smaller than another block is no article.
        holding = set()
        for node in articles:
            while node is not None and id(node) not in holding:
                holding.add(id(node))
                node = node.parent
        best = max((node for node in reversed(order) if node.inside or id(node) in holding), key=lambda node: node.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = next((i for i, node in enumerate(path) if node.tag == "body"), len(path) - 1)
    threshold = min(node.density for node in path[:body + 1])
    chosen = 0
    for i in range(1, body):
        if path[i].density > threshold and chosen == i - 1 or path[i].tag in ("article", "main"):
            chosen = i
    kept = main = path[chosen]
    dense = _dense_articles if main.tag in ("article", "main") else _dense_parts
    for i in range(chosen + 1, body + 1):
        kept = _copy(path[i], dense(root, path[i], path[i - 1], kept, main, threshold))
    return kept


def block_texts(node: Node) -> list[str]:
    """Texts of the node's blocks in page order, white space collapsed, empty ones left out."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if joined := " ".join("".join(line).split()):
            blocks.append(joined)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(html.unescape(part))
        elif not part.skip:
            block = part.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            elif part.tag in SPACE:
                line.append(" ")
                todo.append(" ")
            todo.extend(reversed(part.parts))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(block_texts(main_node(parse(page))))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``, from its whole html.

    ``text`` is the article: its blocks in page order, each with white space collapsed, joined by line feeds. Menus,
    headers, footers, sidebars, notices, adverts, forms and comments that their tag, role or a class name or id tells
    are left out unless they hold the main text, scripts, styles and hidden elements always. ``n_chars`` counts code points. A null or empty html, or one without text, gives an empty text; null ids and urls stay null. Repeated
    rows give repeated rows, no rows give none. Pages are independent: nothing is shuffled.
    """

    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return (pages.select("page_id", "url", texts(F.col("html")).alias("text"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
