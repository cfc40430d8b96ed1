"""Operator 10, HTML extraction by tree scoring.

A lenient parser builds the element tree of a whole page. Every paragraph scores one point, one per
comma and one per hundred characters (three at most), and passes them to its ancestors: all to the parent, half to the
grandparent, a third to the next, and so on; to the nearest ``article`` or ``main`` all of them and a quarter more,
as such an element says that it is the text. A container's score is discounted by its link density. The best container is
kept whole with those siblings that score well enough or read as prose: no paragraph, list or label within it is dropped for its
links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out
wherever they stand, by their element or role.

Names in ``class`` and ``id`` are weaker signs. A name is a mark if every part of it is one or says nothing by itself
(``ad``, ``side-menu``, ``comment-list``; not ``has-sidebar``, ``no-comments`` or ``related-work``). A marked element is left out
unless it wraps the text: holds half of the points of the page or more, in several paragraphs or with an article or a heading in it.

Defined cases: null or empty html gives the empty text; a page cut off in the middle is read as far as
it goes (a tag cut off at the end is dropped); of equal scores the first container in page order wins; very long and very
deep pages are read whole; null ids, null urls and repeated pages are kept; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Roles of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHOLE = HEADINGS | {"article", "main"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
# What is never part of an article, by element and by role.
LEFT_OUT = set("nav footer aside form script style noscript iframe svg button input select textarea template dialog menu head title canvas video audio datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Parts of names that mark such an element, and parts that say nothing beside them.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted promotion banner sidebar sidenav aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager skip hidden copyright outbrain taboola".split()
)
NEUTRAL = set("area bar block box bottom button buttons col column container content desktop div form global group header holder icons inner item items left link links list main message mobile module outer page panel post posts primary right row secondary section side site slot small strip text thread top unit wrap wrapper zone".split())
COMMENT_MARKS = {"comment", "comments", "commentlist", "disqus", "respond"}


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "marked", "score", "points", "chars", "linked", "parts")

    def __init__(self, tag: str, parent: Node | None, out: bool, marked: bool = False):
        self.tag, self.parent, self.out, self.marked = tag, parent, out, marked
        self.kids: list[Node | str] = []
        self.score = self.points = 0.0
        self.chars = self.linked = self.parts = 0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _marks(names: str, marks: set[str]) -> bool:
    """Whether a name in a list of names has a mark and nothing else that means something."""
    for name in names.split():
        parts = {p.lower() for p in _PART.findall(name) if not p.isdigit()}
        if parts & marks and parts <= MARKS | NEUTRAL:
            return True
    return False


def _signs(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out with all that it holds, and whether its names mark it."""
    if tag in LEFT_OUT or tag == "header" and not inside_article:
        return True, False
    if not attrs.strip() or tag in ("html", "body", "main"):
        return False, False
    found = {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(attrs)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or found.get("role", "").lower() in ROLES:
        return True, False
    names = found.get("class", "") + " " + found.get("id", "")
    if tag == "article":
        return False, _marks(names, COMMENT_MARKS)
    return False, _marks(names, MARKS) or not inside_article and tag not in HEADINGS and _marks(names, {"header"})


def parse(page: str) -> Node:
    """The element tree; implied end tags are supplied, raw text is dropped, character references are decoded."""
    root = Node("#root", None, False)
    stack, articles, at, size = [root], 0, 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            articles -= stack.pop().tag in ("article", "main")

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].kids.append(html.unescape(page[a:b]))

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[0][-1] != ">":
            continue
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(Node("br", stack[-1], False))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if stack[depth].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in IMPLIED:
            ends, scope = IMPLIED[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends:
                    pop_to(depth)
                    break
                if stack[depth].tag in scope:
                    break
        node = Node(tag, stack[-1], *_signs(tag, m[3] or "", articles > 0))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCK - VOID:
            stack.append(node)
            articles += tag in ("article", "main")
    return root


def _walk(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        order.append(node)
        pending += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.out]
    return order


def _count(order: list[Node]) -> None:
    """Characters, linked characters and points of each node, its own and those below it."""
    commas: dict[int, int] = {}
    for node in reversed(order):
        own = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
        inner = [k for k in node.kids if isinstance(k, Node) and not k.out]
        node.chars = len(own) + sum(k.chars for k in inner)
        node.linked = node.chars if node.tag == "a" else sum(k.linked for k in inner)
        commas[id(node)] = sum(own.count(c) for c in ",،、，") + sum(commas.pop(id(k)) for k in inner)
        node.points, node.parts = sum(k.points for k in inner), sum(k.parts + 2 * (k.tag in WHOLE) for k in inner)
        if _is_paragraph(node, own, inner):
            node.points += (1 + commas[id(node)] + min(node.chars / 100, 3)) * (1 - node.density())
            node.parts += 1


def _is_paragraph(node: Node, own: str, inner: list[Node]) -> bool:
    prose = node.tag in PARAGRAPHS or node.tag in BLOCK and own and not any(k.tag in BLOCK for k in inner)
    return bool(prose and node.chars and node.tag not in HEADINGS and not any(k.tag in PARAGRAPHS for k in inner))


def _score(order: list[Node]) -> None:
    """Points of paragraphs passed to their ancestors."""
    for node in order:
        given = node.points - sum(k.points for k in node.kids if isinstance(k, Node) and not k.out)
        if given > 1e-9:
            up, share, said = node.parent, 1, False
            while up is not None:
                if up.tag in ("article", "main") and not said:
                    up.score += 1.25 * given
                    said = True
                else:
                    up.score += given / share
                up, share = up.parent, share + 1


def _keep_sibling(node: Node, score: float) -> bool:
    if node.tag in HEADINGS or node.tag in ("header", "hgroup"):
        return node.chars > 0 and node.density() < 0.5
    if node.score * (1 - node.density()) >= max(2.0, 0.2 * score):
        return True
    return node.tag in PARAGRAPHS and node.density() < 0.25 and node.chars > 80


def _blocks(node: Node, out: list[str], line: list[str]) -> None:
    """Text blocks below a node, in page order; ``line`` is the block being gathered."""

    def flush() -> None:
        block = " ".join("".join(line).split())
        line.clear()
        if block:
            out.append(block)

    pending: list[tuple[Node | str | None, bool]] = [(node, True)]
    while pending:
        kid, enter = pending.pop()
        if isinstance(kid, str):
            line.append(kid)
            continue
        if not enter:
            flush()
            continue
        if kid.out:
            line.append(" ")
            continue
        if kid.tag == "br":
            line.append(" ")
        block = kid.tag in BLOCK
        if block:
            flush()
            pending.append((kid, False))
        pending += [(k, True) for k in reversed(kid.kids)]
    flush()


def extract(page: str | None) -> str:
    """Main text of a page."""
    if not page:
        return ""
    root = parse(page)
    order = _walk(root)
    _count(order)
    whole = root.points
    for node in order:
        if node.marked and (2 * node.points < whole or node.parts < 2):
            node.out = True
    order = _walk(root)
    _count(order)
    _score(order)
    rank = lambda n: n.score * (1 - n.density())
    best = max((n for n in order if n.tag in BLOCK and n.tag != "html"), key=rank, default=root)
    if not best.score:
        best = next((n for n in order if n.tag in ("article", "main")), next((n for n in order if n.tag == "body"), root))
    score, out = rank(best), []
    around = [best] if best.parent is None or best.tag in ("body", "article", "main") and not _peers(best) else [k for k in best.parent.kids if isinstance(k, Node) and not k.out]
    for node in around:
        if node is best or _keep_sibling(node, score):
            _blocks(node, out, [])
    return "\n\n".join(out)


def _peers(best: Node) -> bool:
    """Whether the container has siblings of its own kind, as the parts of one text may be."""
    return any(isinstance(k, Node) and k is not best and k.tag == best.tag and not k.out for k in best.parent.kids)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""

    @F.pandas_udf("string")
    def main_text(page: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in page], dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark, sf_dir: str) -> DataFrame:
    """Query: main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
