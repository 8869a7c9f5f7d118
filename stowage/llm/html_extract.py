"""Main-text extraction from HTML by tree scoring.

A lenient parser builds the element tree. Every paragraph passes points for its length and
commas to all its ancestors (all to the parent, half to the grandparent, half as much with every further step); an
element's points are discounted by the share of its text inside links and moved by what its
tag, class and id say. The best container is kept; where its siblings, or those of an ancestor, hold at least
half as much prose as it does, the ancestor stands for it. Siblings of what is kept stay too if they
score well, read like prose or are headings, quotations, lists, tables or figures with few links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are cut out before scoring. Where only a name of class or id says so,
the element stays, with points taken off, if another name calls it content, if it holds a main
or an article of some prose (not a card of links), or if it has `MUCH` characters outside links and few in them; reader comments stay
for a name only. If nothing is left of a page, it is read again without regard to names.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by a newline in page order.

Defined cases: null or empty html, and a page without text outside the parts cut out, give
the empty text; unclosed, crossed and unmatched tags are tolerated; ties go to the element
that opens first; each row is treated by itself, so repeated rows give repeated results.
Nothing is cut off: the whole page is read, however long, in time linear in its length.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
CUT = frozenset("nav footer aside form button select template svg math object canvas audio video map dialog menu datalist head script style noscript iframe textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Kinds of blocks that belong to the text around them unless they are made of links.
KEPT = HEADING | frozenset("blockquote pre ul ol dl table figure p".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
#: An opening tag closes an open element of these kinds, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BAD_NAMES = frozenset("ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus discussion footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Names of reader comments, which are long prose and often articles themselves.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
MUCH = 600
GOOD_NAMES = frozenset("article body content entry main page post story text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Quotes delimit a value only right after the equals sign; elsewhere they are characters of a name or of an unquoted value.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+)>?""")
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("children", "cut", "doubt", "length", "links", "name_weight", "parent", "points", "prose", "tag")

    def __init__(self, tag: str, parent: Node | None, cut: bool, name_weight: int) -> None:
        self.tag, self.parent, self.cut, self.name_weight = tag, parent, cut, name_weight
        self.children: list[Node | str] = []
        self.doubt = 0
        self.points = 0.0
        self.length = self.links = self.prose = 0


def _judged(tag: str, attrs: str) -> tuple[bool, int, int]:
    """(whether the element is cut out, how its class and id move its points, whether they speak against it: 1, or 2 for reader comments)."""
    if tag in CUT:
        return True, 0, 0
    if not attrs or tag in ("html", "body"):
        return False, 0, 0
    found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("role") in BAD_ROLES:
        return True, 0, 0
    each = [set(_NAME.findall(word)) for word in f"{found.get('class', '')} {found.get('id', '')}".split()]
    names = set().union(*each)
    if tag in ("article", "main") or not names & BAD_NAMES:
        return False, 25 * bool(names & GOOD_NAMES), 0
    if any(word & GOOD_NAMES and not word & BAD_NAMES for word in each):
        return False, 0, 0
    return False, -25, 2 if names & READERS else 1


def _settle(root: Node) -> None:
    """Cuts the elements that names speak against, unless what they hold speaks for them."""
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.cut)
    held: dict[Node, tuple[int, int, bool]] = {}  # characters, those in links, whether a main or an article of prose is inside
    for node in reversed(order):  # children before parents
        length, links, holds = sum(len(c.strip()) for c in node.children if isinstance(c, str)), 0, False
        for c in node.children:
            if isinstance(c, Node) and not c.cut:
                n, k, inside = held.pop(c)
                length, links, holds = length + n, links + k, holds or inside or c.tag == "main" or c.tag == "article" and n - k >= 100 and k <= 0.25 * n
        if node.tag == "a":
            links = length
        if node.doubt == 2 or node.doubt and not holds and (length - links < MUCH or links > 0.25 * length):
            node.cut, holds = True, False
            length = links = 0
        held[node] = length, links, holds


def parse(page: str, by_name: bool = True) -> Node:
    root = Node("#root", None, False, 0)
    stack, open_tags = [root], {"#root": 1}
    lower, at, n = "", 0, len(page)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            stack[-1].children.append(page[at : lt if lt >= 0 else n])
            if lt < 0:
                break
            at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, at)
        if m is None:
            stack[-1].children.append("<")
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if open_tags.get(tag, 0):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close_to(depth)
            elif tag == "br":
                stack[-1].children.append(" ")
            continue
        if tag in BLOCK and open_tags.get("p", 0):
            depth = len(stack) - 1
            while stack[depth].tag != "p":
                depth -= 1
            close_to(depth)
        if tag in CLOSES:
            kinds, stops = CLOSES[tag]
            if any(open_tags.get(k, 0) for k in kinds):
                depth = len(stack) - 1
                while depth and stack[depth].tag not in kinds and stack[depth].tag not in stops:
                    depth -= 1
                if stack[depth].tag in kinds:
                    close_to(depth)
        parent = stack[-1]
        if tag in RAW:
            lower = lower or page.lower()
            if len(lower) != n:  # a few characters change length when lower-cased
                lower = re.sub("[A-Z]", lambda c: c[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            at = n if end < 0 else end
            continue
        if tag == "br":
            parent.children.append(" ")
            continue
        if tag in VOID:
            continue
        cut, weight, doubt = _judged(tag, m[3])
        node = Node(tag, parent, cut or parent.cut, weight)
        node.doubt = doubt
        parent.children.append(node)
        if not m[3].endswith("/") or tag in BLOCK:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if by_name:
        _settle(root)
    return root


def _walk(root: Node) -> list[Node]:
    """Elements that are not cut out, parents before children, in page order."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return found


def blocks(node: Node) -> list[str]:
    """The texts of the blocks inside an element, in page order."""
    out, part, todo = [], [], [node]

    def flush() -> None:
        text = " ".join(_html.unescape("".join(part)).split())
        part.clear()
        if text:
            out.append(text)

    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif not x.cut:
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def _score(root: Node) -> list[Node]:
    nodes = _walk(root)
    for node in reversed(nodes):  # children before parents
        own = "".join(c for c in node.children if isinstance(c, str))
        direct = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.length += len(own.strip())
        if node.tag == "a":
            node.links = node.length
        passed = node.points  # what the children passed to this element
        if node.length >= 25 and (node.tag in PARAGRAPH - {"li", "dd"} or (node.tag in ("div", "section", "article", "main", "body", "li", "dd") and direct >= 25)):
            text = "".join(c if isinstance(c, str) else " " for c in node.children)
            commas = text.count(",") + text.count("、") + text.count("，")
            points = (1 + commas + min(node.length / 100, 3)) * (1 - node.links / node.length)
            node.prose = node.length - node.links
            if node.tag not in PARAGRAPH:
                node.points += points  # text of its own: its own container
                points /= 2
        else:
            points = 0.0
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.links += node.links
            node.parent.prose += node.prose
            node.parent.points += points + passed / 2
    return nodes


def _value(node: Node) -> float:
    if not node.points:
        return 0.0
    extra = {"article": 25, "main": 25, "section": 3, "div": 3, "td": 1}.get(node.tag, 0) + node.name_weight
    return (node.points + extra) * (1 - node.links / max(node.length, 1))


def main_text(page: str | None) -> str:
    """The main text of a page (see the module's text)."""
    if not page:
        return ""
    return _main_text(parse(page)) or _main_text(parse(page, by_name=False))


def _belongs(c: Node, top: float) -> bool:
    """Whether a sibling of the best container is kept."""
    if not c.length:
        return False
    density = c.links / c.length
    return (c.tag in KEPT and density < 0.33) or _value(c) >= max(0.2 * top, 1) or (c.prose >= 80 and density < 0.25)


def _main_text(root: Node) -> str:
    nodes = _score(root)
    best, top = None, 0.0
    for node in nodes:
        if node.tag not in ("#root", "html") and (v := _value(node)) > top:
            best, top = node, v
    if best is None:  # no paragraph: an article, else the whole page without links
        found = next((x for x in nodes if x.tag in ("article", "main") and x.length), None) or next((x for x in nodes if x.tag == "body"), root)
        return "\n".join(blocks(found))
    up, path = best.parent, best
    while up is not None:  # a container inside an article or main stands for it, and so does one of several that share the prose
        if up.tag in ("article", "main") and up.links <= 0.5 * max(up.length, 1):
            best = up
            top = max(top, _value(up))
        elif up.tag not in ("body", "html", "#root"):
            beside = sum(c.prose for c in up.children if isinstance(c, Node) and not c.cut and c is not path and c.links < 0.25 * max(c.length, 1))
            if 2 * beside >= max(path.prose, 1) and up.links <= 0.25 * max(up.length, 1):
                best = up
        up, path = up.parent, up
    if best.parent is None or best.tag in ("article", "main", "body"):
        also = [best] if best.tag != "article" or best.parent is None else [c for c in best.parent.children if isinstance(c, Node) and not c.cut and (c is best or c.tag == "article" and _value(c) >= 0.2 * top)]
        return "\n".join(t for x in also for t in blocks(x))
    out: list[str] = []
    run = Node("span", None, False, 0)  # text and inline elements between the blocks

    def flush() -> None:
        if len("".join(found := blocks(run))) >= 25 and run.links < 0.25 * run.length:
            out.extend(found)
        run.children, run.length, run.links = [], 0, 0

    for c in best.parent.children:
        if c is not best and (isinstance(c, str) or not c.cut and c.tag not in BLOCK):
            run.children.append(c)
            run.length += len(c.strip()) if isinstance(c, str) else c.length
            run.links += 0 if isinstance(c, str) else c.links
            continue
        flush()
        if not c.cut and (c is best or _belongs(c, top)):
            out += blocks(c)
    flush()
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
