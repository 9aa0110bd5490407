"""Main text of web pages by tree scoring.

A page becomes a tree.  Scripts, styles, navigation, headers, footers, asides and
hidden parts are left out.  So are forms and elements whose class, id or role names
boilerplate (adverts, notices, sidebars ...), unless an article or main lies within
them, or for forms, most of the page's paragraphs.  Within an article only the
plainest names count, and readers' comments go everywhere.  Every paragraph gives
points for its length and its commas to its ancestors, in full to the parent,
half to the grandparent and ever less above; a container's points are multiplied
by one minus its link density.  The best container gives way to the article, or
else main, around it, or else to its parents while these add only text with few
links.  It is kept whole, with its lists of links (but for several links before all
of its text where there is no article or main), and with the headings beside it, the siblings that score at least a fifth of it or are long
paragraphs with few links and, unless an article or main ends there, everything
else beside it that has few links.

Each kept block's text is decoded, its white space becomes single spaces, and
blocks are joined by one space in page order.  Null or empty html gives an empty
text.  Pages are handled one by one, whole and in time that grows with their length,
so repeated rows get equal values; an empty table gives an empty one.  Only the columns
in `keep` are carried, which must not be named text or n_chars.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import lean

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = RAW | frozenset("head nav header footer aside button select option svg canvas object dialog menu map audio video math fieldset label datalist".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre blockquote li td dd dt figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead"}, "option": {"option"}}
FENCES = frozenset("html body table ul ol dl div article section main td th blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
# Names of boilerplate in class and id; a name of several words counts if all of its words are listed, or fill.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond replies share sharing related "
    "recommended recommendations toolbar notice notices alert alerts pager pagination outbrain taboola tagcloud byline".split()
)
INSIDE_TOO = NAMED  # also within an article
OUTSIDE = NAMED | frozenset("header head foot discussion reply social warning disclaimer copyright legal search form hidden skip meta tags more stories".split())
FILLS = frozenset("a the site page main global top bottom left right side upper lower box block list section area wrapper wrap container bar inner outer item items unit slot zone link links button buttons icons post entry content user reader primary secondary mobile desktop header footer form menu text title body group row col".split())
REMARKS = frozenset("comment comments commentlist disqus respond replies".split())
NEVER = frozenset("html body article main".split())


@functools.lru_cache(maxsize=20_000)
def names_boilerplate(names: str, inside: bool) -> bool:
    """Does a class or id name boilerplate?  Words are parted at hyphens, underscores, digits and inner capitals."""
    listed = INSIDE_TOO if inside else OUTSIDE
    for name in names.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+", re.sub(r"\d+x\d+", "", name))]
        if "".join(words) in listed or any(w in listed for w in words) and all(w in listed or w in FILLS for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "parts", "skip", "doubt", "links", "chars", "score", "paragraphs")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, doubt: bool = False):
        self.tag, self.parent, self.skip, self.doubt = tag, parent, skip, doubt
        self.parts: list[Node | str] = []
        self.links = self.chars = self.paragraphs = 0
        self.score = 0.0


def boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """(left out at once, in doubt: left out unless the article turns out to be in it).  `inside`: within an article or main."""
    if tag in SKIPPED:
        return True, False
    doubt = tag == "form"
    if not attrs or tag in NEVER:
        return False, doubt
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if name == "role" and value.lower() in ROLES:
            doubt = True
        if name in ("class", "id") and names_boilerplate(value, inside):
            if inside or REMARKS & set(re.split(r"[\s_-]", value.lower())):
                return True, False
            doubt = True
    return False, doubt


def parse(html: str) -> Node:
    """The page's tree, boilerplate left out.  Unclosed paragraphs, list items and cells close as browsers close them."""
    root = here = Node("#root", None)
    at, end = 0, len(html)
    opened: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece and not here.skip:
            here.parts.append(piece)

    def up_to(node: Node) -> None:
        """Closes all elements below the node."""
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.parent

    def close(tags: set[str] | frozenset, fences: frozenset) -> None:
        """Closes the nearest open element of those tags, unless a fence stands before it."""
        if any(opened[t] for t in tags):
            look = here
            while look.parent is not None and look.tag not in fences and look.tag not in tags:
                look = look.parent
            if look.tag in tags:
                up_to(look.parent)

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "br":
                text(" ")
            if opened[tag]:
                look = here
                while look.tag != tag:
                    look = look.parent
                up_to(look.parent)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr") and not here.skip:
                here.parts.append("\n" if tag != "wbr" else "")
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in BLOCK or tag in SKIPPED or tag == "form":
            close({"p"}, FENCES)
        if tag in HEADING and here.tag in HEADING:
            up_to(here.parent)
        if tag in CLOSES:
            close(CLOSES[tag], frozenset(("table", "ul", "ol", "dl", "select")) - CLOSES[tag])
        out, doubt = (True, False) if here.skip else boilerplate(tag, m["attrs"], opened["article"] + opened["main"] > 0)
        node = Node(tag, here, out, doubt)
        if not node.skip:
            here.parts.append(node)
        opened[tag] += 1
        here = node
    return root


def settle(root: Node) -> None:
    """Leaves out the elements in doubt: all that hold no article or main, but forms with most of the page's paragraphs."""
    nodes = walk(root)
    if not any(n.doubt for n in nodes):
        return
    size, holds = {}, {}
    for n in reversed(nodes):
        kids = [p for p in n.parts if isinstance(p, Node)]
        own = sum(len(p.strip()) for p in n.parts if isinstance(p, str)) if n.tag in PARAGRAPH or n.tag not in BLOCK else 0
        size[n] = own + sum(size[k] for k in kids)
        holds[n] = n.tag in ("article", "main") or any(holds[k] for k in kids)
    for n in nodes:
        if n.doubt and not holds[n] and not (n.tag == "form" and 2 * size[n] > size[root]):
            n.parent.parts = [p for p in n.parent.parts if p is not n]


def walk(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        out.append(node := todo.pop())
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def around(node: Node | None, *tags: str) -> Node | None:
    """The nearest node with one of those tags, from the node up."""
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def below(node: Node | None, whole: Node | None) -> bool:
    while node is not None and node is not whole:
        node = node.parent
    return node is not None


def single_link(node: Node) -> bool:
    return sum(n.tag == "a" for n in walk(node)) == 1


def blocks(root: Node, whole: Node | None = None) -> list[str]:
    """Texts of the blocks below a node, in page order.

    Lists of links count within an article or main, and within `whole` behind its first text; several links that
    stand before all of its text, or anywhere else, do not.
    """
    out: list[str] = []
    run: list[str] = []
    begun = None  # how many blocks there were before `whole`

    def flush() -> None:
        if piece := " ".join(entities.unescape("".join(run)).split()):
            out.append(piece)
        run.clear()

    todo: list[Node | str | None] = [root]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag in ("ul", "ol", "table", "div") and part.links > 0.75 * part.chars > 0 and part is not whole and around(part, "article", "main") is None and not (
            begun is not None and below(part, whole) and (len(out) > begun or "".join(run).strip() or single_link(part))
        ):
            flush()  # a list of links
        else:
            if part is whole:
                flush()
                begun = len(out)
            block = part.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += reversed(part.parts)
    flush()
    return out


def measure(nodes: list[Node]) -> None:
    """Characters and linked characters of every node, points of every container."""
    for node in reversed(nodes):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        kids = [p for p in node.parts if isinstance(p, Node)]
        node.chars = own + sum(k.chars for k in kids)
        node.links = node.chars if node.tag == "a" else sum(k.links for k in kids)
        commas = sum(p.count(",") for p in node.parts if isinstance(p, str)) + sum(k.paragraphs for k in kids if k.tag not in BLOCK)
        node.paragraphs = commas  # commas of the node's own inline text
        inline = own + sum(k.chars for k in kids if k.tag not in BLOCK)
        if node.chars and inline > 0 and (node.tag in PARAGRAPH or node.tag in BLOCK and node.tag not in HEADING):
            points = (1 + commas + inline / 100) * (1 - node.links / node.chars)
            up, share = node.parent if node.tag in PARAGRAPH else node, 1.0
            while up is not None and up.tag != "#root" and share > 0.05:
                up.score += points * share
                up, share = up.parent, share / 2
    for node in nodes:
        if node.chars:
            node.score *= 1 - node.links / node.chars
            if node.tag in ("article", "main"):
                node.score *= 1.5


def container(best: Node) -> Node:
    """What to keep whole around the best node."""
    if (named := around(best, "article") or around(best, "main")) is not None:
        return named
    while best.parent.tag not in ("#root", "html", "body"):
        more, linked = best.parent.chars - best.chars, best.parent.links - best.links
        if more > 0 and linked >= 0.25 * more:
            break
        best = best.parent
    return best


def main_text(html: str | None) -> str:
    """The page's main text; empty where it has none."""
    if not html:
        return ""
    settle(tree := parse(html))
    nodes = walk(tree)
    measure(nodes)
    best = None
    for node in nodes:
        if node.tag in BLOCK and node.tag not in HEADING and node.score > 0 and (best is None or node.score > best.score):
            best = node
    if best is None:
        return " ".join(blocks(nodes[0]))
    box = container(best)
    open_ = box.tag not in ("article", "main") or around(box.parent, "article", "main") is not None  # what is beside may belong to it
    kept = Node("#kept", None)
    for sibling in box.parent.parts:
        if isinstance(sibling, str):
            keep = open_
        else:
            density = sibling.links / sibling.chars if sibling.chars else 1.0
            keep = sibling is box or sibling.tag in HEADING or sibling.score >= 0.2 * best.score or density < 0.25 and (open_ or sibling.tag == "p" and sibling.chars > 80)
        if keep:
            kept.parts.append(sibling)
    return " ".join(blocks(kept, box))


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, with text and n_chars (code points)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*keep, html).mapInArrow(lean(rows), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string, n_chars long"]))
