"""Main text of web pages by tree scoring.

A page becomes a light tree. Every paragraph passes points to the containers above it: one, one for each comma, and one
for each 100 characters up to three; the parent takes them whole, the grandparent half, and the next one a third. A
container's score is discounted by its link density, and names that speak of content or of page furniture move it. The
best container and the siblings that are like it are kept; their blocks become the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option optgroup datalist fieldset label input svg math canvas object audio video map dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ITEMS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("html body table td th caption button article section div main aside nav header footer form blockquote li ul ol".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
# Words in class and id names that mark page furniture, and those that mark content.
FURNITURE = re.compile(r"(?:^|[-_ ])(?:ads?|adv|advert\w*|adsense|adslot|adbox|adunit|banner\w*|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|pop-up|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|paywall|comment\w*|disqus|respond|replies|reply|discussion|reactions|sidebar\w*|side|rail|widget\w*|related\w*|recommend\w*|more-stories|trending|popular|share\w*|sharing|social\w*|follow|nav\w*|menu\w*|breadcrumb\w*|crumbs|pagination|pager|toolbar|masthead|topbar|site-?header|page-?header|header|site-?footer|page-?footer|footer|foot|copyright|legal|disclaimer|skip|search\w*|form|tags|tagcloud|byline-social|rating|poll|print|hidden|outbrain|taboola)(?=$|[-_ ])", re.I)
LAYOUT = re.compile(r"(?:no|has|with|without|is|js|two|one)[-_]|(?:article|entry|post|story|content)[-_]*(?:header|head|title|text|body|content|main)$", re.I)
CONTENT = re.compile(r"article|content|post|entry|story|main|body|text|blog|page", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
NUMBER = re.compile(r"(&#)0*([0-9]{1,8})[0-9]*")
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BLOCK_END = object()


class Node:
    __slots__ = ("children", "dropped", "hint", "name", "parent", "score")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, hint: str = ""):
        self.name, self.parent, self.dropped, self.hint = name, parent, dropped, hint
        self.children: list[Node | str] = []
        self.score = 0.0


def _is_furniture(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is page furniture by its role, visibility or names; and its class and id."""
    if not attributes or attributes.isspace():
        return False, ""
    found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attributes)}
    hint = f"{found.get('class', '')} {found.get('id', '')}".strip()
    if name in ("html", "body"):
        return False, hint
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    named = hint and any(FURNITURE.search(x) for x in hint.split() if not LAYOUT.match(x))
    furniture = found.get("role", "").lower() in ROLES or bool(named)
    return bool(hidden or furniture), hint


class Scanner:
    """Finds the end of markup in time proportional to the page, however broken the page is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # quotes from which, were they opening ones, no tag ends

    def _tag_end(self, at: int) -> int:
        """The place of the sign that ends a tag whose attributes begin at ``at``: the first outside of quotes or, where
        quotes leave none, the first at all."""
        page, passed, now = self.page, [], at
        while True:
            now = PLAIN.match(page, now).end()
            if now == len(page) or now in self.dead:
                break
            if page[now] == ">":
                return now
            passed.append(now)
            now = page.find(page[now], now + 1) + 1
            if not now:
                break
        self.dead.update(passed)
        return page.find(">", at)

    def markup(self, lt: int) -> tuple[int, bool, str, str] | None:
        """What stands at a ``<``: where it ends, whether it is an end tag, its name (empty: a comment or the like) and its
        attributes. None if the sign is text."""
        page = self.page
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                return page.index(">", lt) + 1, False, "", ""
            m = COMMENT_END.search(page, lt + 4)
            return (m.end() if m else len(page)), False, "", ""
        if lt > self.last:
            return None
        closing = page.startswith("/", lt + 1)
        m = NAME.match(page, lt + 1 + closing)
        if m:
            end = self._tag_end(m.end())
            return end + 1, closing, m[0], page[m.end() : end]
        if closing or page.startswith(("!", "?"), lt + 1):
            return page.index(">", lt) + 1, False, "", ""
        return None


class Open:
    """The open elements, with the places of each name among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes, self.cleared = [root], {}, [0], 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        if node.name in SCOPES:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, name: str) -> int:
        """Where the innermost open element of that name stands; -1 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def cut(self, at: int) -> None:
        """Closes the element at a place and all that are inside of it."""
        for node in self.nodes[at:]:
            self.places[node.name].pop()
        del self.nodes[at:]
        while self.scopes[-1] >= at:
            self.scopes.pop()
        self.cleared = min(self.cleared, at)

    def keep_all(self) -> None:
        """What holds the main element isn't furniture, whatever it is called."""
        for node in self.nodes[self.cleared :]:
            node.dropped = node.dropped and node.name in DROPPED
        self.cleared = len(self.nodes)


def parse(page: str) -> Node:
    """The tree of a page. Unclosed paragraphs and items end where the standard ends them; stray end tags are passed over."""
    root = Node("html", None)
    at, top, end = 0, root, len(page)
    scanner, held = Scanner(page), Open(root)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            top.children.append(page[at:])
            break
        if lt > at:
            top.children.append(page[at:lt])
        found = scanner.markup(lt)
        if not found:
            top.children.append("<")  # a bare sign is text
            at = lt + 1
            continue
        at, closing, name, attributes = found
        if not name:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                top.children.append(" ")
            elif name == "p" and held.last("p") < 0:
                top.children.append(Node("p", top))
            else:
                k = held.last(name)
                if k > 0 and (name in BLOCK or k >= held.scopes[-1]):  # an inline end tag doesn't close containers
                    held.cut(k)
                top = held.nodes[-1]
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            k = held.last("p")
            if k > held.scopes[-1]:
                held.cut(k)
            if name in HEADINGS and held.nodes[-1].name in HEADINGS:
                held.cut(len(held.nodes) - 1)
        elif name in ITEMS:
            ends, within = ITEMS[name]
            floor = max(map(held.last, within))
            while (k := max(map(held.last, ends))) > max(floor, 0):
                held.cut(k)
                if name not in ("tr", "tbody", "thead", "tfoot"):
                    break
        top = held.nodes[-1]
        if name == "br":
            top.children.append(" ")
            continue
        furniture, hint = _is_furniture(name, attributes)
        node = Node(name, top, furniture or name in DROPPED, hint)
        top.children.append(node)
        if name == "main" and not furniture:
            held.keep_all()
        if name in RAW:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
            held.push(node)
            top = node
    return root


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    if "&#" in text:
        text = NUMBER.sub(r"\1\2", text)  # a number of more digits is beyond all characters, as its first eight are
    return " ".join(html.unescape(text).split())


def blocks(node: Node, within: frozenset[int] | None = None) -> list[str]:
    """The node's blocks of text in page order, white space collapsed; furniture is left out."""
    out: list[str] = []
    line: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is BLOCK_END:
            if line:
                if text := _clean(line):
                    out.append(text)
                line = []
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped or x is node:
            if x.name in BLOCK:
                stack.append(BLOCK_END)
                stack.extend(reversed(x.children))
                stack.append(BLOCK_END)
            else:
                stack.extend(reversed(x.children))
    if line and (text := _clean(line)):
        out.append(text)
    return out


def _measure(node: Node, sizes: dict[int, tuple[int, int, int]]) -> None:
    """Characters, characters in links and commas below every node, furniture left out."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str) and not c.dropped)
    for x in reversed(order):
        chars = links = commas = 0
        for c in x.children:
            if isinstance(c, str):
                chars += len(c) - (0 if not c.isspace() else len(c))
                commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.dropped:
                a, b, d = sizes[id(c)]
                chars, links, commas = chars + a, links + b, commas + d
        sizes[id(x)] = (chars, chars if x.name == "a" else links, commas)


def _has_title(node: Node) -> bool:
    """Whether a heading of the first rank stands below a node, outside of furniture."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.name == "h1":
            return True
        stack.extend(c for c in x.children if not isinstance(c, str) and not c.dropped)
    return False


def extract(page: str | None) -> str:
    """The main text of a page, blocks joined by one line feed; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    sizes: dict[int, tuple[int, int, int]] = {}
    _measure(root, sizes)
    candidates: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        x = stack.pop()
        kids = [c for c in x.children if not isinstance(c, str) and not c.dropped]
        stack.extend(kids)
        loose = x.name in ("div", "section", "article", "main", "html") and any(isinstance(c, str) and not c.isspace() for c in x.children)
        if x.name in PARAGRAPHS or loose:
            chars, links, commas = sizes[id(x)]
            if chars < 25 or (loose and x.name not in PARAGRAPHS and any(c.name in BLOCK for c in kids)):
                continue
            points = (1 + commas + min(3, chars // 100)) * (1 - links / chars)
            up, share = (x if loose else x.parent), 1.0
            for level in range(3):
                if up is None:
                    break
                if up.score == 0:
                    candidates.append(up)
                up.score += points * share
                up, share = up.parent, (0.5, 1 / 3, 0)[level]
    if not candidates:
        # nothing scores: what short text is left outside of furniture
        return "\n".join(blocks(root))

    def final(x: Node) -> float:
        chars, links, _ = sizes[id(x)]
        named = 1.25 if x.name in ("article", "main") or CONTENT.search(x.hint) else 1.0
        return x.score * (1 - links / max(chars, 1)) * named

    best = max(candidates, key=final)
    top = final(best)
    # an article or main element around the best container is the article as a whole; so is a parent that scores as well
    up = best.parent
    while up is not None and up.parent is not None:
        if up.name in ("article", "main") or final(up) >= 0.75 * top:
            best, top = up, max(top, final(up))
        up = up.parent
    holder = best.parent
    if holder is None or best.name in ("article", "main") and sum(not isinstance(c, str) and c.name == best.name and not c.dropped for c in holder.children) == 1:
        return "\n".join(blocks(best))
    out: list[str] = []
    bar, passed = 0.1 * top, False
    for c in holder.children:
        if isinstance(c, str):
            continue
        if c is best:
            passed = True
            out.extend(blocks(c))
        elif not c.dropped:
            chars, links, _ = sizes[id(c)]
            density = links / max(chars, 1)
            alike = c.score > 0 and density < 0.5 and final(c) + (bar if c.hint and c.hint == best.hint else 0) >= bar
            prose = c.name in ("p", "pre", "blockquote") and (chars > 80 and density < 0.25 or 0 < chars <= 80 and links == 0)
            title = (c.name in ("h1", "h2", "h3") or not passed and _has_title(c)) and chars > 0 and density < 0.25
            if alike or prose or title:
                out.extend(blocks(c))
    return "\n".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    A null or empty page, and one without text, gives an empty text; null and repeated ids keep their rows; an empty table
    gives an empty result; other columns are ignored. Pages are parsed whole and nothing is capped.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    """``main_text`` over the whole ``pages`` table."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
