"""Main text of web pages by a graphical model on the tree of their nodes.

The nodes are block elements and, as leaves, the blocks of text inside them. Each node is content or not. A child's state
depends on its parent's by the child's kind, and a node's tag, class words and text shape depend on its state. Sum-product
messages go up the tree and down again and give every node's marginal; the text blocks that are content more likely than
not are the article. The tables are maximum-likelihood counts over labelled pages, which :func:`labelled_pages` makes from
a seed in many layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, strings

#: Labelled pages that the tables are counted on, and the seed that makes them.
PAGES, SEED = 600, 5
#: Added to every count.
SMOOTH = 0.5

# Fixed values of HTML: elements without an end, elements whose text isn't shown, those of them that hold no tags, inline
# elements (embedded ones with their words among them, and the elements of formulas and drawings).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe textarea select datalist".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "audio canvas map object optgroup option picture video "
    "math annotation mfrac mi mn mo mover mpadded mphantom mroot mrow ms msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
    "svg circle defs desc ellipse g line path polygon polyline rect text textpath tspan use".split()
)
#: A start tag closes open elements of these tags, up to the nearest of the second list.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

#: What follows the ``<`` of a tag: the slash of an end tag, the name, and the attributes up to ``>``, which may be quoted.
_TAG = re.compile(r"""(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMED = re.compile(r"(/?+)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """An element, or a block of text if ``tag`` is empty."""

    tag: str
    names: tuple[str, ...] = ()
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""
    link_chars: int = 0
    chars: int = 0
    label: int | None = None


class _Reader:
    """The tags of a page from left to right, in time that is linear in the page however broken it is."""

    def __init__(self, page: str):
        self.page, self.place, self.quoted = page, 0, True
        self.ends: dict[str, re.Pattern] = {}
        self.none: set[str] = set()  # elements that no end tag follows any more

    def next(self) -> tuple[str, str, str, str] | None:
        """The text before the next tag, its slash, name (empty for a comment or the like) and attributes; None after the last."""
        page, start = self.page, self.place
        at = start
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return self._out(start, at, len(page) if end < 0 else end + 3)
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                inside = page[at + 9 : len(page) if end < 0 else end].replace("&", "&amp;")
                before = page[start:at] + inside
                self.place = len(page) if end < 0 else end + 3
                return before, "", "", ""
            if page[at + 1 : at + 2] in ("!", "?"):
                if (end := page.find(">", at + 2)) >= 0:
                    return self._out(start, at, end + 1)
                break
            # A quote that never ends is tried once a page; after it tags end at the first ``>``.
            if self.quoted and _NAMED.match(page, at + 1):
                if m := _TAG.match(page, at + 1):
                    return self._out(start, at, m.end(), m[1], m[2].lower(), m[3])
                self.quoted = False
            if m := _NAMED.match(page, at + 1):
                if (end := page.find(">", m.end())) < 0:
                    break
                return self._out(start, at, end + 1, m[1], m[2].lower(), page[m.end() : end])
            at += 1
        return None

    def _out(self, start: int, at: int, place: int, slash: str = "", name: str = "", rest: str = "") -> tuple[str, str, str, str]:
        self.place = place
        return self.page[start:at], slash, name, rest

    def skip(self, name: str) -> None:
        """Go past the end tag of an element whose text isn't shown. A head ends before a body at the latest. An element
        without an end hides nothing, but for the rest of a script or style up to what looks like a tag."""
        page, m = self.page, None
        if name not in self.none:
            pattern = self.ends.get(name)
            if pattern is None:
                pattern = self.ends[name] = re.compile(r"</head(?![^\s/>])|<body(?![^\s/>])" if name == "head" else rf"</{name}(?![^\s/>])", re.IGNORECASE)
            m = pattern.search(page, self.place)
        if m is None:
            self.none.add(name)
            if name in RAW:
                tag = re.compile(r"<[a-zA-Z/!]").search(page, self.place)
                self.place = tag.start() if tag else len(page)
        elif page[m.start() + 1] != "/":
            self.place = m.start()
        else:
            end = page.find(">", m.end())
            self.place = len(page) if end < 0 else end + 1


def parse(page: str) -> Node:
    """The tree of block elements and text blocks of a page; never fails on malformed markup."""
    root = at = Node("html")
    stack: list[tuple[str, Node | None]] = []  # open elements; inline ones have no node
    opened: Counter = Counter()  # how many of each are open
    parts: list[str] = []
    linked, in_link, reader = 0, 0, _Reader(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                at.children.append(Node("", (), at, [], text, min(linked, len(text)), len(text)))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal at, in_link
        for tag, node in reversed(stack[k:]):
            opened[tag] -= 1
            if node is not None:
                flush()
                at = node.parent
            elif tag == "a":
                in_link = max(0, in_link - 1)
        del stack[k:]

    def end_of(tag: str) -> None:
        """Close the nearest open element of that tag; an inline one only above the last block."""
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                close(k)
                return
            if tag in INLINE and stack[k][1] is not None:
                return

    while (found := reader.next()) is not None:
        text, closing, tag, rest = found
        if text:
            parts.append(text)
            linked += len(text) if in_link else 0
        if not tag:
            continue
        if closing:
            if tag == "br":
                parts.append(" ")
            end_of(tag)
            continue
        if tag in UNSEEN:
            if tag in RAW or not rest.endswith("/"):
                reader.skip(tag)
            if tag not in ("script", "style", "template"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE and not (tag in ("label", "ins") or _marked(rest)):
            if not rest.endswith("/") or tag == "a":
                stack.append((tag, None))
                opened[tag] += 1
                in_link += tag == "a"
            continue
        if opened["p"] and tag not in INLINE:  # a block ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][1] is not None and stack[k][0] in ("article", "section", "div", "td", "li", "body", "button", "table"):
                    break
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            ends, stops = CLOSES[tag]
            low = len(stack)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stops:
                    break
                if stack[k][0] in ends:
                    low = k
            close(low)
        flush()
        names = tuple(dict.fromkeys(x.lower() for a in _ATTRIBUTE.finditer(rest) for x in _NAME.findall(a[2])))
        node = Node(tag, names, at)
        at.children.append(node)
        stack.append((tag, node))
        opened[tag] += 1
        at = node
    parts.append(page[reader.place :])
    linked += (len(page) - reader.place) if in_link else 0
    close(0)
    flush()
    return root


#: Class words that make a node of an inline element, because they tell what it is.
_TELLING = frozenset("ad ads advert advertisement sponsored promo comment comments nav menu sidebar footer header banner cookie notice share social".split())


def _marked(rest: str) -> bool:
    return bool(rest) and any(x.lower() in _TELLING for a in _ATTRIBUTE.finditer(rest) for x in _NAME.findall(a[2]))


def kind(node: Node) -> str:
    """What the table of transitions goes by."""
    return node.tag or "text"


def observations(node: Node) -> list[str]:
    """What a node shows of its state: tag and class words of an element; length, links and sentence shape of a text."""
    if node.tag:
        return ["tag:" + node.tag, *("name:" + x for x in node.names)]
    size = min(int(math.log2(node.chars + 1)), 10)
    link = 4 * node.link_chars // max(node.chars, 1)
    stops = sum(map(node.text.count, ".!?,;"))
    return [f"size:{size // 2}", f"in:{node.parent.tag}:{link}", f"stops:{min(stops, 3)}:{size > 6}", f"sign:{node.text[:1] == '©'}"]


@dataclass
class Tables:
    """Log-probabilities: of a child's state after its parent's by kind, and of what is observed by state."""

    step: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    seen: dict[str, tuple[float, float]]
    root: tuple[float, float]

    def marginals(self, root: Node) -> list[tuple[Node, float]]:
        """Every text block in page order with its probability of being content."""
        order: list[Node] = [root]
        for node in order:  # grows while it runs: parents before children
            order += node.children
        place = {id(x): k for k, x in enumerate(order)}
        own = []
        for node in order:
            no = yes = 0.0
            for o in observations(node):
                a, b = self.seen.get(o, (0.0, 0.0))
                no, yes = no + a, yes + b
            own.append([no, yes])
        up: list[tuple[float, float]] = [(0.0, 0.0)] * len(order)  # messages to parents
        total = [x[:] for x in own]  # a node's evidence with that of its subtree
        unknown = self.step["div"]
        for k in range(len(order) - 1, 0, -1):
            step = self.step.get(kind(order[k]), unknown)
            no, yes = total[k]
            up[k] = (_add(step[0][0] + no, step[0][1] + yes), _add(step[1][0] + no, step[1][1] + yes))
            p = place[id(order[k].parent)]
            total[p][0] += up[k][0]
            total[p][1] += up[k][1]
        down: list[tuple[float, float]] = [self.root] * len(order)  # messages from parents
        for k in range(1, len(order)):
            p = place[id(order[k].parent)]
            step = self.step.get(kind(order[k]), unknown)
            a, b = down[p][0] + total[p][0] - up[k][0], down[p][1] + total[p][1] - up[k][1]
            top = max(a, b)
            down[k] = (_add(a - top + step[0][0], b - top + step[1][0]), _add(a - top + step[0][1], b - top + step[1][1]))
        leaves = []
        walk = [root]
        while walk:
            node = walk.pop()
            if not node.tag:
                k = place[id(node)]
                no, yes = down[k][0] + total[k][0], down[k][1] + total[k][1]
                leaves.append((node, 1 / (1 + math.exp(min(max(no - yes, -700), 700)))))
            walk += reversed(node.children)
        return leaves


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(trees: list[Node]) -> Tables:
    """The tables of labelled trees: smoothed shares of their counts."""
    steps: dict[str, list[Counter]] = defaultdict(lambda: [Counter(), Counter()])
    seen: dict[str, Counter] = defaultdict(Counter)
    states, roots = Counter(), Counter()
    for tree in trees:
        roots[tree.label] += 1
        walk = [tree]
        while walk:
            node = walk.pop()
            group = "element" if node.tag else "text"
            states[group, node.label] += 1
            for o in observations(node):
                seen[o][node.label] += 1
            for child in node.children:
                steps[kind(child)][node.label][child.label] += 1
            walk += node.children
    share = lambda c, k: math.log((c[k] + SMOOTH) / (c[0] + c[1] + 2 * SMOOTH))
    step = {k: tuple((share(c, 0), share(c, 1)) for c in v) for k, v in steps.items()}
    known = {}
    for o, c in seen.items():
        group = "element" if o.startswith(("tag:", "name:")) else "text"
        known[o] = tuple(math.log((c[k] + SMOOTH) / (states[group, k] + 1)) for k in (0, 1))
    return Tables(step, known, (share(roots, 0), share(roots, 1)))


def extract(page: str, tables: Tables) -> str:
    """The article of a page: its content blocks in page order, joined by a space."""
    if not page.strip():
        return ""
    return " ".join(node.text for node, p in tables.marginals(parse(page)) if p > 0.5)


class _Writer:
    """Writes one labelled page; content texts are wrapped in private marks that the parser keeps in the text."""

    def __init__(self, rng: random.Random):
        self.r, self.out = rng, []

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice("aeioustrnlmdk") for _ in range(self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 14).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def box(self, tags: str, names: str, inner: str, plain: float = 0.0) -> str:
        """An element of a random tag; outside semantic tags it carries one of the names."""
        tag = self.r.choice(tags.split())
        name = self.r.choice(names.split()) if names else ""
        bare = not name or self.r.random() < (plain if tag in ("div", "section", "ul", "p") else 0.6)
        return f"<{tag}" + ("" if bare else f' {self.r.choice(["class", "class", "id"])}="{name}"') + f">{inner}</{tag}>"

    def good(self, text: str) -> str:
        return f"\ue000{text}\ue001"

    def ad(self) -> str:
        return self.box("div div div aside ins section", "ad ads advert advertisement ad-banner sponsored promo ad-slot banner-ad", self.r.choice([self.sentences(1, 3), self.words(3, 9), f"<p>{self.sentences(1, 2)}</p>", f'<a href="/x">{self.words(2, 6)}</a>']))

    def notice(self) -> str:
        inner = self.sentences(1, 3) + self.r.choice(["", f"<button>{self.words(1, 2)}</button>"])
        return self.box("div div section aside", "cookie-notice notice cookie-banner alert consent gdpr banner newsletter subscribe popup modal", self.r.choice([inner, f"<p>{inner}</p>"]))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(self.r.randint(1, 3)))
        return f'<form>{self.r.choice(["", f"<p>{self.sentences(1, 1)}</p>"])}{fields}<button>{self.words(1, 2)}</button></form>'

    def sidebar(self) -> str:
        inner = self.r.choice(["", f"<h3>{self.words(1, 4)}</h3>"]) + self.r.choice([self.links(3, 7), f"<p>{self.sentences(1, 3)}</p>", self.links(2, 5) + f"<p>{self.sentences(1, 2)}</p>"])
        return self.box("aside aside div div section", "sidebar side-bar widget related related-posts rail recommended secondary more-stories", inner)

    def comments(self) -> str:
        one = lambda: self.box("li div article", "comment comment-body reply", f"{self.r.choice(['', f'<b>{self.words(1, 2)}</b>'])}<p>{self.sentences(1, 4)}</p>")
        inner = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.box("section div div ol", "comments comment-list responses discussion disqus user-comments", inner)

    def footer(self) -> str:
        inner = self.r.choice(["&copy; ", "", "Copyright "]) + self.r.choice([self.words(1, 4), self.sentences(1, 2), self.links(2, 6), f"<p>{self.sentences(1, 2)}</p>"])
        return self.box("footer footer footer div", "footer site-footer page-footer foot colophon bottom", inner)

    def header(self) -> str:
        inner = self.r.choice(["", f'<div class="logo">{self.words(1, 3)}</div>', f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.sentences(1, 1)}</p>", self.words(1, 5)]) + self.r.choice(["", f"<nav>{self.links(3, 7)}</nav>"])
        return self.box("header header div", "header site-header masthead top-bar branding page-header", inner)

    def menu(self) -> str:
        return self.box("nav nav nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav", self.links(3, 9))

    def inner_extra(self) -> str:
        return self.r.choice([self.ad, self.ad, self.notice, self.form, self.sidebar, lambda: self.box("div", "share social share-buttons social-links", self.links(2, 4))])()

    def paragraph(self) -> str:
        text = self.good(self.sentences(1, 8)) if self.r.random() < 0.85 else self.good(self.words(2, 12))
        if self.r.random() < 0.2:
            text = self.good(self.sentences(1, 2)) + f'<a href="/y">{self.good(self.words(1, 3))}</a> ' + self.good(self.sentences(1, 3))
        if self.r.random() < 0.15:
            text = f"<{self.r.choice(['b', 'i', 'em', 'strong'])}>{text}<br>"
        return f"<p>{text}" + self.r.choice(["</p>", "</p>", "</p>", "\n"])

    def body(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 9)):
            x = self.r.random()
            if x < 0.72:
                parts.append(self.paragraph())
            elif x < 0.80:
                parts.append(f"<{(h := self.r.choice(['h2', 'h3', 'h4']))}>{self.good(self.words(1, 7))}</{h}>")
            elif x < 0.86:
                tag = self.r.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{self.good(self.r.choice([self.words(1, 8), self.sentences(1, 2)]))}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>")
            elif x < 0.90:
                parts.append(f"<blockquote>{self.r.choice([self.good(self.sentences(1, 3)), f'<p>{self.good(self.sentences(1, 3))}</p>'])}</blockquote>")
            elif x < 0.93:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.good(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.95:
                parts.append(f"<pre>{self.good(self.words(3, 20))}</pre>")
            elif x < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{self.good(self.sentences(1, 1))}</figcaption></figure>")
            else:
                parts.append(self.box("div section", "text body paragraph section content", self.paragraph(), 0.5))
            if self.r.random() < 0.06:
                parts.append(self.inner_extra())
        return "".join(parts)

    def article(self) -> str:
        title = f"<h1>{self.good(self.words(2, 10))}</h1>"
        if self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = (title if self.r.random() < 0.8 else "") + self.body()
        if self.r.random() < 0.3:
            inner = self.box("div section", "content article-body entry-content post-content story text body", inner, 0.4)
        return self.box("article article article main div div section", "article post content entry main story main-content post-body article-content page", inner, 0.1)

    def page(self) -> str:
        maybe = lambda f, p: f() if self.r.random() < p else ""
        middle = maybe(self.notice, 0.15) + maybe(self.ad, 0.4) + self.article() + maybe(self.ad, 0.2) + maybe(self.sidebar, 0.4) + maybe(self.comments, 0.4) + maybe(self.form, 0.2)
        if self.r.random() < 0.45:
            middle = self.box("main div div section", "main wrapper container page content layout row", middle, 0.3)
        top = [maybe(self.header, 0.5), maybe(self.menu, 0.7), maybe(self.notice, 0.2)]
        self.r.shuffle(top)
        return "<!DOCTYPE html><html><head><title>" + self.words(2, 6) + "</title></head><body>" + "".join(top) + middle + maybe(self.notice, 0.1) + maybe(self.footer, 0.85) + self.r.choice(["</body></html>", ""])


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[Node]:
    """Trees of made pages with their labels: text blocks by what was written into them, elements by the nodes below them."""
    rng = random.Random(seed)
    trees = []
    for _ in range(count):
        tree = parse(_Writer(rng).page())
        order = [tree]
        for node in order:
            order += node.children
        for node in reversed(order):
            if not node.tag:
                node.label = int("\ue000" in node.text)
                node.text = node.text.translate({0xE000: None, 0xE001: None})
                node.chars = len(node.text)
            else:
                node.label = int(any(x.label for x in node.children))
        trees.append(tree)
    return trees


def _extract(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [extract(x, tables) for x in strings(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, tables: Tables | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A map over whole pages. A null or empty html, and a page without content, has the empty text; malformed markup is read
    as far as it goes; a null page_id or url is kept; repeated rows give repeated results; other columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract(tables or train(labelled_pages())), "page_id long, url string, text string, n_chars long")
