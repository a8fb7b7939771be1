"""Main-text extraction by a tree-structured graphical model over the DOM.

A page's block elements that hold text, and their ancestors, form a tree of binary
variables (content or not). A node's potential comes from its tag, the words of its class,
id and role, and the length and link share of its own text; an edge's potential depends on
the child's tag and on both labels. Sum-product messages go up and then down the tree and
give exact content marginals; blocks whose node has a marginal of at least a half are the
text.

Weights are trained by the likelihood of labelled pages (``training_pages``: a fixed
family of page layouts with ``data-gold`` marks; ``fit`` takes any others), on the driver:
their number is a parameter, and the model's size doesn't depend on the corpus.
"""

from __future__ import annotations

import functools
import html
import json
import math
import pkgutil
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAINING_PAGES = 600

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math head object select option datalist button canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
CELLS = frozenset("td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}
#: Beyond these, no end tag and no implied end of a paragraph reaches.
SCOPES = frozenset("table td th caption template object".split())
ROWS = frozenset("tr tbody thead tfoot".split())

# Words in class, id and role that web pages use for their parts.
WORDS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer colophon copyright sidebar aside widget rail cookie cookies consent gdpr notice alert "
    "popup modal overlay comment comments reply replies respond discussion disqus share social related recommended more newsletter subscribe signup form login search pagination pager tags "
    "content article post entry main story body text page wrapper container hidden contentinfo complementary banner toolbar skip".split()
)
# A tag goes on to the first > outside a value. Quotes open a value only after an equals
# sign; without their like further on they are characters as any other.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^\s"'>])[^\s>]++)?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")  # all of Unicode's white space
# How a line that claims the rights says so.
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b\W{0,4}(?:\(c\)|by\b|\d{4})|\ball rights reserved\b", re.I)


#: Texts of this length and more claim no rights: they write about them.
RIGHTS_LENGTH = 200


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset[str] = frozenset()
    gold: int | None = None
    #: Texts that stand in the node itself, by block, and how much of them is in links.
    size: int = 0
    linked: int = 0
    stops: int = 0
    used: bool = False
    #: The part of the page's text outside links and claims that stands at or below the node.
    share: float = 0.0
    #: Whether a text of its own claims rights; all text at or below it, and that in links.
    rights: bool = False
    below: int = 0
    below_linked: int = 0
    #: Where it stands to the core, the innermost part with half of the page's own text.
    place: str = ""


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text)
    #: Of each used node: its features, and the kind of its edge.
    names: list[list[str]] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    """Of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Open:
    """The open elements, innermost last: (tag, node, dropped).

    Where each tag, and each kind of tag, is open is kept beside them, so that no step
    looks through the stack: a page's time is in proportion to its length at any depth.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]
        self.at: dict[str, list[int]] = {}

    @staticmethod
    def _kinds(tag: str) -> list[str]:
        kinds = [tag]
        if tag in BLOCK:
            kinds.append("*block")
        if tag in SCOPES:
            kinds.append("*scope")
        if tag in HEADINGS:
            kinds.append("*heading")
        if tag in CELLS:
            kinds.append("*cell")
        if tag in ("tbody", "thead", "tfoot"):
            kinds.append("*rows")
        if tag in ("dd", "dt"):
            kinds.append("*term")
        if tag in BLOCK | CELLS and tag not in ("address", "div", "p"):
            if tag != "li":
                kinds.append("*ends li")
            if tag not in ("dd", "dt"):
                kinds.append("*ends term")
        return kinds

    def last(self, kind: str) -> int:
        """The innermost place of a tag or kind; 0 if none is open."""
        places = self.at.get(kind)
        return places[-1] if places else 0

    def push(self, tag: str, node: int, dropped: bool) -> None:
        for kind in self._kinds(tag):
            self.at.setdefault(kind, []).append(len(self.stack))
        self.stack.append((tag, node, dropped))

    def pop(self) -> str:
        tag, *_ = self.stack.pop()
        if tag:
            for kind in self._kinds(tag):
                self.at[kind].pop()
        return tag

    def forget(self, k: int) -> None:
        """End an inline element around open blocks, which stay open."""
        tag, node, dropped = self.stack[k]
        self.at[tag].pop()
        self.stack[k] = ("", node, dropped)


def parse(source: str) -> Page:
    """Block elements as a tree, and the text blocks in page order.

    Every string is a page: unclosed, misnested and cut-off markup is closed where the
    next element or the end demands.
    """
    page = Page([Node("html", -1)])
    open_ = _Open()
    stack = open_.stack
    pending: list[str] = []
    linked = 0
    anchors = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(pending)).strip()
        if text:
            node = page.nodes[stack[-1][1]]
            node.size += len(text)
            node.linked += min(linked, len(text))
            node.stops += sum(text.count(c) for c in ".,;?!")
            node.rights = node.rights or len(text) < RIGHTS_LENGTH and bool(_RIGHTS.search(text))
            page.blocks.append((stack[-1][1], text))
        pending.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal anchors
        if open_.last("*block") >= k:
            flush()
        while len(stack) > k:
            anchors -= open_.pop() == "a"

    def end(tag: str) -> None:
        """An end tag, or what implies one."""
        nonlocal anchors
        k = open_.last("*heading" if tag in HEADINGS else tag)
        if not k:
            if tag == "p":
                flush()
        elif k < open_.last("*scope") and tag not in ROWS and tag not in SCOPES:
            pass  # of an element outside the table or the like that this one is in
        elif tag in BLOCK or tag in SCOPES or k > open_.last("*block"):
            close(k)
        else:
            anchors -= tag == "a"
            open_.forget(k)

    def imply(tag: str) -> None:
        """End what a start tag ends."""
        scope = open_.last("*scope")
        if tag in CLOSES_P and open_.last("p") > scope:
            close(open_.last("p"))
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        elif tag == "li" and open_.last("li") > open_.last("*ends li"):
            close(open_.last("li"))
        elif tag in ("dd", "dt") and open_.last("*term") > open_.last("*ends term"):
            close(open_.last("*term"))
        elif tag in CELLS and open_.last("*cell") > max(open_.last("table"), open_.last("tr")):
            close(open_.last("*cell"))
        elif tag == "tr" and open_.last("tr") > open_.last("table"):
            close(open_.last("tr"))
        elif tag in ("tbody", "thead", "tfoot") and max(open_.last("*rows"), open_.last("tr")) > open_.last("table"):
            close(open_.last("*rows") if open_.last("*rows") > open_.last("table") else open_.last("tr"))
        elif tag == "a" and open_.last("a") > scope:
            end("a")

    def say(raw: str) -> None:
        nonlocal linked
        if raw and stack[-1][0] == "head" and not raw.isspace():
            close(len(stack) - 1)
        if raw and not stack[-1][2]:
            text = html.unescape(raw)
            pending.append(text)
            if anchors:
                linked += len(text.strip())

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if source[at - 1] != ">":
            break  # a tag that the page's end cuts off
        tag = m[2].lower()
        if m[1]:
            end(tag)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)  # the head's end tag may be left out
        if tag in VOID:
            if tag == "hr":
                imply(tag)
                flush()
            elif tag == "br" and not stack[-1][2]:
                pending.append(" ")
            continue
        if tag == "html" or tag == "body" and open_.last("body"):
            continue
        imply(tag)
        attributes = _attributes(m[3])
        dropped = stack[-1][2] or tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        node = stack[-1][1]
        if tag in BLOCK:
            flush()
            words = frozenset(w for key in ("class", "id", "role") for part in attributes.get(key, "").split() for w in _SPLIT.split(part.lower()) if w in WORDS)
            gold = attributes.get("data-gold")
            page.nodes.append(Node(tag, node, words, int(gold) if gold in ("0", "1") else page.nodes[node].gold))
            node = len(page.nodes) - 1
        elif tag in CELLS:
            say(" ")
        elif tag == "a":
            anchors += 1
        open_.push(tag, node, dropped)  # as the standard says, a slash closes no element
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = stop.start() if stop else n
    close(1)
    flush()
    for k, _ in page.blocks:
        while k >= 0 and not page.nodes[k].used:
            page.nodes[k].used = True
            k = page.nodes[k].parent
    own = lambda x: 0 if x.rights else x.size - x.linked
    total = sum(map(own, page.nodes)) or 1
    for x in reversed(page.nodes):  # a child always comes after its parent
        x.share += own(x) / total
        x.below, x.below_linked = x.below + x.size, x.below_linked + x.linked
        if x.parent >= 0:
            up = page.nodes[x.parent]
            up.share, up.below, up.below_linked = up.share + x.share, up.below + x.below, up.below_linked + x.below_linked
    _place(page)
    page.names = [_features(x) if x.used else [] for x in page.nodes]
    page.kinds = [_edge(page, k) if x.used else "" for k, x in enumerate(page.nodes)]
    return page


PARTS = frozenset("html body main article section div center td".split())


def _place(page: Page) -> None:
    """Each node's place: up (around the core), core, in (it), before or after.

    The core is a part of the page, not a paragraph, however long that is."""
    nodes = page.nodes
    core = max((k for k, x in enumerate(nodes) if x.share >= 0.5 and x.tag in PARTS), default=0)  # of nested ones the innermost comes last
    around = set()
    k = nodes[core].parent
    while k >= 0:
        around.add(k)
        k = nodes[k].parent
    for k, x in enumerate(nodes):  # a node's own part of the tree follows it without a gap
        inside = x.parent >= 0 and nodes[x.parent].place in ("core", "in")
        x.place = "core" if k == core else "up" if k in around else "in" if inside else "before" if k < core else "after"


# ---------------------------------------------------------------- the model


def _features(node: Node) -> list[str]:
    out = ["bias", f"tag={node.tag}", f"share={min(int(-math.log2(max(node.share, 0.01))), 4)}", *(f"word={w}" for w in node.words)]
    if node.size:
        out += [f"size={min(int(math.log2(node.size)), 9) // 2}", f"links={round(2 * node.linked / node.size)}", f"stops={min(node.stops, 2)}"]
    else:
        out.append("size=none")
    out.append(f"place={node.place}")
    if node.below:
        out.append(f"{node.place} links={round(4 * node.below_linked / node.below)}")
    if node.rights:
        out += ["rights", f"rights {node.place}"]
    return out


def _edge(page: Page, k: int) -> str:
    """The kind of the edge to a node's parent: its tag, whether its names say anything,
    and whether it is a part of the page itself."""
    node = page.nodes[k]
    top = node.parent >= 0 and page.nodes[node.parent].tag in ("html", "body")
    return ("top " if top else "") + node.tag + ("+" if node.words else "")


@dataclass
class Model:
    unary: dict[str, float]
    #: By the kind of the child's edge (or "*"): [parent label][child label].
    edge: dict[str, list[list[float]]]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each used node, exactly, by messages up and down the tree."""
        return self._pass(page)[0]

    def _pass(self, page: Page) -> tuple[list[float], list[list[list[float]] | None]]:
        nodes, n = page.nodes, len(page.nodes)
        up = [[0.0, 0.0] for _ in range(n)]  # log messages gathered from the children
        sent = [[0.0, 0.0] for _ in range(n)]
        own = [0.0] * n
        for k in range(n - 1, -1, -1):  # a child always comes after its parent
            if not nodes[k].used:
                continue
            own[k] = sum([self.unary.get(f, 0.0) for f in page.names[k]])
            if nodes[k].parent >= 0:
                e = self.edge.get(page.kinds[k]) or self.edge["*"]
                low, high = up[k][0], up[k][1] + own[k]
                for a in (0, 1):
                    x, y = e[a][0] + low, e[a][1] + high
                    top = max(x, y)
                    sent[k][a] = top + math.log(math.exp(x - top) + math.exp(y - top))
                    up[nodes[k].parent][a] += sent[k][a]
        belief = [[0.0, 0.0] for _ in range(n)]
        pairs: list[list[list[float]] | None] = [None] * n
        out = [0.0] * n
        for k in range(n):
            if not nodes[k].used:
                continue
            low, high = up[k][0], up[k][1] + own[k]
            p = nodes[k].parent
            if p < 0:
                b = [low, high]
            else:
                e = self.edge.get(page.kinds[k]) or self.edge["*"]
                rest = [belief[p][a] - sent[k][a] for a in (0, 1)]
                joint = [[rest[a] + e[a][c] + (low, high)[c] for c in (0, 1)] for a in (0, 1)]
                top = max(map(max, joint))
                weights = [[math.exp(x - top) for x in row] for row in joint]
                total = sum(map(sum, weights))
                pairs[k] = [[x / total for x in row] for row in weights]
                b = [math.log(max(weights[0][c] + weights[1][c], 1e-300)) for c in (0, 1)]
            top = max(b)
            belief[k] = [b[0] - top, b[1] - top]
            out[k] = math.exp(belief[k][1]) / (math.exp(belief[k][0]) + math.exp(belief[k][1]))
        return out, pairs


def _gold(page: Page) -> list[int]:
    """A node's label: its own mark; without one, what most of the text below it is."""
    votes = [0] * len(page.nodes)
    for k, text in page.blocks:
        sign = len(text) if page.nodes[k].gold else -len(text)
        while k >= 0:
            votes[k] += sign
            k = page.nodes[k].parent
    return [x.gold if x.gold is not None else int(v > 0) for x, v in zip(page.nodes, votes)]


def fit(pages: list[str], rounds: int = 60, rate: float = 0.4, decay: float = 1e-5) -> Model:
    """Gradient ascent on the labels' likelihood, by scaled steps with momentum that shrink
    to nothing; deterministic."""
    parsed = [(p, _gold(p)) for p in map(parse, pages) if p.blocks]
    kinds = sorted({p.kinds[k] for p, _ in parsed for k, x in enumerate(p.nodes) if x.used})
    model = Model({}, {t: [[0.0, 0.0], [0.0, 0.0]] for t in ["*", *kinds]})
    mean: dict[object, float] = {}
    scale: dict[object, float] = {}
    total = sum(x.used for p, _ in parsed for x in p.nodes) or 1
    for t in range(1, rounds + 1):
        grad: dict[object, float] = {}
        for page, gold in parsed:
            p, pairs = model._pass(page)
            for k, x in enumerate(page.nodes):
                if not x.used:
                    continue
                for f in page.names[k]:
                    grad[f] = grad.get(f, 0.0) + gold[k] - p[k]
                if x.parent >= 0:
                    for a in (0, 1):
                        for c in (0, 1):
                            d = (gold[x.parent] == a and gold[k] == c) - pairs[k][a][c]
                            for kind in (page.kinds[k], "*"):
                                grad[kind, a, c] = grad.get((kind, a, c), 0.0) + d
        for key, g in grad.items():
            old = model.edge[key[0]][key[1]][key[2]] if isinstance(key, tuple) else model.unary.get(key, 0.0)
            g = g / total - decay * old
            mean[key] = 0.9 * mean.get(key, 0.0) + 0.1 * g
            scale[key] = 0.98 * scale.get(key, 0.0) + 0.02 * g * g
            step = mean[key] / (1 - 0.9**t) / (math.sqrt(scale[key] / (1 - 0.98**t)) + 1e-5)
            new = old + rate * (1 - t / (rounds + 1)) * step
            if isinstance(key, tuple):
                model.edge[key[0]][key[1]][key[2]] = new
            else:
                model.unary[key] = new
    return model


def main_text(model: Model, source: str | None) -> str:
    """The content blocks of a page, in page order, joined by an empty line."""
    if not source:
        return ""
    page = parse(source)
    p = model.marginals(page)
    return "\n\n".join(text for k, text in page.blocks if p[k] >= 0.5)


# ---------------------------------------------------------------- labelled pages


def training_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[str]:
    """Labelled pages of many layouts: a page's parts carry ``data-gold`` marks."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("abcdeghilmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b))).capitalize()

    def sentences(a: int, b: int) -> str:
        text = " ".join(words(1, 14) + "." for _ in range(rng.randint(a, b)))
        style = rng.random()  # a few shout, ask or never stop
        return text.upper().replace(" ", "!! ") if style < 0.06 else text.replace(".", "?") if style < 0.1 else text.replace(".", "") if style < 0.14 else text

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(a, b)}</a>'

    plain = False  # of a plain page no name and no tag says what a part is

    def attribute(*names: str) -> str:
        name = "" if plain else rng.choice(names)
        return f' {rng.choice(("class", "id", "class"))}="{name}"' if name else ""

    def part(tag: str, inner: str, *names: str, gold: int = 0) -> str:
        names = names or ("",)
        if plain and tag not in ("ul", "ol"):
            tag = "div"
        return f'<{tag}{attribute(*names)} data-gold="{gold}">{inner}</{tag}>'

    def heading() -> str:
        tag = rng.choice(("h2", "h3", "h3", "h4"))
        return f"<{tag}>{words(1, 3)}</{tag}>"

    def listing(k: int) -> str:
        most = rng.choice((1, 1, 3))
        return "<ul>" + "".join(f"<li>{link(1, most) if rng.random() < 0.7 else f'<a href=/>{words(1, 1)[: rng.randint(2, 5)]}</a>'}</li>" for _ in range(k)) + "</ul>"

    def menu() -> str:
        kind, inner = rng.random(), listing(rng.randint(2, 10))
        if kind < 0.6:
            return part("nav", inner if kind < 0.5 else " / ".join(link() for _ in range(3)), "", "", "menu", "navbar", "breadcrumb")
        return part("div", inner, "menu", "nav-main", "navigation") if kind < 0.85 else part("ul", inner[4:-5], "menu", "nav")

    def advert() -> str:
        return part(rng.choice(("div", "aside", "section")), rng.choice((sentences(1, 3), f"<p>{sentences(1, 2)}</p>", f"{link(2, 6)}")), "ad", "ads", "advert", "sponsored", "promo", "ad-slot")

    def notice() -> str:
        return part("div", rng.choice((sentences(1, 2), f"<p>{sentences(1, 3)}</p><button>OK</button>")), "cookie-notice", "consent", "notice", "cookie-banner", "alert", "popup", "newsletter", "gdpr")

    def sidebar() -> str:
        return part(rng.choice(("aside", "div", "section")), heading() + rng.choice((listing(4), f"<p>{sentences(1, 3)}</p>")), "sidebar", "widget", "related", "rail", "recommended")

    def form() -> str:
        return part("form", f"<p>{words(1, 5)}</p><label>{words(1, 3)} <input name=q></label><button>{words(1, 1)}</button>", "", "search", "login", "subscribe")

    def comments() -> str:
        inner = "".join(rng.choice((f'<div class="comment"><p>{sentences(1, 4)}</p></div>', f"<li><p>{sentences(1, 5)}</p></li>", f"<p>{sentences(1, 4)}</p>", f"<article><p>{sentences(1, 4)}</p></article>")) for _ in range(rng.randint(1, 5)))
        return part(rng.choice(("section", "div", "ol")), heading() + inner, "comments", "comment-list", "discussion", "replies", "respond")

    def footer() -> str:
        return part(rng.choice(("footer", "footer", "div")), rng.choice((f"&copy; {words(1, 3)} {sentences(1, 2)}", f"<p>{sentences(1, 2)}</p>", listing(3), link(1, 4))), "footer", "site-footer", "colophon", "copyright")

    def header() -> str:
        return part("header", rng.choice((f"<h1>{words(1, 3)}</h1>{menu()}", f"<p>{link()}</p>", f"<div>{words(1, 5)}</div>", menu())), "", "header", "masthead", "site-header")

    def bare_footer() -> str:
        return f'<footer data-gold="0">&copy; {words(1, 3)} &middot; {sentences(1, 3)}</footer>'

    def links(k: int) -> str:
        """Links side by side, as menus and footers without names have them."""
        return rng.choice((" ", " | ", " &middot; ", "<br>", "\n")).join(link(1, 2) for _ in range(k))

    def rights() -> str:
        year = rng.randint(1995, 2030)
        return rng.choice((f"&copy; {year} {words(1, 3)}", f"Copyright {year} {words(1, 3)}", f"Copyright &copy; {year}, {words(1, 3)}. All rights reserved.", f"(c) {year} {words(1, 2)}", f"Copyright {year}", f"Copyright by {words(1, 3)}", f"{words(1, 4)}. Copyright {year}"))

    def plain_menu() -> str:
        return part("div", rng.choice((links(rng.randint(2, 7)), listing(rng.randint(2, 8)), f"<p>{links(rng.randint(2, 6))}</p>")), "")

    def plain_footer() -> str:
        return part("div", rng.choice((rights(), f"<p>{rights()}</p>", f"{rights()} {links(2)}", f"<p>{links(3)}</p><p>{rights()}</p>", links(4), f"<small>{rights()}</small>")), "")

    def plain_related() -> str:
        return part("div", heading() + listing(rng.randint(3, 7)), "")

    def filed() -> str:
        """What follows a text inside its article: where it is filed, and its links."""
        inner = rng.choice((f"{words(1, 2)} {link()}", f"{words(1, 3)}: {links(2)}", f"<p>{words(2, 5)}</p>", f"{words(2, 4)}"))
        return f'<footer{attribute("", "", "meta", "entry-footer", "post-footer")} data-gold="0">{inner}</footer>'

    def paragraphs(k: int) -> str:
        out = []
        for _ in range(k):
            kind = rng.random()
            body = sentences(1, 7) if rng.random() < 0.75 else words(1, 3) + "."
            if kind < 0.6:
                out.append(f"<p>{body}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{words(1, 6)}.<br><p>{body}</p>")
            elif kind < 0.75:
                out.append(f"<h2>{words(1, 7)}</h2>")
            elif kind < 0.83:
                out.append("<ul>" + "".join(f"<li>{rng.choice((sentences(1, 1), words(1, 6), link(1, 4)))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{sentences(1, 3)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<p>{sentences(1, 3)} {link()} {sentences(1, 2)}</p>")
            elif kind < 0.94:
                out.append(f"<div>{sentences(1, 4)}</div>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{words(1, 2)}</td><td>{words(1, 2)}</td></tr></table>")
            else:
                out.append(f"<pre>{words(2, 8)}\n{words(2, 8)}</pre>")
        return "".join(out)

    pages = []
    for _ in range(n):
        plain = rng.random() < 0.25
        body = f"<h1>{words(2, 9)}</h1>" + paragraphs(rng.randint(1, 9) if rng.random() < 0.75 else rng.randint(10, 30))
        inside = [] if plain else [x() for x in (advert, sidebar, comments, notice, form) if rng.random() < 0.12]
        if inside:
            cut = body.rfind("</p>") + 4 if "</p>" in body else len(body)
            body = body[:cut] + "".join(inside) + body[cut:]
        tag = "div" if plain and rng.random() < 0.8 else rng.choice(("article", "article", "article", "main", "div", "section"))
        if tag == "article" and rng.random() < 0.15:
            body += filed()
        names = ("", "", "content", "post", "entry-content", "story") if tag in ("article", "main") else ("content", "article-body", "post", "entry", "main", "story")
        inner = ("content", "post-body", "entry-content", "article-text", "story-body", "main-content", "text", "")
        if rng.random() < 0.35:  # the text in a part of the part
            cut = body.find("</h1>") + 5 if rng.random() < 0.5 else 0
            body = body[:cut] + part(rng.choice(("div", "div", "section")), body[cut:], *inner, gold=1)
        core = part(tag, body, *names, gold=1)
        if rng.random() < 0.4:
            core = f'<div{attribute("wrapper", "container", "", "page")}>' + "".join(x() for x in ((plain_menu, plain_related) if plain else (menu, sidebar)) if rng.random() < 0.4) + core + "".join(x() for x in ((plain_related,) if plain else (sidebar, advert)) if rng.random() < 0.4) + "</div>"
        before = "".join(x() for x in (notice, header, menu, advert, form) if rng.random() < 0.45)
        after = "".join(x() for x in (comments, sidebar, advert, form, notice) if rng.random() < 0.3) + (rng.choice((footer, bare_footer))() if rng.random() < 0.9 else "")
        if plain:
            if rng.random() < 0.2:  # hardly a text at all
                core = part("div", rng.choice((words(1, 6), words(1, 1).lower(), f"<p>{words(1, 4)}</p>")), gold=1)
            before = "".join(x() for x in (plain_menu, plain_related) if rng.random() < 0.5)
            after = "".join(x() for x in (plain_related, plain_footer) if rng.random() < 0.6)
            if rng.random() < 0.3:
                core = f"<div>{before}{core}{after}</div>"
                before = after = ""
        if rng.random() < 0.2:  # what holds it says nothing
            core = f"<{(outer := rng.choice(('section', 'main', 'div', 'center', 'div')))}>{core}</{outer}>"
        bare = rng.random() < 0.35
        if bare:  # an article and nothing else
            before = after = ""
        if rng.random() < (0.7 if bare else 0.25):  # and a short one
            core = part(tag, "".join(f"<p>{words(1, 5)}.</p>" for _ in range(rng.randint(1, 2))), *names, gold=1)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>{before}{core}{after}</body></html>")
    return pages


@functools.cache
def default_model() -> Model:
    """The model of the training pages, as ``fit`` gives it; read from the file beside this
    module, which ``save`` has written."""
    stored = json.loads(pkgutil.get_data(__package__, "html_model.json"))
    return Model(stored["unary"], stored["edge"])


def save(model: Model, path: str) -> None:
    """Write a model's weights; after a change of features or training pages:
    ``python -c "from braidflow.llm import html_extract as h; h.save(h.fit(h.training_pages()), 'braidflow/llm/html_model.json')"``
    """
    rounded = {"unary": {f: round(w, 5) for f, w in sorted(model.unary.items())}, "edge": {k: [[round(w, 5) for w in row] for row in e] for k, e in sorted(model.edge.items())}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rounded, f, indent=1)
        f.write("\n")


# ---------------------------------------------------------------- on Spark


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null, empty or textless page has the empty text. Pages of any length or depth take
    time in proportion to their length and are held one at a time. Repeated rows stay one
    by one; other columns are ignored; an empty table gives no rows. A block whose marginal
    is exactly a half is content.
    """
    spark = pages.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            out = [main_text(shared.value, x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
