"""Main text of web pages by a tree-structured graphical model of the DOM.

Block elements and blocks of text are nodes with a hidden label: content or not. Unary potentials come from a node's
tag, class, id, role and text; pairwise potentials join parent and child by their kinds. Sum-product messages
go up from the leaves and down from the root and give the exact marginal of every node; blocks whose marginal of
being content is at least `threshold` are the main text. Weights are trained by gradient of the likelihood on labelled
pages, (html, main text): a text block is content if it is a line of the main text, an element if most
of its text is. `labelled_pages` makes such pages from layouts, by rule.

Character references are decoded; white space inside a block, line breaks too, becomes one blank; blocks are joined in
page order by line feeds. Scripts, styles, comments in markup, the head, form controls and hidden elements are never text.

Tags and attributes are read as the HTML standard's tokeniser reads them, and time and memory follow the length of the page, however deep or
long it is.

Defined results: a null or empty page, or one without text, gives an empty text; end tags without a start are ignored and open
elements end with the page, as does a tag that the page ends in; repeated rows are each answered; an empty table gives an empty
result; other columns are carried along, and those named `text` or `n_chars` are replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.textkit import scan

# A quote opens a value directly after "=" only; elsewhere it belongs to a name or an unquoted value, as the HTML standard's tokeniser has it.
VALUE = r"\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+"
MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:{VALUE})?+)*+)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
WORDS = re.compile(r"[a-z]+")

# Fixed values of the HTML standard: elements without an end, with raw text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style textarea title iframe noembed noframes template object svg math canvas audio video select option button datalist noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
P_STOPS = frozenset("table td th button object".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}

# Hints in class, id, role and label: what they say about a part of a page.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar toc dropdown skip",
    "frame": "header footer masthead banner topbar bottom copyright colophon legal contentinfo site logo brand",
    "side": "sidebar side aside rail widget related recommended recommendations popular trending complementary more archive tags",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion promoted banner affiliate",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy dialog paywall subscribe newsletter signup",
    "form": "form search login signin register contact input field",
    "reader": "comment comments disqus reply replies respond discussion feedback reviews thread",
    "share": "share sharing social follow twitter facebook",
    "body": "article content main post entry story body text page hentry prose",
}
HINT_OF: dict[str, list[str]] = {}
for _kind, _terms in HINTS.items():
    for _term in _terms.split():
        HINT_OF.setdefault(_term, []).append(_kind)
TAGS = "article main section nav header footer aside form div ul ol li p h1 h2 h3 table tr td blockquote pre figure figcaption dl dt dd body html fieldset details dialog address".split()


class Node:
    """A block element (tag set) or a block of text (tag None)."""

    __slots__ = ("tag", "hints", "parent", "text", "linked", "label", "full")

    def __init__(self, tag: str | None, hints: frozenset, parent: "Node | None"):
        self.tag, self.hints, self.parent = tag, hints, parent
        self.text, self.linked, self.label, self.full = "", 0, None, tag is None


class Open:
    """The open elements. Where each tag is open is kept by tag, so that no step looks through all of them, however deep a page is."""

    def __init__(self):
        self.tags: list[str | None] = []  # None: an inline element that has ended below others
        self.hides: list[bool] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[tuple[int, Node]] = []

    def push(self, tag: str, node: Node | None, hidden: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if node is not None:
            self.blocks.append((len(self.tags), node))
        self.tags.append(tag)
        self.hides.append(hidden)

    def pop(self) -> None:
        tag = self.tags.pop()
        self.hides.pop()
        if tag is not None:
            self.at[tag].pop()
        if self.blocks and self.blocks[-1][0] == len(self.tags):
            self.blocks.pop()

    def end(self, tag: str) -> None:
        """The last inline element of that tag ends alone."""
        self.tags[self.at[tag].pop()] = None
        while self.tags and self.tags[-1] is None:
            self.pop()

    def last(self, tags, stops=()) -> int:
        """The place of the last open element of these tags; -1 if there is none or one of stops is open in it."""
        where = lambda some: max((self.at[t][-1] for t in some if self.at.get(t)), default=-1)
        k = where(tags)
        return k if k > where(stops) else -1

    def hidden(self) -> bool:
        return bool(self.hides) and self.hides[-1]


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents before children; elements without text are left out. Takes time in proportion to the page."""
    root = Node("html", frozenset(), None)
    nodes, open_ = [root], Open()
    pieces: list[tuple[str, bool]] = []

    def block() -> Node:
        return open_.blocks[-1][1] if open_.blocks else root

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(x for x, _ in pieces).split())
        if text:
            leaf = Node(None, frozenset(), block())
            leaf.text, leaf.linked = text, sum(len(x.strip()) for x, link in pieces if link)
            nodes.append(leaf)
        pieces.clear()

    def close(depth: int) -> None:
        while len(open_.tags) > depth:
            if open_.blocks and open_.blocks[-1][0] == len(open_.tags) - 1:
                flush()
            open_.pop()

    def say(text: str) -> None:
        if text and not open_.hidden():
            pieces.append((unescape(text) if "&" in text else text, bool(open_.at.get("a"))))

    at, size = 0, len(html)
    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if html[m.start() + 1] == "/":
            if tag == "br":
                say(" ")
            elif (k := open_.last({tag}, () if tag not in ("p", "li") else {"table", "td", "th"})) >= 0:
                if tag in INLINE:  # blocks that were opened in a line element go on after its end
                    open_.end(tag)
                else:
                    close(k)
            continue
        if tag not in IN_HEAD and (k := open_.last({"head"}, {"noscript", "template"})) >= 0:
            close(k)
        if tag in CLOSES_P and (k := open_.last({"p"}, P_STOPS)) >= 0:
            close(k)
        if tag in ENDS and (k := open_.last(*ENDS[tag])) >= 0:
            while k > 0 and open_.tags[k - 1] in ENDS[tag][0]:
                k -= 1
            close(k)
        if tag in VOID or (tag not in INLINE and m[2].rstrip().endswith("/") and tag in ("path", "use")):
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "wbr", "input"):
                say(" " if tag != "wbr" else "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            at = stop + 1 if end and stop >= 0 else size
            continue
        attributes: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(m[2]) if m[2].strip(" /") else ():
            attributes.setdefault(name.lower(), "".join(values))  # the first of equal names counts
        hidden = open_.hidden() or tag in HIDDEN or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        node = None
        if tag not in INLINE:
            if not hidden:
                flush()
            if tag not in ("html", "body") and not hidden:
                named = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "aria-label") if a in attributes).lower()
                hints = frozenset(h for w in WORDS.findall(named) for h in HINT_OF.get(w, ())) if named else frozenset()
                node = Node(tag, hints, block())
                nodes.append(node)
        open_.push(tag, node, hidden)
    flush()
    for n in reversed(nodes):
        if n.full and n.parent is not None:
            n.parent.full = True
    return [n for n in nodes if n.full]


STEPS = (3, 8, 16, 40)


def unary(node: Node) -> list[str]:
    """Names of the node's features."""
    if node.tag is not None:
        return ["e", f"e:{node.tag}" if node.tag in TAGS else "e:other", *(f"e#{h}" for h in sorted(node.hints))]
    n = node.text.count(" ") + 1
    share = node.linked / max(1, len(node.text))
    tag = node.parent.tag
    out = ["t", f"t:{tag}" if tag in TAGS else "t:other", f"t~{sum(n > s for s in STEPS)}", f"t@{0 if share == 0 else 1 if share < 0.5 else 2}", *(f"t#{h}" for h in sorted(node.parent.hints))]
    if node.text[-1] in ".!?…:;\"'”»":
        out.append("t.")
    if node.text[0] == "©" or "©" in node.text[:40]:
        out.append("t©")
    return out


def pair(node: Node) -> str:
    """The kind of the edge to the parent."""
    up = node.parent
    if node.tag is None:
        return "text" if up.parent is not None else "text/root"
    if up.parent is None:
        return "block/root"
    if "body" in up.hints or up.tag in ("article", "main"):
        return "block/body"
    return "block"


class Tree:
    """Nodes with the place of each one's parent (-1: none), features and kinds of edges."""

    def __init__(self, nodes: list[Node]):
        place = {id(n): k for k, n in enumerate(nodes)}
        self.nodes, self.up = nodes, [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        self.feats, self.kinds = [unary(n) for n in nodes], [pair(n) if n.parent is not None else None for n in nodes]


class Model:
    """Weights of unary features (log-odds of content) and of edges (of each pair of labels)."""

    def __init__(self, unary_weights: dict[str, float], edges: dict[str, list[list[float]]]):
        self.unary, self.edges = unary_weights, edges

    def marginals(self, tree: "Tree") -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each node, and of each edge P(parent, child) for 00, 01, 10, 11."""
        up, size, known = tree.up, len(tree.up), self.unary
        own = [sum([known.get(f, 0.0) for f in feats]) for feats in tree.feats]
        edge = [self.edges.get(kind) for kind in tree.kinds]
        zero = [[0.0, 0.0], [0.0, 0.0]]
        low, high = [0.0] * size, own[:]  # scores of labels 0 and 1 with all below
        message = [(0.0, 0.0)] * size
        for k in range(size - 1, 0, -1):  # upward: children stand after parents
            w = edge[k] or zero
            a = _plus(w[0][0] + low[k], w[0][1] + high[k])
            b = _plus(w[1][0] + low[k], w[1][1] + high[k])
            message[k] = (a, b)
            low[up[k]] += a
            high[up[k]] += b
        above = [(0.0, 0.0)] * size
        prob, joint = [0.0] * size, [(0.0, 0.0, 0.0, 0.0)] * size
        for k in range(size):  # downward
            if k:
                p, w = up[k], edge[k] or zero
                rest = (low[p] + above[p][0] - message[k][0], high[p] + above[p][1] - message[k][1])
                above[k] = (_plus(rest[0] + w[0][0], rest[1] + w[1][0]), _plus(rest[0] + w[0][1], rest[1] + w[1][1]))
                cells = (rest[0] + w[0][0] + low[k], rest[0] + w[0][1] + high[k], rest[1] + w[1][0] + low[k], rest[1] + w[1][1] + high[k])
                top = max(cells)
                raised = [math.exp(c - top) for c in cells]
                total = sum(raised)
                joint[k] = tuple(r / total for r in raised)
            z = low[k] + above[k][0] - high[k] - above[k][1]
            prob[k] = 1 / (1 + math.exp(z)) if z < 700 else 0.0
        return prob, joint


def _plus(a: float, b: float) -> float:
    top, gap = (a, b - a) if a > b else (b, a - b)
    return top + math.log1p(math.exp(gap)) if gap > -40 else top


def train(pages: list[tuple[str, str]], *, rounds: int = 100, rate: float = 0.3, decay: float = 0.003) -> Model:
    """The model of labelled pages: (html, main text with a line for each block)."""
    trees = []
    for html, text in pages:
        nodes, lines = parse(html), set(text.split("\n"))
        weight: dict[int, list[int]] = {}
        for n in reversed(nodes):
            own = weight.setdefault(id(n), [0, 0])
            if n.tag is None:
                own[n.text in lines] += len(n.text)
            n.label = int(own[1] > own[0])
            if n.parent is not None:
                total = weight.setdefault(id(n.parent), [0, 0])
                total[0] += own[0]
                total[1] += own[1]
        trees.append(Tree(nodes))
    size = max(1, len(trees))
    names = sorted({f for tree in trees for feats in tree.feats for f in feats})
    kinds = sorted({k for tree in trees for k in tree.kinds if k})
    model = Model(dict.fromkeys(names, 0.0), {k: [[0.0, 0.0], [0.0, 0.0]] for k in kinds})
    values = np.zeros(len(names) + 4 * len(kinds))
    at, first, second = {f: k for k, f in enumerate(names)}, np.zeros_like(values), np.zeros_like(values)
    base = {k: len(names) + 4 * i for i, k in enumerate(kinds)}
    for step in range(1, rounds + 1):
        grad = -decay * values
        for tree in trees:
            prob, joint = model.marginals(tree)
            for n, feats, kind, p, cells in zip(tree.nodes, tree.feats, tree.kinds, prob, joint):
                miss = (n.label - p) / size
                for f in feats:
                    grad[at[f]] += miss
                if kind:
                    b = base[kind]
                    for c in range(4):
                        grad[b + c] -= cells[c] / size
                    grad[b + 2 * n.parent.label + n.label] += 1 / size
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        values += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        model.unary = dict(zip(names, values.tolist()))
        model.edges = {k: [[float(values[b]), float(values[b + 1])], [float(values[b + 2]), float(values[b + 3])]] for k, b in base.items()}
    return model


#: Frames of the story in made pages: elements or classes that name it, elements that say nothing, and none.
LAYOUTS = {
    "article": ["<article>{}</article>"] * 4, "main": ["<main>{}</main>", "<main><article>{}</article></main>"], "content": ['<div class="content">{}</div>'], "post": ['<div id="main"><div class="post">{}</div></div>'],
    "body": ['<div class="article-body">{}</div>'], "entry": ['<section class="entry">{}</section>'], "plain": ["<div>{}</div>", "<div><div>{}</div></div>"], "bare": ["{}"] * 3, "alone": ["{}", "<article>{}</article>", "<div>{}</div>", "<main>{}</main>"],
}


def labelled_pages(n: int = 240, seed: int = 11, layouts: list[str] | None = None) -> list[tuple[str, str]]:
    """Pages of these layouts (all) with their main text; words are random letters. Of layout "alone" the story is the whole page."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=1, b=30: words(a, b).capitalize() + rng.choice([".", ".", ".", "", "!"])
    pick = rng.choice

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def junk() -> str:
        return pick([
            lambda: f"<nav>{links(rng.randint(2, 8))}</nav>", lambda: f'<div class="{pick(["menu", "nav", "navbar", "breadcrumbs"])}">{links(rng.randint(2, 6))}</div>',
            lambda: f'<div class="{pick(["ad", "ads", "advert", "sponsored", "promo"])}">{sentence(2, 25)}</div>', lambda: f'<div id="ad-{word()}"><p>{sentence(2, 25)}</p></div>',
            lambda: f"<aside>{pick(['', '<h2>' + words(1, 3) + '</h2>'])}<p>{sentence(3, 30)}</p>{links(3)}</aside>", lambda: f'<div class="{pick(["sidebar", "widget", "related"])}"><h3>{words(1, 3)}</h3>{links(4)}<p>{sentence(2, 20)}</p></div>',
            lambda: f'<div class="{pick(["cookie-notice", "consent", "notice", "alert", "popup"])}"><p>{sentence(4, 30)}</p><button>{word()}</button></div>', lambda: f"<form><label>{words(1, 3)}</label><input><p>{sentence(2, 12)}</p><button>{word()}</button></form>",
            lambda: f'<{pick(["section", "div"])} class="{pick(["comments", "comment-list", "discussion", "replies"])}"><h3>{words(1, 2)}</h3><div class="comment"><p>{sentence(3, 40)}</p><p>{sentence(3, 30)}</p></div></section>',
            lambda: f'<div class="{pick(["share", "social"])}">{links(3)}</div>', lambda: f'<div class="newsletter"><p>{sentence(3, 20)}</p></div>', lambda: f'<section id="comments"><article class="comment"><p>{sentence(3, 40)}</p></article></section>',
        ])()

    def head() -> str:
        return pick(["", f"<header><h1>{words(1, 4)}</h1><p>{sentence(2, 8)}</p></header>", f'<div id="header"><a href="/">{words(1, 3)}</a></div>', f"<header><a href='/'>{word()}</a><nav>{links(4)}</nav></header>"])

    def foot() -> str:
        return pick([f"<footer>&copy; {word()}.example &middot; {sentence(2, 20)}</footer>", f'<div class="footer"><p>{sentence(3, 20)}</p>{links(3)}</div>', f"<footer><p>{sentence(3, 25)}</p>{links(3)}</footer>"])

    def story() -> tuple[str, list[str]]:
        lines, out = [], []
        add = lambda open_, text, close: (lines.append(" ".join(text.split())), out.append(open_ + text + close))
        title, titled = sentence(1, 14), rng.random() < 0.85
        if titled:
            add("<h1>", title, "</h1>")
            if rng.random() < 0.3:
                out[-1] = "<header>" + out[-1] + "</header>"
        if rng.random() < 0.3:
            out.append("<p><b>" + title + "<br>")
            lines.append(title)
        for _ in range(rng.randint(0 if titled else 1, pick([2, 9]))):
            kind = rng.random()
            if kind < 0.7:
                text = " ".join(sentence(1, 40) for _ in range(rng.randint(1, 6)))
                if rng.random() < 0.2:
                    text, plain = f"{text} <a href='/{word()}'>LINK</a> {sentence()}", text
                    linked = words(1, 3)
                    lines.append(" ".join(text.replace(text[len(plain) + 1 : text.index("LINK")], "").replace("LINK</a>", linked).split()))
                    out.append("<p>" + text.replace("LINK", linked) + "</p>")
                else:
                    add("<p>", text, "</p>")
            elif kind < 0.8:
                add(pick(["<h2>", "<h3>"]), words(1, 8).capitalize(), "</h2>")
                out[-1] = out[-1].replace("</h2>", "</" + out[-1][1:3] + ">")
            elif kind < 0.9:
                items = [words(1, 12) for _ in range(rng.randint(1, 5))]
                lines += items
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.95:
                add("<blockquote><p>", sentence(2, 30), "</p></blockquote>")
            else:
                cells = [words(1, 4) for _ in range(4)]
                lines += cells
                out.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells[:2]) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in cells[2:]) + "</tr></table>")
        return "".join(out), lines

    found = []
    for _ in range(n):
        body, lines = story()
        layout = pick(layouts or list(LAYOUTS))
        wrap = pick(LAYOUTS[layout])
        if layout != "alone" and rng.random() < 0.25:
            cut = pick([f'<div class="ad">{sentence(2, 20)}</div>', f'<aside><p>{sentence(2, 25)}</p></aside>', f'<div class="share">{links(3)}</div>', f'<section class="comments"><p>{sentence(3, 30)}</p></section>'])
            body = body + cut
        parts = [wrap.replace("{}", body)]
        if layout != "alone":
            parts = [head(), *(junk() for _ in range(rng.randint(0, 3))), *parts, *(junk() for _ in range(rng.randint(0, 2))), foot()]
        page = "".join(parts)
        if layout != "alone" or rng.random() < 0.6:
            page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>"
        found.append((page, "\n".join(lines)))
    return found


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(html: str, model: Model, threshold: float = 0.5) -> str:
    nodes = parse(html)
    prob, _ = model.marginals(Tree(nodes)) if nodes else ([], None)
    return "\n".join(n.text for n, p in zip(nodes, prob) if n.tag is None and p >= threshold)


FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


def extract(pages: DataFrame, *, body: str = "html", keep: list[str] | None = None, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """keep (all columns unless given) with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def make() -> Callable:
        def work(column: pa.Array) -> list[pa.Array]:
            texts = [main_text(h.as_py(), shared.value, threshold) if h.is_valid else "" for h in column]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return scan(pages, body, make, FIELDS, pages.columns if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
