"""Main-text extraction from HTML by a tree-structured graphical model.

A tolerant parser builds the tree of block-level elements of a page; inline markup melts into the text of
its block. Every block node has a binary label, content or not. Node potentials are a logistic model
of the node's features (tag, hints in class and id, text and link lengths, position); edge potentials link
parent and child. Sum-product messages upward and downward give exact marginals, and the blocks with a
marginal above one half, in page order, are the text. The weights are learned by maximum likelihood, with the
same messages, on labelled pages that ``sample_pages`` composes from a seed, so training needs no data.

Pages are independent: one pass over the table, no shuffle; messages of all pages of a batch go level by level
in numpy.

Defined cases: null or empty html gives an empty text; broken markup (unclosed, crossed or cut-off tags) never
fails; head, script, style, form controls and comments are no text; repeated rows are each extracted; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Form controls and media: what they hold is no text of the page once their own end tag closes them.
HELD = frozenset("select option optgroup datalist button svg object canvas audio video noscript template annotation annotation-xml".split())
#: Labels, not prose, even where the end tag is missing.
LABELS = frozenset("option optgroup svg annotation annotation-xml".split())
#: An opening tag of these closes open ones, looking no further up than the scope.
CLOSES_HELD = {"option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select", "datalist"}), "button": ({"button"}, {"body"}), "select": ({"select"}, {"body"})}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr center".split()
    + "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd semantics".split()
) - {"center"}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An opening tag closes an open one of these kinds, looking no further up than the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_KNOWN = CLOSES_P | INLINE | VOID | RAW | HELD | {*IMPLIED, "html", "head", "body", "thead", "caption"}

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<other>[!?][^>]*(?:>|\Z))|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements nest no deeper: the innermost ends where another opens, as in browsers, so a page takes linear time.
MOST_DEPTH = 512
_SPACE = re.compile(r"\s+")
_HINT_SPLIT = re.compile(r"[^a-z0-9]+")

# words in class, id and role that hint at a block's part
HINTS = {
    "content": "article content main post entry story body text prose blog copy page single".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs skip toolbar links topnav".split(),
    "footer": "footer foot colophon copyright legal bottom credits".split(),
    "header": "header masthead banner top topbar head brand logo hero".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommend popular trending more also tags share social author bio".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall promo toast message warning".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored banner-ad promoted adsbygoogle dfp outbrain taboola".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader readers feedback".split(),
    "form": "form login search searchbox contact field input".split(),
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws}
TAG_GROUPS = {
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol menu dl", "item": "li dt dd", "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer",
    "aside": "aside", "form": "form fieldset search", "section": "section", "div": "div", "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre figure figcaption", "root": "html body",
}
_GROUP_OF = {t: g for g, ts in TAG_GROUPS.items() for t in ts.split()}
SCALARS = ["bias", "own_text", "own_long", "tree_text", "own_links", "tree_links", "sentences", "rights", "in_article", "first_half", "leaf"]
FEATURES = [*SCALARS, *(f"tag_{g}" for g in TAG_GROUPS), *(f"hint_{h}" for h in HINTS), *(f"under_{h}" for h in HINTS), *(f"under_tag_{t}" for t in ("nav", "footer", "aside", "form", "header"))]
_AT = {f: i for i, f in enumerate(FEATURES)}


class Node:
    __slots__ = ("tag", "parent", "hints", "label", "own", "links", "depth")

    def __init__(self, tag: str, parent: int, hints: tuple, label: str | None, depth: int):
        self.tag, self.parent, self.hints, self.label, self.depth = tag, parent, hints, label, depth
        self.own = self.links = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level nodes (parents first) and (node, text) of every text block in page order."""
    nodes = [Node("html", -1, (), None, 0)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements: tag, index of their block node
    held: list[tuple] = []  # open form controls and media: place in the stack, and what to return to at their end tag
    current, pending, link = 0, [], 0
    at, n = 0, len(page)
    opened: Counter[str] = Counter()  # open elements by tag

    def flush() -> None:
        nonlocal pending
        if pending:
            text = _SPACE.sub(" ", html.unescape("".join(pending))).strip()
            if text:
                blocks.append((current, text))
                nodes[current].own += len(text)
            pending = []

    def enter(tag: str) -> None:
        if len(stack) >= MOST_DEPTH:
            pop_to(MOST_DEPTH - 1)
        stack.append((tag, current))
        opened[tag] += 1

    def shut(i: int) -> None:
        nonlocal link
        for t, _ in stack[i:]:
            opened[t] -= 1
            link -= t == "a"
        del stack[i:]

    def pop_to(i: int) -> None:
        nonlocal current
        if any(t not in INLINE for t, _ in stack[i:]):
            flush()
        shut(i)
        while held and held[-1][0] >= i:
            held.pop()
        current = stack[-1][1] if stack else 0

    def hold(tag: str) -> None:
        kinds, scope = CLOSES_HELD.get(tag, ((), ()))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                pop_to(i)
            elif stack[i][0] in scope:
                break
        if len(stack) >= MOST_DEPTH:
            pop_to(MOST_DEPTH - 1)
        held.append((len(stack), current, pending, len(pending), len(blocks), len(nodes), nodes[current].own, nodes[current].links, link))
        enter(tag)

    def let_go(i: int) -> None:
        """Drop what the element at i of the stack held; one around an article was left open by mistake and is kept."""
        nonlocal current, pending, link
        mark = next(h for h in held if h[0] == i)
        if any(x.tag in ("article", "main", "body") for x in nodes[mark[5] :]):
            pop_to(i)
            return
        shut(i)
        _, current, pending, said, n_blocks, n_nodes, own, links, link = mark
        nodes[current].own, nodes[current].links = own, links
        del pending[said:], blocks[n_blocks:], nodes[n_nodes:]
        while held and held[-1][0] >= i:
            held.pop()

    def say(text: str) -> None:
        if held and text and next((t for t, _ in reversed(stack) if t not in INLINE), "") in LABELS:
            return
        if text:
            pending.append(text)
            if link:
                nodes[current].links += len(text.strip())

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw text
        say(page[at : m.start()])
        at = m.end()
        if m["open"]:
            tag = m["open"].lower()
            attrs = m["attrs"] or ""
            if tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else n
                continue
            if tag in HELD:
                if not attrs.rstrip().endswith("/"):
                    hold(tag)
                continue
            if held and tag not in _KNOWN and stack[held[-1][0]][0] == "svg":
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr", "img"):
                    pending.append(" " if tag == "br" else "")
                continue
            if tag in INLINE:
                enter(tag)
                link += tag == "a"
                continue
            kinds, scope = IMPLIED.get(tag, ((), ()))
            if tag in CLOSES_P or tag in IMPLIED:
                kinds = {*kinds, "p"}
            lowest = None
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t in kinds:
                    lowest = i
                elif t in scope or t not in INLINE and t != "p" and not (kinds and t in kinds) and tag not in IMPLIED:
                    break
                elif tag in IMPLIED and t in ("table", "ul", "ol", "dl", "article", "section", "div", "body"):
                    break
            if lowest is not None:
                pop_to(lowest)
            flush()
            found = dict((k.lower(), v.strip("\"'")) for k, v in _ATTR.findall(attrs)) if attrs else {}
            words = _HINT_SPLIT.split(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()) if found else ()
            hints = tuple({_HINT_OF[w] for w in words if w in _HINT_OF})
            label = found.get("data-label")
            if "hidden" in found or "display:none" in found.get("style", "").replace(" ", ""):
                hints = (*hints, "notice")
            if len(stack) >= MOST_DEPTH:
                pop_to(MOST_DEPTH - 1)
            nodes.append(Node(tag, current, hints, label, nodes[current].depth + 1))
            current = len(nodes) - 1
            enter(tag)
        elif m["close"]:
            tag = m["close"].lower()
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in HELD:
                        let_go(i)
                    else:
                        pop_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
    say(page[at:])
    flush()
    return nodes, blocks


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> np.ndarray:
    n = len(nodes)
    x = np.zeros((n, len(FEATURES)))
    tree, links = [node.own for node in nodes], [node.links for node in nodes]
    children = [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        tree[p] += tree[i]
        links[p] += links[i]
        children[p] += 1
    x[:, _AT["bias"]] = 1
    under: list[frozenset] = []
    before = 0
    for i, node in enumerate(nodes):
        row = x[i]
        row[_AT["own_text"]] = np.log1p(node.own) / 5
        row[_AT["own_long"]] = node.own > 80
        row[_AT["tree_text"]] = np.log1p(tree[i]) / 8
        row[_AT["own_links"]] = min(1.0, node.links / node.own) if node.own else 0.0
        row[_AT["tree_links"]] = min(1.0, links[i] / tree[i]) if tree[i] else 0.0
        row[_AT["first_half"]] = before * 2 < tree[0]
        row[_AT["leaf"]] = children[i] == 0
        before += node.own
        if node.tag in _GROUP_OF:
            row[_AT["tag_" + _GROUP_OF[node.tag]]] = 1
        for h in node.hints:
            row[_AT["hint_" + h]] = 1
        above = under[node.parent] if i else frozenset()
        for a in above:
            row[_AT[a]] = 1
        mine = {f"under_{h}" for h in node.hints}
        if node.tag in ("nav", "footer", "aside", "form", "header"):
            mine.add("under_tag_" + node.tag)
        if node.tag in ("article", "main") or "content" in node.hints:
            mine.add("in_article")
        under.append(above | mine if mine else above)
    for i, text in blocks:
        x[i, _AT["sentences"]] = min(1.0, x[i, _AT["sentences"]] + 0.25 * (text.count(". ") + text.endswith((".", "!", "?"))))
        if "©" in text[:40] or "All rights" in text:
            x[i, _AT["rights"]] = 1
    return x


class Forest:
    """Trees of many pages, laid out for messages by level."""

    def __init__(self, parents: np.ndarray, depth: np.ndarray):
        self.parent = parents
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2 if len(depth) else 1))
        self.levels = [x for x in np.split(order, cuts) if len(x)]


def marginals(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Node marginals (n x 2), pair marginals (n x 2 x 2: parent, child; roots are 0) and the log partition sum."""
    n = len(unary)
    below = unary.copy()
    up = np.zeros((n, 2))  # message to the parent
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    for level in reversed(forest.levels[1:]):
        up[level] = lse(below[level][:, None, :] + edge[None], 2)
        np.add.at(below, forest.parent[level], up[level])
    roots = forest.levels[0]
    total = float(lse(below[roots], 1).sum())
    belief, pair = below.copy(), np.zeros((n, 2, 2))
    belief[roots] -= lse(below[roots], 1)[:, None]
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - up[level]
        joint = rest[:, :, None] + edge[None] + below[level][:, None, :]
        joint -= lse(joint.reshape(len(level), 4), 1)[:, None, None]
        pair[level] = np.exp(joint)
        belief[level] = lse(joint, 1)
    return np.exp(belief), pair, total


def sample_pages(count: int, seed: int = 5) -> list[str]:
    """Labelled pages of many layouts: blocks of main text carry data-label=1, everything else 0."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("an", "be", "tion", "er", "ou", "la", "stri", "men", "é", "ü", "ko", "re") for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    noise = lambda: pick("", "", "", "%%%", "$$$", "!!", " |")

    def prose() -> str:
        tail = noise()
        style = rng.random()
        text = " ".join(words(1, 14).capitalize() + tail + pick(".", ".", ".", "", "!", "?") for _ in range(int(rng.integers(1, 6))))
        return text if style < 0.9 else words(1, 4)

    def links(k: int) -> str:
        return "".join(pick(f'<li data-label="0"><a href="/{word()}">{words(1, 3)}</a></li>', f'<a href="#">{words(1, 3)}</a> ') for _ in range(k))

    def junk(kind: str) -> str:
        k = int(rng.integers(2, 8))
        if kind == "nav":
            return pick(f'<nav data-label="0"><ul data-label="0">{links(k)}</ul></nav>', f'<div data-label="0" class="{pick("menu", "navbar", "breadcrumb", "top-nav")}">{links(k)}</div>', f'<ul data-label="0" id="menu">{links(k)}</ul>')
        if kind == "ad":
            return pick(f'<div data-label="0" class="{pick("ad", "ads", "advert", "sponsored", "promo")}">{prose()}</div>', f'<aside data-label="0" class="ad-box"><p data-label="0">{prose()}</p></aside>', f'<div data-label="0" id="{pick("ad-1", "ad_top", "advertisement")}"><p data-label="0">{prose()}</p></div>')
        if kind == "side":
            return pick(f'<aside data-label="0"><h3 data-label="0">{words(1, 4)}</h3><p data-label="0">{prose()}</p><ul data-label="0">{links(k)}</ul></aside>', f'<div data-label="0" class="{pick("sidebar", "related", "widget", "share", "author-bio")}"><h4 data-label="0">{words(1, 4)}</h4><p data-label="0">{prose()}</p>{links(k)}</div>')
        if kind == "notice":
            return f'<{(t := pick("div", "section", "aside"))} data-label="0" class="{pick("cookie-banner", "cookie-notice", "consent", "notice", "newsletter", "alert", "popup")}"><p data-label="0">{prose()}</p></{t}>' if chance(0.6) else f'<div data-label="0" id="{pick("cookie", "gdpr", "notice")}">{prose()}</div>'
        if kind == "form":
            return f'<form data-label="0"><p data-label="0">{prose()}</p><label>{words(1, 4)}</label><input name="q">{words(0, 3)}<button>{word()}</button></form>'
        if kind == "comment":
            one = lambda: pick(f'<div data-label="0" class="comment"><p data-label="0">{prose()}</p></div>', f'<li data-label="0"><p data-label="0">{prose()}</p></li>', f'<article data-label="0" class="comment"><p data-label="0">{prose()}</p></article>')
            return f'<{(t := pick("section", "div", "ol", "aside"))} data-label="0" {pick("class", "id")}="{pick("comments", "comment-list", "reader-comments", "replies", "discussion")}"><h3 data-label="0">{words(1, 3)}</h3>{"".join(one() for _ in range(int(rng.integers(1, 5))))}</{t}>'
        if kind == "header":
            return pick(f'<header data-label="0"><div data-label="0" class="logo">{words(1, 3)}</div><p data-label="0">{prose()}</p></header>', f'<header data-label="0"><h1 data-label="0">{words(1, 4)}</h1></header>', f'<div data-label="0" class="{pick("header", "masthead", "site-header")}"><p data-label="0">{words(1, 6)}</p></div>', f'<header data-label="0">{words(2, 9)}.</header>')
        return pick(f'<footer data-label="0">&copy; {word()}.example.com &middot; {prose()}</footer>', f'<footer data-label="0"><p data-label="0">{prose()}</p>{links(3)}</footer>', f'<div data-label="0" class="footer"><p data-label="0">&copy; {words(2, 9)}. {prose()}</p></div>')

    pages = []
    for _ in range(count):
        body = [f'<h{(h := pick(1, 1, 2))} data-label="1">{words(2, 12)}{noise()}</h{h}>'] if chance(0.85) else []
        if chance(0.1) and body:
            body = [f'<header data-label="1">{body[0]}</header>']
        for _ in range(int(rng.integers(0 if body and chance(0.1) else 1, 9))):
            r = rng.random()
            inline = prose() if chance(0.8) else f'{words(2, 9)} <a href="/x">{words(1, 3)}</a> {prose()}'
            if r < 0.72:
                body.append(f'<p data-label="1">{pick("", "", "<b>")}{inline}{pick("</p>", "</p>", "</p>", "<br>", "")}')
            elif r < 0.78:
                body.append(f'<ul data-label="1">{"".join(f"<li data-label=1>{prose()}</li>" for _ in range(int(rng.integers(2, 5))))}</ul>')
            elif r < 0.83:
                body.append(f'<h{(h := pick(2, 3))} data-label="1">{words(1, 7)}</h{h}>')
            elif r < 0.87:
                body.append(f'<blockquote data-label="1"><p data-label="1">{prose()}</p></blockquote>')
            elif r < 0.9:
                body.append(f'<table data-label="1"><tr data-label="1"><td data-label="1">{words(1, 4)}</td><td data-label="1">{words(1, 4)}</td></tr></table>')
            elif r < 0.93:
                body.append(f'<div data-label="1">{prose()}</div>')
            elif r < 0.95:
                body.append(f'<pre data-label="1">{prose()}</pre>')
            else:
                body.append(junk(pick("ad", "side", "notice", "form", "nav")))
        if chance(0.25):
            body.append(junk(pick("comment", "side", "form", "nav", "comment")))
        inner = "".join(body)
        shell = pick("article", "article", "article", "main", "div", "section", "div-c", "div-c", "bare")
        if shell == "div-c":
            inner = f'<div data-label="1" {pick("class", "id")}="{pick("content", "post", "entry-content", "article-body", "story", "main", "post-text")}">{inner}</div>'
        elif shell != "bare":
            inner = f'<{shell} data-label="1">{inner}</{shell}>'
        if chance(0.3):
            inner = f'<{(t := pick("main", "div", "section"))} data-label="1">{inner}{junk(pick("side", "comment", "ad", "footer")) if chance(0.4) else ""}</{t}>'
        lead = [junk(k) for k in ("header", "nav", "notice", "ad", "side") if chance(0.5)]
        trail = [junk(k) for k in ("comment", "side", "form", "ad", "notice", "nav") if chance(0.3)] + ([junk("footer")] if chance(0.8) else [])
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body data-label=\"1\">{''.join(lead)}{inner}{''.join(trail)}</body></html>")
    return pages


@functools.lru_cache(maxsize=2)
def train(count: int = 500, steps: int = 180, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and edge potentials by penalised maximum likelihood on the labelled pages."""
    xs, ys, parents, depths, at = [], [], [], [], 0
    for page in sample_pages(count, seed):
        nodes, blocks = parse(page)
        xs.append(features(nodes, blocks))
        label = [1]
        for node in nodes[1:]:
            label.append(int(node.label) if node.label is not None else label[node.parent])
        ys += label
        parents += [node.parent + at if node.parent >= 0 else -1 for node in nodes]
        depths += [node.depth for node in nodes]
        at += len(nodes)
    x, y, parent = np.concatenate(xs), np.array(ys), np.array(parents)
    forest = Forest(parent, np.array(depths))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1)
    w, edge = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(edge), np.zeros_like(edge)]
    for t in range(1, steps + 1):
        unary = np.stack([np.zeros(len(x)), x @ w], axis=1)
        p, pair, _ = marginals(forest, unary, edge)
        grads = (x.T @ (y - p[:, 1]) / len(x) - 5e-5 * w, (seen - pair.sum(axis=0)) / len(x) - 5e-5 * edge)
        for value, g, k in ((w, grads[0], 0), (edge, grads[1], 2)):
            moments[k][...] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1][...] = 0.99 * moments[k + 1] + 0.01 * g * g
            value += 0.15 * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
    return w, edge


def extract_pages(pages: list[str], model: tuple[np.ndarray, np.ndarray], batch: int = 64) -> list[str]:
    """The main text of each page: blocks joined by a blank line."""
    w, edge = model
    out: list[str] = []
    for lo in range(0, len(pages), batch):
        parsed = [parse(page or "") for page in pages[lo : lo + batch]]
        x = np.concatenate([features(*one) for one in parsed])
        sizes = np.cumsum([0, *(len(nodes) for nodes, _ in parsed)])
        parent = np.array([node.parent + at if node.parent >= 0 else -1 for (nodes, _), at in zip(parsed, sizes) for node in nodes])
        forest = Forest(parent, np.array([node.depth for nodes, _ in parsed for node in nodes]))
        content = marginals(forest, np.stack([np.zeros(len(x)), x @ w], axis=1), edge)[0][:, 1]
        for (_, blocks), at in zip(parsed, sizes):
            out.append("\n\n".join(text for i, text in blocks if content[at + i] > 0.5))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    model = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = extract_pages(b.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
