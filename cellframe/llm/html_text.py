"""Main text of web pages: content marginals on the DOM by sum-product message passing.

A page becomes a tree of its block elements; the runs of inline text between their edges are its leaves. Every node is
content or not. Its own evidence is log-linear in features (tag, words of class, id and role, length, share of linked
text, punctuation); a table of four potentials for each kind of edge couples a child to its parent. Messages go up and
then down, level by level over many pages at once, and give exact marginals; leaves at 0.5 or more are kept in page
order. Weights and potentials maximise the likelihood of labelled pages (gradient: observed minus expected features).

Labelled pages are ``labelled_pages``, made from a seeded grammar of layouts, and at most ``SAMPLE`` rows of the table
itself whose own markup says what is content (one article or main element), in the order of a hash.

Defined results: a null or empty page, or one without content, gives an empty text; broken markup is closed as browsers
do for paragraphs, list items and table cells; repeated rows give equal texts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, sample_rows

SAMPLE, STEPS, PAGES = 200, 160, 500

# Element names by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg select xmp".split())
HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())
ENDS_SVG = "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|menu|ol|p|pre|s|small|span|strong|sub|sup|table|tt|u|ul"
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr picture source".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "dl", "table", "body", "html"}
GROUPS = ("article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody thead tfoot tr", "td th", "blockquote pre figure figcaption", "nav", "header", "footer", "aside", "form fieldset button dialog", "body html")
GROUP = {t: i for i, names in enumerate(GROUPS) for t in names.split()}
# Words of class, id and role attributes.
BAD = (
    "nav|menu|breadcrumb|pagination|pager|toc|tabs", "header|masthead|banner|topbar|logo|branding", "footer|copyright|colophon|legal|bottom", "side|sidebar|aside|rail|widget|related|recommended|trending|popular|tags",
    "ad|ads|advert|advertisement|adsense|sponsor|sponsored|promo|promoted", "cookie|consent|notice|gdpr|popup|modal|overlay|alert|paywall|newsletter|subscribe|signup|login|search|form|share|social|toolbar|skip", "comment|comments|reply|replies|discussion|disqus|respond|feedback|reviews",
)
GOOD = "article|content|main|post|entry|story|body|text|prose|blog|page"
_BAD = [re.compile(rf"(?:^|[^a-z])(?:{w})(?:[^a-z]|$)") for w in BAD]
_GOOD = re.compile(rf"(?:^|[^a-z])(?:{GOOD})(?:[^a-z]|$)")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_AFTER_SVG = re.compile(rf"<(?:{ENDS_SVG})(?=[\s/>])", re.I)
_ATTR = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "bad", "good", "hidden", "depth", "text", "linked", "chars", "links", "leaves", "y")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.bad, self.good, self.hidden, self.text, self.linked = 0, False, False, None, 0
        self.chars = self.links = self.leaves = 0
        self.y = 0


def parse(page: str) -> list[Node]:
    """Block elements and text leaves, parents first, in page order; scripts, styles, comments and the head leave nothing."""
    nodes = [Node("html", -1, 0)]
    open_tags: list[tuple[str, int]] = [("html", 0)]  # every open element and the block it belongs to
    run: list[str] = []
    run_links = 0
    in_link = 0
    head = False

    def flush() -> None:
        nonlocal run_links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                block = open_tags[-1][1]
                leaf = Node("", block, nodes[block].depth + 1)
                leaf.text, leaf.linked = text, min(run_links, len(text))
                nodes.append(leaf)
        run_links = 0

    def add(text: str) -> None:
        nonlocal run_links, head
        head = head and (not text or text.isspace())
        if text and not head:
            run.append(text)
            if in_link:
                run_links += len(text.strip())

    def close(n: int) -> None:
        nonlocal in_link
        for tag, _ in reversed(open_tags[n:]):
            if tag not in INLINE:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            open_tags.pop()

    def close_until(names: set[str], stop: set[str]) -> None:
        for i in range(len(open_tags) - 1, 0, -1):
            tag = open_tags[i][0]
            if tag in names:
                close(i)
                return
            if tag in stop:
                return

    at = 0
    while True:
        m = _MARK.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "head":
                head = False
            if tag == "br":
                add(" ")
            for i in range(len(open_tags) - 1, 0, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and open_tags[i][0] not in INLINE:
                    break
            continue
        if tag == "head":
            head = True
            continue
        if tag in ("html", "body"):
            head = False
            continue
        if tag not in HEAD:
            head = False
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea") else None
            if end:
                at = end.end()
            elif not attributes.rstrip().endswith("/"):
                after = _AFTER_SVG.search(page, at) if tag == "svg" else None
                at = after.start() if after else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag != "wbr":
                add(" ")
            continue
        if tag in INLINE:
            open_tags.append((tag, open_tags[-1][1]))
            in_link += tag == "a"
            continue
        if tag in CLOSES_P:
            close_until({"p"}, STOPS | {"div", "section", "article", "td", "li", "button"})
        if tag in SIBLINGS:
            close_until(SIBLINGS[tag], STOPS - ({"table"} if tag == "option" else set()))
        flush()
        node = Node(tag, open_tags[-1][1], nodes[open_tags[-1][1]].depth + 1)
        if attributes:
            words = []
            for key, value in _ATTR.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    words.append(_CAMEL.sub("-", value).lower())
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                    node.hidden = True
            if words:
                said = " ".join(words)
                node.bad = sum(1 << i for i, p in enumerate(_BAD) if p.search(said))
                node.good = bool(_GOOD.search(said))
        open_tags.append((tag, len(nodes)))
        nodes.append(node)
    close(1)
    flush()
    for n in reversed(nodes):
        if n.text is not None:
            n.chars, n.links, n.leaves = len(n.text), n.linked, 1
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars, up.links, up.leaves = up.chars + n.chars, up.links + n.links, up.leaves + n.leaves
    return nodes


_N = len(GROUPS) + 1 + len(BAD) + 2
_OWN = 10
DIM = 2 * (_N + _OWN)


def _features(nodes: list[Node]) -> list[list[float]]:
    out = []
    for n in nodes:
        leaf = n.text is not None
        holder = nodes[n.parent] if leaf else n
        x = [0.0] * DIM
        at = _N + _OWN if leaf else 0
        x[at + GROUP.get(holder.tag, len(GROUPS))] = 1.0
        base = at + len(GROUPS) + 1
        for i in range(len(BAD)):
            if holder.bad >> i & 1:
                x[base + i] = 1.0
        base += len(BAD)
        x[base], x[base + 1] = float(holder.good and not holder.bad), float(holder.hidden)
        base += 2
        share = n.links / n.chars if n.chars else 0.0
        x[base], x[base + 1], x[base + 2] = 1.0, log1p(n.chars) / 5, share
        if leaf:
            words = n.text.split(" ")
            x[base + 3], x[base + 4], x[base + 5] = float(n.text[-1] in ".!?…。:;\"”»"), min(n.text.count(",") + n.text.count("."), 10) / 10, float(len(words) < 4)
            x[base + 6], x[base + 7] = float(len(words) > 12), float(len(words) > 30)
            x[base + 8], x[base + 9] = float("©" in n.text), float(n.chars and share > 0.8)
        else:
            x[base + 3], x[base + 4], x[base + 5] = log1p(n.leaves) / 3, log1p(n.chars / max(n.leaves, 1)) / 5, float(share > 0.5)
            x[base + 6], x[base + 7] = float(n.leaves == 0), float(n.depth > 5)
        out.append(x)
    return out


class Forest:
    """The nodes of many pages as arrays, grouped by depth for messages."""

    def __init__(self, pages: list[list[Node]]):
        flat = [n for p in pages for n in p]
        first = np.cumsum([0] + [len(p) for p in pages])
        self.parent = np.array([n.parent + first[i] if n.parent >= 0 else -1 for i, p in enumerate(pages) for n in p], np.int64)
        self.kind = np.array([int(n.text is not None) for n in flat], np.int64)
        depth = np.array([n.depth for n in flat], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(flat) else []
        self.x = np.array([f for p in pages for f in _features(p)], np.float64).reshape(-1, DIM)
        self.y = np.array([n.y for n in flat], np.int64)

    def marginals(self, w: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node is content), and P(parent, child) of each node's edge, by one pass up and one down."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = self.x @ w
        message = np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            e = edges[self.kind[level]] + up[level][:, None, :]  # parent, child
            message[level] = np.logaddexp(e[:, :, 0], e[:, :, 1])
            message[level] -= message[level].max(axis=1, keepdims=True)
            np.add.at(up, self.parent[level], message[level])
        belief = up.copy()
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]
            e = edges[self.kind[level]] + above[:, :, None]
            belief[level] += np.logaddexp(e[:, 0, :], e[:, 1, :])
            j = e + up[level][:, None, :]
            j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
            joint[level] = j / j.sum(axis=(1, 2), keepdims=True)
            belief[level] -= belief[level].max(axis=1, keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), joint


def fit(pages: list[list[Node]], l2: float = 3e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials of greatest likelihood, by Adam on exact gradients."""
    forest = Forest(pages)
    theta, m, v = np.zeros(DIM + 8), np.zeros(DIM + 8), np.zeros(DIM + 8)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[inner], forest.y[forest.parent[inner]], forest.y[inner]), 1)
    for t in range(1, STEPS + 1):
        p, joint = forest.marginals(theta[:DIM], theta[DIM:].reshape(2, 2, 2))
        expected = np.stack([joint[inner][forest.kind[inner] == k].sum(axis=0) for k in (0, 1)])
        g = np.concatenate([forest.x.T @ (forest.y - p), (seen - expected).ravel()]) / max(len(inner), 1) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:DIM], theta[DIM:].reshape(2, 2, 2)


def _label(nodes: list[Node], content: list[bool]) -> list[Node]:
    """Leaves by ``content``; a block is content if most of the text in it is."""
    own = [0] * len(nodes)
    for n, y in zip((n for n in nodes if n.text is not None), content):
        n.y = int(y)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.text is not None:
            own[i] = n.chars * n.y
        else:
            n.y = int(2 * own[i] > n.chars)
        if n.parent >= 0:
            own[n.parent] += own[i]
    return nodes


def labelled_by_markup(page: str) -> list[Node] | None:
    """A page with one article or main element: its leaves are content unless a block in between says otherwise."""
    nodes = parse(page)
    roots = [i for i, n in enumerate(nodes) if n.tag == "article"] or [i for i, n in enumerate(nodes) if n.tag == "main"]
    if len(roots) != 1:
        return None
    state = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i == roots[0]:
            state[i] = True
        elif n.parent >= 0:
            state[i] = state[n.parent] and not (n.bad or n.hidden or n.tag in ("nav", "footer", "aside", "form", "button", "dialog"))
    return _label(nodes, [state[i] for i, n in enumerate(nodes) if n.text is not None])


def labelled_pages(count: int = PAGES, seed: int = 23) -> list[list[Node]]:
    """Pages of many layouts from a grammar, with the label of every block known as it is written."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni ro su ta ve li an or es in to ra de".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 22) -> str:
        s = words(low, high)
        return s.capitalize() + rng.choice("....!?")

    def paragraph() -> str:
        glue = rng.choice([" "] * 9 + [" | "])
        text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
        return text if glue == " " else text.replace(" ", glue) + rng.choice(["", " |"])

    def link(text: str) -> str:
        return f'<a href="/{text[:5]}">{text}</a>'

    def attr(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1, 1)}"', f" class='{words(1, 1)}-{name}'", f' class="{name}-{rng.randint(1, 9)}"'])

    class Out:
        def __init__(self):
            self.parts, self.labels = [], []

        def raw(self, s: str) -> None:
            self.parts.append(s)

        def block(self, open_: str, text: str, close: str, y: bool) -> None:
            self.parts.append(open_ + text + close)
            self.labels.append(y)

        def items(self, tag: str, texts: list[str], y: bool = False) -> None:
            self.raw(f"<{tag}>")
            for t in texts:
                self.block("<li>", t, rng.choice(["</li>", "</li>", ""]), y)
            self.raw(f"</{tag}>")

    def menu(o: Out) -> None:
        links = [link(words(1, 2)) for _ in range(rng.randint(3, 9))]
        kind = rng.randint(0, 3)
        if kind == 0:
            o.raw("<nav>")
            o.items("ul", links)
            o.raw("</nav>")
        elif kind == 1:
            o.raw(f"<div{attr('menu', 'nav', 'navbar', 'main-menu', 'breadcrumbs')}>")
            o.items("ul", links)
            o.raw("</div>")
        elif kind == 2:
            o.block(f"<div{attr('nav', 'topnav', 'links')}>", " | ".join(links), "</div>", False)
        else:
            o.items("ul", links)

    def header(o: Out) -> None:
        tag = rng.choice(["header", "div"])
        o.raw(f"<{tag}{attr('header', 'masthead', 'site-header', 'banner', 'topbar') if tag == 'div' or rng.random() < 0.5 else ''}>")
        name = rng.choice(["h1", "div", "p"])
        o.block(f"<{name}>", link(words(1, 3)), f"</{name}>", False)
        if rng.random() < 0.5:
            o.block("<p>", words(3, 7), "</p>", False)
        if rng.random() < 0.5:
            menu(o)
        o.raw(f"</{tag}>")

    def footer(o: Out) -> None:
        tag = rng.choice(["footer", "footer", "div"])
        o.raw(f"<{tag}{attr('footer', 'site-footer', 'bottom', 'colophon') if tag == 'div' else ''}>")
        if rng.random() < 0.4:
            o.items("ul", [link(words(1, 2)) for _ in range(rng.randint(2, 5))])
        name = rng.choice(["p", "div"])
        o.block(f"<{name}>", "&copy; " + words(1, 3) + " &middot; " + rng.choice([sentence(), words(1, 4)]), f"</{name}>", False)
        o.raw(f"</{tag}>")

    def advert(o: Out) -> None:
        o.block(f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}>", rng.choice([paragraph(), sentence(), link(words(2, 5))]), "</div>", False)

    def notice(o: Out) -> None:
        tag = rng.choice(["div", "section"])
        o.raw(f"<{tag}{attr('cookie-notice', 'notice', 'consent', 'popup', 'newsletter', 'alert')}>")
        o.block("<p>", paragraph(), "</p>", False)
        if rng.random() < 0.6:
            o.block("<button>", words(1, 2), "</button>", False)
        o.raw(f"</{tag}>")

    def sidebar(o: Out) -> None:
        tag = rng.choice(["aside", "aside", "div"])
        o.raw(f"<{tag}{attr('sidebar', 'side', 'related', 'widget') if tag == 'div' or rng.random() < 0.5 else ''}>")
        o.block("<h3>", words(1, 3), "</h3>", False)
        if rng.random() < 0.5:
            o.items("ul", [link(words(3, 8)) for _ in range(rng.randint(2, 6))])
        else:
            o.block("<p>", paragraph(), "</p>", False)
        o.raw(f"</{tag}>")

    def form(o: Out) -> None:
        o.raw(f"<form{attr('search', 'login', 'contact-form') if rng.random() < 0.5 else ''}>")
        o.block("<p>", f"<label>{words(1, 3)}</label><input name=q>", "</p>", False)
        if rng.random() < 0.5:
            o.block("<p>", sentence(), "</p>", False)
        o.raw("</form>")

    def comments(o: Out) -> None:
        tag = rng.choice(["div", "section"])
        o.raw(f"<{tag}{attr('comments', 'comment-list', 'discussion', 'replies')}>")
        o.block("<h3>", words(1, 3), "</h3>", False)
        for _ in range(rng.randint(1, 5)):
            name = rng.choice(["div", "div", "article"])
            o.raw(f"<{name}{rng.choice([' class=comment', ' class="reply"', ''])}>")
            o.block("<p>", paragraph(), "</p>", False)
            o.raw(f"</{name}>")
        o.raw(f"</{tag}>")

    def article(o: Out) -> None:
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        o.raw(f"<{tag}{attr('content', 'article', 'post', 'entry', 'story', 'main', 'post-body') if tag in ('div', 'section') and rng.random() < 0.7 else ''}>")
        if rng.random() < 0.8:
            o.block("<h1>", words(2, 12).capitalize() + rng.choice(["", "."]), "</h1>", True)
        for _ in range(rng.choice([1, 2, 4, 8, 12, 20])):
            r = rng.random()
            if r < 0.7:
                text = paragraph()
                if rng.random() < 0.2:
                    text = text.replace(" ", " " + link(words(1, 2)) + " ", 1)
                o.block("<p>", text, rng.choice(["</p>", "</p>", ""]), True)
            elif r < 0.78:
                o.block("<p><b>", sentence(), "<br>", True)
            elif r < 0.84:
                name = rng.choice(["h2", "h3"])
                o.block(f"<{name}>", words(1, 7).capitalize(), f"</{name}>", True)
            elif r < 0.88:
                o.items(rng.choice(["ul", "ol"]), [sentence(2, 12) for _ in range(rng.randint(2, 5))], True)
            elif r < 0.92:
                o.block("<blockquote>", paragraph(), "</blockquote>", True)
            elif r < 0.94:
                o.block("<pre>", words(3, 20), "</pre>", True)
            elif r < 0.96:
                o.raw("<table><tr>")
                for _ in range(4):
                    o.block("<td>", words(1, 4), "</td>", True)
                o.raw("</tr></table>")
            else:
                rng.choice([advert, advert, notice, sidebar])(o)
        o.raw(f"</{tag}>")

    pages = []
    while len(pages) < count:
        o = Out()
        o.raw("<!DOCTYPE html><html><head><title>" + words(2, 5) + "</title><style>p{}</style></head><body>")
        wrap = rng.choice(["", "", "<div>", "<div id='page'>", "<div class=\"container\"><div>"])
        o.raw(wrap)
        before, after = [header, menu, notice, advert, form], [sidebar, comments, advert, form, notice, menu]
        for part in rng.sample(before, rng.randint(0, 4)):
            part(o)
        if rng.random() < 0.25:
            sidebar(o)
        article(o)
        for part in rng.sample(after, rng.randint(0, 4)):
            part(o)
        if rng.random() < 0.85:
            footer(o)
        o.raw("</div>" * wrap.count("<div") + rng.choice(["</body></html>", ""]))
        nodes = parse("".join(o.parts))
        if sum(n.text is not None for n in nodes) == len(o.labels):  # else markup ran two blocks together
            pages.append(_label(nodes, o.labels))
    return pages


def main_texts(pages: DataFrame, key: str = "page_id", markup: str = "html", text: str = "text") -> DataFrame:
    """``(key, url, text, n_chars, n_blocks)`` for every row of ``pages`` (columns key, url, html)."""
    known = sample_rows(pages.where(F.col(markup).isNotNull()).select(key, markup), SAMPLE, key).toPandas()
    trained = [p for p in map(labelled_by_markup, known[markup]) if p] + labelled_pages()
    w, edges = fit(trained)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in runs(batch, markup, 400_000):
                trees = [parse(r or "") for r in raw]
                p, _ = Forest(trees).marginals(w, edges)
                texts, blocks, at = [], [], 0
                for tree in trees:
                    kept = [n.text for n, q in zip(tree, p[at : at + len(tree)]) if n.text is not None and q >= 0.5]
                    at += len(tree)
                    texts.append("\n\n".join(kept))
                    blocks.append(len(kept))
                own = batch.slice(start, len(raw))
                yield pa.RecordBatch.from_arrays(
                    [own.column(key), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.int64())],
                    names=[key, "url", text, "n_chars", "n_blocks"])

    return pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), markup).mapInArrow(extract, f"{key} long, url string, {text} string, n_chars long, n_blocks long")
