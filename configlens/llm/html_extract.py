"""HTML extraction (4) with a tree-structured graphical model.

Block elements of a page form a tree. Each has a hidden label, content or not.
Log-linear potentials connect it to its parent's label (by its kind and by each
hint in its class, id and role on its own) and to what is seen of it (text
length, its share of the page's text, share of link text, paragraphs below).
Sum-product messages go up and down the tree once, and text stays where the
marginal of its element says content. The weights are those under which labels
of labelled pages are likeliest, found by gradient steps through the messages.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .labelled_pages import LABEL, labelled_pages

#: Kinds of block elements; elements in none of them are inline and belong to the block around them.
KINDS = {
    "root": "html body",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside dialog",
    "form": "form fieldset",
    "article": "article",
    "main": "main",
    "section": "section details",
    "div": "div center hgroup",
    "heading": "h1 h2 h3 h4 h5 h6",
    "para": "p address summary",
    "list": "ul ol dl dir",
    "item": "li dt dd",
    "table": "table thead tbody tfoot tr caption",
    "cell": "td th",
    "quote": "blockquote pre",
    "figure": "figure figcaption",
}
#: Hints in class, id and role: a word that starts with one of these.
HINTS = {
    "comment": "comment reply replies disqus discussion respond",
    "ad": "ad ads advert advertisement sponsor promo banner",
    "nav": "nav menu breadcrumb pager pagination toc tabs",
    "footer": "footer copyright legal colophon",
    "side": "side sidebar aside widget related recommend trending popular more",
    "notice": "cookie notice consent gdpr alert popup modal overlay banner-notice",
    "form": "form login signin signup subscribe newsletter search contact",
    "social": "social share follow",
    "header": "header masthead topbar logo branding",
    "content": "article content post entry main body story text prose",
}
#: Elements whose text is never shown, or is a control's.
HIDDEN = {"head", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video", "button", "select", "textarea", "datalist"}
RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
#: Start tags that may be in a head; any other one ends it, since </head> and <body> may be left out.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_KIND_OF = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
_NAMES = list(KINDS)
_HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
_CONTENT = list(HINTS).index("content")
#: Words that say of the next word, or of the one before, that it is only about the layout: `with-sidebar`, `ad-free`.
_BEFORE, _AFTER = {"with", "without", "has", "have", "no", "is", "not"}, {"free", "open", "closed", "enabled", "disabled", "less"}
#: Kinds whose elements are typically not content, nor what is inside them.
_APART = {_NAMES.index(k) for k in ("nav", "footer", "aside", "form")}
#: Elements that end an open paragraph, and what ends an open element of the same sort.
_ENDS_P = {t for k in ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "heading", "list", "table", "quote", "figure") for t in KINDS[k].split()} | {"p", "address", "hr"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_BOUND = {"ul", "ol", "dl", "table", "article", "section", "div", "nav", "aside", "body"}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|data-content)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """A page's block elements in page order (parents first), and its texts with the element each belongs to."""

    parent: list[int]
    kind: list[int]
    hints: list[tuple[int, ...]]
    inside: list[bool]
    given: list[int]
    texts: list[tuple[int, str]]
    length: list[int]
    linked: list[int]
    stretches: list[int]


def _tags(source: str) -> list[tuple[int, int, bool, str, str]]:
    """Begin, end, whether closing, name and attributes of each tag outside of comments and raw texts; raw elements are one tag named `raw`.

    Goes over the page once. After a quote in a tag that nothing closes, tags end
    at the next `>` for the rest of the page.
    """
    tags, marks = [], {}
    last = source.rfind(">")  # no tag ends later
    quoted, at = True, 0

    def marked(name: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Where start tags of a raw element begin, and its end tags."""
        if name not in marks:
            both = re.compile(rf"<(/?){name}\b[^>]*>", re.IGNORECASE)
            starts, ends = marks[name] = [], []
            for found in both.finditer(source, 0, last + 1):
                if found[1]:
                    ends.append(found.span())
                else:
                    starts.append(found.start())
        return marks[name]

    while True:
        begin = source.find("<", at)
        if begin < 0:
            break
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = len(source) if end < 0 else end + 3
            tags.append((begin, at, False, "", ""))
            continue
        if begin > last:
            break
        found = _NAME.match(source, begin)
        if not found:
            at = begin + 1
            if source[at : at + 1] in ("!", "?", "/"):
                at = source.index(">", at) + 1
                tags.append((begin, at, False, "", ""))
            continue
        closing, name, after = source[begin + 1] == "/", found[1].lower(), found.end()
        end = _ATTRIBUTES.match(source, after).end() if quoted else source.index(">", after)
        if end >= len(source) or source[end] != ">":
            quoted = False
            end = source.find(">", after)
            if end < 0:
                break
        attributes, at = source[after:end], end + 1
        if name in RAW and not closing:
            starts, ends = marked(name)
            k = bisect_left(ends, (at, 0))
            span = ends[k] if k < len(ends) else None
            if span and name in ("iframe", "noscript"):
                inner = bisect_left(starts, at)
                if inner < len(starts) and starts[inner] < span[0]:
                    span = None  # left open; the end is of a later one
            if span:
                at = span[1]
            elif name in ("script", "style"):
                at = len(source)  # code up to the end of the page
            elif name in ("title", "textarea"):
                tag = source.find("<", at)
                at = len(source) if tag < 0 else tag
            tags.append((begin, at, False, "raw:" + name, ""))
            continue
        tags.append((begin, at, closing, name, attributes))
    return tags


def _closed(tags: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Numbers of the tags of hidden elements that have an end tag of their own."""
    begun: dict[str, list[int]] = {}
    closed = set()
    for number, (_, _, closing, name, attributes) in enumerate(tags):
        if name in HIDDEN:
            if not closing and not attributes.endswith("/"):
                begun.setdefault(name, []).append(number)
            elif closing and begun.get(name):
                closed.add(begun[name].pop())
    return closed


def parse(source: str) -> Page:
    """The block tree of a page; unclosed, misnested and unknown elements are taken as browsers mostly do.

    A hidden element ends with its end tag or that of its parent; one without an
    end tag ends at the next block, so that it hides nothing else.
    """
    parent, kind, hints, inside, given, length, linked = [-1], [0], [()], [False], [-1], [0], [0]
    stretches, broken = [0], [0]  # own stretches of text between br elements, and the length where the last one ended
    texts: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]
    open_count = {"html": 1}
    paragraphs, bounds = [], []  # depths of open p elements, and of those that keep a p apart from what is in them
    hidden: list[tuple[str, int, bool]] = []  # open hidden elements: name, open blocks around, whether closed by a tag of its own
    hides: Counter[str] = Counter()  # how many of each are open, and under "" how many that no tag of their own closes
    links, pending, began = 0, [], False
    at = 0

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                texts.append((stack[-1][1], text))

    def add(text: str) -> None:
        if hidden and hidden[-1][0] == "head" and not text.isspace() and text:
            show()
        if text and not hidden:
            pending.append(text)
            shown = len(text) - text.count(" ")
            length[stack[-1][1]] += shown
            if links:
                linked[stack[-1][1]] += shown

    def show() -> str:
        name, _, has_end = hidden.pop()
        hides[name] -= 1
        hides[""] -= not has_end and name != "head"
        return name

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_count[stack.pop()[0]] -= 1
        for depths in (paragraphs, bounds):
            while depths and depths[-1] >= depth:
                depths.pop()
        while hidden and hidden[-1][1] > depth:
            show()

    tags = _tags(source)
    closed = _closed(tags)
    for number, (begin, end, closing, name, attributes) in enumerate(tags):
        add(source[at:begin])
        at = end
        if not name:
            continue
        in_head = name.removeprefix("raw:") in IN_HEAD
        if not closing and not in_head and hidden and hidden[-1][0] == "head":
            show()
        if name.startswith("raw:"):
            began |= not in_head
            continue
        if name in HIDDEN:
            if closing:
                if hides[name]:
                    while show() != name:
                        pass
            elif not attributes.endswith("/") and not (name == "head" and (began or pending or texts)):
                hidden.append((name, len(stack), number in closed))
                hides[name] += 1
                hides[""] += number not in closed and name != "head"
            began |= not in_head
            continue
        began |= not closing and not in_head
        if name == "body":
            hidden.clear()
            hides.clear()
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            add(" ")
            node = stack[-1][1]
            stretches[node] += length[node] - broken[node] >= STRETCH
            broken[node] = length[node]
            continue
        if name not in _KIND_OF:
            if name in ("td", "th", "img", "input", "hr"):
                add(" ")
            continue
        while hides[""]:
            show()
        flush()
        links = 0
        name = "h1" if len(name) == 2 and name[0] == "h" and name != "hr" else name  # any heading's end tag ends any heading
        if closing:
            if open_count.get(name, 0) and name not in ("html", "body"):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop_to(depth)
            continue
        if name in ("html", "body"):
            if name == "body" and "data-content" in attributes:
                given[0] = _given(attributes)
            continue
        around = hidden[-1][1] if hidden else 0  # a start tag in a hidden element ends no block around that
        if name in _ENDS_P and open_count.get("p", 0):
            depth = paragraphs[-1]
            if depth >= around and (not bounds or depth > bounds[-1]):
                pop_to(depth)
        if name in _SAME:
            depth = len(stack) - 1
            while depth and stack[depth][0] not in _SAME[name] and stack[depth][0] not in _BOUND:
                depth -= 1
            if depth >= around and stack[depth][0] in _SAME[name]:
                pop_to(depth)
        if attributes.endswith("/") and name in VOID:
            continue
        node, above = len(parent), stack[-1][1]
        parent.append(above)
        kind.append(_KIND_OF[name])
        inside.append(inside[above] or kind[above] in _APART or any(k != _CONTENT for k in hints[above]))
        hints.append(_hints(attributes))
        given.append(_given(attributes))
        for counts in (length, linked, stretches, broken):
            counts.append(0)
        if name == "p" or name in _BOUND:
            (paragraphs if name == "p" else bounds).append(len(stack))
        stack.append((name, node))
        open_count[name] = open_count.get(name, 0) + 1
    add(source[at:])
    flush()
    for node, n in enumerate(stretches):
        stretches[node] += n > 0 and length[node] - broken[node] >= STRETCH
    return Page(parent, kind, hints, inside, given, texts, length, linked, stretches)


def _hints(attributes: str) -> tuple[int, ...]:
    """The hints of an element, each once; words that only tell its layout are none."""
    found = set()
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for value in "".join(values).split():
                    words = [word.lower() for word in _HINT_WORD.findall(value)]
                    for k, word in enumerate(words):
                        hint = _HINT_OF.get(word, _HINT_OF.get(word.rstrip("s")))
                        if hint is not None and _BEFORE.isdisjoint(words[:k]) and not (k + 1 < len(words) and words[k + 1] in _AFTER):
                            found.add(hint)
    return tuple(sorted(found))


def _given(attributes: str) -> int:
    if "data-content" not in attributes:
        return -1
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == LABEL:
            return int("".join(values) or 0)
    return -1


#: Buckets of text length (powers of four), of the share of link text, of the number of paragraphs and headings right below, and of the share of the page's text.
LENGTHS, SHARES, PARAGRAPHS, PARTS = 7, 4, 4, 6
#: Least text, in characters, of a stretch between br elements, or of an element of another kind, to count as a paragraph.
STRETCH = 40
_PARAGRAPH_KINDS = {_NAMES.index(k) for k in ("para", "heading", "quote")}
_TEXT_KINDS = {_NAMES.index(k) for k in ("div", "section", "cell")}
_WHOLE_KINDS = {_NAMES.index(k) for k in ("article", "main")}
#: Kinds that hold other elements together; a page without them is bare, nothing but its text.
_HOLDING = {_NAMES.index(k) for k in ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div")}


def seen(page: Page) -> list[tuple[int, int, int, int]]:
    """Buckets of length, link share, paragraphs and share of the page's text, of each element with all below it."""
    total, links = page.length.copy(), page.linked.copy()
    below = page.stretches.copy()
    for i in range(len(total) - 1, 0, -1):
        up = page.parent[i]
        total[up] += total[i]
        links[up] += links[i]
        below[up] += page.kind[i] in _PARAGRAPH_KINDS or page.kind[i] in _TEXT_KINDS and page.length[i] - page.linked[i] >= STRETCH
    whole = total[0] or 1
    return [
        (
            min(LENGTHS - 1, (n.bit_length() + 1) // 2),
            0 if not n or not k else 1 + min(SHARES - 2, int(3 * k / n)),
            min(PARAGRAPHS - 1, (p + 1) // 2),
            min(PARTS - 1, 1 + int((PARTS - 1) * n / whole)) if n else 0,
        )
        for n, k, p in zip(total, links, below, strict=True)
    ]


def bare(page: Page) -> bool:
    """Whether nothing holds a page's elements together but its body."""
    return _HOLDING.isdisjoint(page.kind)


def lone(page: Page) -> bool:
    """Whether no element says by its kind or its hints that it is the content."""
    return _WHOLE_KINDS.isdisjoint(page.kind) and not any(_CONTENT in hints for hints in page.hints)


def _pairs(kind: int, hints: tuple[int, ...], inside: bool, alone: bool) -> list[int]:
    """Numbers of the pair weights of an element: its kind and each hint, by whether it is inside of what is typically not content, else by whether the page is lone()."""
    state = 2 if inside else int(alone)
    return [kind + len(KINDS) * state, *(3 * len(KINDS) + h + len(HINTS) * state for h in hints)]


@dataclass
class Model:
    """Weights: of the root's label, by whether the page is bare; of pairs of labels (parent's, child's) by kind, hint and place; of content by what is seen, for the two kinds of pages that lone() tells apart."""

    root: np.ndarray
    pair: np.ndarray
    seen: list[np.ndarray]

    @classmethod
    def zero(cls) -> Model:
        return cls(np.zeros(2), np.zeros((3 * len(KINDS) + 3 * len(HINTS), 2, 2)), [np.zeros((2, n)) for n in (LENGTHS, SHARES, PARAGRAPHS, PARTS)])

    def weights(self) -> list[np.ndarray]:
        return [self.root, self.pair, *self.seen]


#: Gradient steps of a fit, their size, and how strongly weights are drawn to zero (per element).
STEPS, RATE, DECAY = 200, 0.1, 1e-5


def fit(pages: Iterable[str] | None = None, hints: bool = True) -> Model:
    """The model under which the labels of labelled pages, by default those of labelled_pages(), are likeliest.

    On a labelled page the attribute data-content gives an element's label, 1 for
    content, which holds for all below it until another element says otherwise.
    Without hints, words of class, id and role are not looked at. The labels'
    likelihood and its slope come from the same messages as the marginals, for all
    pages at once, one depth of their trees after the other.
    """
    parent, depth, label, root_of, alone_of, buckets, rows, features = [], [], [], [], [], [], [], []
    for source in labelled_pages() if pages is None else pages:
        page = parse(source)
        if not hints:
            page.hints = [()] * len(page.parent)
            page.inside = [False] * len(page.parent)
        base, alone = len(parent), lone(page)
        label += given_labels(page)
        buckets += seen(page)
        for i, up in enumerate(page.parent):
            parent.append(base + up if i else -1)
            depth.append(depth[base + up] + 1 if i else 0)
            alone_of.append(int(alone))
            if i:
                numbers = _pairs(page.kind[i], page.hints[i], page.inside[i], alone)
                rows += [base + i] * len(numbers)
                features += numbers
        root_of.append((base, int(bare(page))))
    model, n = Model.zero(), len(parent)
    if not n:
        return model
    parent, depth, label, alone_of, rows, features = (np.array(x) for x in (parent, depth, label, alone_of, rows, features))
    roots, bares = np.array(root_of).T
    buckets = np.array(buckets).T
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    truth = np.zeros((n, 2, 2))
    truth[np.arange(n), label[parent], label] = 1
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    for step in range(1, STEPS + 1):
        score = np.empty((n, 2, 2))
        for a in (0, 1):
            for b in (0, 1):
                score[:, a, b] = np.bincount(rows, weights=model.pair[features, a, b], minlength=n)
        below = np.zeros((n, 2))
        below[:, 1] = sum(w[alone_of, at] for w, at in zip(model.seen, buckets, strict=True))
        below[roots, 1] += model.root[bares]
        up = np.zeros((n, 2))
        for at in reversed(levels):
            both = score[at] + below[at][:, None, :]
            up[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            for a in (0, 1):
                below[:, a] += np.bincount(parent[at], weights=up[at, a], minlength=n)
        belief = np.zeros((n, 2))
        belief[roots] = below[roots] - np.logaddexp(below[roots, 0], below[roots, 1])[:, None]
        pairs = np.zeros((n, 2, 2))
        for at in levels:
            both = (belief[parent[at]] - up[at])[:, :, None] + score[at] + below[at][:, None, :]
            pairs[at] = np.exp(both)
            belief[at] = np.logaddexp(both[:, 0], both[:, 1])
        missing = truth - pairs
        off = label - np.exp(belief[:, 1])
        slopes = [np.bincount(bares, weights=off[roots], minlength=2), np.stack([np.bincount(features, weights=missing[rows, a, b], minlength=len(model.pair)) for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2)]
        slopes += [np.stack([np.bincount(at[alone_of == k], weights=off[alone_of == k], minlength=w.shape[1]) for k in (0, 1)]) for w, at in zip(model.seen, buckets, strict=True)]
        rate = RATE * min(1.0, 2 * (STEPS - step + 1) / STEPS)
        for w, slope, (mean, square) in zip(model.weights(), slopes, moments, strict=True):
            slope = slope / n - DECAY * w
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return model


def given_labels(page: Page) -> list[int]:
    """The labels of a labelled page's elements."""
    label = [0] * len(page.parent)
    for i, up in enumerate(page.parent):
        label[i] = page.given[i] if page.given[i] >= 0 else label[up] if up >= 0 else 0
    return label


def _tables(model: Model) -> tuple:
    return np.exp(model.root).tolist(), np.exp(model.pair).tolist(), [np.exp(w).tolist() for w in model.seen]


def potentials(page: Page, tables: tuple) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Each element's potential of being content, against 1 of not, and of its pair of labels with its parent's: (0, 0), (0, 1), (1, 0), (1, 1)."""
    root, pair, (by_length, by_share, by_paragraphs, by_part) = tables
    alone = lone(page)
    by_length, by_share, by_paragraphs, by_part = (w[alone] for w in (by_length, by_share, by_paragraphs, by_part))
    own = [by_length[a] * by_share[b] * by_paragraphs[c] * by_part[d] for a, b, c, d in seen(page)]
    own[0] *= root[bare(page)]
    known: dict[tuple, tuple[float, float, float, float]] = {}
    edges = []
    for key in zip(page.kind, page.hints, page.inside, strict=True):
        if key not in known:
            a = b = c = d = 1.0
            for number in _pairs(*key, alone):
                (e, f), (g, h) = pair[number]
                a, b, c, d = a * e, b * f, c * g, d * h
            known[key] = a, b, c, d
        edges.append(known[key])
    return own, edges


def marginals(page: Page, tables: tuple) -> list[float]:
    """Each element's probability of being content: messages from leaves to the root, then back.

    Messages are pairs scaled to sum 1.
    """
    own, edges = potentials(page, tables)
    n = len(page.parent)
    below = [[1 / (1 + x), x / (1 + x)] for x in own]  # evidence of each element and all below it
    up = [(0.5, 0.5)] * n
    for i in range(n - 1, 0, -1):
        no, yes = below[i]
        a, b, c, d = edges[i]
        m0, m1 = a * no + b * yes, c * no + d * yes
        s = m0 + m1
        up[i] = m0, m1 = m0 / s, m1 / s
        at = below[page.parent[i]]
        at[0] *= m0
        at[1] *= m1
        s = at[0] + at[1]
        at[0] /= s
        at[1] /= s
    belief = [0.0] * n
    belief[0] = below[0][1] / (below[0][0] + below[0][1])
    for i in range(1, n):
        p = belief[page.parent[i]]
        # What reaches the parent from elsewhere: its belief without this element's message.
        no, yes = (1 - p) / max(up[i][0], 1e-300), p / max(up[i][1], 1e-300)
        a, b, c, d = edges[i]
        x, y = (no * a + yes * c) * below[i][0], (no * b + yes * d) * below[i][1]
        belief[i] = y / (x + y)
    return belief


def main_text(source: str, tables: tuple) -> str:
    """The main text of a page: texts of elements that are likelier content than not, joined by one space."""
    page = parse(source)
    belief = marginals(page, tables)
    return " ".join(text for node, text in page.texts if belief[node] >= 0.5)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row.

    A null, empty or text-free html has an empty text; html is read whole at any
    length; nulls in page_id and url stay, repeated rows are each extracted,
    other columns are left out and an empty table gives no rows.
    """
    tables = pages.sparkSession.sparkContext.broadcast(_tables(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            texts = [main_text(source, tables.value) for source in texts_of(batch.column("html"))]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
