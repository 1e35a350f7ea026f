"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks, the runs of text between block-level tags, each with the
tags and the class and id words of its ancestors. The field has two labels, article and rest; its features
are those ancestors and plain properties of the text, its weights are trained by the gradient of the
conditional likelihood (forward-backward), and Viterbi decodes a page. The labelled pages are written by
:func:`labelled_pages`: layouts of many kinds, whose blocks say what they are.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.words import give_back, slices

#: Labelled pages that the field is trained on, and passes over them.
TRAINING_PAGES, EPOCHS = 400, 6

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*)|/)")
_SPECIAL = re.compile(r"[>\"']")
_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?](?: |$)")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video select option textarea button title head".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
#: What an opening tag closes first, up to the named bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_P_STAYS = _INLINE | _VOID - {"hr"}



class Node:
    """A block-level element: its tag, the words of its attributes, and the element around it."""

    __slots__ = ("tag", "words", "above", "scored")

    def __init__(self, tag: str, words: tuple[str, ...], above: Node | None):
        self.tag, self.words, self.above = tag, words, above
        self.scored = None  # set by BlockField

    def path(self) -> list[Node]:
        """The node and those around it, from the outside in."""
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.above
        return out[::-1]


#: Text, innermost element, linked characters.
Block = tuple[str, Node | None, int]


class _Page:
    """Where the tags of a page end, in time linear in its length however broken it is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.memo: dict[int, int] = {}

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``: the first outside quotes or, where
        quotes leave none, the first. There is one, for ``at`` is not behind the last."""
        page, memo, seen = self.page, self.memo, []
        first = m = _SPECIAL.search(page, at)
        end = -1
        while m:
            c = m.start()
            if c in memo:
                end = memo[c]
                break
            seen.append(c)
            if page[c] == ">":
                end = c
                break
            close = page.find(page[c], c + 1)
            m = _SPECIAL.search(page, close + 1) if close >= 0 else None
        for c in seen:  # each quote is followed once
            memo[c] = end
        return end if end >= 0 else page.find(">", first.start())


def _unescaped(text: str) -> str:
    """Character references decoded; a number beyond all characters, of any length, is U+FFFD."""

    def number(m: re.Match) -> str:
        digits = m[0].rstrip(";")[2:]
        kind = digits[:1] if digits[0] in "xX" else ""
        digits = digits[len(kind) :].lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{kind}{digits or 0};"

    return html.unescape(_NUMBER.sub(number, text) if "&#" in text else text)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. What closes what is found by the places of open tags, never by going through them."""
    out: list[Block] = []
    stack: list[tuple[str, Node | None]] = []
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    outer: list[int] = []  # places of block-level elements
    held: list[str] = []
    linked, hidden = 0, 0
    at, end, seen = 0, len(page), _Page(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_unescaped("".join(held)).split())
            if text:
                out.append((text, stack[outer[-1]][1] if outer else None, min(linked, len(text))))
            held.clear()
        linked = 0

    def leave(k: int) -> None:
        nonlocal hidden
        while len(stack) > k:
            tag, node = stack.pop()
            places[tag].pop()
            if node is not None:
                outer.pop()
            hidden -= tag in _HIDDEN

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def text(s: str) -> None:
        nonlocal linked
        if s and not hidden:
            held.append(s)
            if places.get("a"):
                linked += len(s)

    while at < end:
        m = _OPEN.search(page, at)
        if not m or m.start() > seen.last and not page.startswith("<!--", m.start()):
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            at = close + 3 if close >= 0 else end
            continue
        if not m[2]:  # a declaration, or a closing tag without a name
            at = page.find(">", m.end()) + 1
            if not at:
                break
            continue
        if m.end() > seen.last:
            text(page[m.start() :])
            break
        stop = seen.tag_end(m.end())
        attributes, at = page[m.end() : stop], stop + 1
        name, closing = m[2].lower(), bool(m[1])
        if name not in _INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            k = last((name,))
            if k >= 0 and (name not in _INLINE or not outer or k > outer[-1]):
                leave(k)
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, seen.last + 1)
            at = close.end() if close else end
            continue
        if name not in _P_STAYS and outer and stack[outer[-1]][0] == "p":
            leave(outer[-1])
        if name in _CLOSES:
            shut, bound = _CLOSES[name]
            floor = last(bound)
            k = min((places[t][-1] for t in shut if places.get(t) and places[t][-1] > floor), default=-1)
            if k >= 0:
                leave(k)
        if name == "body":
            leave(0)
        if attributes.rstrip().endswith("/") and name not in ("p", "div", "a"):
            continue
        places.setdefault(name, []).append(len(stack))
        hidden += name in _HIDDEN
        if name in _INLINE:
            stack.append((name, None))
        else:
            words = tuple(t for a in _ATTR.findall(attributes) for t in _TOKEN.findall("".join(a).lower())) if attributes else ()
            node = Node(name, words, stack[outer[-1]][1] if outer else None)
            outer.append(len(stack))
            stack.append((name, node))
    flush()
    return out


def _around(node: Node) -> list[str]:
    """Features of an element that hold for all within it."""
    return [f"in:{node.tag}", *(f"word:{w}" for w in node.words)]


def _innermost(node: Node) -> list[str]:
    return [f"leaf:{node.tag}", f"pair:{node.above.tag if node.above else ''}>{node.tag}"]


def _path_features(node: Node | None) -> list[str]:
    return sorted({x for n in node.path() for x in _around(n)} | {*_innermost(node)}) if node else []


def _text_kind(text: str, linked: int, k: int, n: int) -> tuple:
    """What the field sees of a block's text and place; there are a few thousand kinds at most."""
    share = linked / len(text)
    return (
        min(text.count(" ") + 1, 128).bit_length(),
        0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3,
        text[-1] in ".!?…:\"”»",
        sum(1 for _ in islice(_SENTENCE.finditer(text), 3)),
        "©" in text or "|" in text or "»" in text,
        text[:1].isupper(),
        "first" if k == 0 else "last" if k == n - 1 else "mid",
    )


def _kind_features(kind: tuple) -> list[str]:
    return ["bias", *(f"{name}:{value}" for name, value in zip(("words", "links", "stop", "sentences", "mark", "upper", "edge"), kind))]


class BlockField:
    """Weights of a two-label linear chain; label 1 is the article."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.step = np.zeros((2, 2))
        self._memo: dict[tuple, tuple] = {}
        self._sets = 0

    def _ids(self, sequence: list[Block], grow: bool = False) -> list[list[int]]:
        out = []
        for k, (text, node, linked) in enumerate(sequence):
            names = _path_features(node) + _kind_features(_text_kind(text, linked, k, len(sequence)))
            if grow:
                out.append([self.index.setdefault(x, len(self.index)) for x in names])
            else:
                out.append([self.index[x] for x in names if x in self.index])
        return out

    def _of_node(self, node: Node | None) -> np.ndarray | float:
        """The score of an element's own and its ancestors' features.

        Elements share the set of the one around them unless they add a feature that the field knows, so depth
        costs nothing; elements of the same kind in the same place, on other pages too, are scored once.
        """
        if node is None:
            return 0.0
        todo, last = [], node
        while node is not None and node.scored is None:
            todo.append(node)
            node = node.above
        index, weight, memo = self.index, self.weight, self._memo
        for node in reversed(todo):
            number, known, base, _ = node.above.scored if node.above else (0, frozenset(), np.zeros(2), None)
            key = number, node.above.tag if node.above else "", node.tag, node.words
            node.scored = memo.get(key)
            if node.scored is None:
                new = sorted({index[x] for x in _around(node) if x in index} - known)
                if new:
                    self._sets += 1  # a number for each set of features
                    number, known, base = self._sets, known.union(new), base + weight[new].sum(axis=0)
                node.scored = memo[key] = number, known, base, base + weight[[index[x] for x in _innermost(node) if x in index]].sum(axis=0)
        return last.scored[3]

    def _scores(self, sequence: list[Block]) -> np.ndarray:
        """Label scores of each block."""
        if len(self._memo) > 20_000:
            self._memo.clear()
        index, weight, n = self.index, self.weight, len(sequence)
        kinds: dict[tuple, int] = {}
        kind_of, around = np.zeros(n, np.int64), np.zeros((n, 2))
        for k, (text, node, linked) in enumerate(sequence):
            kind_of[k] = kinds.setdefault(_text_kind(text, linked, k, n), len(kinds))
            if node is not None:
                around[k] = self._of_node(node)
        own = np.array([weight[[index[x] for x in _kind_features(kind) if x in index]].sum(axis=0) for kind in kinds]).reshape(-1, 2)
        return around + own[kind_of]

    def viterbi(self, scores: np.ndarray) -> list[int]:
        (a00, a01), (a10, a11) = self.step.tolist()
        best, back = scores[0].tolist(), []
        for s0, s1 in scores[1:].tolist():
            x0, y0, x1, y1 = best[0] + a00, best[1] + a10, best[0] + a01, best[1] + a11
            back.append((int(y0 > x0), int(y1 > x1)))
            best = [max(x0, y0) + s0, max(x1, y1) + s1]
        label = [int(best[1] > best[0])]
        for b in reversed(back):
            label.append(b[label[-1]])
        return label[::-1]

    def decode(self, sequence: list[Block]) -> list[int]:
        return self.viterbi(self._scores(sequence)) if sequence else []

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, rate: float = 0.3, ridge: float = 1e-4, seed: int = 7) -> BlockField:
        """Ascent on the conditional log-likelihood with AdaGrad steps."""
        data = [(self._ids(s, True), y) for s, y in pages if s]
        self.weight = np.zeros((len(self.index), 2))
        square, step_square, order = np.full((len(self.index), 2), 1e-3), np.full((2, 2), 1e-3), list(range(len(data)))
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                ids, y = data[i]
                scores = np.array([self.weight[f].sum(axis=0) for f in ids])
                node, edge = self._marginals(scores)
                node[np.arange(len(y)), y] -= 1
                for a, b in zip(y, y[1:]):
                    edge[a, b] -= 1
                gradient: dict[int, np.ndarray] = {}
                for f, g in zip(ids, node):
                    for j in f:
                        gradient[j] = gradient.get(j, 0) + g
                rows = np.fromiter(gradient, np.int64, len(gradient))
                g = np.array([gradient[j] for j in rows.tolist()]) + ridge * self.weight[rows]
                square[rows] += g * g
                self.weight[rows] -= rate * g / np.sqrt(square[rows])
                step_square += edge * edge
                self.step -= rate * edge / np.sqrt(step_square)
        self._memo.clear()
        return self

    def _marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels, and expected counts of label pairs."""
        n = len(scores)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for k in range(1, n):
            forward[k] = scores[k] + np.logaddexp(forward[k - 1][0] + self.step[0], forward[k - 1][1] + self.step[1])
        for k in range(n - 2, -1, -1):
            ahead = scores[k + 1] + backward[k + 1]
            backward[k] = np.logaddexp(self.step[:, 0] + ahead[0], self.step[:, 1] + ahead[1])
        total = np.logaddexp(*forward[-1])
        edge = np.zeros((2, 2))
        for k in range(n - 1):
            edge += np.exp(forward[k][:, None] + self.step + (scores[k + 1] + backward[k + 1])[None] - total)
        return np.exp(forward + backward - total), edge


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with a label for each of their leaf blocks, 1 for the article."""
    rng = random.Random(seed)
    syllables = "an be cor du el fi go ha in jo ka lu mer no or pi que ra su ti un ve wo xi ya zo sch ent tion ler mas".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        style = rng.random()
        parts = [words(1, 16).capitalize() + rng.choice(("." if style < 0.9 else "!! ", ".", "?")) for _ in range(rng.randint(a, b))]
        return " ".join(parts).upper() if style > 0.96 else " ".join(parts)

    def one() -> tuple[str, list[int]]:
        out: list[str] = []
        labels: list[int] = []

        def block(tag: str, text: str, y: int, attributes: str = "") -> None:
            out.append(f"<{tag}{attributes}>{text}</{tag}>" if rng.random() < 0.9 or tag not in ("p", "li") else f"<{tag}{attributes}>{text}")
            labels.append(y)

        def menu(low: int = 2, high: int = 8) -> None:
            out.append("<ul>")
            for _ in range(rng.randint(low, high)):
                block("li", f'<a href="/{word()}">{words(1, 2)}</a>', 0)
            out.append("</ul>")

        def boxed(tag: str, names: str, fill) -> None:
            name = rng.choice(names.split())
            out.append(f'<{tag} {rng.choice(("class", "id"))}="{name}">' if tag in ("div", "section") or rng.random() < 0.5 else f"<{tag}>")
            fill()
            out.append(f"</{tag}>")

        def aside() -> None:
            kind = rng.randrange(8)
            if kind == 0:
                boxed("div", "ad ads advert advertisement sponsor promo banner-ad", lambda: (out.append(sentences(1, 3)), labels.append(0)))
            elif kind == 1:
                boxed(rng.choice(("aside", "div")), "sidebar related widget recommended", lambda: (block(rng.choice(("h3", "h4")), words(1, 4), 0), menu()))
            elif kind == 2:
                boxed("div", "cookie cookie-notice consent notice alert gdpr banner", lambda: block("p", sentences(1, 3), 0))
            elif kind == 3:
                boxed("form", "newsletter search login subscribe", lambda: (block("label", words(1, 3), 0), out.append("<input>")) if rng.random() < 0.3 else block("p", sentences(1, 2), 0))
            elif kind == 4:
                boxed(rng.choice(("div", "nav")), "breadcrumb share social pagination tags meta", lambda: menu(1, 4))
            elif kind == 5:
                boxed("aside", "sidebar ad related", lambda: block("p", sentences(1, 4), 0))
            elif kind == 6:
                boxed(rng.choice(("div", "aside")), "ad sponsor promo notice", lambda: [block("p", sentences(1, 3), 0) for _ in range(rng.randint(1, 2))])
            else:
                boxed(rng.choice(("header", "div")), "header masthead site-header top", lambda: block(rng.choice(("p", "div")), words(1, 6), 0))

        def article() -> None:
            opening = rng.choice(("article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="article"', 'div class="entry-content"', 'section class="story"', "div"))
            out.append(f"<{opening}>")
            if rng.random() < 0.8:
                block(rng.choice(("h1", "h1", "h2")), words(2, 12).capitalize() + rng.choice(("", ".", "")), 1)
            for _ in range(rng.choice((1, 2, 3, 4, 6, 8, 12, 20))):
                kind = rng.random()
                if kind < 0.72:
                    block("p", sentences(1, 8), 1)
                elif kind < 0.78:
                    out.append(f"<p><b>{sentences(1, 2)}<br>")
                    labels.append(1)
                elif kind < 0.84:
                    block("p", words(1, 3).capitalize() + ".", 1)
                elif kind < 0.88:
                    block(rng.choice(("h2", "h3")), words(1, 6).capitalize(), 1)
                elif kind < 0.92:
                    out.append(rng.choice(("<ul>", "<ol>")))
                    for _ in range(rng.randint(1, 5)):
                        block("li", words(2, 14), 1)
                    out.append("</ul>")
                elif kind < 0.95:
                    out.append("<blockquote>")
                    block("p", sentences(1, 3), 1)
                    out.append("</blockquote>")
                elif kind < 0.97:
                    block(rng.choice(("pre", "figcaption", "td", "dd")), words(2, 20), 1)
                else:
                    aside()
            out.append(f"</{opening.split()[0]}>")

        if rng.random() < 0.8:
            boxed(rng.choice(("nav", "nav", "header", "div")), "nav menu navbar navigation", menu)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            aside()
        article()
        if rng.random() < 0.3:
            boxed(rng.choice(("section", "div")), "comments comment-list responses discussion", lambda: [boxed(rng.choice(("div", "article", "li")), "comment reply", lambda: [block("p", sentences(1, 4), 0) for _ in range(rng.randint(1, 2))]) for _ in range(rng.randint(1, 4))])
        for _ in range(rng.choice((0, 0, 1, 2))):
            aside()
        if rng.random() < 0.9:
            boxed(rng.choice(("footer", "footer", "footer", "div")), "footer site-footer bottom legal", lambda: (out.append(f"&copy; {word()}.example &middot; {sentences(1, 2)}"), labels.append(0)) if rng.random() < 0.6 else (block("p", words(2, 9), 0), menu(1, 3)))
        return f"<html><body>{''.join(out)}</body></html>", labels

    return [one() for _ in range(n)]


def trained_field(pages: int = TRAINING_PAGES, seed: int = 11) -> BlockField:
    """The field trained on ``pages`` labelled pages; the same for the same arguments."""
    data = [(blocks(p), y) for p, y in labelled_pages(pages, seed)]
    return BlockField().train([(b, y) for b, y in data if len(b) == len(y)])


def main_text(page: str | None, field: BlockField) -> str:
    """The blocks of the article joined by line feeds."""
    sequence = blocks(page or "")
    return "\n".join(b[0] for b, y in zip(sequence, field.decode(sequence)) if y)


def extract(pages: DataFrame, html_col: str = "html", field: BlockField | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``pages`` without the markup: all columns but ``html_col``, then the text and its code points.

    Null and empty pages, and pages without an article, have an empty text. Rows with null or repeated
    ids stay as they are. A column that is named like one of the two new ones is replaced. The whole page
    is read, however long. An empty table gives an empty result.
    """
    field = field or trained_field()
    rest = [c for c in pages.columns if c not in (html_col, text_col, size_col)]
    source = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField(text_col, T.StringType()), T.StructField(size_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [main_text(p, field) for p in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(rest))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)
        give_back()

    return source.mapInArrow(run, schema)
