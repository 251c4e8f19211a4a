"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block element is a node that is content or not. A node's own evidence (tag, words of its class, id and
role, text length, share of linked text) and the labels of its parent and children, joined by a potential,
decide together: messages pass from the leaves up and from the root down, and their sums give exact
marginals. The weights are trained by maximum likelihood on labelled pages, with the same messages giving
the expected counts. Blocks of nodes whose content marginal is above one half make up the text.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship, whole

#: What can begin markup: an end or start tag, a comment or another declaration. Any other "<" is text.
OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
#: The usual tag without attributes ends at once.
BARE = re.compile(r"\s*>")
#: One attribute: a name, and a value in quotes, or without them up to white space or the end of the tag.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(\"|\Z)|'([^']*+)('|\Z)|([^\s>]++)?))?+)?+")
COMMENT_END = re.compile("--!?>")
#: Elements whose inside is text without tags, up to their own end tag.
RAW = frozenset("script style textarea title".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: head holds void and skipped elements only; like in browsers, anything else in it belongs to the body.
VOID = frozenset("area base br col embed head hr img input link meta param source track wbr".split())
#: Elements whose inside is no text. One that is never closed loses its tag alone.
DROPPED = frozenset("svg iframe select object canvas noscript template".split())
DROPPED_START = re.compile("<(?:" + "|".join(sorted(DROPPED)) + r")\b", re.I)
#: Lists of choices: their text lasts until the next tag.
OPTIONS = frozenset("option optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN_FEATURE = frozenset(
    "html body div section article main nav header footer aside form p li ul ol dl dt dd table tr td th blockquote pre figure figcaption button".split()
)
#: Words of class, id and role that speak for a part of the page; a training page shows each group.
WORD_GROUPS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead topbar banner logo brand",
    "foot": "footer copyright legal bottom colophon",
    "side": "sidebar side aside rail related recommended widget popular trending",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup",
    "form": "form search login comment-form",
    "talk": "comment comments reply replies disqus discussion respond",
    "share": "share social sharing follow tags meta byline",
    "main": "content article main post entry story text body page-content post-content article-body prose",
}
GROUP_OF = {w: g for g, words in WORD_GROUPS.items() for w in words.split()}
#: Elements that mark a part of the page by their name.
MARK_OF = {f"tag:{t}": g for g, tags in {"main": "article main", "other": "nav header footer aside form button"}.items() for t in tags.split()}
#: Elements that end an open element of the same kind.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@dataclass
class Tree:
    """Nodes in page order: parents come before their children. blocks: (node, text) in page order."""

    parents: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    marks: list[bool] = field(default_factory=list)  # of a training page: inside data-main
    bare: bool = False  # nothing is marked as the main part


class Token(NamedTuple):
    """A tag, or other markup without a name, from start to end. words: values of class, id and role."""

    start: int
    end: int
    name: str | None = None
    closing: bool = False
    alone: bool = False  # <name/>
    words: tuple[str, ...] = ()
    main: bool = False  # carries data-main


def _tag(page: str, m: re.Match[str]) -> Token:
    """A tag up to its ">"; one that the page ends in reaches to the end, as in browsers."""
    name, closing = m[2].lower(), bool(m[1])
    bare = BARE.match(page, m.end())
    if bare:
        return Token(m.start(), bare.end(), name, closing)
    at, words, main = m.end(), [], False
    while at < len(page) and page[at] != ">":
        x = ATTRIBUTE.match(page, at)
        if x.end() == at:  # a lone "="
            at += 1
            continue
        at = x.end()
        if x[1]:
            key = x[1].lower()
            if key in ("class", "id", "role"):
                words.append(x[2] or x[4] or x[6] or "")
            main = main or key == "data-main"
    alone = at < len(page) and page[at - 1] == "/"
    return Token(m.start(), min(at + 1, len(page)), name, closing, alone, tuple(words), main)


def _after(page: str, mark: str, at: int) -> int:
    found = page.find(mark, at)
    return len(page) if found < 0 else found + len(mark)


def tokens_of(page: str) -> list[Token]:
    """The markup of a page in order, by the states of the HTML tokenizer; one pass, each character is met a
    bounded number of times. An element of RAW with its inside is one token; where title or textarea are never
    closed, their tag alone."""
    found: list[Token] = []
    unclosed: set[str] = set()
    at = 0
    while m := OPEN.search(page, at):
        start = m.start()
        if m[2] is None:  # comment, declaration, or an end tag without a name
            if not page.startswith("<!--", start):
                at = _after(page, ">", start)
            elif page.startswith((">", "->"), start + 4):
                at = _after(page, ">", start + 4)
            else:
                end = COMMENT_END.search(page, start + 4)
                at = end.end() if end else len(page)
            found.append(Token(start, at))
            continue
        token = _tag(page, m)
        at = token.end
        if token.name in RAW and not token.closing:
            end = None if token.name in unclosed else RAW_END[token.name].search(page, at)
            if end:
                at = _after(page, ">", end.end())
            elif token.name in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(token.name)
            token = Token(start, at)
        found.append(token)
    return found


def _dropped(tokens: list[Token]) -> dict[int, int]:
    """Start and end tag, as token numbers, of each closed element of DROPPED. The end of an element around
    it ends an unclosed one, so that a later end tag is not taken for its own."""
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    found = {}
    for i, t in enumerate(tokens):
        name = t.name
        if not name or name in INLINE or name in VOID:
            continue
        if not t.closing:
            if not t.alone:
                opened.append((name, i))
                count[name] = count.get(name, 0) + 1
        elif count.get(name):
            while True:
                last, start = opened.pop()
                count[last] -= 1
                if last == name:
                    break
            if name in DROPPED:
                found[start] = i
    return found


def parse(page: str) -> Tree:
    """The block tree of a page, with unclosed and misplaced tags put right as browsers do."""
    tree, stack, tags = Tree(), [0], ["#"]
    tree.parents.append(-1)
    tree.features.append(["tag:#"])
    tree.marks.append(False)
    chars, linked = [0], [0]
    held: list[str] = []
    links = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                tree.blocks.append((stack[-1], text))
                chars[stack[-1]] += len(text)

    at, past, hidden = 0, -1, False
    tokens = tokens_of(page)
    dropped = _dropped(tokens) if DROPPED_START.search(page) else {}
    for i, token in enumerate(tokens):
        if i <= past:
            at = token.end
            continue
        if token.start > at and not hidden:
            raw = page[at : token.start]
            held.append(raw)
            if links:
                linked[stack[-1]] += len(raw.strip())
        at, name = token.end, token.name
        if name is None:
            continue
        hidden = name in OPTIONS and not token.closing
        if name in DROPPED or name in OPTIONS:
            past = dropped.get(i, past)
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if token.closing else 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                held.append(" ")
            if name == "hr":
                flush()
            continue
        flush()
        links = 0
        if token.closing:
            if name in tags:
                while tags.pop() != name:
                    stack.pop()
                stack.pop()
            continue
        over = ENDS.get(name, {"p"})
        while tags[-1] in over or tags[-1] == "p":
            tags.pop()
            stack.pop()
        node = len(tree.parents)
        tree.parents.append(stack[-1])
        own = ["tag:" + ("h" if name in HEADINGS else name if name in OWN_FEATURE else "other")]
        groups = set()
        for value in token.words:
            for word in re.split(r"[\s_]+", value.lower()):
                groups |= {GROUP_OF[w] for w in (word, *word.split("-")) if w in GROUP_OF}
        own += sorted("is:" + g for g in groups)
        tree.features.append(own)
        tree.marks.append(tree.marks[stack[-1]] or token.main)
        chars.append(0)
        linked.append(0)
        stack.append(node)
        tags.append(name)
    if at < len(page) and not hidden:
        held.append(page[at:])
    flush()
    below, below_linked = chars[:], linked[:]
    for v in range(len(chars) - 1, 0, -1):
        below[tree.parents[v]] += below[v]
        below_linked[tree.parents[v]] += below_linked[v]
    # A page where nothing is marked as the main part is judged by weights of its own.
    marked = {MARK_OF.get(own[0]) for own in tree.features} | {f[3:] for own in tree.features for f in own if f.startswith("is:")}
    tree.bare = "main" not in marked
    other = [False] * len(chars)
    for v, own in enumerate(tree.features):
        own.append(f"own:{min(6, chars[v].bit_length() // 2)}")
        own.append(f"all:{min(6, below[v].bit_length() // 2)}")
        own.append(f"links:{min(4, 5 * below_linked[v] // max(1, below[v]))}")
        if tree.bare:
            other[v] = v > 0 and other[tree.parents[v]] or own[0] in MARK_OF or any(f.startswith("is:") for f in own)
            own.append("other" if other[v] else "plain")
            own[:] = ["bare:" + f for f in own]
    return tree


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


class Model:
    """Weights of the features for content, and of the four parent-child label pairs on marked and on bare pages."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]  # [bare page][parent][child]

    def marginals(self, tree: Tree) -> tuple[list[float], list[list[list[float]]]]:
        """P(content) of every node, and P(parent, child) of every node's edge to its parent."""
        weights, pair, parents = self.weights, self.pair[tree.bare], tree.parents
        n = len(parents)
        inside = [[0.0, sum(weights.get(f, 0.0) for f in own)] for own in tree.features]
        up = [(0.0, 0.0)] * n
        for v in range(n - 1, 0, -1):
            no, yes = inside[v]
            up[v] = (_add(no + pair[0][0], yes + pair[0][1]), _add(no + pair[1][0], yes + pair[1][1]))
            own = inside[parents[v]]
            own[0] += up[v][0]
            own[1] += up[v][1]
        total = _add(*inside[0])
        full = [inside[0]] + [[0.0, 0.0]] * (n - 1)
        content = [math.exp(inside[0][1] - total)] + [0.0] * (n - 1)
        edges: list[list[list[float]]] = [[[0.0, 0.0], [0.0, 0.0]]] * n
        for v in range(1, n):
            above = full[parents[v]]
            rest = (above[0] - up[v][0], above[1] - up[v][1])  # the parent without what came from v
            no, yes = inside[v]
            full[v] = [no + _add(rest[0] + pair[0][0], rest[1] + pair[1][0]), yes + _add(rest[0] + pair[0][1], rest[1] + pair[1][1])]
            edges[v] = [[math.exp(rest[p] + pair[p][c] + inside[v][c] - total) for c in (0, 1)] for p in (0, 1)]
            content[v] = min(1.0, math.exp(full[v][1] - total))
        return content, edges

    def fit(self, pages: Sequence[tuple[Tree, Sequence[bool]]], rounds: int = 80, step: float = 0.5, decay: float = 0.001) -> Model:
        """Maximum likelihood by adaptive gradient steps: observed minus expected counts."""
        scale: dict[object, float] = {}
        for _ in range(rounds):
            gain: dict[str, float] = {}
            pairs = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)]
            for tree, labels in pages:
                own_pairs = pairs[tree.bare]
                content, edges = self.marginals(tree)
                for own, p, y in zip(tree.features, content, labels, strict=True):
                    for f in own:
                        gain[f] = gain.get(f, 0.0) + y - p
                for v in range(1, len(labels)):
                    own_pairs[labels[tree.parents[v]]][labels[v]] += 1
                    for p in (0, 1):
                        for c in (0, 1):
                            own_pairs[p][c] -= edges[v][p][c]
            for f, g in gain.items():
                g -= decay * len(pages) * self.weights.get(f, 0.0)
                scale[f] = scale.get(f, 1e-6) + g * g
                self.weights[f] = self.weights.get(f, 0.0) + step * g / math.sqrt(scale[f])
            for k, p, c in product((0, 1), repeat=3):
                g = pairs[k][p][c] - decay * len(pages) * self.pair[k][p][c]
                scale[k, p, c] = scale.get((k, p, c), 1e-6) + g * g
                self.pair[k][p][c] += step * g / math.sqrt(scale[k, p, c])
        return self

    def text(self, page: str) -> str:
        tree = parse(page)
        content, _ = self.marginals(tree)
        return "\n".join(text for v, text in tree.blocks if content[v] > 0.5)


def labelled_pages(n: int, seed: int = 7, bare: bool = False) -> list[str]:
    """Training pages; the article carries data-main. Layouts, wrappers and surroundings vary by the seed.

    On bare pages its blocks stand in the page, or in a div of it, without any wrapper of their own.
    """
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("w" * r.randint(1, 9) for _ in range(r.randint(a, b))) + r.choice([".", ".", "", "!"])

    def named(word: str) -> str:
        return r.choice([f'class="{word}"', f'id="{word}"', f'class="x {word}"', f"class='{word}-box'"])

    def some(group: str) -> str:
        return named(r.choice(WORD_GROUPS[group].split()))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def around() -> list[str]:
        return [
            r.choice([f"<nav>{links(r.randint(2, 8))}</nav>", f"<div {some('nav')}>{links(r.randint(2, 8))}</div>", f"<nav {some('nav')}><a>{words(1, 2)}</a> <a>{words(1, 2)}</a></nav>"]),
            r.choice([f"<header><h2>{words(1, 5)}</h2><p>{words(2, 9)}</p></header>", f"<div {some('head')}><p>{words(2, 12)}</p></div>"]),
            r.choice([f"<div {some('ad')}>{words(2, 30)}</div>", f"<div {some('ad')}><p>{words(2, 30)}</p></div>", f"<section {some('ad')}><a>{words(2, 9)}</a></section>"]),
            r.choice([f"<div {some('notice')}><p>{words(5, 40)}</p></div>", f"<div {some('notice')}>{words(5, 40)}</div>"]),
            f"<form><p>{words(1, 6)}</p><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>",
            r.choice([f"<aside><h3>{words(1, 5)}</h3>{links(3)}<p>{words(3, 40)}</p></aside>", f"<div {some('side')}><h3>{words(1, 5)}</h3><p>{words(3, 40)}</p></div>"]),
        ]

    def after() -> list[str]:
        return [
            r.choice([f"<footer>{words(2, 40)}</footer>", f"<footer><p>{words(2, 30)}</p>{links(3)}</footer>", f"<div {some('foot')}><p>{words(2, 30)}</p></div>"]),
            r.choice([f"<section {some('talk')}><h3>{words(1, 3)}</h3><div><p>{words(3, 60)}</p></div><div><p>{words(3, 60)}</p></div></section>", f"<div {some('talk')}><ul><li><p>{words(3, 60)}</p></li></ul></div>"]),
            f"<div {some('share')}>{links(2)}</div>",
        ]

    def body() -> list[str]:
        out = [r.choice([f"<h1>{words(2, 12)}</h1>", f"<h1>{words(2, 12)}</h1>", ""])]
        for _ in range(r.choice([1, 1, 2, r.randint(3, 14)])):
            kind = r.random()
            if kind < 0.75:
                out.append(f"<p>{r.choice(['', '', '<b>'])}{words(1, r.choice([2, 9, 9, 120]))}{r.choice(['</p>', '</p>', '<br>'])}")
            elif kind < 0.82:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{words(2, 25)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote><p>{words(3, 40)}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")
            else:
                out.append(f"<pre>{words(3, 20)}</pre>")
        return out

    pages = []
    for _ in range(n):
        inner = body()
        if r.random() < 0.2:  # clutter inside the article element
            clutter = r.choice([f"<div {some('ad')} data-off>{words(2, 20)}</div>", f"<aside data-off><p>{words(3, 20)}</p></aside>", f"<div {some('share')} data-off>{links(2)}</div>"])
            inner.insert(r.randint(0, len(inner)), clutter)
        text = "".join(inner)
        wrap = r.random()
        if bare:
            main = re.sub(r"<(h1|h2|p|ul|blockquote|table|pre)>(?!<p>)", r"<\1 data-main>", text)
            main = re.sub(r"<blockquote><p data-main>", "<blockquote data-main><p>", main)
            if wrap < 0.4:
                main = f"<div>{main}</div>"
        elif wrap < 0.45:
            main = f"<article data-main>{text}</article>"
        elif wrap < 0.6:
            main = f"<main><article data-main>{text}</article></main>"
        elif wrap < 0.75:
            main = f"<div {some('main')} data-main>{text}</div>"
        elif wrap < 0.85:
            main = f"<main data-main>{text}</main>"
        elif wrap < 0.93:
            main = f"<div data-main><div>{text}</div></div>"
        else:
            main = f"<div><section data-main>{text}</section></div>"
        before = [x for x in around() if r.random() < 0.6]
        r.shuffle(before)
        behind = [x for x in after() if r.random() < 0.6]
        pages.append("<html><body>" + "".join(before) + main + "".join(behind) + "</body></html>")
    return pages


def _labels(tree: Tree, page: str) -> list[bool]:
    """Content: inside data-main and not inside data-off."""
    off = [m.start() for m in re.finditer("data-off", page)]
    if not off:
        return tree.marks
    cut = parse(re.sub(r"data-off", "data-main", page.replace("data-main", "")))
    return [a and not b for a, b in zip(tree.marks, cut.marks, strict=True)]


BARE_LAYOUTS = (
    "{}",
    "{}",
    "{}<br>{}",
    "{}<!-- -->",
    "<html><body>{}</body></html>",
    "<body>{}<br>{}",
    "<p>{}</p>",
    "<html><body><p>{}</p></body></html>",
    "<h1>{}</h1><p>{}</p>",
    "<html><body><div><h1>{}</h1><p>{}</p><p>{}</p></div></body></html>",
    "<div><p>{}</p></div>",
    "<div>{}</div>",
    "<body><ul><li>{}</li><li>{}</li></ul></body>",
)


def bare_pages(n: int, seed: int = 8) -> list[tuple[Tree, list[bool]]]:
    """Pages that are text alone, without markup or in a body without blocks: the node that holds it is content."""
    r, found = random.Random(seed), []
    for _ in range(n):
        text = " ".join("w" * r.randint(1, 9) for _ in range(r.choice([2, 9, 40, 200, 900])))
        layout = r.choice(BARE_LAYOUTS)
        tree = parse(layout.replace("{}", text))
        held = {v for v, _ in tree.blocks}
        found.append((tree, [v in held for v in range(len(tree.parents))]))
    return found


def trained(pages: int = 200) -> Model:
    made = labelled_pages(pages) + labelled_pages(pages // 3, 9, bare=True)
    trees = [parse(p) for p in made]
    return Model().fit([(t, _labels(t, p)) for t, p in zip(trees, made, strict=True)] + bare_pages(pages // 3))


def _extract(shared):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = [model.text(page.as_py()) for page in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["_id", "_url", "text", "n_chars"],
            )

    return extract


def main_text(
    pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Per row: id, url, text, n_chars (code points).

    Null and empty html, and pages without content, have an empty text. Plain text without markup is content.
    Time grows with the length of a page, also where quotes or comments are left open. Rows that repeat an id stay rows of their own.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or trained())  # a few hundred weights
    rows = pages.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{url_column}`").alias("_url"), whole(html_column).alias("_html")
    )
    found = StructType([rows.schema["_id"], rows.schema["_url"]]).add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(_extract(shared), found).withColumnsRenamed({"_id": id_column, "_url": url_column})
