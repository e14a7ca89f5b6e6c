"""Main text of web pages: boosted trees over DOM-node features with hierarchical decoding.

A small forgiving reader builds the element tree of a page. Every element is described by its tag,
the tokens of its class, id and role, its ancestors' tokens, depth, siblings, and the text and link
density of its subtree. Gradient-boosted trees (trained here, in numpy) score how likely an element
belongs to the article. Decoding then chooses the best labelling in which an element is outside the
article, inside it, or removed from it, and a child never goes back to an earlier one of these: once
inside, descendants are inside or removed; what is removed stays removed. The choice is exact, by
dynamic programming over the tree.

The trees are trained on pages drawn from a seeded grammar of page parts (articles in many kinds of
containers or in none, menus, headers, sidebars, notices, adverts, forms, comments), as no labelled pages are
given; the number of pages is a parameter and the training takes about twenty seconds on the driver.

Text inside the article is joined by block: character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by one space in page order.

Defined results: a null or empty html and a page without article text give an empty text; unclosed,
stray and cut-off tags, quotes and comments are read as browsers do, as far as text is concerned, but for
a quote that is never closed, which ends at once; repeated rows are each given; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting

# Fixed values of HTML: elements without content, raw text, blocks, and tags that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark picture q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table select menu".split())
NEVER = frozenset("script style noscript template iframe head title form select button textarea input svg math object canvas dialog".split())

# Words in class, id and role attributes, by what they stand for.
TOKENS = {
    "main": "article content post entry story main body text page blog news prose articlebody maincontent single markdown",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs links topbar",
    "head": "header head masthead banner logo branding top hero",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside widget rail column related recommended popular trending tags categories more author bio",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message toast warning",
    "comment": "comment comments reply replies discussion disqus respond reader readers thread feedback reviews",
    "share": "share sharing social facebook twitter buttons follow tools meta byline print",
    "form": "form search login register contact field input",
}
_GROUP = {word: name for name, words in TOKENS.items() for word in words.split()}
GROUPS = tuple(TOKENS)
_TAGS = {
    "article": {"article"}, "main": {"main"}, "section": {"section"}, "div": {"div"}, "p": {"p", "pre", "blockquote"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "list": {"ul", "ol", "dl", "menu"}, "item": {"li", "dt", "dd"}, "nav": {"nav"}, "header": {"header"}, "footer": {"footer"}, "aside": {"aside"}, "form": set(NEVER),
    "table": {"table", "tbody", "tr", "td", "th"}, "inline": set(INLINE), "body": {"html", "body"}, "figure": {"figure", "figcaption"},
}
TAG_KINDS = tuple(_TAGS)
_TAG_KIND = {tag: i for i, kind in enumerate(TAG_KINDS) for tag in _TAGS[kind]}

_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
#: An attribute as browsers read it; a value whose quote is never closed ends at once, so the tag ends at the next `>`.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_TAG_END = re.compile(r"[\s/]*(>|\Z)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.IGNORECASE) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "groups", "parent", "block", "parts", "depth", "place", "siblings")

    def __init__(self, tag: str, groups: int, parent: Node | None):
        self.tag, self.groups, self.parent = tag, groups, parent
        #: The nearest element that is not inline, itself included.
        self.block: Node = parent.block if parent and tag in INLINE else self
        self.parts: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


@functools.lru_cache(maxsize=100_000)
def _groups(value: str) -> int:
    """Which token groups an attribute's words are of, as bits."""
    found = 0
    for word in _WORDS.findall(value):
        name = _GROUP.get(word.lower())
        if name:
            found |= 1 << GROUPS.index(name)
    whole = _GROUP.get(re.sub(r"[^a-z]", "", value.lower()))
    return found | (1 << GROUPS.index(whole) if whole else 0)


def _attributes(page: str, at: int) -> tuple[int, int]:
    """The token groups of a tag's class, id and role, from where its name ends, and where the tag ends."""
    found = 0
    while not (end := _TAG_END.match(page, at)):
        m = _ATTRIBUTE.match(page, at)
        if m[1].lower() in ("class", "id", "role"):
            found |= _groups(m[2] or m[3] or m[4] or "")
        at = m.end()
    return found, end.end()


def parse(page: str) -> Node:
    """The element tree of a page; text stays undecoded. The time is linear in the page's length."""
    root = Node("html", 0, None)
    here, at, text_from = root, 0, 0
    open_: dict[str, int] = {}
    # for each open list or table, and the page, its open items by tag, outermost first
    scopes: list[dict[str, list[Node]]] = [{}]

    def close(top: Node) -> Node:
        """Close the open elements up to `top`."""
        node = here
        while node is not top.parent:
            open_[node.tag] -= 1
            if node.tag in _LISTS:
                scopes.pop()
            elif node.tag in ITEMS:
                scopes[-1][node.tag].pop()
            node = node.parent
        return node

    while m := _MARKUP.search(page, at):
        if m.start() > text_from:
            here.parts.append(page[text_from : m.start()])
        if m[2] is None:
            if not m[3]:
                at = page.find(">", m.end()) + 1 or len(page)
            elif page.startswith((">", "->"), m.end()):
                at = page.index(">", m.end()) + 1
            else:
                end = _COMMENT_END.search(page, m.end())
                at = end.end() if end else len(page)
            text_from = at
            continue
        tag = m[2].lower()
        groups, at = _attributes(page, m.end())
        text_from = at
        if m[1]:
            if open_.get(tag):
                top = here
                while top.tag != tag:
                    top = top.parent
                here = close(top)
            continue
        if tag in ("html", "body"):
            root.groups |= groups if tag == "body" else 0
            continue
        if tag in ITEMS:
            items = [scopes[-1][x][-1] for x in ITEMS[tag] if scopes[-1].get(x)]
            if items:
                here = close(max(items, key=lambda x: x.depth))
        elif tag in ENDS_PARAGRAPH and here.block.tag == "p":
            here = close(here.block)
        node = Node(tag, groups, here)
        here.parts.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag == "textarea" or tag == "title":
                node.parts.append(page[at : end.start()])
            at = text_from = end.end()
        elif tag not in VOID:
            open_[tag] = open_.get(tag, 0) + 1
            if tag in _LISTS:
                scopes.append({})
            elif tag in ITEMS:
                scopes[-1].setdefault(tag, []).append(node)
            here = node
    if text_from < len(page):
        here.parts.append(page[text_from:])
    return root


def nodes_of(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        out.append(node)
        inner = [x for x in node.parts if isinstance(x, Node)]
        for i, x in enumerate(inner):
            x.place, x.siblings = i, len(inner)
        open_ += reversed(inner)
    return out


_N = 2 * len(TAG_KINDS) + 2 * len(GROUPS) + 12


def features(nodes: list[Node]) -> np.ndarray:
    """One row per element: own and ancestors' tag kinds and token groups, then counts and densities."""
    n = len(nodes)
    out = np.zeros((n, _N), np.float32)
    number = {id(node): i for i, node in enumerate(nodes)}
    text, links, commas, elements, paragraphs = (np.zeros(n) for _ in range(5))
    own, tag_bits, group_bits = np.zeros(n), [0] * n, [0] * n
    for i, node in enumerate(nodes):
        for part in node.parts:
            if isinstance(part, str):
                own[i] += len(part) - part.count(" ") if part.isspace() else len(part)
                commas[i] += part.count(",") + part.count(".")
        kind = _TAG_KIND.get(node.tag)
        up = number.get(id(node.parent)) if node.parent else None
        above_tags, above_groups = (tag_bits[up], group_bits[up]) if up is not None else (0, 0)
        tag_bits[i] = above_tags | (1 << kind if kind is not None else 0)
        group_bits[i] = above_groups | node.groups
        row = out[i]
        if kind is not None:
            row[kind] = 1
        base = len(TAG_KINDS)
        for j in range(len(TAG_KINDS)):
            row[base + j] = above_tags >> j & 1
        base *= 2
        for j in range(len(GROUPS)):
            row[base + j] = node.groups >> j & 1
            row[base + len(GROUPS) + j] = above_groups >> j & 1
    text[:] = own
    elements[:] = 1
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.tag == "a":
            links[i] = text[i]
        if node.tag == "p":
            paragraphs[i] += 1
        if node.parent is not None:
            up = number[id(node.parent)]
            for x in (text, links, commas, elements, paragraphs):
                x[up] += x[i]
    place = np.array([(getattr(x, "place", 0), getattr(x, "siblings", 1), x.depth) for x in nodes], np.float64)
    total = max(1.0, text[0])
    out[:, -12:] = np.stack(
        [np.log1p(text), np.log1p(own), links / np.maximum(1, text), text / elements, commas / np.maximum(1, text / 100), np.log1p(elements), np.log1p(paragraphs), text / total, place[:, 0] / place[:, 1], np.log1p(place[:, 1]), place[:, 2], np.arange(n) / n],
        axis=1,
    )
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Labels 0 (outside), 1 (inside), 2 (removed), never falling from parent to child, that maximise the summed evidence.

    An element's evidence is its logit weighted by the text it holds directly. Inline elements without
    telling attributes have none and go with their block.
    """
    n = len(nodes)
    number = {id(node): i for i, node in enumerate(nodes)}
    size = np.array([sum(len(x.strip()) for x in node.parts if isinstance(x, str)) for node in nodes], np.float64)
    weight = 0.05 + np.log1p(size)
    gain = np.zeros((n, 3))
    gain[:, 1] = np.clip(logits, -8, 8) * weight
    gain[[i for i, node in enumerate(nodes) if node.tag in INLINE and not node.groups], 1] = 0
    gain[[i for i, node in enumerate(nodes) if node.tag in NEVER], 1] = -1e9
    choice = np.zeros((n, 3), np.int8)
    below = np.zeros((n, 3))
    for i in range(n - 1, -1, -1):
        value = gain[i] + below[i]
        # best label of at least s, for a parent labelled s; leaving the article costs a little, so labels change only for evidence
        for s in range(3):
            options = value[s:].copy()
            options[1:] -= 0.1 if s else 0.0
            choice[i, s] = s + int(options.argmax())
        if nodes[i].parent is not None:
            up = number[id(nodes[i].parent)]
            for s in range(3):
                c = choice[i, s]
                below[up, s] += value[c] - (0.1 if s and c != s else 0.0)
    labels = np.zeros(n, np.int8)
    for i, node in enumerate(nodes):
        labels[i] = choice[i, labels[number[id(node.parent)]] if node.parent is not None else 0]
    return labels


def _walk(root: Node) -> Iterator[tuple[Node, str | bool]]:
    """Text parts and block edges (True) in page order, with their element."""
    open_: list[tuple[Node, Iterator]] = [(root, iter(root.parts))]
    while open_:
        node, parts = open_[-1]
        part = next(parts, None)
        if part is None:
            open_.pop()
            yield node, node.tag not in INLINE
        elif isinstance(part, str):
            yield node, part
        else:
            yield part, part.tag not in INLINE
            open_.append((part, iter(part.parts)))


def main_text(nodes: list[Node], labels: np.ndarray) -> str:
    inside = {id(node) for node, label in zip(nodes, labels, strict=True) if label == 1}
    blocks, now = [], []
    for node, part in _walk(nodes[0]):
        if isinstance(part, str):
            if id(node) in inside:
                now.append(part)
        elif part and now:
            blocks.append(now)
            now = []
    blocks.append(now)
    texts = (" ".join(entities.unescape("".join(block)).split()) for block in blocks)
    return " ".join(text for text in texts if text)


# ---- training pages ---------------------------------------------------------------------------------------

#: The share of training pages whose article stands in the body itself.
BARE = 0.15


@functools.lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choices("aeioulnrstdk", k=rng.randint(2, 9))) for _ in range(3000)]


def _sentence(rng: random.Random, least: int, most: int) -> str:
    words = rng.choices(_vocabulary(), k=rng.randint(least, most))
    return " ".join(w + ("," if rng.random() < 0.08 else "") for w in words).capitalize() + rng.choice(["."] * 9 + ["", "!"])


def _prose(rng: random.Random, least: int = 4, most: int = 90) -> str:
    return " ".join(_sentence(rng, 3, 14) for _ in range(max(1, rng.randint(least, most) // 9)))


def _links(rng: random.Random, n: int) -> str:
    item = rng.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<div><a href='/x'>{}</a></div>"])
    return ("<ul>{}</ul>" if "<li>" in item else "{}").format("".join(item.format(_sentence(rng, 1, 4)) for _ in range(n)))


def _attr(rng: random.Random, group: str, bare: float = 0.0) -> str:
    if rng.random() < bare:
        return ""
    word = rng.choice(TOKENS[group].split())
    word = rng.choice([word, word, f"{word}-{rng.choice(['box', 'wrap', 'block', 'area', 'list', 'item', '1'])}", f"{rng.choice(['site', 'page', 'js', 'c'])}-{word}"])
    return f" {rng.choice(['class', 'class', 'id'])}=\"{word}\""


def _comment(rng: random.Random, listed: bool) -> str:
    tag, text = "li" if listed else rng.choice(["div", "p", "article", "div"]), _prose(rng, 2, 70)
    text = text if tag == "p" or rng.random() < 0.3 else f"<p>{text}</p>"
    return f"<{tag}{_attr(rng, 'comment', 0.4)}>{text}</{tag}>"


def _wrapped(rng: random.Random, text: str) -> str:
    tag = rng.choice(["", "p", "div", "span"])
    return f"<{tag}>{text}</{tag}>" if tag else text


def _junk(rng: random.Random, kinds: list[str] | None = None) -> str:
    """A page part that is not of the article, marked with an `x-` wrapper for the labels."""
    kind = rng.choice(kinds or ["nav", "head", "foot", "side", "ad", "notice", "comment", "share", "form"])
    tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "comment": "section"}.get(kind, "div")
    semantic = tag != "div" and rng.random() < 0.6
    tag = tag if semantic else rng.choice(["div", "section", "div", {"nav": "ul", "comment": rng.choice(["ul", "ol"])}.get(kind, "div")])
    attr = _attr(rng, kind, 0.7 if semantic and tag not in ("section",) else 0.0)
    small, p = _sentence(rng, 1, 6), rng.choice(["p", "div", "span"])
    inner = {
        "nav": lambda: _links(rng, rng.randint(2, 12)),
        "head": lambda: (f"<h1>{small}</h1>" if rng.random() < 0.2 else "") + f"<{p}>{small}</{p}>" + (_links(rng, rng.randint(1, 6)) if rng.random() < 0.5 else ""),
        "foot": lambda: _wrapped(rng, f"{rng.choice(['&copy; ', 'Copyright ', ''])}{small} {rng.choice(['&middot; ', ''])}{_prose(rng, 3, 60)}") + (_links(rng, 4) if rng.random() < 0.5 else ""),
        "side": lambda: f"<h3>{small}</h3>" + (_links(rng, rng.randint(2, 8)) if rng.random() < 0.6 else "".join(f"<p>{_prose(rng)}</p>" for _ in range(rng.randint(1, 3)))),
        "ad": lambda: rng.choice([_prose(rng, 3, 50), f"<p>{_prose(rng, 3, 50)}</p>", f"<a href='/x'>{_prose(rng, 3, 20)}</a>"]),
        "notice": lambda: f"<{p}>{_prose(rng, 4, 60)}</{p}>" + rng.choice(["", "<button>OK</button>", "<a href='/x'>More</a>"]),
        "comment": lambda: (f"<h3>{small}</h3>" if tag not in ("ul", "ol") and rng.random() < 0.7 else "") + "".join(_comment(rng, tag in ("ul", "ol")) for _ in range(rng.randint(1, 5))),
        "share": lambda: _links(rng, rng.randint(2, 5)) if rng.random() < 0.7 else small,
        "form": lambda: f"<label>{small}</label><input name=q><button>{small}</button>",
    }[kind]()
    return f"<x-junk><{tag}{attr}>{inner}</{tag}></x-junk>"


def training_page(rng: random.Random) -> str:
    """A page of the grammar; `x-main` and `x-junk` wrap what is and is not article text, and are taken out again."""
    body = [f"<h1>{_sentence(rng, 2, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 14)):
        body.append(rng.choice([f"<p>{_prose(rng)}</p>"] * 8 + [f"<p>{_sentence(rng, 1, 6)}</p>", f"<p><b>{_prose(rng)}<br>", f"<p><b>{_prose(rng)}<br><p>{_sentence(rng, 1, 6)}</p>", f"<h2>{_sentence(rng, 2, 8)}</h2>", f"<ul>{''.join(f'<li>{_prose(rng, 3, 25)}</li>' for _ in range(rng.randint(1, 5)))}</ul>", f"<blockquote>{_prose(rng)}</blockquote>", f"<div>{_prose(rng)}</div>", f"<table><tr><td>{_sentence(rng, 1, 5)}<td>{_sentence(rng, 1, 5)}</table>", f"<pre>{_prose(rng)}</pre>", f"<p>{_prose(rng)} <a href='/x'>{_sentence(rng, 1, 4)}</a> {_prose(rng)}</p>"]))
        if rng.random() < 0.15:
            body.append(_junk(rng, ["ad", "ad", "side", "share", "notice", "form", "nav"]))
    if rng.random() < 0.35:
        body.append(_junk(rng, ["share", "comment", "comment", "side", "foot"]))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    plain = tag in ("article", "main")
    article = f"<{tag}{_attr(rng, 'main', 0.6 if plain else 0.0)}><x-main>{''.join(body)}</x-main></{tag}>"
    if rng.random() < BARE:  # no container: paragraphs, or bare text with breaks, in the body itself
        text = rng.choice(["<br>", "<br><br>", "\n"]).join(_prose(rng) for _ in range(rng.randint(1, 8)))
        article = f"<x-main>{rng.choice([''.join(body), text])}</x-main>"
    for _ in range(rng.randint(0, 2) if not article.startswith("<x-main>") else 0):
        article = rng.choice(["{}", "<div{}>{{}}</div>".format(_attr(rng, "main", 0.7)), "<main>{}</main>", "<section>{}</section>"]).format(article)
    before = [_junk(rng, ["nav", "head", "ad", "notice", "nav", "form", "side"]) for _ in range(rng.randint(0, 4))]
    after = [_junk(rng, ["foot", "comment", "side", "ad", "notice", "foot", "share", "nav"]) for _ in range(rng.randint(0, 4))]
    parts = "".join([*before, article, *after])
    return f"<html><head><title>t</title></head><body>{parts}</body></html>" if rng.random() < 0.8 else f"<body><div id=wrapper>{parts}</div>"


def _labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """The page's tree without the wrappers, and 1 for elements of the article."""
    nodes, labels = [], {}
    root = parse(page)

    def take_out(parts: list, node: Node, label: int) -> Iterator[tuple[Node | str, int]]:
        """Parts with their labels, the contents of wrappers in place of them."""
        for part in parts:
            if isinstance(part, Node) and part.tag.startswith("x-"):
                inner = int(part.tag == "x-main")
                if inner:
                    labels[id(node)] = 1
                yield from take_out(part.parts, node, inner)
            else:
                yield part, label

    def lift(node: Node, label: int) -> None:
        labels[id(node)] = label
        inside = list(take_out(node.parts, node, label))
        node.parts = [part for part, _ in inside]
        for part, own in inside:
            if isinstance(part, Node):
                part.parent, part.depth = node, node.depth + 1
                lift(part, own)

    lift(root, 0)
    nodes = nodes_of(root)
    return nodes, np.array([labels[id(x)] for x in nodes], np.float64)


@functools.lru_cache(maxsize=4)
def train(pages: int = 800, seed: int = 5) -> boosting.Forest:
    rng, x, y, weight = random.Random(seed), [], [], []
    for _ in range(pages):
        nodes, labels = _labelled(training_page(rng))
        x.append(features(nodes))
        y.append(labels)
        weight.append(1 + np.log1p([sum(len(t) for t in node.parts if isinstance(t, str)) for node in nodes]))
    return boosting.fit(np.concatenate(x), np.concatenate(y), np.concatenate(weight) / 3)


def extract(page: str, forest: boosting.Forest) -> str:
    nodes = nodes_of(parse(page))
    return main_text(nodes, decode(nodes, forest.logits(features(nodes))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: boosting.Forest | None = None, group: int = 64) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    forest = forest or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for first in range(0, batch.num_rows, group):
                trees = [nodes_of(parse(x.as_py() or "")) for x in batch.column(2)[first : first + group]]
                scores = forest.logits(np.concatenate([features(nodes) for nodes in trees]))
                at = np.concatenate([[0], np.cumsum([len(nodes) for nodes in trees])])
                texts += [main_text(nodes, decode(nodes, scores[at[i] : at[i + 1]])) for i, nodes in enumerate(trees)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
