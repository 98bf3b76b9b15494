"""A lenient HTML reader for the wrapper induction: trees, and blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from hashlib import blake2b

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
# A start tag of the first closes an open element of the second, up to the nearest of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
SKIP_TAGS = frozenset("nav header footer aside form script style noscript iframe template svg button select textarea title head dialog menu object canvas".split())
SKIP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|cookies?|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice"
    r"|pagination|popup|promo|related|share|sharing|sidebar|social|sponsored?|subscribe|toolbar|widget)(?:$|[\s_-])"
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN = frozenset(("article", "main"))
HOLDERS = frozenset("html body main article section div td table tbody tr center figure".split())


@dataclass
class Node:
    tag: str
    label: str
    skip: bool
    children: list = field(default_factory=list)  # nodes and strings in page order


def opened(tag: str, attributes: str) -> Node:
    """A node named by its tag and classes; what its tag, names or role mark as no part of an article is skipped."""
    if not attributes.strip():
        return Node(tag, tag, tag in SKIP_TAGS)
    a = {k.lower(): html.unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(attributes)}
    classes = sorted(a.get("class", "").lower().split())
    names = " ".join([*classes, a.get("id", "").lower()])
    hidden = "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("aria-hidden") == "true" or re.search(r"\shidden(?:\s|$|=)", " " + ATTRIBUTE.sub(lambda m: " " if m[1].lower() != "hidden" else " hidden ", attributes) + " ")
    role = a.get("role", "").lower()
    skip = tag in SKIP_TAGS or bool(hidden) or role in SKIP_ROLES or bool(tag not in ("html", "body") and SKIP_WORDS.search(names))
    return Node(tag, ".".join([tag if role != "main" else "main", *classes]), skip)


def parse(text: str) -> Node:
    root = Node("", "", False)
    stack, at, n = [root], 0, len(text)

    def close(upto: int) -> None:
        del stack[upto:]

    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in HOLDERS or stack[k].tag in ("li", "blockquote", "dd"):
                    break
        if tag in CLOSES:
            own, within = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in own:
                    close(k)
                    break
                if stack[k].tag in within:
                    break
        node = opened(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            stop = end.start() if end else n
            node.children.append(text[at:stop])
            at = text.find(">", stop) + 1 or n if end else n
            continue
        stack.append(node)
    return root


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, skipped elements left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.skip and x is not node:
            flush() if x.tag in BLOCK else None
        elif x.tag in ("br", "wbr"):
            run.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


@dataclass
class Shape:
    """A node of a page's template tree: siblings of one label in a row are one node."""

    label: str
    depth: int
    text: int = 0  # characters below, skipped elements left out
    marks: list = field(default_factory=list)  # (checksum, characters) of the text directly in each of its elements that has any
    children: list = field(default_factory=list)


def said(node: Node) -> tuple[int, int]:
    """Checksum and characters of the text directly in an element; (0, 0) without text."""
    text = " ".join("".join([x for x in node.children if isinstance(x, str)]).split())
    if not text:
        return 0, 0
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1, len(text)


def below(node: Node) -> int:
    """Characters in an element, skipped elements left out."""
    n, todo = 0, [node]
    while todo:
        x = todo.pop()
        n += said(x)[1]
        todo.extend(k for k in x.children if not isinstance(k, str) and not k.skip)
    return n


def shape(node: Node, depth: int = 0, most_deep: int = 60) -> Shape:
    out = Shape(node.label, depth)
    for x in node.children:
        if isinstance(x, str):
            continue
        if x.skip:
            kid = Shape("-" + x.label, depth + 1)
        elif depth >= most_deep:  # no tree from here on, only text
            kid = Shape(x.label, depth + 1, below(x))
        else:
            kid = shape(x, depth + 1, most_deep)
        if out.children and out.children[-1].label == kid.label:
            merge(out.children[-1], kid)
        else:
            out.children.append(kid)
    mark, chars = said(node)
    out.text = chars + sum(k.text for k in out.children)
    out.marks = [(mark, chars)] if chars else []
    return out


def merge(into: Shape, more: Shape) -> None:
    into.text += more.text
    into.marks += more.marks
    for kid in more.children:
        same = next((k for k in into.children if k.label == kid.label), None)
        merge(same, kid) if same else into.children.append(kid)


def matched(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest number of node pairs that keep parents and order, and the pairs."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.children), len(b.children)
    inner = {(i, j): matched(x, y) for i, x in enumerate(a.children) for j, y in enumerate(b.children) if x.label == y.label}
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            pair = inner.get((i - 1, j - 1), (0, []))[0]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + pair)
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner[(i - 1, j - 1)][1]
            i, j = i - 1, j - 1
    return 1 + best[m][n], pairs
