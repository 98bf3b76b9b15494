"""Main text of web pages by wrapper induction.

1. Every page becomes a small template tree (siblings of one label in a row are one
   node, text is kept as length and checksum). Equal trees of a host count once.
2. Trees of one host are dealt into blocks of about ``BLOCK``; near copies in a
   block count once, and every tree is aligned with the block's first by simple
   tree matching. A pair of nodes votes for its path: how much text stands below
   it, and which texts stand directly in it. Votes are summed by host.
3. The host's wrapper is the path of the container that holds its content: an
   article or main element before any other, else the deepest holder of all the
   varying text, so that a headline or lead beside the body stays. A text that
   nearly all aligned pages have at one path is template; a block of near copies
   alone can't tell template from article and has no say.
4. Each page gives the blocks below the wrapper's path. Texts that are template at
   their path are left out, unless the wrapper is an article or main element; other
   text at that path stays. A page without the wrapper's path, or without text
   there, gives its own article, main or body.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are skipped by tag, role or name wherever they stand (``html_tree``).

Null and empty pages give the empty text; a null or odd url is a host of its own,
its pages are aligned with each other. Repeated rows get equal results; other
columns are passed on.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_tree import HOLDERS, MAIN, Node, Shape, blocks, matched, parse, said, shape
from .store import carried, written
from .words import flat

BLOCK = 16  # pages aligned with one another
COPY = 0.9  # share of equal text from which two pages of a block count as one
SHARED = 0.8  # share of aligned pages that have a template text
LEAST = 4  # pages that a template text needs
BROADCAST_HOSTS = 20_000  # wrappers sent to every task at most (some hundred bytes each)
WRAPPER = "host string, root string, template array<string>"


def host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def trees(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, pick, depth, label, text, marks, chars): template trees in preorder; pick is the tree's checksum."""

    def run(stream):
        kinds = {"depth": pa.list_(pa.int32()), "label": pa.list_(pa.string()), "text": pa.list_(pa.int64()), "marks": pa.list_(pa.list_(pa.int64())), "chars": pa.list_(pa.list_(pa.int64()))}
        for batch in stream:
            html = flat(batch.column(1))
            for lo in range(0, batch.num_rows, 64):
                out = defaultdict(list)
                for text in html[lo : lo + 64].to_pylist():
                    order: list[Shape] = []
                    todo = [shape(parse(text))]
                    while todo:
                        s = todo.pop()
                        order.append(s)
                        todo.extend(reversed(s.children))
                    out["depth"].append([s.depth for s in order])
                    out["label"].append([s.label for s in order])
                    out["text"].append([s.text for s in order])
                    out["marks"].append([[m for m, _ in s.marks] for s in order])
                    out["chars"].append([[n for _, n in s.marks] for s in order])
                    sign = repr((out["depth"][-1], out["label"][-1], out["text"][-1], out["marks"][-1])).encode("utf-8", "replace")
                    out["pick"].append(int.from_bytes(blake2b(sign, digest_size=8).digest(), "little", signed=True))
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out["pick"], pa.int64()), *(pa.array(out[c], k) for c, k in kinds.items())], names=["host", "pick", *kinds])

    rows = pages.select(host(url).alias("host"), page)
    return rows.mapInArrow(run, "host string, pick long, depth array<int>, label array<string>, text array<long>, marks array<array<long>>, chars array<array<long>>")


def rebuilt(row) -> Shape:
    """The tree of a preorder listing."""
    root, stack = None, []
    for depth, label, text, marks, chars in zip(row.depth, row.label, row.text, row.marks, row.chars, strict=True):
        s = Shape(label, int(depth), int(text), [(int(m), int(n)) for m, n in zip(marks, chars, strict=True)])
        del stack[int(depth) :]
        if stack:
            stack[-1].children.append(s)
        else:
            root = s
        stack.append(s)
    return root


def slots(root: Shape) -> dict[tuple[str, int], int]:
    """Characters of each text (path, mark) of a page."""
    out: dict[tuple[str, int], int] = defaultdict(int)
    todo = [(root, "/")]
    while todo:
        s, at = todo.pop()
        for mark, chars in s.marks:
            out[at, mark] += chars
        todo.extend((k, f"{at}/{k.label}") for k in s.children)
    return out


def folded(shapes: list[Shape]) -> list[Shape]:
    """Pages of which none shares ``COPY`` of its text with an earlier one."""
    out, kept = [], []
    for s in shapes:
        own = slots(s)
        for other, text in kept:
            same = sum(min(n, other[k]) for k, n in own.items() if k in other)
            if same >= COPY * max(text, s.text):
                break
        else:
            out.append(s)
            kept.append((own, s.text))
    return out


def votes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Votes of one block of pages: (host, path, mark, pages, text); mark 0 is all text below a path."""
    shapes = folded([rebuilt(r) for r in pdf.sort_values("pick").itertuples()])
    pivot = shapes[0]
    path: dict[int, str] = {}
    todo = [(pivot, "/")]
    while todo:
        s, at = todo.pop()
        path[id(s)] = at
        todo.extend((k, f"{at}/{k.label}") for k in s.children)
    out: dict[tuple[str, int], list[int]] = {}
    alone = len(shapes) == 1
    for other in shapes:
        seen: dict[tuple[str, int], int] = defaultdict(int)
        for a, b in matched(pivot, other)[1]:
            at = path[id(a)]
            seen[at, 0] += b.text
            for mark, chars in b.marks:
                seen[at, mark] += chars
        for k, text in seen.items():
            if alone and k[1]:
                continue
            v = out.setdefault(k, [0, 0])
            v[0] += not alone
            v[1] += text
    return pd.DataFrame([(key[0], p, m, *v) for (p, m), v in out.items()], columns=["host", "path", "mark", "pages", "text"])


def wrapper(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of one host from its summed votes and template texts."""
    varying: dict[str, int] = {}
    template, cut = [], defaultdict(int)
    for p, mark, text in zip(pdf["path"], pdf["mark"], pdf["text"], strict=True):
        if not mark:
            varying[p] = text
            continue
        template.append(slot(p, mark))
        # template text is no content: take it from all holders above
        parts = p.split("/")
        for k in range(2, len(parts) + 1):
            cut["/".join(parts[:k])] += text
    for p, text in cut.items():
        varying[p] -= text
    total = max((t for t in varying.values()), default=0)
    tag = lambda p: p.rpartition("/")[2].partition(".")[0]
    main = [p for p in varying if tag(p) in MAIN and varying[p] >= 0.3 * total and varying[p] > 0]
    root = "/"
    if main:
        root = min(main, key=lambda p: (p.count("/"), -varying[p], p))  # the outermost
    else:
        for p in sorted(varying, key=lambda p: (p.count("/"), p)):
            # go down while one child holds all of the text
            if p.rpartition("/")[0] == root and tag(p) in HOLDERS and varying[p] > 0 and varying[p] >= varying[root]:
                root = p
    return pd.DataFrame([(key[0], root, sorted(template))], columns=["host", "root", "template"])


def induce(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, root, template): the wrapper of every host."""
    made = written(trees(pages, url, page).dropDuplicates(["host", "pick"]), "page-trees")
    sizes = made.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = made.join(sizes, "host").withColumn("block", F.pmod("pick", "blocks"))
    cast = dealt.groupBy("host", "block").applyInPandas(votes, "host string, path string, mark long, pages long, text long")
    summed = written(cast.groupBy("host", "path", "mark").agg(F.sum("pages").alias("pages"), F.sum("text").alias("text")).filter((F.col("mark") == 0) | (F.col("pages") >= LEAST)), "page-votes")
    paths = summed.filter("mark = 0")
    fixed = summed.filter("mark != 0").join(paths.select("host", "path", F.col("pages").alias("of")), ["host", "path"])
    fixed = fixed.filter(F.col("pages") >= SHARED * F.col("of")).select(*summed.columns)
    return paths.unionByName(fixed).groupBy("host").applyInPandas(wrapper, WRAPPER)


def found(root: Node, path: str) -> list[tuple[Node, str]]:
    """Nodes that stand at a path, with the path; outermost only."""
    out, todo = [], [(root, "/")]
    while todo:
        node, at = todo.pop()
        if at == path:
            out.append((node, at))
            continue
        if path.startswith(at):
            todo.extend((k, f"{at}/{k.label}") for k in reversed(node.children) if not isinstance(k, str) and not k.skip)
    return out


def first(root: Node, tag: str) -> Node | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.label.partition(".")[0] == tag:
            return node
        todo.extend(k for k in reversed(node.children) if not isinstance(k, str) and not k.skip)
    return None


def slot(path: str, mark: int) -> str:
    return f"{mark} {path}"


def without(node: Node, at: str, template: set[str]) -> Node:
    """A copy of a tree without the text of template slots."""
    top = Node(node.tag, node.label, node.skip)
    todo = [(node, at, top)]
    while todo:
        x, at, copy = todo.pop()
        drop = slot(at, said(x)[0]) in template
        for k in x.children:
            if isinstance(k, str):
                if not drop:
                    copy.children.append(k)
                continue
            kid = Node(k.tag, k.label, k.skip)
            copy.children.append(kid)
            if not k.skip:
                todo.append((k, f"{at}/{k.label}", kid))
    return top


def main_text(page: str, path: str, template: list[str]) -> str:
    root = parse(page)
    if path:
        got = []
        fixed = set(template)
        for node, at in found(root, path):
            own = node if node.label.partition(".")[0] in MAIN or not fixed else without(node, at, fixed)
            got += blocks(own)
        if got:
            return "\n\n".join(got)
    for tag in ("article", "main", "body", ""):
        node = first(root, tag) if tag else root
        if node is not None and (got := blocks(node)):
            return "\n\n".join(got)
    return ""


def extract(pages: DataFrame, url: str = "url", page: str = "html", to: str = "text") -> DataFrame:
    """``pages`` without the html and with its main text."""
    wrappers = written(induce(pages, url, page), "wrappers")
    if wrappers.count() <= BROADCAST_HOSTS:
        wrappers = F.broadcast(wrappers)
    rest = [c for c in pages.columns if c not in (page, to)]
    cols, fields = carried(pages, rest)
    schema = T.StructType([*fields, T.StructField(to, T.StringType())])
    rows = pages.select(pages[page].alias("_page_"), host(url).alias("_host_"), *cols)
    rows = rows.join(wrappers.select(F.col("host").alias("_host_"), "root", "template"), "_host_", "left").select("_page_", "root", "template", *(f.name for f in fields))

    def run(stream):
        for batch in stream:
            html = flat(batch.column(0))
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = [main_text(t, r or "", s or []) for t, r, s in zip(html[lo : lo + 64].to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[3:], pa.array(got, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*rest, to)
