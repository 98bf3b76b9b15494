"""Benchmark decontamination by winnowing.

A text's k-gram hashes are winnowed: of every window of w consecutive k-grams
the smallest hash is kept. Two texts that share a span of k + w - 1 words share a
whole window, so they keep the same fingerprint at the same place of the span.
With k = min(5, L) and w = L - k + 1 every shared span of L words is found.

1. Fingerprints of all documents meet those of the items in an equi-join; a text
   and an item keep each fingerprint once however often it occurs. The items' side
   is sent to every task only if its counted rows are few.
2. A hit is a document and an item. Each hit document gets the words of its items,
   once for each item; hits of few words in all are sent to the texts, so that the
   texts stay where they are.
3. Hits are extended: the hashes of all windows of a document are looked up among
   those of the item, and where one is found the words are compared one by one.
   All words covered by a window are marked. The work is linear in both lengths.

Items of fewer than ``span`` words are one window of their own length, found
with a family of fingerprints for that length. Items without words match
nothing. Null texts have no words. Items that share an id count as one; a null
item id counts as the id ''. Repeated documents get equal results; null
document ids are allowed, other columns are passed on. A very long text is
worked through as one slice of memory in proportion to it; an empty table gives
an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import carried, written
from .words import ALNUM, LOWER, Words, mix, run_hashes, slices, window_least, words

BROADCAST_ROWS = 500_000  # fingerprints of items sent to every task at most (about 20 bytes each)
BROADCAST_WORDS = 4_000_000  # words of hit items sent to every task at most (8 bytes each)
# Names of the result columns; columns of these names in the input are replaced.
RESULTS = ("n_words", "n_hit", "items", "contaminated")


def winnow(w: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of the fingerprints that every shared run of ``span`` words contains."""
    k = min(gram, span)
    at, h = w.grams(k)
    if not len(at):
        return at, h
    width = span - k + 1
    least = window_least(h, width)
    inside = w.row[at[: len(least)]] == w.row[at[width - 1 :]]
    keep = np.unique(least[inside])
    return at[keep], mix(h[keep] + np.uint64(span))  # spans of different lengths don't meet


def fingerprints(df: DataFrame, key: str, text: str, spans: list[int], gram: int, own: int | None = None) -> DataFrame:
    """(key, print), each once, of every text; with ``own`` a text of fewer words than that is one window of its own length."""
    schema = T.StructType([df.schema[key], T.StructField("print", T.LongType())])

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(0)):
                w = words(data, offsets, ALNUM, LOWER)
                per = np.diff(w.first)
                for span in spans:
                    at, h = winnow(w, span, gram)
                    row = w.row[at]
                    if own is not None:
                        mine = per[row] >= own if span == own else per[row] == span
                        row, h = row[mine], h[mine]
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    row, h = row[new], h[new]
                    for k in range(0, len(h), 1 << 16):
                        s = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row[s] + lo)), pa.array(h[s].view(np.int64))], names=[key, "print"])

    return df.select(F.col(text).alias("_text_"), key).mapInArrow(run, schema)


def item_words(items: DataFrame, span: int) -> DataFrame:
    """(item, text, n) of the items that have words."""

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, ALNUM, LOWER)
                codes = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hashes.view(np.int64)))
                n = pa.array(np.diff(w.first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), codes, n], names=["item", "text", "codes", "n"])

    return items.mapInArrow(run, "item string, text string, codes array<long>, n int").filter("n > 0")


def covered(doc: np.ndarray, item: np.ndarray, span: int, windows: np.ndarray | None = None) -> np.ndarray:
    """Which words of ``doc`` stand in a window of ``span`` words of ``item``; ``windows`` are the hashes of the document's windows."""
    out = np.zeros(len(doc), bool)
    theirs = window_hashes(item, span)
    mine = window_hashes(doc, span) if windows is None else windows
    if not len(mine) or not len(theirs):
        return out
    order = np.argsort(theirs, kind="stable")
    place = np.minimum(np.searchsorted(theirs[order], mine), len(theirs) - 1)
    at = np.flatnonzero(theirs[order][place] == mine)
    step = np.arange(span)
    same = np.ones(len(at), bool)
    for lo in range(0, len(at), 1 << 16):  # word by word
        some = at[lo : lo + (1 << 16)]
        same[lo : lo + len(some)] = (doc[some[:, None] + step] == item[order[place[some]][:, None] + step]).all(1)
    edges = np.bincount(at[same], minlength=len(doc) + 1)[: len(doc) + 1] - np.bincount(at[same] + span, minlength=len(doc) + 1)[: len(doc) + 1]
    return np.cumsum(edges)[: len(doc)] > 0


def window_hashes(codes: np.ndarray, span: int) -> np.ndarray:
    starts = np.arange(len(codes) - span + 1) if len(codes) >= span else np.zeros(0, np.int64)
    return mix(run_hashes(codes, starts, starts + span, "word"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 13, gram: int = 5, share: int = 20, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids) and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    # each item row gets a number: rows may share an id, and words travel by number
    items = item_words(items, span).groupBy("item", "text").agg(F.first("codes").alias("codes"), F.first("n").alias("n"))
    items = items.withColumn("key", F.xxhash64("item", "text"))
    spans = sorted({min(r["n"], span) for r in items.select(F.least("n", F.lit(span)).alias("n")).distinct().collect()})
    rest = [c for c in docs.columns if c not in results]
    cols, fields = carried(docs, rest)
    base = docs.select(*cols, docs[text].alias("_text_"), F.xxhash64(docs[doc_id], docs[text]).alias("_key_"))
    theirs = fingerprints(items, "key", "text", spans, gram, own=span)
    if theirs.count() <= BROADCAST_ROWS:
        theirs = F.broadcast(theirs)
    pairs = fingerprints(base, "_key_", "_text_", spans, gram).join(theirs, "print").select("_key_", "key").distinct()
    hits = pairs.join(items.select("key", "item", "codes"), "key").groupBy("_key_").agg(F.collect_list(F.struct("item", "codes")).alias("_hits_"))
    hits = written(hits, "benchmark-hits")
    size = hits.agg(F.sum(F.aggregate("_hits_", F.lit(0).cast("long"), lambda n, h: n + F.size(h["codes"])))).first()[0] or 0
    if size <= BROADCAST_WORDS:
        hits = F.broadcast(hits)
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())])

    def mark(stream):
        for batch in stream:
            found = batch.column(0)
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, ALNUM, LOWER)
                n = np.diff(w.first)
                hit, names = np.zeros(hi - lo, np.int64), [[] for _ in range(hi - lo)]
                for i in np.flatnonzero(found.slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False)):
                    doc = w.hashes[w.first[i] : w.first[i + 1]]
                    marked, ids, of_span = np.zeros(len(doc), bool), set(), {}
                    for h in found[lo + int(i)].as_py():
                        codes = np.array(h["codes"], np.int64).view(np.uint64)
                        length = min(span, len(codes))
                        if length not in of_span:
                            of_span[length] = window_hashes(doc, length)
                        here = covered(doc, codes, length, of_span[length])
                        if here.any():
                            marked |= here
                            ids.add(h["item"])
                    hit[i], names[i] = marked.sum(), sorted(ids)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(n.astype(np.int64)), pa.array(hit), pa.array(names, pa.list_(pa.string())), pa.array((hit > 0) & (share * hit >= n))],
                    names=schema.names,
                )

    joined = base.join(hits, "_key_", "left").select("_hits_", "_text_", *(f.name for f in fields))
    return joined.mapInArrow(mark, schema).toDF(*rest, *results)
