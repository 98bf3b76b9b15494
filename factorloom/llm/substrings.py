"""Removal of long repeated word spans on a compacted de Bruijn graph.

An edge is a window of ``width`` words (from its first to its last width - 1
words). A word goes if an edge over it occurs at a second place. The edges of all
texts are as many as their words, so they are never listed. They are compacted
first:

1. Paths. The ``gram``-word hash that is smallest in a window (the leftmost of
   equal ones) marks it. Consecutive windows with the same mark at the same place
   are a path without branches inside one text; it is one row: mark, hash of its
   word span, place. Equal windows have equal marks, so windows that repeat lie on
   paths of equal mark.
2. Joins. Paths are counted by span. A path that occurs twice is repeated as a
   whole. Where a mark has different paths (the graph branches there), one path of
   each span is opened.
3. Coordinates. Opened paths are read again at their source, text and start word,
   and give their windows with a 128-bit hash; windows at two places are repeated.
4. Repeated paths and windows of a text are laid over its words, and the words they
   cover are removed.

Texts that are the same word sequence are one source: of such a group one text
takes part, and all texts of the group that have a window lose all their words.
Null and empty texts have no words and lose none. Rows with equal ids or null ids
are told apart by their texts; equal rows are copies. Other columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import carried, written
from .words import NOT_SPACE, Words, slices, window_least, words

RESULTS = ("n_words", "n_removed", "kept")


def paths(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and mark of every path; windows are named by their start word."""
    at, h = w.grams(gram)
    many = width - gram + 1
    none = np.zeros(0, np.int64)
    if len(at) < many:
        return none, none, h[:0]
    least = window_least(h, many)
    start = at[: len(least)]
    inside = w.row[start] == w.row[at[many - 1 :]]
    start, least = start[inside], least[inside]
    if not len(start):
        return none, none, h[:0]
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return start[head], np.diff(np.append(head, len(start))), h[least[head]]


def all_paths(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """One row per text: key, number of words, digest of the word sequence, and its paths."""
    names = {"start": pa.int32(), "size": pa.int16(), "mark": pa.int64(), "span": pa.int64()}

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, NOT_SPACE)
                digest = [w.spans(w.first[:-1], w.first[1:], k).view(np.int64) for k in ("word", "second")]
                start, size, mark = paths(w, width, gram)
                row = w.row[start]
                bounds = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                span = w.spans(start, start + size + width - 1)
                values = (start - w.first[row], size, mark.view(np.int64), span.view(np.int64))
                cols = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(k.to_pandas_dtype()), k)) for v, k in zip(values, names.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), *map(pa.array, digest), *cols], names=["key", "n", "d1", "d2", *names]
                )

    return docs.select("_key_", "_text_").mapInArrow(run, "key long, n long, d1 long, d2 long, start array<int>, size array<short>, mark array<long>, span array<long>")


def windows(texts: DataFrame, width: int) -> DataFrame:
    """(key, pos, h1, h2) of the windows of the opened paths; ``texts`` has key, text, start and size lists."""

    def run(stream):
        for batch in stream:
            starts, sizes = batch.column(2), batch.column(3)
            for lo, hi, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, NOT_SPACE)
                s, z = starts.slice(lo, hi - lo), sizes.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), s.value_lengths().fill_null(0).to_numpy())
                start, size = s.flatten().to_numpy(), z.flatten().to_numpy().astype(np.int64)
                upto = np.cumsum(size)
                pos = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size) + np.repeat(start, size)
                row = np.repeat(row, size)
                at = w.first[row] + pos
                hashes = [w.spans(at, at + width, k).view(np.int64) for k in ("word", "second")]
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                for k in range(0, len(at), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([keys[part], pa.array(pos[part].astype(np.int32)), *(pa.array(h[part]) for h in hashes)], names=["key", "pos", "h1", "h2"])

    return texts.mapInArrow(run, "key long, pos int, h1 long, h2 long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35, gram: int = 6, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """``docs`` with the number of words, the number removed, and the kept words joined by one space."""
    rest = [c for c in docs.columns if c not in results]
    cols, fields = carried(docs, rest)
    base = docs.select(*cols, docs[text].alias("_text_"), F.xxhash64(docs[doc_id], docs[text]).alias("_key_"))

    listed = written(all_paths(base, width, gram), "debruijn-paths")
    groups = listed.filter(F.col("n") >= width).groupBy("n", "d1", "d2").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    groups = written(groups, "debruijn-texts")
    copies = listed.select("key", "n", "d1", "d2").join(groups.filter("copies > 1").select("n", "d1", "d2"), ["n", "d1", "d2"]).select("key").distinct()
    sources = listed.join(groups.select("key"), "key", "left_semi")
    path = sources.select("key", F.inline(F.arrays_zip("start", "size", "mark", "span")))
    path = path.withColumn("place", F.xxhash64("key", "start"))

    spans = written(path.groupBy("mark", "span").agg(F.count("*").alias("times"), F.min("place").alias("opened_at")), "debruijn-spans")
    branching = spans.groupBy("mark").agg(F.count("*").alias("spans")).filter("spans > 1").select("mark")
    status = spans.join(branching.withColumn("branch", F.lit(True)), "mark", "left").filter("times > 1 OR branch")
    status = status.select("mark", "span", (F.col("times") > 1).alias("whole"), F.coalesce("branch", F.lit(False)).alias("branch"), "opened_at")
    used = path.join(status, ["mark", "span"])
    used = used.select("key", "start", "size", "whole", (F.col("branch") & (F.col("place") == F.col("opened_at"))).alias("open")).filter("whole OR open")
    by_text = used.groupBy("key").agg(F.collect_list(F.struct("start", "size", "whole", "open")).alias("paths"))
    by_text = written(by_text, "debruijn-used")

    opened = by_text.select("key", F.filter("paths", lambda p: p["open"]).alias("paths")).filter(F.size("paths") > 0)
    opened = opened.select("key", F.col("paths.start").alias("start"), F.col("paths.size").alias("size"))
    texts = base.select(F.col("_key_").alias("key"), "_text_").join(opened, "key").select("key", "_text_", "start", "size")
    # Rows of equal id and text give their windows once each: they are two places.
    window = written(windows(texts, width), "debruijn-windows")
    twice = window.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2")
    single = window.join(twice, ["h1", "h2"]).groupBy("key").agg(F.collect_list("pos").alias("single"))

    whole = by_text.select("key", F.filter("paths", lambda p: p["whole"]).alias("paths")).select("key", F.col("paths.start").alias("start"), F.col("paths.size").alias("size"))
    laid = whole.join(single, "key", "full_outer").join(copies.withColumn("copy", F.lit(True)), "key", "full_outer")
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cover(stream):
        for batch in stream:
            start, size, single, copy = batch.columns[:4]
            for lo, hi, data, offsets in slices(batch.column(4)):
                w = words(data, offsets, NOT_SPACE)
                cut = slice(lo, hi)
                change = np.zeros(len(w.row) + 1, np.int64)
                for at, many in ((start, size), (single, None)):
                    got = at[cut]
                    row = np.repeat(np.arange(hi - lo), got.value_lengths().fill_null(0).to_numpy())
                    first = w.first[row] + got.flatten().to_numpy()
                    last = first + width - 1 + (many[cut].flatten().to_numpy() if many is not None else 1)
                    np.add.at(change, first, 1)
                    np.add.at(change, last, -1)
                gone = np.cumsum(change[:-1]) > 0
                for i in np.flatnonzero(copy[cut].fill_null(False).to_numpy(zero_copy_only=False)):
                    gone[w.first[i] : w.first[i + 1]] = True
                n = np.diff(w.first)
                removed = np.bincount(w.row[gone], minlength=hi - lo)
                kept = []
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = w.first[i], w.first[i + 1]
                    if not removed[i]:
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                    else:
                        k = np.flatnonzero(~gone[a:b]) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(w.starts[k].tolist(), w.ends[k].tolist(), strict=True)]))
                part = batch.slice(lo, hi - lo)
                out = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[5:], pa.array(n), pa.array(removed), out], names=schema.names)

    joined = base.join(laid, F.col("_key_") == F.col("key"), "left").select("start", "size", "single", "copy", "_text_", *(f.name for f in fields))
    return joined.mapInArrow(cover, schema).toDF(*rest, *results)
