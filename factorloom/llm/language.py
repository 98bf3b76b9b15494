"""Language of a text by language-bitmask n-gram filters.

One Bloom filter serves all languages: every slot holds a bitmask of languages
(bit-sliced: bit i of all slots is the filter of language i). The masks at the
slots of an n-gram, joined by AND, name all languages that contain it. Over a
text the bits are counted for each language, what false positives are expected
to add is taken off, and the largest count decides.

A language contains an n-gram (2 to 5 bytes of the lower-cased text with every run of
non-letters as one space) if a large enough share of its sampled documents has it, next to the
language where that share is the largest; of these the most frequent ones are kept.

Learning takes rows with text and language, of each language at most ``per_language`` documents chosen by a hash of the id (of
repeated ids the smallest text); scoring takes every row and every whole text. A text that is null or has no letter gets ``und`` with score 0,
as does every text where nothing could be learnt. A text without a known n-gram gets the language with the
most learning rows, score 0; equal counts go to it too, then to the smaller name.
Very long texts are worked through in windows of a megabyte (when learning, every window of
64 kB counts as a document). Repeated rows are scored each, other columns are passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import carried, fresh, written
from .words import mix, slices

UNKNOWN = "und"
SIZES = (2, 3, 4, 5)
WINDOW = 1 << 20
LEARN_WINDOW = 1 << 16
BROADCAST_IDS = 250_000  # of the sample, sent to every task at most


@dataclass(frozen=True)
class Rule:
    per_language: int = 4000
    share: float = 0.01  # of a language's documents that hold an n-gram of it
    near: float = 0.2  # of the share in the language where it is most usual
    kept: int = 20_000  # n-grams of a language
    slots: int = 1 << 18  # a power of two, 2**21 at most
    hashes: int = 3  # at most


@dataclass(frozen=True)
class Filter:
    """Languages by learning rows, masks of all slots (a byte for each 8 languages), false positive rates, slots of an n-gram."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    hashes: int


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id's text leaves 2 over four. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def letters(text: Column) -> Column:
    """Lower-cased words of letters with one space around each; empty without a letter."""
    got = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.coalesce(got, F.lit("")) != "", F.concat(F.lit(" "), got, F.lit(" "))).otherwise("")


def grams(data: np.ndarray, row: np.ndarray, starts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the n-grams (bytes and size packed into a number) that begin in the first ``starts`` bytes, and their rows."""
    packed = data.astype(np.uint64)
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            return
        packed = packed[: len(data) - n + 1] << np.uint64(8) | data[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(row[: len(packed)][:starts] == row[n - 1 :][:starts])
            yield packed[at] | np.uint64(n << 56), row[at]


def windows(column, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, row of each byte (from the first row), and bytes where n-grams begin, of bounded windows over the texts."""
    for lo, hi, data, offsets in slices(column):
        row = np.repeat(np.arange(hi - lo), np.diff(offsets))
        for a in range(0, len(data), size):
            yield lo, data[a : a + size + max(SIZES) - 1], row[a : a + size + max(SIZES) - 1], size


def counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): in how many documents of the language each n-gram occurs, from (lang, letters) rows."""

    def run(stream):
        for batch in stream:
            langs = batch.column(0).dictionary_encode()
            code, names = np.asarray(langs.indices), langs.dictionary
            for lo, data, row, starts in windows(batch.column(1), LEARN_WINDOW):
                for gram, at in grams(data, row, starts):
                    order = np.lexsort((at, gram))
                    gram, at = gram[order], at[order]
                    new = np.ones(len(gram), bool)
                    new[1:] = (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])
                    gram, lang = gram[new], code[lo + at[new]]
                    for k in np.unique(lang):
                        of, n = np.unique(gram[lang == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[int(k)].as_py()] * len(of), pa.string()), pa.array(of.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
                        )

    return rows.select("lang", "letters").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame, rule: Rule) -> DataFrame:
    """(lang, letters) of at most ``per_language`` documents of each language; no language without a letter."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rule.per_language).select("lang", "doc_id")
    ids = written(ids, "language-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return texts.select("lang", letters(F.col("text")).alias("letters")).filter(F.col("letters") != "")


def slot_numbers(gram: np.ndarray, hashes: int, slots: int) -> Iterator[np.ndarray]:
    h = mix(gram)
    for i in range(hashes):
        yield (h >> np.uint64(21 * i) & np.uint64(slots - 1)).astype(np.int64)


def fit(docs: DataFrame, rule: Rule = Rule()) -> Filter:
    """A filter learnt from (doc_id, text, lang) rows; what reaches the driver is its slots."""
    spark = docs.sparkSession
    learn = written(sampled(docs, rule), "language-sample")
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.desc("docs"), "lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Filter([], np.zeros((0, rule.slots), np.uint8), np.zeros(0), rule.hashes)
    numbers = spark.createDataFrame([(i, r["lang"], r["docs"]) for i, r in enumerate(sizes)], "bit int, lang string, docs long")
    share = F.col("n") / F.col("docs")
    got = counted(learn).join(F.broadcast(numbers), "lang").withColumn("share", share).filter(F.col("share") >= rule.share)
    got = got.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= rule.near * F.col("most"))
    first = Window.partitionBy("bit").orderBy(F.desc("share"), "gram")
    got = got.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= rule.kept)

    def slots(stream):
        for batch in stream:
            bit, gram = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            for at in slot_numbers(gram, rule.hashes, rule.slots):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit // 8), pa.array(1 << bit % 8)], names=["slot", "byte", "mask"])

    filled = got.select("bit", "gram").mapInArrow(slots, "slot long, byte int, mask int").groupBy("slot", "byte").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((-(-len(languages) // 8), rule.slots), np.uint8)
    masks[np.asarray(filled.column("byte")), np.asarray(filled.column("slot"))] = np.asarray(filled.column("mask"))
    full = np.array([(masks[i // 8] >> i % 8 & 1).mean() for i in range(len(languages))])
    return Filter(languages, masks, full**rule.hashes, rule.hashes)


BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)  # of each byte


def votes(column, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text, and how many of them the filter gives to each language."""
    total, hits = np.zeros(len(column), np.int64), np.zeros((len(column), 8 * len(f.masks)), np.int64)
    for lo, data, row, starts in windows(column, WINDOW):
        for gram, at in grams(data, row, starts):
            if not len(at):
                continue
            first, n = int(at[0]), int(at[-1] - at[0]) + 1
            at = at - first
            some = slice(lo + first, lo + first + n)
            total[some] += np.bincount(at, minlength=n)
            slots = list(slot_numbers(gram, f.hashes, f.masks.shape[1]))
            for i, masks in enumerate(f.masks):
                found = masks[slots[0]]
                for slot in slots[1:]:
                    found &= masks[slot]
                # how often each byte of languages occurs in a text, then its bits
                hits[some, 8 * i : 8 * i + 8] += np.bincount(at * 256 + found, minlength=256 * n).reshape(n, 256) @ BITS
    return total, hits[:, : len(f.languages)]


def decided(total: np.ndarray, hits: np.ndarray, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language with the largest corrected count, and its part of the n-grams that stand out from the next language's."""
    with np.errstate(divide="ignore", invalid="ignore"):
        clean = np.maximum((hits - total[:, None] * f.false) / (1 - f.false), 0.0)
        best = clean.argmax(1)
        rest = np.partition(clean, -2, axis=1)[:, -2] if clean.shape[1] > 1 else np.zeros(len(clean))
        top = clean.max(1)
        score = np.where(top > 0, 1 - rest / (2 * np.where(top > 0, top, 1)), 0.0)
    return best, score


def identify(docs: DataFrame, f: Filter, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of each text and a score of 0.5 (two languages alike) to 1 (one alone)."""
    sent = docs.sparkSession.sparkContext.broadcast(f)
    cols, fields = carried(docs, docs.columns)
    names = [*(x.name for x in fields), "lang_", "score_"]
    work = fresh(docs, "letters_")

    def run(stream):
        for batch in stream:
            model, plain = sent.value, batch.column(batch.num_columns - 1)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            said = np.full(batch.num_rows, UNKNOWN, object)
            if model.languages:
                total, hits = votes(plain, model)
                best, score = decided(total, hits, model)
                said = np.where(total > 0, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(total > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.string()), pa.array(score)], names=names)

    out = T.StructType([*fields, T.StructField("lang_", T.StringType()), T.StructField("score_", T.DoubleType())])
    return docs.select(*cols, letters(F.col(text)).alias(work)).mapInArrow(run, out).toDF(*docs.columns, *to)
