"""How far the sources of a language differ in the terms they use.

Terms that occur in enough documents of a language are sorted by ranges; every range of
them becomes minimal acyclic transducers (``transducer.py``), which give a term its lexicographic
ordinal. The texts then stream through the transducers, so that counts, joins and
ties work on ordinals instead of strings; only the terms that are returned are named again.

Transducers go to the tasks in waves of at most ``WAVE`` terms, so what is sent is bounded; texts of a
language stream once for every wave that holds terms of it. Sources are compared in blocks of ordinals and groups of
sources, each a dense matrix of bounded size, and only sums leave a block.

A null text, language or source is an empty string, and every row is a document, repeated ones too. A group without terms takes part with
zero counts; a language without kept terms has pairs of value 0. Equal values come by term (its ordinal) or source.
Long texts are worked through in slices of whole words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shared_folder, written
from .transducer import Transducer, build
from .words import BYTE_CODE, LOWER, mix, run_hashes, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
PART = 20_000  # terms of one automaton, 65,535 at most
WAVE = 500_000  # terms whose automata are sent to the tasks at once
BLOCK = 2048  # ordinals of one matrix
GROUP = 128  # sources of one matrix, about
UNIT = 10**9


@dataclass(frozen=True)
class Rule:
    documents: int = 10  # that a kept term occurs in
    terms: int = 10  # ranks returned of the terms of a group


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, rule: Rule) -> DataFrame:
    """(lang, term) of the terms in at least ``documents`` documents of a language."""

    def run(stream):
        for batch in stream:
            lang = batch.column(0).dictionary_encode()
            langs, lang_of = lang.dictionary, np.asarray(lang.indices)
            for lo, hi, data, offsets in slices(batch.column(1)):
                data = LOWER[data]
                word, code, n = document_counts(data, offsets, lang_of[lo:hi])
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(code)), texts(data, *word), pa.array(n)], names=["lang", "term", "n"])

    seen = docs.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.documents).drop("n")


def document_counts(data: np.ndarray, offsets: np.ndarray, lang_of: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words of each language, its code, and in how many of the rows the word occurs."""
    starts, ends = runs(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    word = word_numbers(data, starts, ends)
    seen = np.unique(word * len(lang_of) + row)  # of each word and row, once
    word_of, lang = seen // max(len(lang_of), 1), lang_of[seen % max(len(lang_of), 1)]
    pair, n = np.unique(word_of * (int(lang_of.max(initial=0)) + 1) + lang, return_counts=True)
    first = np.zeros(int(word.max(initial=-1)) + 1, np.int64)
    first[word[::-1]] = np.arange(len(word))[::-1]
    at = first[pair // (int(lang_of.max(initial=0)) + 1)]
    return (starts[at], ends[at]), pair % (int(lang_of.max(initial=0)) + 1), n


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers: words are grouped by a hash, then held against the first of their group byte for byte."""
    h = mix(run_hashes(BYTE_CODE[data], starts, ends, "byte") + (ends - starts).astype(np.uint64))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, head = ends - starts, starts[first][number]
    same = size == size[first][number]
    at = np.flatnonzero(same)
    byte = np.arange(int(size[at].sum())) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
    equal = data[np.repeat(starts[at], size[at]) + byte] == data[np.repeat(head[at], size[at]) + byte]
    if same.all() and equal.all():
        return number.astype(np.int64)
    known: dict[bytes, int] = {}  # two words with one hash
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts, ends, strict=True)], np.int64)


def texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow string array."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    byte = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(starts, size)
    got = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[byte]))])
    return got.cast(pa.string())


def vocabulary(terms: DataFrame) -> DataFrame:
    """(lang, part, place, term, automaton): the sorted terms in parts; the first row of a part carries its automaton."""
    terms = written(terms, "terms")
    ranges = max(1, -(-terms.count() // PART))
    ordered = terms.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")

    def run(stream):
        lang, held, number = None, [], 0
        for batch in stream:
            for x, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (x != lang or len(held) == PART):
                    yield part(lang, held, number)
                    held, number = [], number + 1
                lang = x
                held.append(term)
        if held:
            yield part(lang, held, number)

    def part(lang: str, held: list[str], number: int) -> pa.RecordBatch:
        n = len(held)
        automaton = [pickle.dumps(build(t.encode() for t in held))] + [None] * (n - 1)
        columns = [pa.array([lang] * n, pa.string()), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(held, pa.string()), pa.array(automaton, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "number", "place", "term", "automaton"])

    got = ordered.mapInArrow(run, "lang string, number long, place long, term string, automaton binary")
    return written(got.withColumn("part", F.struct(F.spark_partition_id().alias("range"), "number")).drop("number"), "vocabulary")


def parts(words: DataFrame) -> DataFrame:
    """(lang, part, head, n, base): the parts in order, with their first term and its ordinal."""
    got = words.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("head"))
    before = Window.partitionBy("lang").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    return got.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of letters within rows."""
    inside = LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge], after[edge - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def recounted(docs: DataFrame, automata: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n) of the terms of one wave of (lang, head, base, automaton) rows, found by streaming the texts through them."""
    by_lang = defaultdict(list)
    for r in automata.collect():
        by_lang[r["lang"]].append((r["head"].encode(), r["base"], bytes(r["automaton"])))
    sent = docs.sparkSession.sparkContext.broadcast(dict(by_lang))

    def run(stream):
        ready: dict[str, Transducer] = {}

        def of(lang: str) -> Transducer:
            if lang not in ready:
                ready[lang] = Transducer([(head, base, pickle.loads(p)) for head, base, p in sent.value.get(lang, [])])
            return ready[lang]

        for batch in stream:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            lang_of, source_of = np.asarray(lang.indices), np.asarray(source.indices)
            found = []
            for lo, hi, data, offsets in slices(batch.column(2)):
                data = LOWER[data]
                starts, ends = runs(data, offsets)
                row = lo + np.searchsorted(offsets, starts, "right") - 1
                for k in np.unique(lang_of[lo:hi]):
                    at = np.flatnonzero(lang_of[row] == k)
                    ordinal = of(langs[k]).ordinals(data, starts[at], ends[at])
                    known = ordinal >= 0
                    found.append(folded(np.full(known.sum(), k), source_of[row[at[known]]], ordinal[known]))
            if found:
                k, s, ordinal, n = folded(*(np.concatenate(x) for x in zip(*found, strict=True)))
                columns = [pa.array(langs, pa.string()).take(pa.array(k)), pa.array(sources, pa.string()).take(pa.array(s)), pa.array(ordinal), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "ordinal", "n"])

    some = docs.filter(F.col("lang").isin(*by_lang)) if by_lang else docs.filter(F.lit(False))
    return some.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long")


def folded(lang: np.ndarray, source: np.ndarray, ordinal: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Equal (lang, source, ordinal) once, with their sum."""
    n = np.ones(len(ordinal), np.int64) if n is None else n
    order = np.lexsort((ordinal, source, lang))
    lang, source, ordinal, n = lang[order], source[order], ordinal[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (ordinal[1:] != ordinal[:-1]) | (source[1:] != source[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(new)
    return lang[at].astype(np.int64), source[at].astype(np.int64), ordinal[at], np.add.reduceat(n, at) if len(at) else n


def counts(docs: DataFrame, words: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n) of all kept terms with an occurrence."""
    order = Window.orderBy("lang", "head").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each part
    waves = written(ranges.withColumn("wave", F.floor((F.sum("n").over(order) - 1) / WAVE)), "parts")
    automata = words.filter(F.col("automaton").isNotNull()).select("lang", "part", "automaton").join(waves, ["lang", "part"])
    to = shared_folder(docs.sparkSession, "term-counts")
    schema = "lang string, source string, ordinal long, n long"
    docs.sparkSession.createDataFrame([], schema).write.parquet(to)
    last = waves.agg(F.max("wave")).first()[0]
    for w in range(0 if last is None else int(last) + 1):
        got = recounted(docs, automata.filter(F.col("wave") == w))
        got.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")).write.mode("append").parquet(to)
    return docs.sparkSession.read.schema(schema).parquet(to)


def rate(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(2)).cast("decimal(20,0)")
    below = (total + F.lit(2) * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", over, below)


def difference(p, q):
    return (p - q) * (p - q) // (p + q)


def pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language, from (lang, source, ordinal, p) and groups with ``zero`` and ``terms``."""
    split = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("splits"))
    split = groups.join(split, "lang").withColumn("split", F.pmod(F.xxhash64("source"), F.col("splits")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / BLOCK))).alias("block")
    base = split.select("lang", "source", "split", "splits", blocks, F.lit(-1).cast("long").alias("ordinal"), F.col("zero").alias("p"), "terms")
    some = found.join(split.select("lang", "source", "split", "splits", "terms"), ["lang", "source"])
    some = some.select("lang", "source", "split", "splits", F.floor(F.col("ordinal") / BLOCK).alias("block"), "ordinal", "p", "terms")
    both = base.unionByName(some).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)))
    both = both.withColumn("one", F.least("split", "other")).withColumn("two", F.greatest("split", "other"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        lang, block, terms = cell["lang"].iat[0], int(cell["block"].iat[0]), int(cell["terms"].iat[0])
        zero, some = cell[cell["ordinal"] < 0], cell[cell["ordinal"] >= 0]
        sources, splits = zero["source"].to_numpy(object), zero["split"].to_numpy()
        number = {s: i for i, s in enumerate(sources)}
        rates = np.repeat(zero["p"].to_numpy(np.int64)[:, None], min(BLOCK, terms - block * BLOCK), axis=1)
        rates[some["source"].map(number).to_numpy(np.int64), some["ordinal"].to_numpy(np.int64) - block * BLOCK] = some["p"].to_numpy(np.int64)
        one, two = np.flatnonzero(splits == cell["one"].iat[0]), np.flatnonzero(splits == cell["two"].iat[0])
        out = []
        for i in one:
            value = difference(rates[i], rates[two]).sum(1)
            keep = two != i
            out.append((np.full(keep.sum(), i), two[keep], value[keep]))
            if cell["one"].iat[0] != cell["two"].iat[0]:
                out.append((two[keep], np.full(keep.sum(), i), value[keep]))
        a, b, v = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
        return pd.DataFrame({"lang": lang, "source": sources[a], "item": sources[b], "value": v})

    sums = both.groupBy("lang", "block", "one", "two").applyInPandas(compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(lang, source, part, item, value, rank) of (lang, source, text) rows: how far every source is from the others, and the terms that set it off its language."""
    docs = plain(docs)
    words = vocabulary(kept_terms(docs, rule))
    ranges = parts(words)
    found = counts(docs, words, ranges)
    sizes = ranges.groupBy("lang").agg(F.sum("n").alias("terms"))
    groups = docs.select("lang", "source").distinct()
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
    groups = written(groups, "groups")
    rated = groups.filter(F.col("terms") > 0).withColumn("zero", rate(F.lit(0), F.col("total"), F.col("terms")))
    of_lang = rated.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rates = found.join(rated, ["lang", "source"]).join(of_lang, "lang").withColumn("p", rate(F.col("n"), F.col("total"), F.col("terms")))

    none = groups.filter(F.col("terms") == 0)
    apart = none.alias("a").join(none.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    apart = apart.select("a.lang", "a.source", F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value"))
    far = pairs(rates.select("lang", "source", "ordinal", "p"), rated).unionByName(apart)
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = far.withColumn("rank", F.row_number().over(rank)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    everywhere = F.sum("n").over(Window.partitionBy("lang", "ordinal"))
    own = rates.withColumn("q", rate(everywhere, F.col("lang_total"), F.col("terms"))).filter(F.col("p") > F.col("q"))
    apart_by = F.col("p") - F.col("q")
    own = own.withColumn("value", F.call_function("div", apart_by * apart_by, F.col("p") + F.col("q")))
    top = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    own = own.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= rule.terms).select("lang", "source", "ordinal", "value", "rank")
    named = words.join(ranges.select("lang", "part", "base"), ["lang", "part"]).select("lang", (F.col("base") + F.col("place")).alias("ordinal"), F.col("term").alias("item"))
    own = own.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return far.unionByName(own)
