"""License scans with a positional index of rare words.

1. Over all documents, count in how many each word of the licence texts occurs;
   idf = ln((1 + documents) / (1 + those)). The vocabulary is fixed, so the counts
   are a bounded table.
2. The index: for every phrase its word of highest idf, for every template its
   ``anchors`` words of highest idf, each with its place in the phrase or template.
3. A document looks up only the occurrences of indexed words. Each posting gives a
   start (place in the document minus place in the text); a phrase stands where
   all its words follow that start. A template is a candidate at a start on which
   at least half of its anchors' idf agrees, and is reported if each of its
   mandatory key phrases stands within it (``SLACK`` words aside). Its score is the
   idf-weighted share of its words that stand in place.

Phrases (``BASE``) are found at all their places: every occurrence holds the word
that is looked up, whichever word that is. Null and empty texts have no words and
no matches, score 0. Other columns are passed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import carried
from .words import ALNUM, LOWER, Words, slices, words

# Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of common licences, each with the key phrases it can't do without.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license",)),
    "apache-grant": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3 0", ("gnu general public license", "version 3")),
    "gpl-2.0": ("licensed under the gnu general public license version 2 0", ("gnu general public license", "version 2")),
    "lgpl": ("gnu lesser general public license version", ("lesser general public license",)),
    "agpl": ("gnu affero general public license version", ("affero general public license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-nd": ("licensed under cc by nd 4 0", ("cc by nd",)),
    "cc0": ("to the extent possible under law the author has waived all copyright and related rights", ("waived all copyright",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software",)),
}
SLACK = 3
MATCH = "array<struct<label:string,base:boolean,start:int,size:int,score:double>>"


def hashed(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    w = words(np.frombuffer(b"".join(raw), np.uint8), offsets, ALNUM, LOWER)
    return [w.hashes[w.first[i] : w.first[i + 1]] for i in range(len(raw))]


def document_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, and the number of documents."""
    size = len(vocabulary)

    def run(stream):
        n, total = np.zeros(size, np.int64), 0
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(0)):
                w = words(data, offsets, ALNUM, LOWER)
                at = np.minimum(np.searchsorted(vocabulary, w.hashes), size - 1)
                known = vocabulary[at] == w.hashes
                n += np.bincount(np.unique(w.row[known] * size + at[known]) % size, minlength=size)
                total += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(np.append(n, total))], names=["k", "n"])

    got = docs.select(text).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(size + 1, np.int64)
    for r in got:
        n[r["k"]] = r["n"]
    return n[:-1], int(n[-1])


def standing(w: Words, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """For each start, whether all words of the phrase stand there in one row."""
    ok = (at >= 0) & (at + len(phrase) <= len(w.row))
    k = np.where(ok, at, 0)
    ok &= w.row[k] == w.row[np.minimum(k + len(phrase) - 1, len(w.row) - 1)]
    for j, h in enumerate(phrase):
        ok &= w.hashes[np.minimum(k + j, len(w.row) - 1)] == h
    return ok


class Index:
    """Postings of the rare words of phrases and templates."""

    def __init__(self, idf: dict[int, float], anchors: int) -> None:
        self.idf = idf
        weight = lambda h: idf[int(h)]
        keys = {p for _, ks in TEMPLATES.values() for p in ks}
        self.phrases = {p: (h, max(range(len(h)), key=lambda j: (weight(h[j]), -j))) for p, h in zip([*BASE, *keys], hashed([*BASE, *keys]), strict=True)}
        self.templates = {}
        for label, h in zip(TEMPLATES, hashed([t for t, _ in TEMPLATES.values()]), strict=True):
            rare = sorted(range(len(h)), key=lambda j: (-weight(h[j]), j))[:anchors]
            self.templates[label] = (h, rare, np.array([weight(x) for x in h]))
        looked_up = {int(h[j]) for h, j in self.phrases.values()} | {int(h[j]) for h, rare, _ in self.templates.values() for j in rare}
        self.rare = np.array(sorted(looked_up), np.uint64)

    def places(self, w: Words) -> list[tuple[int, str, bool, int, int, float]]:
        """(row, label, base, start, size, score) of every match, starts counted in the row."""
        if not len(w.row):
            return []
        k = np.minimum(np.searchsorted(self.rare, w.hashes), len(self.rare) - 1)
        at = np.flatnonzero(self.rare[k] == w.hashes)
        h = w.hashes[at]
        found, stand = [], {}
        for p, (hashes, j) in self.phrases.items():
            starts = at[h == hashes[j]] - j
            stand[p] = starts[standing(w, starts, hashes)]
            if p in BASE:
                found += [(int(w.row[s]), BASE[p], True, int(s - w.first[w.row[s]]), len(hashes), 1.0) for s in stand[p]]
        for label, (hashes, rare, weights) in self.templates.items():
            votes: list[np.ndarray] = [at[h == hashes[j]] - j for j in rare]
            starts = np.concatenate(votes)
            if not len(starts):
                continue
            rows = np.concatenate([w.row[at[h == hashes[j]]] for j in rare])
            share = np.concatenate([np.full(len(v), weights[j]) for v, j in zip(votes, rare, strict=True)])
            pairs, back = np.unique(np.stack([rows, starts]), axis=1, return_inverse=True)
            agreed = np.bincount(back.ravel(), share)
            for row, s in pairs[:, agreed >= 0.5 * weights[rare].sum()].T:
                lo, hi = w.first[row], w.first[row + 1]
                key_ok = all(((stand[p] >= max(lo, s - SLACK)) & (stand[p] + len(self.phrases[p][0]) <= min(hi, s + len(hashes) + SLACK))).any() for p in TEMPLATES[label][1])
                if not key_ok:
                    continue
                place = np.arange(s, s + len(hashes))
                inside = (place >= lo) & (place < hi)
                same = inside & (w.hashes[np.clip(place, lo, hi - 1)] == hashes)
                total = weights.sum()
                score = float(weights[same].sum() / total) if total > 0 else float(same.mean())
                found.append((int(row), label, False, int(max(s, lo) - lo), int(min(s + len(hashes), hi) - max(s, lo)), score))
        return sorted(found)


def scan(docs: DataFrame, text: str = "text", anchors: int = 4) -> DataFrame:
    """``docs`` with n_words and matches (label, base, start, size, score)."""
    everything = hashed([*BASE, *[t for t, _ in TEMPLATES.values()], *[p for _, ks in TEMPLATES.values() for p in ks]])
    vocabulary = np.unique(np.concatenate(everything))
    counts, total = document_counts(docs, text, vocabulary)
    index = Index({int(h): math.log((1 + total) / (1 + int(n))) for h, n in zip(vocabulary, counts, strict=True)}, anchors)
    rest = [c for c in docs.columns if c not in ("n_words", "matches")]
    cols, fields = carried(docs, rest)
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"matches {MATCH}").fields])
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int32()), ("size", pa.int32()), ("score", pa.float64())]))

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(0)):
                w = words(data, offsets, ALNUM, LOWER)
                by_row: list[list[dict]] = [[] for _ in range(hi - lo)]
                for row, label, base, start, size, score in index.places(w):
                    by_row[row].append({"label": label, "base": base, "start": start, "size": size, "score": score})
                n = pa.array(np.diff(w.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], n, pa.array(by_row, kind)], names=schema.names)

    return docs.select(docs[text].alias("_text_"), *cols).mapInArrow(run, schema).toDF(*rest, "n_words", "matches")
