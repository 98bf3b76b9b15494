"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has the white-space marker after another character,
no merge can cross from one marked word into the next. A text then falls into
chunks (a run of markers and what follows), each distinct chunk is segmented
once, and ids are joined back by the chunks' positions.

The table belongs to a task and is emptied before a run of rows that would take
it past ``most`` chunks; it always holds all chunks of the run at hand. A
table of all distinct chunks would have to be joined to every word occurrence
of the corpus through a shuffle several times as large as the texts.

Null and empty texts give no ids and the empty text. Rows, repeated or not,
keep their place; other columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import carried
from .words import flat, lists

MARK = "▁"
CHUNK = re.compile(r" ( *[^ ]*)", re.S)


def keys(text: str) -> list[str]:
    """Chunks of a text without their first marker; the model puts one marker before the text."""
    if MARK in text:
        text = text.replace(MARK, " ")  # both are the same marker to the model
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return CHUNK.findall(" " + text)


class ChunkTable:
    """Ids and decoded texts of the distinct chunks seen so far."""

    def __init__(self, model: str, most: int) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp, self.most = SentencePieceProcessor(model_file=model), most
        for i in range(self.sp.vocab_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece of this model crosses a white-space marker; its texts can't be cut into chunks")
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.size = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def add(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self.sp.encode(chunks), strict=True):
            k = len(self.number)
            if not chunk:
                ids = [self.sp.piece_to_id(MARK)]  # a marker with nothing after it
            if k == len(self.size):
                self.size, self.start = np.resize(self.size, 2 * k), np.resize(self.start, 2 * k)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.number[chunk], self.size[k], self.start[k] = k, len(ids), self.used
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.text.append(self.sp.decode(ids))

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.Array]:
        """Ids and decoded text of each text."""
        by_text = [keys(t) for t in texts]
        flat_keys = [k for ks in by_text for k in ks]
        distinct = dict.fromkeys(flat_keys)
        new = [k for k in distinct if k not in self.number]
        if new and len(self.number) + len(new) > self.most:  # one run may hold more than ``most`` by itself
            self.clear()
            new = list(distinct)
        if new:
            self.add(new)
        at = np.fromiter(map(self.number.__getitem__, flat_keys), np.int64, len(flat_keys))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        # position of each id: its chunk's start in the table, plus its place in the chunk
        take = np.arange(total) + np.repeat(self.start[at] - (ends - sizes), sizes)
        bounds = np.cumsum([0, *map(len, by_text)])
        upto = np.concatenate([[0], ends])
        out, k = [], 0
        for ks in by_text:
            out.append(" ".join([self.text[i] for i in at[k : k + len(ks)].tolist()]))
            k += len(ks)
        return lists(self.ids[take], np.diff(upto[bounds]), pa.int32()), pa.array(out, pa.string())


def batches(arr: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes."""
    lengths = np.cumsum(pc.binary_length(arr).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def round_trip(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", most: int = 200_000) -> DataFrame:
    """``df`` with the ids of each text and the text decoded from them; existing columns of these names are replaced."""
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    cols, fields = carried(df, rest)
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(stream):
        chunks = ChunkTable(model, most)
        for batch in stream:
            arr = flat(batch.column(0))
            for lo, hi in batches(arr):
                part = batch.slice(lo, hi - lo)
                got, back = chunks.encode(arr[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], got, back], names=schema.names)

    return df.select(df[text].alias("_text_"), *cols).mapInArrow(run, schema).toDF(*rest, ids, decoded)


def decode(df: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of an id list; null and empty lists give the empty text."""
    rest = [c for c in df.columns if c != decoded]
    cols, fields = carried(df, rest)
    schema = T.StructType([*fields, T.StructField(decoded, T.StringType())])
    place = rest.index(ids)

    def run(stream):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        for batch in stream:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                back = [sp.decode(x) if x else "" for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], names=schema.names)

    return df.select(*cols).mapInArrow(run, schema).toDF(*rest, decoded)
