"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. What is left of a document after its whole windows goes into
the open window that it fits most tightly; when it fits none and no more may be opened, the fullest is
topped up with the head of the document and emitted, and the rest opens a new window. Windows still open at the end
are merged in a tree over partitions: each group joins those of FAN partitions, emits full windows and
passes on fewer tokens than one window.
"""

from __future__ import annotations

import base64
import json
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import Scratch, by_run, runs, sliced

WINDOW, OPEN, FAN = 1024, 8, 16

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("place", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long, place long"


def encoder(ranks: str, file: str) -> tiktoken.Encoding:
    """The byte-level BPE of a file of ranks with the added tokens of the vocabulary's tokenizers file, loaded once in each Python worker.

    It gives the ids of that file's own tokenizer: a text that names an added token holds that token's id.
    """
    held = sys.modules.setdefault("_isobar_held", types.ModuleType("_isobar_held"))
    if ranks not in held.__dict__:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(file, encoding="utf-8") as whole:
            added = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
        held.__dict__[ranks] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
    return held.__dict__[ranks]


class Packer:
    """Windows of `size` ids; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, size: int = WINDOW, most: int = OPEN):
        self.size, self.most, self.next = size, most, first_id
        self.open: list[list] = []
        self.fill: list[int] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray, total: int, start: int = 0) -> None:
        at = 0
        while len(ids) - at >= self.size:
            self._emit([(doc_id, start + at, ids[at : at + self.size], total)])
            at += self.size
        rest = len(ids) - at
        if not rest:
            return
        fits = [i for i, f in enumerate(self.fill) if f + rest <= self.size]
        if fits:
            best = max(fits, key=self.fill.__getitem__)
            self._put(best, (doc_id, start + at, ids[at:], total))
        elif len(self.open) < self.most:
            self._new((doc_id, start + at, ids[at:], total))
        else:
            full = max(range(len(self.fill)), key=self.fill.__getitem__)
            gap = self.size - self.fill[full]
            self._put(full, (doc_id, start + at, ids[at : at + gap], total))
            self._new((doc_id, start + at + gap, ids[at + gap :], total))

    def _new(self, piece: tuple) -> None:
        self.open.append([])
        self.fill.append(0)
        self._put(len(self.open) - 1, piece)

    def _put(self, i: int, piece: tuple) -> None:
        self.open[i].append(piece)
        self.fill[i] += len(piece[2])
        if self.fill[i] == self.size:
            self._emit(self.open.pop(i))
            self.fill.pop(i)

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, None, None, None))
            at += len(ids)
        self.next += 1

    def left(self, part: int) -> None:
        """The open windows' pieces with their ids, to be merged elsewhere."""
        place = 0
        for pieces in self.open:
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, None, None, ids.tobytes(), part, place))
                place += 1
        self.open, self.fill = [], []

    def close(self) -> None:
        for pieces in self.open:
            self._emit(pieces)
        self.open, self.fill = [], []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(PIECES), PIECES, strict=True)], schema=PIECES)


def _pack(ranks: str, file: str, end: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, bpe = Packer(part << 36), encoder(ranks, file)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*bpe.encode(text or "", allowed_special="all"), end], dtype="<u4")
                packer.add(doc_id, ids, len(ids))
            yield packer.take()
        packer.left(part)
        yield packer.take()

    return f


def _merge(level: int, last: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in runs(batches, "key"):
            packer = Packer((1 << 62) | (level << 56) | (key << 20), most=1)
            cols = {n: t.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens", "part", "place")}
            for i in sorted(range(t.num_rows), key=lambda i: (cols["part"][i], cols["place"][i])):
                packer.add(cols["doc_id"][i], np.frombuffer(cols["ids"][i], dtype="<u4"), cols["doc_tokens"][i], cols["start"][i])
            packer.close() if last else packer.left(key)
            yield packer.take()

    return f


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, file: str | None = None, end: int = 0) -> DataFrame:
    """Pieces of all documents' ids in sequences of at most WINDOW ids.

    A document is the ids of its whole text, then `end`. Returns for each piece: doc_id, start (the document's ids
    before it), length, ids_crc32 (of its unsigned little-endian 32-bit ids), doc_tokens, sequence_id and
    offset. Every sequence but the last is full. Null and empty texts are the one id `end`; repeated ids are
    documents of their own, and so are null ids; other columns are not read; an empty table gives no pieces. `ranks` and
    `file` are the paths of one vocabulary's tiktoken and tokenizers files on the executors (by default those of
    the installed public tokenizers). A text that names an added token of the file holds that token's id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    paths = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), file or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = scratch.keep(source.mapInArrow(_pack(*paths, end), DDL), "packed")
    done = [out.where("ids is null")]
    left, level = out.where("ids is not null"), 0
    most = left.agg(F.max("part")).first()[0]
    while most is not None:
        level += 1
        last = most < FAN
        keyed = left.withColumn("key", F.floor(F.col("part") / FAN))
        merged = scratch.keep(by_run(keyed, "key", None, _merge(level, last), DDL), "merged")
        done.append(merged.where("ids is null"))
        left, most = merged.where("ids is not null"), None if last else most // FAN
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
