"""Operator 13: packing documents into windows by the sum of squares.

A document's ids that fill whole windows fill them by themselves; the rest goes, as
it comes, to the fill level that makes the sum over levels of (partly filled windows
of that level) squared least: a level array holds how many windows have each level,
and the choice is one pass over it. A level that many windows share costs, one that
completes a window gains, so the windows left open stay of many different levels and
most rests find one that they fill exactly.

Each task packs its own rows in one pass: texts are neither shuffled nor held beyond
the open windows. Where more than `most_open` are open (texts all of one length that
does not divide a window leave every window open), and when the task ends, open
windows are closed exactly: the least filled are cut up to fill the fullest. So a
task ends with at most one window that is padded, by less than a window, and only
documents in open windows are cut further than whole windows require.

Defined cases: a null or empty text is its end token alone; a null doc_id is packed
like others; equal rows are packed each; ties in the sum of squares go to the fuller
level; an empty table gives an empty table; other columns are not read. A retried
task reads the same split and so makes the same windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import each, texts
from millrace.llm.tokens import WordTokens
from millrace.llm.work import lean

WINDOW = 2048
_PIECES = "start long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Open windows by fill level; pieces are [doc, start, ids]."""

    def __init__(self, window: int) -> None:
        self.window = window
        #: How many windows are filled up to each level; none counts as empty or full.
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)

    def n_open(self) -> int:
        return int(self.levels.sum())

    def level_for(self, size: int) -> int:
        """The level that keeps the sum of squares least after `size` more ids."""
        before, after = self.levels[: self.window - size + 1], self.levels[size:]
        change = 2 * (after - before + 1)
        change[-1] -= 1  # A window that becomes full leaves the sum.
        change[before == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.levels[size] + 1
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def put(self, piece: list) -> list | None:
        """Places a piece that is shorter than a window; a window that is full now."""
        size = len(piece[2])
        level = self.level_for(size)
        pieces = self._take(level) if level else []
        pieces.append(piece)
        return self._keep(pieces, level + size)

    def _take(self, level: int) -> list:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _keep(self, pieces: list, level: int) -> list | None:
        if level == self.window:
            return pieces
        self.levels[level] += 1
        self.open[level].append(pieces)
        return None

    def close(self, leave: int) -> Iterator[list]:
        """Full windows, until at most `leave` are open: the pieces of the least filled
        are cut to fill the fullest."""
        while self.n_open() > leave:
            held = np.flatnonzero(self.levels)
            if len(held) == 1 and self.levels[held[0]] == 1:
                return
            least = int(held[0])
            source = self._take(least)
            most = int(np.flatnonzero(self.levels)[-1])
            pieces, level = self._take(most), most
            while source and level < self.window:
                doc, start, ids = source.pop()
                fits = ids[: self.window - level]
                pieces.append([doc, start, fits])
                level, least = level + len(fits), least - len(fits)
                if len(fits) < len(ids):
                    source.append([doc, start + len(fits), ids[len(fits) :]])
            if source:
                self._keep(source, least)
            full = self._keep(pieces, level)
            if full:
                yield full

    def rest(self) -> Iterator[list]:
        for level in np.flatnonzero(self.levels).tolist():
            yield from self.open[level]


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, window: int, most_open: int) -> Iterator[pa.RecordBatch]:
    tokens, packer = WordTokens(vocabulary), Packer(window)
    made, kind = TaskContext.get().partitionId() << 40, None
    columns: list[list] = [[] for _ in range(6)]

    def add(pieces: list) -> None:
        nonlocal made
        at = 0
        for (doc, total), start, ids in pieces:
            for column, value in zip(columns, (doc, start, ids.tobytes(), total, made, at)):
                column.append(value)
            at += len(ids)
        made += 1

    def rows() -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
        for column in columns:
            column.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        whole, at, rest = [], 0, np.empty(0, "<u4")
        for doc, ids, last in tokens.of(zip(batch.column("doc_id").to_pylist(), each(batch, "raw"))):
            rest = np.concatenate([rest, ids]) if len(rest) else ids
            n = len(rest) // window * window
            whole += [(at + i, rest[i : i + window]) for i in range(0, n, window)]
            at, rest = at + n, rest[n:]
            if not last:
                continue
            rest = np.append(rest, np.array([end], "<u4"))
            named = doc, at + len(rest)
            for start, ids in whole:
                add([[named, start, ids]])
            full = [[named, at, rest]] if len(rest) == window else packer.put([named, at, rest])
            if full:
                add(full)
            if packer.n_open() > most_open:
                for pieces in packer.close(most_open // 2):
                    add(pieces)
            if len(columns[0]) >= 4096:
                yield rows()
            whole, at, rest = [], 0, np.empty(0, "<u4")
    for pieces in packer.close(1):
        add(pieces)
    for pieces in packer.rest():
        add(pieces)
    if columns[0]:
        yield rows()


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, window: int = WINDOW, most_open: int = 2048) -> DataFrame:
    """Rows doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset: the pieces of all documents and where they lie.

    A document's ids are followed by `end`. A task holds at most `most_open` open
    windows, and of one text its ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(lean(lambda batches: _pack(batches, vocabulary, end, window, most_open)), f"doc_id {kind}, {_PIECES}")


def op13_ss_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens; ids as their checksum."""
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    length = F.octet_length("ids").cast("long") / 4
    return pieces.select("doc_id", "start", length.cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
