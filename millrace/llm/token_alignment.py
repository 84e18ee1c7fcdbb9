"""Operator 11: aligning the tokens of two tokenizers by merge-path partitioning.

Both tokenizers spell the same bytes, so each gives an ascending list of the offsets
at which its tokens end. Merging the two lists shows where tokens of both end: there
the text is cut into groups. A merge of m and n ends is a path through an m by n grid
that crosses the diagonals i + j = 0, w, 2w, ...; a binary search along each diagonal
finds where, without merging anything. Between two diagonals lies a piece of exactly
w ends, whatever the texts are like, which is merged on its own. A piece gives the
ends that both lists have in it; a group that reaches over a diagonal, and an end whose
two tokens fall on different sides of one, are stitched from the pieces beside it.

Spark deals out the documents. Pairs of tokens that end together are counted per
document, then over the corpus; the counts are sent back to the documents, in blocks
of bounded size, so nothing is shuffled but the distinct pairs of each task.

Defined cases: null and empty texts, and those that a tokenizer does not spell back
byte for byte, have no tokens; strings of special tokens are plain text; a null doc_id
is kept; equal rows count each; ties for a B id's highest count are all best; an empty
table gives an empty table; other columns are not read. Texts are taken a segment at a
time, cut where both tokenizers begin anew; a document's distinct pairs are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from millrace.llm.text import each, texts
from millrace.llm.tokens import BROKEN, TokenPair, byte_spellings, piece_spellings
from millrace.llm.work import Scratch, discard, lean, stored

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends that a piece merges.
WORK = 1 << 14
_DIGEST = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of a and of b lie before each diagonal, `work` ends apart; of equal
    ends that of a comes first. One binary search for all diagonals at once."""
    diagonal = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        at, to = middle[open_], (diagonal - middle - 1)[open_]
        further = a[at] <= b[to]
        low[open_] = np.where(further, at + 1, low[open_])
        high[open_] = np.where(further, high[open_], at)
    return low, diagonal - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both lists of a piece have the same end: positions in a and in b."""
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b, a)
    same = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return same, at[same]


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b lie before the end of each group.

    Pieces are independent of each other; what lies across a diagonal is stitched.
    """
    if len(a) + len(b) <= work:
        i, j = merge_piece(a, b)
        return i + 1, j + 1
    i, j = crossings(a, b, work)
    parts = []
    for k in range(len(i) - 1):
        x, y = merge_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        parts.append((i[k] + x + 1, j[k] + y + 1))
        if 0 < i[k + 1] and j[k + 1] < len(b) and a[i[k + 1] - 1] == b[j[k + 1]]:
            parts.append((i[k + 1 : k + 2], j[k + 1 : k + 2] + 1))
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


class Aligner:
    """Groups of whole texts, segment by segment."""

    def __init__(self, a: str, b: str) -> None:
        self.tokens = TokenPair(a, b)
        self.length_a = np.array([len(x) for x in byte_spellings(a)])
        self.length_b = np.array([len(x) for x in piece_spellings(b)])
        self.n_b = len(self.length_b)

    def of(self, rows) -> Iterator[tuple]:
        """(key, a, b, i, j, last): ids, and how many of each lie before the ends of the
        groups; a and b are None where the tokens do not spell the text."""
        for key, a, b, last in self.tokens.of(rows):
            if len(a) and (a.max() == BROKEN or b.max() == BROKEN):
                yield key, None, None, None, None, last
            else:
                yield (key, a, b, *common_ends(self.length_a[a].cumsum(), self.length_b[b].cumsum()), last)


@cache
def _written(n_a: int, n_b: int) -> list[bytes]:
    """At 2 id an id inside a group's list, at 2 id + 1 the last one of a list; B's
    ids follow A's."""
    return [f"{i}{x}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for x in (",", last)]


def written_groups(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> bytes:
    """`a1,a2|b1;a3|b2,b3;`: ids in order, a group's A ids before its B ids."""
    before_i, before_j = np.append(0, i[:-1]), np.append(0, j[:-1])
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(before_j, i - before_i)] = 2 * a.astype(np.int64)
    out[np.arange(len(b)) + np.repeat(i, j - before_j)] = 2 * (n_a + b.astype(np.int64))
    out[i + before_j - 1] += 1
    out[i + j - 1] += 1
    return b"".join(map(_written(n_a, n_b).__getitem__, out.tolist()))


def _digests(batches: Iterator[pa.RecordBatch], a_name: str, b_name: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(a_name, b_name)
    sizes = len(aligner.length_a), aligner.n_b
    for batch in batches:
        kind, rows = batch.schema.field("doc_id").type, []
        n_a = n_b = groups = 0
        digest, held, pairs, broken = hashlib.sha256(), b"", [], False
        for doc, a, b, i, j, last in aligner.of(zip(batch.column("doc_id").to_pylist(), each(batch, "raw"))):
            broken = broken or a is None
            if not broken and len(a):
                n_a, n_b, groups = n_a + len(a), n_b + len(b), groups + len(i)
                digest.update(held)
                held = written_groups(a, b, i, j, *sizes)
                pairs.append(a[i - 1].astype(np.uint64) * np.uint64(aligner.n_b) + b[j - 1])
            if not last:
                continue
            if broken or not n_a:
                rows.append((doc, 0, 0, 0, "", b"", b""))
            else:
                digest.update(held[:-1])
                codes, times = np.unique(np.concatenate(pairs), return_counts=True)
                rows.append((doc, n_a, n_b, groups, digest.hexdigest(), pack_sorted(codes), pack(times.astype(np.uint32))))
            n_a = n_b = groups = 0
            digest, held, pairs, broken = hashlib.sha256(), b"", [], False
        fields = [("doc_id", kind), *_DIGEST]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def align_documents(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """One row a document: counts of tokens and groups, the digest of its groups, and
    its distinct linked pairs (a id * size of b + b id, ascending) with how often each
    occurs, both packed (packing.py)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(lean(lambda batches: _digests(batches, a, b)), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary")


def token_groups(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Rows doc_id, segment, a_ids, b_ids, a_ends, b_ends: the tokens themselves, and how
    many of a segment's tokens lie before the end of each of its groups. A segment that
    is not spelt back has none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in batches:
            segment = 0
            for doc, *lists, last in aligner.of(zip(batch.column("doc_id").to_pylist(), each(batch, "raw"))):
                arrays = [pa.array([[] if x is None else x.astype(np.int32)], pa.list_(pa.int32())) for x in lists]
                yield pa.record_batch([pa.array([doc], batch.schema.field("doc_id").type), pa.array([segment], pa.int32()), *arrays], ["doc_id", "segment", "a_ids", "b_ids", "a_ends", "b_ends"])
                segment = 0 if last else segment + 1

    return texts(docs, "doc_id").mapInArrow(lean(run), f"doc_id {kind}, segment int, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _pair_counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A task's counts of pairs, added up whenever `most` are held."""
    codes, times, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0

    def add_up() -> None:
        nonlocal codes, times, held
        distinct, which = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, np.concatenate(times))
        codes, times, held = [distinct], [total], 0

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array(codes[0].astype(np.int64)), pa.array(times[0])], ["pair", "n"])

    for batch in batches:
        for x, y in zip(each(batch, "pairs"), each(batch, "times")):
            if x:
                codes.append(unpack_sorted(x))
                times.append(unpack(y, np.uint32).astype(np.int64))
                held += len(codes[-1])
            if held > most:
                add_up()
                if len(codes[0]) > most:
                    yield rows()
                    codes, times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    add_up()
    if len(codes[0]):
        yield rows()


def count_pairs(aligned: DataFrame, size_b: int) -> DataFrame:
    """Rows pair, n, best: how many links of the corpus hold a pair, and whether no other
    pair of its B id is held by more."""
    summed = aligned.select("pairs", "times").mapInArrow(lean(_pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % size_b)
    return summed.withColumn("best", F.col("n") == F.max("n").over(of_b))


def score_links(aligned: DataFrame, counts: DataFrame, at_once: int = 4_000_000) -> DataFrame:
    """Adds n_best and count_sum to the rows of `aligned`, and drops their pairs.

    At most `at_once` pairs (17 bytes each) are sent to the documents at a time; more go
    in as many rounds as they need, each of which adds its pairs' share to what the
    rounds before it found. Both tables are stored ones.
    """
    spark, done = aligned.sparkSession, None
    rounds = -(-counts.count() // at_once) or 1
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(rounds):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == k).toArrow()
        pair = part["pair"].to_numpy().astype(np.uint64)
        order = np.argsort(pair)
        sent = spark.sparkContext.broadcast((pair[order], part["n"].to_numpy()[order], part["best"].to_numpy()[order]))
        keep = rows.columns if k + 1 < rounds else [c for c in rows.columns if c not in ("pairs", "times")]

        def add(batches: Iterator[pa.RecordBatch], sent=sent, keep=keep) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                n_best, count_sum = batch.column("n_best").to_pylist(), batch.column("count_sum").to_pylist()
                for r, (x, y) in enumerate(zip(each(batch, "pairs"), each(batch, "times"))):
                    if not x or not len(known):
                        continue
                    codes, times = unpack_sorted(x), unpack(y, np.uint32).astype(np.int64)
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    times[known[at] != codes] = 0
                    n_best[r] += int(times[best[at]].sum())
                    count_sum[r] += int((times * n[at]).sum())
                found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
                yield pa.record_batch([found[c] if c in found else batch.column(c) for c in keep], keep)

        fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        rows = stored(rows.mapInArrow(lean(add), fields), "alignment-scored")
        sent.destroy()
        if done is not None:
            discard(done)
        done = rows
    return rows


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: groups of tokens, links, and how common the links' pairs are."""
    scratch = Scratch()
    aligned = scratch.stored(align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "alignment")
    counts = scratch.stored(count_pairs(aligned, len(piece_spellings(B))), "alignment-pairs")
    scored = score_links(aligned, counts)
    scratch.clear()
    return scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
