"""Operator 7: benchmark decontamination by BM25 with block-max WAND.

The test items form an inverted index: postings of item and impact by term, in
blocks that keep their largest impact. Impacts are BM25 scores divided by the
score of the item against itself, so one threshold means the same for short and
long items. Every passage of every training text is a query. The block maxima of
its terms, summed over all passages of a text at once, leave the passages that
could reach the threshold in some block of items; those are evaluated item by
item, skipping by term and block bounds. What is retrieved is verified: the item's question and its answer must each be
found in the passage as runs of five words.

Items are indexed by length, in classes of powers of two: a passage is up to four
times as long as the items that it is a query for, whatever other items there are.
The index is built in shards of a bounded number of items, a few of which are sent
to every task at a time, and one pass over the texts searches them all; what is
found does not depend on the sharding.

Defined cases: a null text has no passages; a null or empty item matches
nothing; items of fewer than five words are looked for as one run; repeated
items, and items without item_id, are items of their own; a text without doc_id
gives rows without one; repeated rows give repeated results; empty tables give an
empty table; extra columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import each, texts
from millrace.llm.work import Scratch, lean

_EDGE = b".,;:!?\"'()[]{}<>*#$%&|"
#: Where an answer begins inside an item that has one.
_ANSWER = re.compile(rb"(?:\?\s|\n\s*answer\s*:|\banswer\s*:)", re.IGNORECASE)


def terms(raw: bytes) -> list[bytes]:
    """Lower-cased words without the punctuation at their ends."""
    return [w.strip(_EDGE) or w for w in raw.lower().split()]


def question_and_answer(raw: bytes) -> list[list[bytes]]:
    """The parts of an item that must both be found: question and answer, if any."""
    m = _ANSWER.search(raw)
    parts = [raw[: m.end()], raw[m.end() :]] if m else [raw]
    return [t for t in map(terms, parts) if t]


@dataclass
class Index:
    """An inverted index of items, with impacts normalised to each item's self score.

    No item is longer than `step` words; passages are twice that long.
    """

    step: int
    block: int = 16
    items: list[int | None] = field(default_factory=list)
    parts: list[list[list[bytes]]] = field(default_factory=list)
    postings: dict[bytes, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    most: dict[bytes, float] = field(default_factory=dict)
    block_most: dict[bytes, np.ndarray] = field(default_factory=dict)
    #: Row of each term in `bounds` (row 0: no term), whose columns are blocks of items.
    row: dict[bytes, int] = field(default_factory=dict)
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))


def length_class(words: int) -> int:
    """The least power of two that is no less, from 8 on."""
    return max(8, 1 << (words - 1).bit_length())


def build_index(rows: list[tuple[int | None, str]], document_frequency: dict[bytes, int], n_items: int, mean_length: float, step: int, k1: float = 1.2, b: float = 0.75, block: int = 16) -> Index:
    """Index `rows` (item_id, text) with the statistics of the whole benchmark."""
    index = Index(step, block)
    found: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
    for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        words = terms(raw)
        if not words:
            continue
        at = len(index.items)
        tf = Counter(words)
        norm = k1 * (1 - b + b * len(words) / mean_length)
        impact = {t: math.log(1 + (n_items - document_frequency[t] + 0.5) / (document_frequency[t] + 0.5)) * f * (k1 + 1) / (f + norm) for t, f in tf.items()}
        own = sum(impact.values())
        for t, v in impact.items():
            found[t].append((at, v / own))
        index.items.append(item)
        index.parts.append(question_and_answer(raw))
    wide = max(4, -(-len(index.items) // 64))
    index.bounds = np.zeros((len(found) + 1, -(-len(index.items) // wide) or 1), np.float32)
    for t, rows_of in found.items():
        index.row[t] = len(index.row) + 1
        for item, value in rows_of:
            index.bounds[index.row[t], item // wide] = max(index.bounds[index.row[t], item // wide], value * 1.000001)
        ids, values = np.array([r[0] for r in rows_of]), np.array([r[1] for r in rows_of])
        index.postings[t] = (ids, values)
        index.most[t] = float(values.max())
        index.block_most[t] = np.maximum.reduceat(values, np.arange(0, len(values), block))
    return index


def wand(index: Index, query: set[bytes], threshold: float) -> list[tuple[int, float]]:
    """Items whose normalised score for the query terms reaches `threshold`.

    Cursors are kept in order of their current item. The pivot is the first item
    at which the terms' bounds can reach the threshold; block bounds are tried
    there before any score is computed, and failing them skips whole blocks.
    """
    cursors = [[0, t] for t in query if t in index.postings]
    out: list[tuple[int, float]] = []
    at = lambda c: int(index.postings[c[1]][0][c[0]])
    slack = threshold - 1e-9

    def seek(c: list, item: int) -> None:
        ids = index.postings[c[1]][0]
        c[0] += int(np.searchsorted(ids[c[0] :], item))

    while cursors:
        cursors.sort(key=at)
        bound, pivot = 0.0, None
        for i, c in enumerate(cursors):
            bound += index.most[c[1]]
            if bound >= slack:
                pivot = i
                break
        if pivot is None:
            break
        item = at(cursors[pivot])
        while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == item:
            pivot += 1
        ahead = cursors[: pivot + 1]
        block_bound, until = 0.0, 1 << 62
        for c in ahead:
            ids = index.postings[c[1]][0]
            p = c[0] + int(np.searchsorted(ids[c[0] :], item))
            if p < len(ids):
                k = p // index.block
                block_bound += float(index.block_most[c[1]][k])
                end = min(len(ids), (k + 1) * index.block) - 1
                until = min(until, int(ids[end]) + 1)
        if block_bound < slack:
            limit = min(until, at(cursors[pivot + 1]) if pivot + 1 < len(cursors) else 1 << 62)
            for c in ahead:
                seek(c, max(item + 1, limit))
        elif at(cursors[0]) == item:
            score = sum(float(index.postings[c[1]][1][c[0]]) for c in ahead)
            if score >= slack:
                out.append((item, score))
            for c in ahead:
                c[0] += 1
        else:
            for c in ahead:
                seek(c, item)
        cursors = [c for c in cursors if c[0] < len(index.postings[c[1]][0])]
    return out


def _run_share(part: list[bytes], passage: set[tuple[bytes, ...]], size: int) -> float:
    k = min(size, len(part))
    runs = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    return len(runs & passage) / len(runs)


def _live_passages(index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages of a text, and the most that its words' bounds add up to
    in any block of items. `rows` has the index's row of each word (0: none); each
    distinct term of a passage adds its bounds once."""
    at = np.flatnonzero(rows)
    if not len(at):
        return at, at
    segment, n_rows = at // index.step, len(index.bounds)
    keys = segment * n_rows + rows[at]
    keys = np.unique(np.concatenate([keys, keys[segment > 0] - n_rows]))
    passage = keys // n_rows
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    return passage[first] * index.step, np.add.reduceat(index.bounds[keys % n_rows], first, axis=0).max(axis=1)


class Searcher:
    """Several indexes, searched together: words are looked up once."""

    def __init__(self, indexes: list[Index]):
        self.indexes = indexes
        self.number: dict[bytes, int] = {}
        for index in indexes:
            for t in index.row:
                self.number.setdefault(t, len(self.number) + 1)
        self.rows = []
        for index in indexes:
            rows = np.zeros(len(self.number) + 1, np.int64)
            for t, row in index.row.items():
                rows[self.number[t]] = row
            self.rows.append(rows)

    def matches(self, raw: bytes, threshold: float, overlap: float, run: int) -> list[tuple[int | None, float, float]]:
        """(item, score, overlap) of each item found in the text: its best."""
        words = terms(raw)
        numbers = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        out: list[tuple[int | None, float, float]] = []
        for index, rows in zip(self.indexes, self.rows, strict=True):
            found: dict[int, tuple[float, float]] = {}
            starts, reach = _live_passages(index, rows[numbers])
            for start in starts[reach >= threshold - 1e-5].tolist():
                passage = words[start : start + 2 * index.step]
                for item, score in wand(index, set(passage), threshold):
                    sizes = {min(run, len(p)) for p in index.parts[item]}
                    runs = {tuple(passage[j : j + k]) for k in sizes for j in range(len(passage) - k + 1)}
                    shared = min(_run_share(p, runs, run) for p in index.parts[item])
                    if shared >= overlap:
                        found[item] = max(found.get(item, (0.0, 0.0)), (shared, score))
            out += [(index.items[i], score, shared) for i, (shared, score) in sorted(found.items())]
        return out


def shards(benchmark: DataFrame, max_items: int = 5000) -> Iterator[Index]:
    """Indexes of at most about `max_items` items of one length class each.

    Document frequencies and lengths are counted over all items.
    """
    scratch = Scratch()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = [terms(t.encode()) for t in each(batch, "text")]
            columns = [batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in per], pa.int64()), pa.array([length_class(len(w)) for w in per], pa.int64()), pa.array([sorted(set(w)) for w in per], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "n", "step", "terms"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    items = scratch.stored(rows.mapInArrow(words, "item_id long, text string, n long, step long, terms array<binary>").where("n > 0"), "benchmark-items")
    total = items.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    classes = items.groupBy("step").count().orderBy("step").collect()
    frequency = scratch.stored(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "benchmark-terms")
    for step, n in classes:
        parts = -(-n // max_items)
        for k in range(parts):
            mine = items.where((F.col("step") == step) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k))
            texts_of = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]
            used = mine.select(F.explode("terms").alias("term")).distinct()
            df = {bytes(r["term"]): r["df"] for r in frequency.join(used, "term").collect()}
            if texts_of:
                yield build_index(texts_of, df, total["items"], total["mean"], step)
    scratch.clear()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, run: int = 5, max_items: int = 5000, max_sent: int = 20_000) -> DataFrame:
    """Pairs (doc_id, item_id, score, overlap) of texts and the items found in them.

    Half of a passage is the next one's, so every item lies whole in some passage.
    An item is retrieved at `threshold` of its self score and kept if `overlap` of
    the runs of `run` words of both its question and its answer are there. At most
    about `max_sent` items are sent to every task at a time; a larger benchmark
    takes more than one pass.
    """
    source = texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, item_id long, score double, overlap double"

    def searched(indexes: list[Index]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in batches:
                rows = [(doc, *m) for doc, raw in zip(each(batch, "doc_id"), each(batch, "raw"), strict=True) for m in searcher.matches(raw, threshold, overlap, run)]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "overlap"])

        return source.mapInArrow(lean(search), schema)

    found, waiting = [], []
    for index in shards(benchmark, max_items):
        if waiting and sum(len(i.items) for i in waiting) + len(index.items) > max_sent:
            found.append(searched(waiting))
            waiting = []
        waiting.append(index)
    if waiting:
        found.append(searched(waiting))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
