"""Operator 12: how far the sources of a language diverge from each other.

Each document is lowered and blanked by one `bytes.translate`, split by
`bytes.split` and counted by a `Counter`: its values are frequencies, its keys give
one to the number of documents. A task adds up its counters by group (language and
source) and gives rows of what occurs, so all that is shuffled is sparse: once, by
language and term, which brings together what a term needs to be judged (its
documents, its frequency over the language) and its sources.

The divergence of two sources is a sum over all kept terms, most of which occur in
neither. With p0 and q0 for the probability of a term that a source does not have,
f(p, q) = f(p0, q0) + [f(p, q0) - f(p0, q0)] + [f(p0, q) - f(p0, q0)] + c(p, q).
The first part is one product a pair. The brackets depend only on a term's count,
so they go over the histogram of a source's counts. Only the last, for terms that
both have, goes over sources of a term; a task adds it up by pair of sources.

Defined cases: null text, lang and source are ''; a group without terms is listed
(its p is that of absent terms everywhere); a language without kept terms has value 0
for its pairs and no terms; a language of one source has no pairs; ties go by item;
repeated rows are documents of their own; an empty table gives an empty table; other
columns are not read. A document's distinct terms are held at once, its text is
split a megabyte at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.text import each
from millrace.llm.work import Scratch, lean, stored

#: Byte by byte: A-Z to a-z, other letters and bytes of longer characters as they are,
#: everything else blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
SPAN = 1 << 20
_BLANK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_COUNTS = "lang string, source string, term binary, n long, docs long"


def count_terms(raw: bytes) -> Counter:
    """Frequencies of the terms of one text."""
    counts: Counter = Counter()
    at = 0
    while at < len(raw):
        blank = _BLANK.search(raw, at + SPAN)
        end = blank.start() if blank else len(raw)
        counts.update(raw[at:end].translate(TABLE).split())
        at = end
    return counts


def _count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (freq, docs) in groups.items():
            n = len(docs)
            columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(docs), pa.binary()), pa.array([freq[t] for t in docs], pa.int64()), pa.array(list(docs.values()), pa.int64())]
            yield pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), each(batch, "raw")):
            key = lang, source
            if key not in groups:
                # Of a group that has no terms, this is its only row.
                groups[key] = Counter({None: 0}), Counter({None: 0})
            freq, docs = groups[key]
            found = count_terms(raw)
            held -= len(docs)
            docs.update(found.keys())
            for term, n in found.items():
                freq[term] += n
            held += len(docs)
            if held > most:
                yield from rows()
                held = 0
    yield from rows()


def group_counts(docs: DataFrame, least_docs: int = 10, most: int = 300_000) -> DataFrame:
    """Rows lang, source, term, n, lang_n, first: the kept terms of each group, and
    each group once more with a null term.

    `lang_n` is a term's frequency over its language, and `first` marks one of a
    term's rows. A task holds `most` distinct terms of groups and those of one text.
    """
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    parts = read.mapInArrow(lean(lambda batches: _count(batches, most)), _COUNTS)
    cells = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    judged = cells.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("lang_docs"), (F.min("source").over(of_term) == F.col("source")).alias("first"))
    return judged.where((F.col("lang_docs") >= least_docs) | F.col("term").isNull()).drop("lang_docs")


def probability(n: str | Column, total: str, terms: str) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), in whole numbers of any size."""
    n = F.col(n) if isinstance(n, str) else n
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    below = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, below)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """c(p, q) of every two sources of a term, added up by pair; the rows of a term
    follow each other, the lesser source first."""
    pairs, values, held = [], [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        if pairs:
            sums: dict[tuple[int, int], int] = {}
            both, which = np.unique(np.concatenate(pairs), axis=0, return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, which.ravel(), np.concatenate(values))
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(total)], ["g", "h", "value"])
        pairs.clear()
        values.clear()

    rest: pa.Table | None = None

    def block(table: pa.Table, last: bool) -> tuple[pa.Table | None, list]:
        term, lang = table["term"].combine_chunks(), table["lang"].combine_chunks()
        n = len(table)
        fresh = np.ones(n, bool)
        if n > 1:
            fresh[1:] = pc.or_(pc.not_equal(term.slice(1), term.slice(0, n - 1)), pc.not_equal(lang.slice(1), lang.slice(0, n - 1))).to_numpy(zero_copy_only=False)
        end = n if last else int(np.flatnonzero(fresh)[-1])
        run = np.cumsum(fresh[:end])
        g, p, p0 = (table[c].to_numpy()[:end] for c in ("g", "p", "p0"))
        found, at, step = [], np.arange(end), 1
        while True:
            at = at[at + step < end]
            at = at[run[at + step] == run[at]]
            if not len(at):
                break
            to = at + step
            found.append((np.stack([g[at], g[to]], 1), _f(p[at], p[to]) - _f(p[at], p0[to]) - _f(p0[at], p[to]) + _f(p0[at], p0[to])))
            step += 1
        return (table.slice(end) if end < n else None), found

    def take(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest, held
        rest, found = block(table, last)
        for both, value in found:
            pairs.append(both)
            values.append(value)
            held += len(value)
            if held > most:
                yield from rows()
                held = 0

    for batch in batches:
        for at in range(0, batch.num_rows, 65_536):
            table = pa.Table.from_batches([batch.slice(at, 65_536)])
            yield from take(table if rest is None else pa.concat_tables([rest, table]), False)
    if rest is not None:
        yield from take(rest, True)
    yield from rows()


def audit_sources(docs: DataFrame, least_docs: int = 10, top: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """Rows lang, source, part, item, value, rank: for each source of a language all
    the others by divergence, and the `top` terms that it has more often than its
    language, by their divergence from it."""
    scratch = scratch or Scratch()
    kept = scratch.stored(group_counts(docs, least_docs), "divergence-terms")
    cells = kept.where("term IS NOT NULL")
    langs = cells.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sized = kept.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    groups = sized.join(langs, "lang", "left").withColumns({"v": F.coalesce("v", F.lit(0)), "g": F.monotonically_increasing_id()})
    groups = scratch.stored(groups.withColumn("p0", F.when(F.col("v") > 0, probability(F.lit(0), "total", "v"))), "divergence-groups")
    scored = cells.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "v"))

    over = scored.withColumn("q", probability("lang_n", "lang_total", "v")).where("p > q")
    ranked = over.withColumn("value", divergence(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")))
    terms = ranked.where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    others = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    absent = divergence(F.col("p0"), F.col("q0"))
    whole = groups.join(others, "lang").where("g <> h").select("g", "h", F.coalesce(F.col("v") * absent, F.lit(0)).alias("value"))
    levels = scored.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("k"))
    alone = levels.join(others, "lang").where("g <> h").groupBy("g", "h").agg(F.sum(F.col("k") * (divergence(F.col("p"), F.col("q0")) - absent)).alias("value"))
    ordered = scored.select("lang", "term", "g", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    both = ordered.mapInArrow(lean(_shared), "g long, h long, value long").groupBy("g", "h").agg(F.sum("value").alias("value"))
    turned = [x.select(F.col("h").alias("g"), F.col("g").alias("h"), "value") for x in (alone, both)]
    summed = whole.unionByName(alone).unionByName(both).unionByName(turned[0]).unionByName(turned[1]).groupBy("g", "h").agg(F.sum("value").alias("value"))
    named = summed.join(groups.select("g", "lang", "source"), "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the ten terms that mark each source, from all documents."""
    scratch = Scratch()
    result = stored(audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch=scratch), "divergence")
    scratch.clear()
    return result
