"""Operator 5: n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles. All documents order the
shingles alike: by how many sets are seen to hold them, rarest first. If two
sets are similar enough, little of the rarer end of either can be missing in the
other, so their prefixes must meet: in one shingle if it is of the rare class,
or in a combination of two if of the frequent class. There the prefix is extended
until it holds more shared shingles than both sets together can miss; then two of
those follow one another in both sets, and only neighbours need to be combined: a
number of signatures in proportion to the set, whatever its size. These signatures
are joined, and what meets is verified on the whole sets.

Equal sets become one node before the join. Inside one signature no all-pairs
are made: first each set meets the signature's best-placed set only; once those
links have formed components, sets of one signature that are still apart are
compared in cells, strays of the largest component with all, if size, position and
bitmap still allow a link. So
a thousand near copies cost a thousand comparisons, and no link between
different components is missed.

Counts of shingles are kept in a fixed number of counters over all documents
(colliding shingles share one), so the order and the classes have a bounded size
whatever the corpus; they decide what is fast, never what is found.

Defined cases: a null or empty text has an empty set, links with nothing and is
its own component; a row without doc_id links with nothing and has a null
component; a text of fewer words than a shingle is one shingle; repeated rows and
equal texts share a component; an empty table gives an empty table; extra columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.text import WordHashes, each, mix, texts, windows
from millrace.llm import work
from millrace.llm.work import Scratch, lean, row_key, stored, without

COUNTER_BITS = 22
SLICES = 64
#: Signatures that no more sets than this can hold, by the counters, are compared
#: in one sorted pass.
BOUNDED = 10_000
_PAIR = np.uint64(0x9FB21C651E98DF25)


def shingle_set(raw: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a lower-cased text."""
    return np.unique(windows(hashes.of(raw.lower().split()), size))


#: Longs in a set's bitmap: each shingle flips one bit, so two bitmaps differ in
#: no more bits than the sets in shingles.
BITMAP = 8


def _bitmap(s: np.ndarray) -> np.ndarray:
    flipped = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(flipped.astype(np.uint8)).view(np.int64)


def _fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _describe(size: int):
    """Rows of two sorts: a document's set size and fingerprint; counter slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), np.uint64((1 << COUNTER_BITS) - 1)
        counters = np.zeros(1 << COUNTER_BITS, np.uint32)
        names = ["doc_id", "n", "fp", "bits", "slice", "counts"]
        waiting, held = [], 0

        def add() -> None:
            if waiting:
                counters[:] += np.bincount(np.concatenate(waiting), minlength=len(counters)).astype(np.uint32)
                waiting.clear()

        for batch in batches:
            sizes, prints, bits = [], [], []
            for raw in each(batch, "raw"):
                s = shingle_set(raw, size, hashes)
                sizes.append(len(s))
                prints.append(_fingerprint(s))
                bits.append(_bitmap(s))
                waiting.append((s & mask).astype(np.int64))
                held += len(s)
                if held > 1_000_000:
                    add()
                    held = 0
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        add()
        if counters.any():
            packer = zstandard.ZstdCompressor(level=1)
            parts = [packer.compress(p.tobytes()) for p in counters.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of each slice, one row at a time."""
    sums: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(unpack.decompress(blob), np.uint32).astype(np.int64)
            sums[i] = sums[i] + part if i in sums else part
    packer = zstandard.ZstdCompressor(level=1)
    rows = [(i, packer.compress(np.minimum(s, 2**31 - 1).astype(np.int32).tobytes())) for i, s in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "counts"])


def _counters(described: DataFrame) -> np.ndarray:
    """All counters: 16 MB, whatever the corpus, summed by slice in Spark."""
    rows = described.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(lean(_sum_slices), "slice int, counts binary").collect()
    out = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), np.int32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.int32)
    return out.ravel()


def _threshold(counters: np.ndarray) -> int:
    """Counts above this are of the frequent class: well over the mean counter's."""
    mean = counters.sum(dtype=np.int64) / len(counters)
    return int(mean + 6 * mean**0.5 + 32)


def prefix_signatures(s: np.ndarray, counts: np.ndarray, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the overlap each still leaves possible, and a bound on
    the sets that hold each.

    The overlap supposes that what is before the signature is lost to both sets: for
    a rare shingle all shingles before it, for a combination the rare ones.

    Why it is enough to combine neighbours: let two sets that may link lack a and b
    of their shingles, no rare one being shared. Of the first a + b + 2 shingles that
    they share, some two have nothing between them in either set, and they lie within
    the first a + (a + b + 2) of the one's frequent shingles and the first
    b + (a + b + 2) of the other's.
    """
    n = len(s)
    least, most = -(-percent * n // 100), n * 100 // percent
    if least == n == most:  # Only equal sets are similar enough.
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((s, counts))
    ranked, held = s[order], counts[order]
    misses = n - least
    rare = int(np.searchsorted(held, frequent, side="right"))
    singles = ranked[: min(rare, misses + 1)]
    sigs, room, bound = [mix(singles ^ _PAIR)], [n - np.arange(len(singles))], [held[: len(singles)]]
    if rare <= misses:
        mine, theirs = misses - rare, most - -(-percent * most // 100)
        tail = slice(rare, rare + 2 * mine + theirs + 2)
        tokens, seen = ranked[tail], held[tail]
        sigs.append(mix(tokens[:-1] * _PAIR + mix(tokens[1:])))
        room.append(np.full(len(tokens) - 1, n - rare))
        bound.append(seen[:-1])  # The rarer of the two.
    return np.concatenate(sigs), np.concatenate(room), np.concatenate(bound)


def _signatures(size: int, percent: int, counters, frequent: int):
    """Signatures of the distinct sets of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), np.uint64((1 << COUNTER_BITS) - 1)
        table, seen = counters.value, set()

        def out(parts: list[tuple]) -> pa.RecordBatch:
            sig, room, bound = (np.concatenate([p[i] for p in parts]) for i in range(3))
            reps = [len(p[0]) for p in parts]
            columns = [sig.view(np.int64), np.repeat(np.array([p[3] for p in parts], np.int64), reps), np.repeat(np.array([p[4] for p in parts], np.int32), reps), room.astype(np.int32), bound <= max(frequent, BOUNDED)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "fp", "n", "room", "bounded"])

        for batch in batches:
            parts, held = [], 0
            for raw in each(batch, "raw"):
                s = shingle_set(raw, size, hashes)
                if not len(s) or (print_ := _fingerprint(s)) in seen:
                    continue
                seen.add(print_)
                sig, room, bound = prefix_signatures(s, table[s & mask], frequent, percent)
                if len(sig):
                    parts.append((sig, room, bound, print_, len(s)))
                    held += len(sig)
                if held > 200_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)

    return run


def _shared_only(percent: int):
    """Of rows sorted by signature, those that may link with another of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            sig = held.column("sig").to_numpy()
            last = int(np.searchsorted(sig, sig[-1], side="left")) if len(sig) else 0
            rest = held.slice(last)
            yield from held.take(_with_partner(held.slice(0, last), percent)).to_batches()
        if rest is not None:
            yield from rest.take(_with_partner(rest, percent)).to_batches()

    return run


def _with_partner(rows: pa.Table, percent: int, window: int = 32) -> np.ndarray:
    """Rows that size and position let link with another set of the same signature.

    In order of size, a row is tried with the next `window` rows of its signature;
    in larger groups one near enough in size is taken for a partner. Copies of one
    set, from different tasks, count once.
    """
    sig, fp, n, room = (rows.column(c).to_numpy().astype(np.int64) for c in ("sig", "fp", "n", "room"))
    if not len(sig):
        return np.zeros(0, np.int64)
    order = np.lexsort((fp, n, sig))
    same = np.zeros(len(sig), bool)
    same[1:] = (np.diff(sig[order]) == 0) & (np.diff(fp[order]) == 0)
    order = order[~same]
    sig, n, room = sig[order], n[order], room[order]
    keep = np.zeros(len(sig), bool)
    left = np.arange(len(sig))
    for step in range(1, window + 1):
        left = left[left + step < len(sig)]
        left = left[sig[left] == sig[left + step]]
        if not len(left):
            return order[keep]
        smaller, larger = n[left], n[left + step]
        may = (100 * smaller >= percent * larger) & ((100 + percent) * np.minimum(room[left], room[left + step]) >= percent * (smaller + larger))
        keep[left[may]] = keep[left[may] + step] = True
    large = np.isin(sig, sig[left])
    near = np.zeros(len(sig) + 1, bool)  # With the row before.
    near[1:-1] = (sig[1:] == sig[:-1]) & (100 * n[:-1] >= percent * n[1:])
    least = -(-percent * n // 100)
    return order[keep | large & (near[:-1] | near[1:]) & ((100 + percent) * room >= percent * (n + least))]


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            blobs = [shingle_set(raw, size, hashes).tobytes() for raw in each(batch, "raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(each(batch, "x"), each(batch, "y"), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    return run


def _may_link(x: str, y: str, percent: int) -> Column:
    """By size, and by the overlap that position leaves possible."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return sizes & ((100 + percent) * F.least(F.col(f"{x}.room"), F.col(f"{y}.room")) >= percent * (nx + ny))


def _alike(x: str, y: str, sizes: Column, percent: int) -> Column:
    """By bitmaps: each bit that differs stands for a shingle that one set has alone."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, k: t + k)
    return (100 + percent) * differ <= (100 - percent) * sizes


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_similar(docs: DataFrame, size: int = 3, percent: int = 90, block: int = 64, wide: int = 4096) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Sets link when 100 * intersection >= percent * union; component_id is the
    least doc_id that can be reached by links.
    """
    if percent < 75:
        raise ValueError("neighbouring shingles are certain to be shared from 75 per cent on only")
    spark, scratch = docs.sparkSession, Scratch()
    stored = scratch.stored
    source = texts(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    described = stored(source.mapInArrow(lean(_describe(size)), "doc_id long, n long, fp long, bits array<long>, slice int, counts binary"), "jaccard-documents")
    counters = _counters(described)
    frequent = _threshold(counters)
    shared = spark.sparkContext.broadcast(counters)
    del counters
    members = described.where("slice IS NULL")
    nodes = stored(members.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("bits").alias("bits")), "jaccard-nodes", rows=members.count())

    # Most signatures are in a bounded number of sets: one sorted pass leaves those
    # that several share. Others may be in a third of all sets and are only ever
    # aggregated and joined.
    signatures = stored(source.select("raw").mapInArrow(lean(_signatures(size, percent, shared, frequent)), "sig long, fp long, n int, room int, bounded boolean"), "jaccard-signatures")
    shared.destroy()
    bounded = signatures.where("bounded").drop("bounded").repartition("sig").sortWithinPartitions("sig").mapInArrow(lean(_shared_only(percent)), "sig long, fp long, n int, room int")
    met = stored(bounded.unionByName(signatures.where("NOT bounded").drop("bounded")), "jaccard-met")
    rows = met.count()
    # The best-placed set of a signature has lost the least before it.
    best = met.groupBy("sig").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("rows"), F.min(F.struct((F.col("n") - F.col("room")).alias("lost"), "n", "fp", "room")).alias("p")).where("low <> high").select("sig", "rows", F.struct("p.fp", "p.n", "p.room").alias("p"))
    postings = met.distinct().join(best, "sig")
    # What meets neither by size nor by position with the best may still meet others.
    postings = stored(postings.select("sig", "rows", F.struct("fp", "n", "room").alias("m"), "p"), "jaccard-postings", rows=rows)
    apart = postings.where(F.col("m.fp") != F.col("p.fp"))
    stars = stored(_pairs(apart.where(_may_link("m", "p", percent)).select(F.col("m.fp").alias("a"), F.col("p.fp").alias("b"))), "jaccard-stars", rows=rows)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The verified pairs, as links between nodes.

        Pairs whose bitmaps differ too much cannot be similar; the others' sets
        are fetched and compared whole.
        """
        end = lambda x, y: nodes.select(F.col("fp").alias(x), F.col("node").alias(y), F.col("n").alias(f"n{y}"), F.col("bits").alias(f"bits{y}"))
        near = pairs.join(end("a", "u"), "a").join(end("b", "v"), "b").where(_alike("bitsu", "bitsv", F.col("nu") + F.col("nv"), percent))
        near = stored(near.select("u", "v"), f"{name}-near", rows=pairs.count())
        n_pairs = near.count()
        if not n_pairs:
            return near
        wanted = stored(near.select(F.col("u").alias("doc_id")).unionByName(near.select(F.col("v").alias("doc_id"))).distinct(), f"{name}-wanted", rows=2 * n_pairs)
        # Up to a million ids (16 MB) go to the texts; beyond, both sides are shuffled.
        ids = F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted
        sets = stored(source.join(ids, "doc_id").mapInArrow(lean(_sets(size)), "doc_id long, shingles binary"), f"{name}-sets")
        x = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("x"))
        y = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("y"))
        true = near.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(lean(_verify(percent)), "u long, v long")
        # Verified where the shuffle left them, by bytes; only links are dealt again.
        return stored(true.repartition(-(-n_pairs // 200_000)), name)

    first = links(stars, "jaccard-links1")
    labels = components(first, "jaccard-components1")
    roots = nodes.join(labels, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    labelled = postings.join(roots.withColumnRenamed("fp", "_fp"), F.col("m.fp") == F.col("_fp")).drop("_fp")
    # A set goes on if its place leaves it a link with the least set it may meet.
    smallest = labelled.groupBy("sig").agg(F.min("m.n").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("m.n") * percent / 100))
    labelled = labelled.join(smallest, "sig").where((100 + percent) * F.col("m.room") >= percent * (F.col("m.n") + partner)).drop("least")
    # Of a signature's sets most are in one component by now. Only the others, its strays,
    # have something to find: each is compared with all sets of the signature, in cells
    # of `block` strays and `wide` sets.
    by_root = labelled.groupBy("sig", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("sig").agg(F.sum("n").alias("sets"), F.max(F.struct("n", "root")).alias("most")).where("sets > most.n").select("sig", F.col("most.root").alias("major"), F.col("sets"), (F.col("sets") - F.col("most.n")).alias("strays"))
    split = split.withColumns({"blocks": F.ceil(F.col("strays") / block).cast("int"), "widths": F.ceil(F.col("sets") / wide).cast("int")})
    n_cells = split.agg(F.sum(F.col("blocks") * F.col("sets") + F.col("widths") * F.col("strays"))).first()[0] or 0
    bits = nodes.select(F.col("fp").alias("_fp"), "bits")
    placed = labelled.join(split.drop("sets", "strays"), "sig").join(bits, F.col("m.fp") == F.col("_fp")).drop("_fp")
    part = lambda n: F.pmod(F.xxhash64("m.fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    strays = placed.where("root <> major").withColumn("i", part("blocks")).withColumn("j", every("widths")).select("sig", "i", "j", "root", "m", "p", "bits", "major")
    whole = placed.withColumn("j", part("widths")).withColumn("i", every("blocks")).select("sig", "i", "j", "root", "m", "bits")
    final = labels
    if n_cells:
        x, y = stored(strays, "jaccard-strays", rows=n_cells).alias("x"), stored(whole, "jaccard-cells", rows=n_cells).alias("y")
        same_cell = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
        once = (F.col("y.root") == F.col("x.major")) | (F.col("x.m.fp") < F.col("y.m.fp"))  # Two strays meet twice.
        new = once & (F.col("x.root") != F.col("y.root")) & (F.col("x.m.fp") != F.col("x.p.fp")) & (F.col("y.m.fp") != F.col("x.p.fp"))
        alike = _alike("x.bits", "y.bits", F.col("x.m.n") + F.col("y.m.n"), percent)
        rest = x.join(y, same_cell & new & _may_link("x.m", "y.m", percent) & alike).select(F.col("x.m.fp").alias("a"), F.col("y.m.fp").alias("b"))
        second = links(stored(_pairs(rest), "jaccard-rest", rows=n_cells), "jaccard-links2")
        if second.take(1):
            final = components(first.unionByName(second), "jaccard-components2")
    by_set = nodes.join(final, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = members.join(by_set.withColumnRenamed("fp", "_fp"), (F.col("fp") == F.col("_fp")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    done = work.stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-classes")
    scratch.clear()
    return done


def keep_one_of_each(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """`docs` without those that are linked to a document of smaller doc_id.

    Of equal rows that repeat a doc_id, one stays. Other rows that repeat one are
    documents of their own; of those that are linked, one stays.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.take(1):
        return without(docs, link_similar(docs, size, percent).where("component_id <> doc_id"), "jaccard-gone")
    # Numbers in the order of doc_id, one for each different row.
    known, keyed = docs.where("doc_id IS NOT NULL"), docs.withColumn("_row", row_key(docs))
    rows = known.select("doc_id", row_key(docs).alias("_key")).distinct().orderBy("doc_id", "_key")
    numbers = stored(rows.select("_key", F.monotonically_increasing_id().alias("_number")), "jaccard-numbers")
    numbered = stored(keyed.join(numbers, (F.col("_row") == F.col("_key")) & F.col("doc_id").isNotNull(), "left").drop("_row", "_key"), "jaccard-numbered")
    linked = link_similar(numbered.select(F.col("_number").alias("doc_id"), "text"), size, percent)
    gone = linked.where("component_id <> doc_id").select(F.col("doc_id").alias("_number"))
    kept = without(numbered, gone, "jaccard-gone", key="_number")
    once = kept.where("_number IS NOT NULL").join(repeated, "doc_id", "left_semi").distinct()
    rest = kept.where("_number IS NULL").unionByName(kept.where("_number IS NOT NULL").join(repeated, "doc_id", "left_anti"))
    return rest.unionByName(once).select(*docs.columns)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_similar(docs)
