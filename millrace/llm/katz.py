"""Operator 9: language-model scoring by Katz backoff.

N-grams up to `order` are counted over the training documents, counts up to five
are discounted by Good-Turing, and what a context's discounts free is spread over
the words never seen after it, in proportion to the probability of the next lower
order and exactly normalised: p(w | uv) = d(c) c(uvw) / c(uv) if the n-gram was
seen, else backoff(uv) p(w | v), and so on down. Unknown words share the mass that
unigram discounts free; a context that was never seen backs off with weight one. A
text is preceded by start marks.

Texts are tokenised once into chunks: rows of about a million tokens with a local
vocabulary. Order by order, a chunk asks for the counts of its distinct n-grams
(see sums.py), then for the backoff weights of the contexts that it needs. To a
weight each distinct n-gram adds once, by the one chunk that accounts for it, and
only to contexts that some scored text may back off from: those that held-out texts
have. Everything that a
task holds at a time is bounded by `chunk_tokens`; a frequent n-gram is one entry a
chunk however often it occurs.

Counts above five are not discounted, so a context that occurs more often may have
nothing free. Such contexts count as seen once more, by something unknown: their
n-grams are shares of c(uv) + 1.

Defined cases: a null or empty text is one end token; held-out rows are scored
but teach nothing; a null doc_id teaches; repeated rows count and are scored
each; without training rows every score is 0 (probability one of the unknown);
an empty table gives an empty table; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from millrace.llm.sums import ASK, ASK_FIELDS, Answers, Levels, add_up, rows_of
from millrace.llm.text import WordHashes, each, mix, texts
from millrace.llm.work import discard, stored

END, START = np.uint64(1), np.uint64(2)
#: Counts up to this are discounted.
DISCOUNTED = 5
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

_CHUNK = "chunk long, doc_ids array<long>, held_out array<boolean>, lengths binary, vocabulary binary, ids binary, tokens long"
_CHUNK_FIELDS = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("vocabulary", pa.binary()), ("ids", pa.binary()), ("tokens", pa.int64())]


def _chunks(chunk_tokens: int):
    """Texts to chunks; ends are tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        base, made = TaskContext.get().partitionId() << 32, 0
        docs, held, parts, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            vocabulary, ids = np.unique(np.concatenate(parts), return_inverse=True)
            lengths = np.array([len(p) for p in parts], np.int32)
            row = (base + made, docs, held, pack(lengths), pack_sorted(vocabulary), pack(ids.astype(np.int32)), total)
            return rows_of(_CHUNK_FIELDS, [row]).to_batches()[0]

        for batch in batches:
            for doc, out, raw in zip(*(each(batch, c) for c in ("doc_id", "held_out", "raw")), strict=True):
                words = hashes.of(raw.lower().split())
                docs.append(doc)
                held.append(out)
                parts.append(np.append(words, END))
                total += len(words) + 1
                if total >= chunk_tokens:
                    yield flush()
                    docs, held, parts, total, made = [], [], [], 0, made + 1
        if parts:
            yield flush()

    return run


@dataclass
class _Chunk:
    """One chunk unpacked: per token its word and whether it teaches."""

    chunk: int
    doc_ids: list
    held_out: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    vocabulary: np.ndarray
    word: np.ndarray
    teaches: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Chunk:
        lengths, vocabulary, word = unpack(row["lengths"], np.int32), unpack_sorted(row["vocabulary"]), unpack(row["ids"], np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        held = np.array(row["held_out"], bool)
        return cls(row["chunk"], row["doc_ids"], held, lengths, starts, vocabulary, word, ~np.repeat(held, lengths))

    def names(self, order: int) -> np.ndarray:
        """Per token, the hash of the n-gram that ends there."""
        words = mix(self.vocabulary)
        out = words[self.word]
        after = (words * _B)[self.word] if order > 1 else None
        for k in range(2, order + 1):
            out = np.roll(out, 1)
            out[self.starts] = start_name(k)
            out *= _A
            out += after
            out = mix(out)
        return out

    def grams(self, order: int) -> _Grams:
        """The distinct n-grams, by hash."""
        keys, first, inverse = np.unique(self.names(order), return_index=True, return_inverse=True)
        inverse = inverse.astype(np.int32)
        counts = np.bincount(inverse[self.teaches], minlength=len(keys))
        return _Grams(keys, first.astype(np.int32), inverse, counts)

    def before(self, values: np.ndarray, at_start: int) -> np.ndarray:
        """`values` of each token's predecessor in its text."""
        out = np.roll(values, 1)
        out[self.starts] = at_start
        return out

    def held_contexts(self, grams: _Grams) -> np.ndarray:
        """Marks n-grams that come before a token of a held-out text."""
        marks = np.zeros(len(grams.keys), bool)
        followed = ~self.teaches
        followed[self.starts + self.lengths - 1] = False
        marks[grams.inverse[followed]] = True
        return marks


def start_name(order: int) -> np.uint64:
    """The context of a text's first token among contexts of `order` - 1 words."""
    return mix(np.array([START + np.uint64(order)]))[0]


@dataclass
class _Grams:
    """A chunk's distinct n-grams of one order, and what the corpus says of them."""

    keys: np.ndarray
    first: np.ndarray
    inverse: np.ndarray
    counts: np.ndarray
    #: Counts over all training texts; whether held-out texts go on after it;
    #: whether this chunk accounts for it.
    totals: np.ndarray = field(default=None)
    continued: np.ndarray = field(default=None)
    mine: np.ndarray = field(default=None)
    p: np.ndarray = field(default=None)


def _ask_counts(order: int, last: bool, levels: Levels):
    """Every chunk's distinct n-grams with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk.of(row)
                g = c.grams(order)
                marks = np.zeros(len(g.keys), bool) if last else c.held_contexts(g)
                yield from rows_of(ASK_FIELDS, levels.messages(0, c.chunk, 0, g.keys, g.counts, None, marks)).to_batches()

    return run


def _count_stats(totals: np.ndarray) -> list[int]:
    """Tokens, distinct n-grams, and those with counts of 1 to DISCOUNTED + 1."""
    by_count = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return [int(totals.sum()), int((totals > 0).sum()), *by_count[1 : DISCOUNTED + 2].tolist()]


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discount ratios of one order, and its total of counts."""

    total: int
    distinct: int
    ratios: np.ndarray

    @classmethod
    def of(cls, stats: list[int]) -> Discounts:
        """Katz's ratios from the counts of counts; where those are too uneven, from
        the straight line fitted to their logarithms; where that is too flat, a
        constant is taken off every small count."""
        total, distinct, k = stats[0], stats[1], DISCOUNTED
        n = np.array([0, *stats[2:]], float)
        ratios = np.ones(k + 1)
        r = np.arange(1, k + 2)
        tries = []
        if (n[1:] > 0).all():
            slope, level = np.polyfit(np.log(r), np.log(n[1:]), 1)
            tries = [n, np.append(0, np.exp(level + slope * np.log(r)))]
        for m in tries:
            common = (k + 1) * m[k + 1] / m[1]
            if common < 1:
                ratios[1:] = [((i + 1) * m[i + 1] / (i * m[i]) - common) / (1 - common) for i in range(1, k + 1)]
                if ((ratios[1:] > 0) & (ratios[1:] < 1)).all():
                    break
        else:
            off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            ratios[1:] = [(i - off) / i for i in range(1, k + 1)]
        return cls(total, distinct, ratios)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.where(counts <= DISCOUNTED, self.ratios[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass(frozen=True)
class KatzModel:
    #: Discounts of each order, unigrams first.
    orders: tuple[Discounts, ...]
    #: Unigram mass of unknown words; the counts it goes with add up to `weight`.
    unknown: float
    weight: float

    @classmethod
    def of(cls, stats: list[list[int]]) -> KatzModel:
        one = Discounts.of(stats[0])
        free = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(stats[0][2 : 2 + DISCOUNTED], one.ratios[1:], strict=True), 1))
        weight = float(one.total)
        if free <= 0:
            free, weight = 1.0, weight + 1.0
        return cls((one, *map(Discounts.of, stats[1:])), free / weight, weight)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.orders[0].kept(counts) / self.weight, self.unknown)


def whole_counts(counts: np.ndarray) -> np.ndarray:
    """Of contexts: the count that their n-grams are shares of."""
    return np.maximum(counts + (counts > DISCOUNTED), 1).astype(np.float64)


class _Scorer:
    """A chunk beside the answers that it has got so far, order by order."""

    def __init__(self, chunk: pa.Table, answers: pa.Table, model: KatzModel):
        self.chunk, self.model = _Chunk.of(chunk.to_pylist()[0]), model
        self.rows: dict[str, list[dict]] = {}
        for r in answers.to_pylist():
            self.rows.setdefault(r.pop("kind"), []).append(r)
        self.grams = self._counted(1)
        self.grams.p = model.unigram(self.grams.totals)
        self.unigrams = self.grams

    def _counted(self, order: int) -> _Grams:
        g, got = self.chunk.grams(order), Answers.of(self.rows.pop(f"count{order}"), True)
        g.totals, g.continued, g.mine = got.a, got.flags, got.mine
        return g

    def up(self, order: int) -> None:
        """From order - 1 to the n-grams of `order`, not yet with probabilities.

        Contexts are numbered as the n-grams of the lower order are; the last is
        the one of a text's start, which occurs as often as a text ends.
        """
        self.lower = self.grams
        end = np.searchsorted(self.unigrams.keys, mix(np.array([END]))[0])
        self.context_counts = np.append(self.lower.totals, self.unigrams.totals[end])
        self.grams = g = self._counted(order)
        self.context = self.chunk.before(self.lower.inverse, len(self.lower.keys))[g.first]
        self.below = self.lower.p[self.lower.inverse[g.first]]
        seen = g.totals > 0
        self.unseen = ~seen & (self.context_counts[self.context] > 0)
        self.asked = np.zeros(len(self.context_counts), bool)
        self.asked[self.context[self.unseen]] = True

    def ask_weights(self, order: int, levels: Levels) -> list[tuple]:
        """What this chunk's own n-grams add to the discounted counts of contexts
        and to the lower-order mass seen after them."""
        g, counts = self.grams, self.context_counts
        wanted = np.append(self.lower.continued, True)
        own = np.flatnonzero(g.mine & wanted[self.context])
        sums = [np.bincount(self.context[own], weights=w, minlength=len(counts)) for w in (self.model.orders[order - 1].kept(g.totals[own]), self.below[own])]
        chosen = np.flatnonzero(self.asked | (sums[0] > 0))
        names = np.append(self.lower.keys, start_name(order))[chosen]
        by_name = np.argsort(names)
        chosen, names = chosen[by_name], names[by_name]
        return levels.messages(0, self.chunk.chunk, 0, names, sums[0][chosen], sums[1][chosen], self.asked[chosen])

    def weigh(self, order: int) -> None:
        """The probabilities of this order, with the weights that were asked for."""
        g, counts = self.grams, self.context_counts
        names = np.append(self.lower.keys, start_name(order))
        chosen = np.flatnonzero(self.asked)
        chosen = chosen[np.argsort(names[chosen])]
        whole, weight = whole_counts(counts), np.ones(len(counts))
        if len(chosen):  # Kept counts, and the mass below of what was seen.
            got = Answers.of(self.rows.pop(f"weight{order}"), False)
            weight[chosen] = (1 - got.a / whole[chosen]) / (1 - got.b)
        kept = self.model.orders[order - 1].kept(g.totals)
        g.p = np.where(g.totals > 0, kept / whole[self.context], self.below * np.where(self.unseen, weight[self.context], 1.0))

    def scores(self) -> pa.Table:
        c, one = self.chunk, self.unigrams
        total = lambda values: np.add.reduceat(values, c.starts).astype(np.float64)
        by_word = np.log10((one.totals + 1) / (self.model.orders[0].total + self.model.orders[0].distinct + 1))
        known = total((one.totals > 0).astype(np.int64)[one.inverse]).astype(np.int64)
        arrays = [pa.array(c.doc_ids, pa.int64()), pa.array(c.held_out.tolist(), pa.bool_()), pa.array(c.lengths.astype(np.int64)), pa.array(known), pa.array(total(by_word[one.inverse])), pa.array(total(np.log10(self.grams.p)[self.grams.inverse]))]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _ask_weights(model: KatzModel, order: int, levels: Levels):
    def run(_, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s = _Scorer(chunk, answers, model)
        for k in range(2, order + 1):
            s.up(k)
            if k < order:
                s.weigh(k)
        return rows_of(ASK_FIELDS, s.ask_weights(order, levels))

    return run


def _score(model: KatzModel):
    def run(_, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s = _Scorer(chunk, answers, model)
        for k in range(2, len(model.orders) + 1):
            s.up(k)
            s.weigh(k)
        return s.scores()

    return run


def score_texts(docs: DataFrame, held_out: str, order: int = 3, chunk_tokens: int = 1_000_000, fan: int = 256) -> DataFrame:
    """Learn from the rows of `docs` (doc_id, text, ...) where the SQL condition
    `held_out` is not true, and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    source = texts(docs, "doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks = stored(source.mapInArrow(_chunks(chunk_tokens), _CHUNK), "lm-chunks")
    levels = Levels.of(chunks.count(), fan)
    answers, stats = {}, []
    for k in range(1, order + 1):
        asks = chunks.mapInArrow(_ask_counts(k, k == order, levels), ASK)
        got = answers[f"count{k}"] = add_up(asks, levels, f"lm-count{k}", True, _count_stats)
        sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)).alias(str(i)) for i in range(DISCOUNTED + 3)]
        stats.append([*got.where("member < 0").agg(*sums).first()])
    model = KatzModel.of(stats)

    def beside(f, schema: str) -> DataFrame:
        """`f` of each chunk and all answers that it has got so far."""
        columns = [F.col("member").alias("chunk"), "place", "a", "b", "flags", "mine"]
        known = None
        for kind, table in answers.items():
            rows = table.where("member >= 0").select(F.lit(kind).alias("kind"), *columns)
            known = rows if known is None else known.unionByName(rows)
        return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(f, schema)

    for k in range(2, order + 1):
        answers[f"weight{k}"] = add_up(beside(_ask_weights(model, k, levels), ASK), levels, f"lm-weight{k}", False)
    done = stored(beside(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "lm-scores")
    discard(chunks, *answers.values())
    return done.withColumn("train_tokens", F.lit(model.orders[0].total).cast("long"))


def op9_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, "crc32(cast(doc_id AS string)) % 7 = 2")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
