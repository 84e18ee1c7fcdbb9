"""Sums by key over chunks of data, with an answer to every chunk.

A chunk asks with its sorted distinct 64-bit keys and what it adds to each. Keys
are hashes, so equal ranges of them are equally full. With few chunks, each sends
one message to each range; a range adds up and answers. Beyond `fan` chunks this
goes in levels: groups of about `fan` chunks first add up among themselves, range
by range, and what they have in common goes on as one; answers come back the same
way. A chunk or range sends at most `fan` messages on every level and holds about
as many keys as one chunk, so messages grow in proportion to the chunks and the
levels with their logarithm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from millrace.llm.work import discard, stored

#: grp, path: the node that a message goes to; member, at: the node that it is from.
ASK = "grp long, path long, member long, at long, keys binary, a binary, b binary, flags binary"
ANSWER = "member long, at long, place long, a binary, b binary, flags binary, mine binary, stats array<long>"
ASK_FIELDS = [("grp", pa.int64()), ("path", pa.int64()), ("member", pa.int64()), ("at", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("flags", pa.binary())]
ANSWER_FIELDS = [("member", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("flags", pa.binary()), ("mine", pa.binary()), ("stats", pa.list_(pa.int64()))]
MOST_PARTITIONS = 20_000


def rows_of(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def pack_bits(bits: np.ndarray) -> bytes:
    return pack(np.packbits(bits))


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data, np.uint8), count=n).astype(bool)


@dataclass(frozen=True)
class Levels:
    """How many levels and ranges there are for a number of chunks."""

    depth: int
    width: int

    @classmethod
    def of(cls, chunks: int, fan: int) -> Levels:
        depth = max(1, math.ceil(math.log(max(chunks, 1)) / math.log(fan) - 1e-9))
        width = max(1, math.ceil(chunks ** (1 / depth) - 1e-9))
        return cls(depth, width)

    def messages(self, level: int, member: int, at: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, flags: np.ndarray) -> list[tuple]:
        """One row a range that has keys. `at` is the range that all keys are in."""
        parts = self.width ** (level + 1)
        ranges = range(at * self.width, (at + 1) * self.width)
        bounds = np.array([(i << 64) // parts for i in ranges], np.uint64)
        cut = np.append(np.searchsorted(keys, bounds), len(keys))
        # The number of a chunk says little of its task: groups are dealt by a hash.
        grp = (member * 0x9E3779B97F4A7C15 >> 7) % self.width ** (self.depth - 1) if level == 0 else member % self.width ** (self.depth - 1 - level)
        return [
            (grp, i, member, at, pack_sorted(keys[s:e]), pack(a[s:e]), None if b is None else pack(b[s:e]), pack_bits(flags[s:e]))
            for i, s, e in zip(ranges, cut[:-1], cut[1:], strict=True)
            if e > s
        ]


@dataclass
class _Node:
    """What a node received, by member, and its sums by distinct key."""

    rows: list[dict]
    keys: np.ndarray
    index: list[np.ndarray]
    own: list[np.ndarray]
    flagged: list[np.ndarray]
    a: np.ndarray
    b: np.ndarray | None
    flags: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, counts: bool) -> _Node:
        rows = sorted(table.select(["member", "at", "keys", "a", "b", "flags"]).to_pylist(), key=lambda r: (r["member"], r["at"]))
        each = [unpack_sorted(r["keys"]) for r in rows]
        keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
        values = [unpack(r["a"], np.int64 if counts else np.float64) for r in rows]
        flagged = [unpack_bits(r["flags"], len(k)) for r, k in zip(rows, each, strict=True)]
        a = np.bincount(inverse, weights=np.concatenate(values), minlength=len(keys))
        b = None if counts else np.bincount(inverse, weights=np.concatenate([unpack(r["b"], np.float64) for r in rows]), minlength=len(keys))
        flags = np.bincount(inverse, weights=np.concatenate(flagged), minlength=len(keys)) > 0
        ends = np.cumsum([len(k) for k in each])[:-1]
        return cls(rows, keys, np.split(inverse.astype(np.int32), ends), [v > 0 for v in values], flagged, a.astype(np.int64) if counts else a, b, flags)


def _deal(mine: np.ndarray, index: list[np.ndarray], own: list[np.ndarray]) -> list[np.ndarray]:
    """Each key of `mine` is dealt to the first member that adds to it."""
    left, out = mine.copy(), []
    for i, o in zip(index, own, strict=True):
        got = left[i] & o
        left[i[got]] = False
        out.append(got)
    return out


def _answers(counts: bool, place: int, members: list[dict], index: list[np.ndarray], own: list[np.ndarray], flagged: list[np.ndarray], a: np.ndarray, b: np.ndarray | None, flags: np.ndarray, mine: np.ndarray | None) -> list[tuple]:
    """Counts go to all of a member's keys, other sums to those that it flagged."""
    if counts:
        dealt = _deal(mine, index, own)
        return [(m["member"], m["at"], place, pack(a[i]), None, pack_bits(flags[i]), pack_bits(d), None) for m, i, d in zip(members, index, dealt, strict=True)]
    return [(m["member"], m["at"], place, pack(a[i[f]]), pack(b[i[f]]), None, None, None) for m, i, f in zip(members, index, flagged, strict=True)]


def _top(counts: bool, stats: Callable[[np.ndarray], list[int]] | None):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = _Node.of(table, counts)
        rows = _answers(counts, key[1].as_py(), node.rows, node.index, node.own, node.flagged, node.a, node.b, node.flags, node.a > 0)
        if stats:
            rows.append((-1, 0, 0, None, None, None, None, stats(node.a)))
        return rows_of(ANSWER_FIELDS, rows)

    return run


def _join(counts: bool):
    """Below the top: one row with the sums, and one a member with its places in them."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, (grp, path) = _Node.of(table, counts), (k.as_py() for k in key)
        rows = [(grp, path, None, None, pack_sorted(node.keys), pack(node.a), None if counts else pack(node.b), pack_bits(node.flags))]
        rows += [(grp, path, r["member"], r["at"], None, pack(i), pack_bits(o), pack_bits(f)) for r, i, o, f in zip(node.rows, node.index, node.own, node.flagged, strict=True)]
        return rows_of(ASK_FIELDS, rows)

    return run


def _split_again(levels: Levels, level: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = unpack_sorted(r["keys"])
                a, b = (None if r[c] is None else unpack(r[c], np.int64 if counts else np.float64) for c in ("a", "b"))
                yield from rows_of(ASK_FIELDS, levels.messages(level, r["grp"], r["path"], keys, a, b, unpack_bits(r["flags"], len(keys)))).to_batches()

    return run


def _down(counts: bool):
    """Hand the answers that a node got on to its members."""

    def run(_, places: pa.Table, answers: pa.Table) -> pa.Table:
        members = sorted((r for r in places.to_pylist() if r["keys"] is None), key=lambda r: (r["member"], r["at"]))
        if not members:
            return rows_of(ANSWER_FIELDS, [])
        got = Answers.of(answers.to_pylist(), counts)
        index = [unpack(r["a"], np.int32) for r in members]
        own, flagged = ([unpack_bits(r[c], len(i)) for r, i in zip(members, index, strict=True)] for c in ("b", "flags"))
        a, b = got.a, got.b
        if not counts:  # Only flagged sums were sent.
            asked = np.zeros(max(int(i.max()) for i in index) + 1, bool)
            for i, f in zip(index, flagged, strict=True):
                asked[i[f]] = True
            a, b = np.zeros(len(asked)), np.zeros(len(asked))
            a[asked], b[asked] = got.a, got.b
        return rows_of(ANSWER_FIELDS, _answers(counts, members[0]["path"], members, index, own, flagged, a, b, got.flags, got.mine))

    return run


@dataclass
class Answers:
    """A member's answers, in the order of its keys (of its flagged ones, for sums)."""

    a: np.ndarray
    b: np.ndarray | None
    flags: np.ndarray | None
    mine: np.ndarray | None

    @classmethod
    def of(cls, rows: list[dict], counts: bool) -> Answers:
        rows = sorted(rows, key=lambda r: r["place"])
        a = [unpack(r["a"], np.int64 if counts else np.float64) for r in rows]
        if not counts:
            return cls(np.concatenate([np.zeros(0), *a]), np.concatenate([np.zeros(0), *(unpack(r["b"], np.float64) for r in rows)]), None, None)
        bits = [np.concatenate([np.zeros(0, bool), *(unpack_bits(r[c], len(x)) for r, x in zip(rows, a, strict=True))]) for c in ("flags", "mine")]
        return cls(np.concatenate([np.zeros(0, np.int64), *a]), None, *bits)


def add_up(asks: DataFrame, levels: Levels, name: str, counts: bool, stats: Callable[[np.ndarray], list[int]] | None = None, level: int = 0) -> DataFrame:
    """Answers (member, place, a, ...) to `asks`, rows made by Levels.messages.

    With `counts`, a holds whole numbers and every key is answered with its total,
    whether anyone flagged it, and whether it is this member's, alone of all that
    add to it, to account for; otherwise a and b are sums of floats. `stats` of the
    totals of each range are in rows of member -1.
    """
    tasks = min(levels.width**levels.depth, MOST_PARTITIONS)
    dealt = asks.repartition(tasks, "grp", "path").groupBy("grp", "path")
    if level == levels.depth - 1:
        return stored(dealt.applyInArrow(_top(counts, stats), ANSWER), f"{name}-{level}")
    nodes = stored(dealt.applyInArrow(_join(counts), ASK), f"{name}-nodes{level}")
    above = add_up(nodes.where("keys IS NOT NULL").mapInArrow(_split_again(levels, level + 1, counts), ASK), levels, name, counts, stats, level + 1)
    asked = above.where("member >= 0").select(F.col("member").alias("grp"), F.col("at").alias("path"), "place", "a", "b", "flags", "mine")
    down = nodes.where("keys IS NULL").groupBy("grp", "path").cogroup(asked.groupBy("grp", "path")).applyInArrow(_down(counts), ANSWER)
    if stats:
        down = down.unionByName(above.where("member < 0"))
    answers = stored(down, f"{name}-{level}")
    discard(nodes, above)
    return answers
