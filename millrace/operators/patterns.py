"""Sequences of rows of a key that match a pattern of steps, for keys of any size.

A pattern names steps, each perhaps with `?`, `*` or `+`: `breach recovered+ breach`. A
step is a condition on a row; the rows of a match follow one another without others
between. A row ends a match if some run of rows up to it has the pattern and began at most
`within` seconds before; of several such runs the one that began last is told.

The automaton has a state for each step (the step that the last row took), and holds for
each the latest second at which a run in that state began. So what a part of a key does
is a small function of what it is entered with: which states lead to which, and what
began inside. Rows are dealt out by range of key and order, parts give their functions at
once, these are applied one after another (two keys a part at most), and then all parts
find their matches at once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.cycles import _segments
from millrace.sources.scratch import checkpointed

NEVER = float("-inf")


@dataclass(frozen=True)
class Automaton:
    """Steps by position: which may begin, which may end, and which may come before each."""

    names: tuple[str, ...]
    first: frozenset[int]
    last: frozenset[int]
    before: tuple[frozenset[int], ...]

    @classmethod
    def of(cls, pattern: str) -> Automaton:
        parts = [re.fullmatch(r"(\w+)([?*+]?)", p) for p in pattern.split()]
        if not parts or None in parts:
            raise ValueError(f"not a pattern: {pattern!r}")
        names = tuple(p[1] for p in parts)
        optional = [p[2] in ("?", "*") for p in parts]
        if all(optional):
            raise ValueError("some step of a pattern must be there")
        n = len(names)
        skips = lambda a, b: all(optional[a:b])
        before = tuple(frozenset([p for p in range(q) if skips(p + 1, q)] + ([q] if parts[q][2] in ("*", "+") else [])) for q in range(n))
        return cls(names, frozenset(q for q in range(n) if skips(0, q)), frozenset(q for q in range(n) if skips(q + 1, n)), before)

    def step(self, began: list[float], mask: int, sec: float) -> list[float]:
        """The latest beginnings after a row that meets the steps of `mask`."""
        if not mask:
            return [NEVER] * len(self.names)
        out = []
        for q, before in enumerate(self.before):
            best = NEVER
            if mask >> q & 1:
                best = sec if q in self.first else max((began[p] for p in before), default=NEVER)
            out.append(best)
        return out

    def reach(self, lead: list[int], mask: int) -> list[int]:
        """For each state of entering, the states it has led to, as bits, after a row."""
        if not mask:
            return [0] * len(lead)
        out = []
        for bits in lead:
            now = 0
            if bits:
                for q, before in enumerate(self.before):
                    if mask >> q & 1 and any(bits >> p & 1 for p in before):
                        now |= 1 << q
            out.append(now)
        return out

    def enter(self, made: tuple[list[int], list[float]], began: list[float]) -> list[float]:
        """What a part's function makes of the beginnings it is entered with."""
        lead, inside = made
        return [max([inside[q]] + [began[p] for p, bits in enumerate(lead) if bits >> q & 1]) for q in range(len(inside))]


def _entering(dealt: DataFrame, key: str, automaton: Automaton) -> dict[tuple[int, Any], list[float]]:
    """(part, key) to the beginnings with which a part of a key is entered. Only the first
    and the last key of a part may lie in others too, so a part tells of no more."""
    n = len(automaton.names)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, current = TaskContext.get().partitionId(), [], None
        for name, fresh, rows in _segments(batches, key):
            if fresh:
                current = [name, [1 << q for q in range(n)], [NEVER] * n]
                found = [*found[:1], current]
            for mask, sec in zip(rows.column("_mask").to_pylist(), rows.column("_sec").to_pylist()):
                if any(current[1]):
                    current[1] = automaton.reach(current[1], mask)
                current[2] = automaton.step(current[2], mask, sec)
        if found:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], ["part", "made"])

    made = {r["part"]: pickle.loads(r["made"]) for r in dealt.select(key, "_mask", "_sec").mapInArrow(functions, "part int, made binary").collect()}
    states, now = {}, {}
    for part in sorted(made):
        for name, lead, inside in made[part]:
            began = states[part, name] = now.get(name, [NEVER] * n)
            now[name] = automaton.enter((lead, inside), began)
    return {k: v for k, v in states.items() if any(b > NEVER for b in v)}


def match_pattern(df: DataFrame, key: str, order: list[str], seconds: Column, steps: dict[str, Column], pattern: str, within: float, parts: int | None = None) -> DataFrame:
    """The rows of `df` that end a match, with `began_sec`, the second it began.

    A row may meet several steps or none; a condition that is null is not met. A null key
    is a key. A row without seconds meets no step. Rows of equal `order` keep no order
    among themselves, so `order` should be total. An empty table gives no rows. Columns of
    `df` called `_mask`, `_sec` or `began_sec` are refused. Runs its first passes when
    called; `parts` is the number of ranges (the session's number of shuffle partitions).
    """
    taken = {"_mask", "_sec", "began_sec"} & set(df.columns)
    if taken:
        raise ValueError(f"columns with names of this operator: {sorted(taken)}")
    automaton = Automaton.of(pattern)
    unknown = set(automaton.names) - set(steps)
    if unknown:
        raise ValueError(f"steps without a condition: {sorted(unknown)}")
    if len(automaton.names) > 62:
        raise ValueError("a pattern has at most 62 steps")
    mask = sum((F.when(steps[s], F.lit(1 << q)).otherwise(F.lit(0)).cast("long") for q, s in enumerate(automaton.names)), F.lit(0).cast("long"))
    sec = seconds.cast("double")
    marked = df.withColumns({"_mask": F.when(sec.isNull(), F.lit(0).cast("long")).otherwise(mask), "_sec": sec})
    dealt = checkpointed(marked.repartitionByRange(*([parts] if parts else []), key, *order).sortWithinPartitions(key, *order))
    states = _entering(dealt, key, automaton)
    n, columns = len(automaton.names), df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, began = TaskContext.get().partitionId(), [NEVER] * n
        for name, fresh, rows in _segments(batches, key):
            if fresh:
                began = states.get((part, name), [NEVER] * n)
            at, starts = [], []
            for i, (m, s) in enumerate(zip(rows.column("_mask").to_pylist(), rows.column("_sec").to_pylist())):
                began = automaton.step(began, m, s)
                latest = max(began[q] for q in automaton.last) if m else NEVER
                if latest > NEVER and s - latest <= within:
                    at.append(i)
                    starts.append(latest)
            if at:
                hit = rows.take(pa.array(at, pa.int64()))
                yield pa.record_batch([*(hit.column(c) for c in columns), pa.array(starts, pa.float64())], [*columns, "began_sec"])

    return dealt.mapInArrow(find, fields + ", began_sec double")
