"""Fill-and-discharge cycles of a measure, for units of any size.

A cycle is armed once its peak reaches `arm` of the greatest value so far, and completes
at the first row at or below `zero` of its peak; the next cycle opens on that row. Rows
are dealt out by range of unit and order, so a unit of any share of the rows lies in
many tasks. What a task's part of a unit does is a function of the state in which it is
entered, and a small one:

* not armed: the first row that by itself reaches `arm` of the greatest value so far
  arms the cycle, whatever the peak was before (it was less);
* armed with peak P: the cycle completes at the first row of falling minima at or below
  `zero` of P, or at the first row at or below `zero` of the part's own peak.

From its first completion on a part does not depend on how it was entered. So parts give
their functions at once, these are applied one after another (a few numbers a part), and
then all parts label their rows at once. Within a part, numpy finds one cycle's end
after the other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import epoch_seconds, half_up
from millrace.sources.scratch import checkpointed

ARM, ZERO = 0.05, 0.02


@dataclass(frozen=True)
class State:
    """Before a row: the greatest value so far, the cycle's peak (None before the first
    value), whether it is armed, and how many cycles are complete."""

    top: float = float("-inf")
    peak: float | None = None
    armed: bool = False
    cycles: int = 0


@dataclass
class Rules:
    arm: float
    zero: float

    def __post_init__(self) -> None:
        if not 0 < self.zero < self.arm:
            raise ValueError("a cycle is armed above where it completes")

    def end(self, v: np.ndarray, at: int, peak: float) -> tuple[int | None, float]:
        """The first row from `at` on that completes an armed cycle, and its peak there."""
        size = 64
        while at < len(v):
            some = v[at : at + size]
            peaks = np.maximum(np.maximum.accumulate(some), peak)
            hit = np.flatnonzero(some <= peaks * self.zero)
            if len(hit):
                return at + int(hit[0]), float(peaks[hit[0]])
            at, size, peak = at + size, size * 4, float(peaks[-1])
        return None, peak

    def arming(self, v: np.ndarray, top: float) -> np.ndarray:
        """Rows that arm a cycle by themselves."""
        return np.flatnonzero((v > 0) & (v >= np.maximum(np.maximum.accumulate(v), top) * self.arm))

    def run(self, v: np.ndarray, state: State) -> tuple[list[int], State]:
        """Rows that complete cycles, and the state after the last row."""
        if not len(v):
            return [], state
        arming, at, done = self.arming(v, state.top), 0, []
        peak, armed = state.peak, state.armed
        if peak is None:
            peak, armed, at = float(v[0]), bool(v[0] > 0), 1
        while at < len(v):
            if not armed:
                k = np.searchsorted(arming, at)
                if k == len(arming):
                    peak = max(peak, float(v[at:].max()))
                    break
                at = int(arming[k])
                peak, armed = float(v[at]), True
            end, peak = self.end(v, at, peak)
            if end is None:
                break
            done.append(end)
            peak, armed, at = float(v[end]), False, end + 1
        return done, State(max(state.top, float(v.max())), peak, armed, state.cycles + len(done))

    def function(self, v: np.ndarray, top: float) -> dict[str, Any]:
        """What a part does if it is entered with a peak, in few numbers: the outcome if it
        is not armed, and falling thresholds with the outcome if `zero` of the peak
        reaches them. An outcome is (completions, armed, peak); no peak: the greater of
        the peak before and the part's greatest value."""
        greatest, arming = float(v.max()), self.arming(v, top)
        known: dict[int, tuple[int, bool, float]] = {}

        def after(row: int) -> tuple[int, bool, float]:
            """From a completion at `row` to the end of the part."""
            chain: list[int] = []
            while True:
                k = int(np.searchsorted(arming, row + 1))
                if k == len(arming):
                    out = (0, False, float(v[row:].max()))
                    break
                if k in known:
                    out = known[k]
                    break
                end, peak = self.end(v, int(arming[k]), float(v[arming[k]]))
                chain.append(k)
                if end is None:
                    out = (0, True, peak)
                    known[k] = out
                    chain.pop()
                    break
                row = end
            for k in reversed(chain):
                out = known[k] = (out[0] + 1, *out[1:])
            return out

        def completed(row: int) -> tuple[int, bool, float]:
            n, armed, peak = after(row)
            return n + 1, armed, peak

        first, peak = (None, None) if not len(arming) else self.end(v, int(arming[0]), float(v[arming[0]]))
        idle = completed(first) if first is not None else (0, True, peak) if len(arming) else (0, False, None)
        own, _ = self.end(v, 0, float(v[0]))
        upto = v if own is None else v[:own]
        falling = np.flatnonzero(upto < np.append(np.inf, np.minimum.accumulate(upto)[:-1])) if len(upto) else np.empty(0, int)
        steps: list[tuple[float, tuple[int, bool, float]]] = []
        for row in falling.tolist():
            outcome = completed(row)
            if steps and steps[-1][1] == outcome:
                steps.pop()  # The lower threshold has the same outcome.
            steps.append((float(v[row]), outcome))
        return {"idle": idle, "steps": steps, "own": completed(own) if own is not None else (0, True, None), "greatest": greatest}

    def apply(self, function: dict[str, Any], state: State) -> State:
        outcome = function["idle"]
        if state.armed:
            outcome = next((o for least, o in function["steps"] if least <= state.peak * self.zero), function["own"])
        n, armed, peak = outcome
        return State(max(state.top, function["greatest"]), max(state.peak, function["greatest"]) if peak is None else peak, armed, state.cycles + n)


def _segments(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[tuple[Any, bool, pa.RecordBatch]]:
    """(unit, fresh, rows): slices of one unit each."""
    current, begun = None, False
    for batch in batches:
        names = batch.column(unit).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                fresh = not begun or names[a] != current
                current, begun = names[a], True
                yield current, fresh, batch.slice(a, b - a)


def _values(rows: pa.RecordBatch, measure: str) -> np.ndarray:
    """Doubles, NaN for a null."""
    return rows.column(measure).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _entering(dealt: DataFrame, unit: str, measure: str, rules: Rules) -> dict[tuple[int, Any], State]:
    """(part, unit) to the state in which a part of a unit is entered, for units that lie in
    several parts: at most two a part."""
    parts = dealt.select(F.spark_partition_id().alias("part"), F.col(unit).alias("unit"), F.col(measure).cast("double").alias("v"))
    greatest = parts.groupBy("part", "unit").agg(F.max(F.when(~F.isnan("v"), F.col("v"))).alias("top"))
    split = greatest.withColumn("_n", F.count("*").over(Window.partitionBy("unit"))).where("_n > 1").select("part", "unit", "top").collect()
    if not split:
        return {}
    tops: dict[tuple[int, Any], float] = {}
    running: dict[Any, float] = {}
    for r in sorted(split, key=lambda r: r["part"]):
        tops[r["part"], r["unit"]] = running.get(r["unit"], float("-inf"))
        if r["top"] is not None:
            running[r["unit"]] = max(running.get(r["unit"], float("-inf")), r["top"])

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}
        for name, _, rows in _segments(batches, "unit"):
            if (part, name) in tops:
                found.setdefault(name, []).append(_values(rows, "v"))
        for name, arrays in found.items():
            v = np.concatenate(arrays)
            v = v[~np.isnan(v)]
            top = tops[part, name]
            made = None if not len(v) else (rules.run(v, State(top))[1], rules.function(v, top))
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pickle.dumps((name, made))], pa.binary())], ["part", "made"])

    made = {}
    for r in parts.drop("part").mapInArrow(functions, "part int, made binary").collect():
        name, what = pickle.loads(r["made"])
        made[r["part"], name] = what
    states: dict[tuple[int, Any], State] = {}
    now: dict[Any, State] = {}
    for part, name in sorted(made, key=lambda k: k[0]):
        state = states[part, name] = now.get(name, State())
        if made[part, name] is not None:
            fresh, function = made[part, name]
            now[name] = fresh if state.peak is None else rules.apply(function, state)
    return states


def label_cycles(df: DataFrame, unit: str, measure: str, order: list[str], arm: float = ARM, zero: float = ZERO, parts: int | None = None) -> DataFrame:
    """Adds cycle, completes and cycle_peak to every row of `df`.

    A null or NaN neither counts nor completes, and has the labels of its place. Rows of
    equal `order` keep no order among themselves. Runs its first passes when called;
    `parts` is the number of ranges (the session's number of shuffle partitions).
    """
    rules = Rules(arm, zero)
    dealt = df.repartitionByRange(*([parts] if parts else []), unit, *order).sortWithinPartitions(unit, *order)
    dealt = checkpointed(dealt)
    states = _entering(dealt, unit, measure, rules)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), State()
        for name, fresh, rows in _segments(batches, unit):
            if fresh:
                state = states.get((part, name), State())
            everything = _values(rows, measure)
            live = np.flatnonzero(~np.isnan(everything))
            v = everything[live]
            done, after = rules.run(v, state)
            completes = np.zeros(len(everything), bool)
            completes[live[done]] = True
            cycle = state.cycles + np.append(0, np.cumsum(completes)[:-1]) if len(completes) else np.empty(0, np.int64)
            shown, held = _peaks(v, done, state.peak)
            peak = np.full(len(everything), 0.0 if state.peak is None else state.peak)
            place = np.cumsum(~np.isnan(everything)) - 1
            peak[place >= 0] = held[place[place >= 0]]
            peak[live] = shown
            yield pa.record_batch([*rows.columns, pa.array(cycle, pa.int64()), pa.array(completes), pa.array(peak, pa.float64())], [*rows.schema.names, "cycle", "completes", "cycle_peak"])
            state = after

    return dealt.mapInArrow(label, fields + ", cycle long, completes boolean, cycle_peak double")


def _peaks(v: np.ndarray, done: list[int], before: float | None) -> tuple[np.ndarray, np.ndarray]:
    """A cycle's peak up to each row, and what it is after it: a completing row begins the
    next cycle."""
    shown = np.empty(len(v))
    start, peak = 0, float("-inf") if before is None else before
    for end in [*done, len(v) - 1]:
        if start <= end:
            shown[start : end + 1] = np.maximum(np.maximum.accumulate(v[start : end + 1]), peak)
            start, peak = end + 1, float(v[end])
    held = shown.copy()
    held[done] = v[done]
    return shown, held


def cycle_table(labelled: DataFrame, unit: str, ts: str, measures: list[str], order: list[str]) -> DataFrame:
    """One row a cycle of label_cycles: its rows, when it began (where the one before
    completed) and ended, its peak, what it discharged to, and the sum of every measure. The
    row that completes a cycle belongs to it."""
    place = F.struct(*order)
    found = labelled.groupBy(unit, "cycle").agg(F.count("*").alias("rows"), F.min(epoch_seconds(ts)).alias("first_sec"), F.max(epoch_seconds(ts)).alias("end_sec"), F.bool_or("completes").alias("complete"), F.max("cycle_peak").alias("peak"), F.max_by(measures[0], F.when(F.col("completes"), place)).alias("discharge"), *(F.sum(m).alias(f"sum_{m}") for m in measures))
    before = F.lag("end_sec").over(Window.partitionBy(unit).orderBy("cycle"))
    return found.withColumn("begin_sec", F.coalesce(before, F.col("first_sec"))).drop("first_sec")


def cycle_statistics(cycles: DataFrame, unit: str, measures: list[str]) -> DataFrame:
    """One row a unit that completed a cycle: cycles, quantity (the peaks' sum), mean and
    deviation of peak and length, mean discharge and its ratio to the mean peak, whether one
    was unfinished, and of every measure the sum inside complete cycles, its mean and
    deviation a cycle."""
    done = F.col("complete")
    of = lambda f, x: f(F.when(done, x))
    mean = lambda x: half_up(of(F.sum, x)) / F.count_if(done)  # noqa: E731  Of a rounded sum, which does not depend on the order of rows.
    sd = lambda x: half_up(F.coalesce(of(F.stddev_samp, x), F.lit(0.0)))
    sec = (F.col("end_sec") - F.col("begin_sec")).cast("double")
    ratio = mean(F.col("discharge")) / F.nullif(mean(F.col("peak")), F.lit(0.0))
    sums = [x for m in measures for x in (half_up(of(F.sum, F.col(f"sum_{m}"))).alias(f"{m}_sum"), half_up(mean(F.col(f"sum_{m}"))).alias(f"{m}_mean"), sd(F.col(f"sum_{m}")).alias(f"{m}_sd"))]
    per = cycles.groupBy(unit).agg(F.count_if(done).alias("cycles"), half_up(mean(F.col("rows"))).alias("rows_per_cycle"), half_up(of(F.sum, F.col("peak"))).alias("quantity"), half_up(mean(F.col("peak"))).alias("peak_mean"), sd(F.col("peak")).alias("peak_sd"), half_up(mean(sec)).alias("mean_sec"), sd(sec).alias("sd_sec"), half_up(mean(F.col("discharge"))).alias("discharge_mean"), half_up(ratio).alias("discharge_ratio"), F.count_if(~done).alias("unfinished"), *sums)
    return per.where("cycles > 0")


def cycle_terminals(labelled: DataFrame, unit: str, categories: list[str], least: float = 0.5) -> DataFrame:
    """Rows (unit, column, value, n, share): what categories have where cycles complete, if
    at least `least` of a unit's cycles complete there."""
    done = labelled.where("completes")
    long = done.select(unit, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories)))).where("value <> ''")
    counted = long.groupBy(unit, "column", "value").agg(F.count("*").alias("n"))
    total = done.groupBy(unit).agg(F.count("*").alias("_all"))
    share = F.col("n") / F.col("_all")
    return counted.join(total, unit).where(share >= least).select(unit, "column", "value", "n", half_up(share).alias("share"))
