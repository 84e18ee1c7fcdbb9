"""Cross-tabs of categories by measures, with incident rows held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up
from millrace.operators.quantiles import medians
from millrace.operators.stats import unpivot_measures


def in_windows(ts: str, windows: list[tuple[str, str | None]]) -> Column:
    """Inside any window, ends included; an open end goes on for ever."""
    found = F.lit(False)
    for start, end in windows:
        inside = F.col(ts) >= F.lit(start).cast("timestamp_ntz")
        found = found | (inside if end is None else inside & (F.col(ts) <= F.lit(end).cast("timestamp_ntz")))
    return F.coalesce(found, F.lit(False))


def quarantined_by(df: DataFrame, ts: str, windows: DataFrame) -> DataFrame:
    """Adds `quarantined` from a table of windows (start, end: null is open).

    Windows that overlap are first merged into runs, so a row meets at most one
    and the join does not multiply rows; days are the equi-join key, so it needs
    no nested loop over a large table of windows.
    """
    far = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    closed = windows.select(F.col("start"), F.coalesce("end", far).alias("end")).where("start <= end")
    before = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = closed.withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).cast("int"))
    merged = fresh.withColumn("run", F.sum("fresh").over(Window.orderBy("start", "end"))).groupBy("run").agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
    span = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    days = merged.crossJoin(F.broadcast(span)).withColumn("_day", F.explode(F.sequence(F.to_date(F.greatest("_start", "lo")), F.to_date(F.least("_end", "hi"))))).where("_start <= hi AND _end >= lo").groupBy("_day").agg(F.collect_list(F.struct("_start", "_end")).alias("_windows"))
    joined = df.withColumn("_day", F.to_date(ts)).join(days, "_day", "left")
    hit = F.exists("_windows", lambda w: (F.col(ts) >= w["_start"]) & (F.col(ts) <= w["_end"]))
    return joined.withColumn("quarantined", F.coalesce(hit, F.lit(False))).select(*df.columns, "quarantined")


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    q = F.col("quarantined")
    return rows.groupBy(*keys, "measure").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(q).alias("ex_n"), F.coalesce(F.sum(F.when(q, F.col("v"))), F.lit(0.0)).alias("ex_sum"), F.avg(F.when(~q, F.col("v"))).alias("clean"))


def _with_baseline(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A baseline exists where only some of a cell's rows are held out; where all
    are, there is none to fall back to."""
    baseline_n = F.col("n") - F.col("ex_n")
    return cells.select(*keys, "measure", "n", *(half_up(c).alias(c) for c in ("mean", "sd", "lo", "hi")), "ex_n", half_up("ex_sum").alias("ex_sum"), baseline_n.alias("baseline_n"), half_up(F.when(F.col("ex_n") > 0, F.col("clean")).otherwise(F.col("mean"))).alias("baseline_mean"))


def marginal(df: DataFrame, categories: list[str], measures: list[str], quarantined: Column | None = None) -> DataFrame:
    """Cells (category, value, measure): all rows, held-out rows and the baseline."""
    rows = df.withColumn("quarantined", F.lit(False) if quarantined is None else quarantined)
    long = unpivot_measures(rows, measures, [*categories, "quarantined"])
    by_value = long.unpivot(["quarantined", "measure", "v"], categories, "category", "value").where("value IS NOT NULL")
    return _with_baseline(_cells(by_value, ["category", "value"]), ["category", "value"])


def joint(df: DataFrame, first: str, second: str, measures: list[str], quarantined: Column | None = None) -> DataFrame:
    """Cells of two categories at once."""
    long = unpivot_measures(df.withColumn("quarantined", F.lit(False) if quarantined is None else quarantined), measures, [first, second, "quarantined"])
    named = long.withColumnsRenamed({first: "first_value", second: "second_value"}).where("first_value IS NOT NULL AND second_value IS NOT NULL")
    return _with_baseline(_cells(named, ["first_value", "second_value"]), ["first_value", "second_value"])


def median_of_unit_means(df: DataFrame, unit: str, category: str, measure: str) -> DataFrame:
    """For each value: how many units have it, and the median of their means."""
    means = df.where(F.col(category).isNotNull()).groupBy(unit, F.col(category).alias("value")).agg(F.avg(measure).alias("v"))
    units = means.groupBy("value").agg(F.count("*").alias("units"))
    return units.join(medians(means, ["value"]), "value").select("value", "units", half_up("median").alias("median_of_unit_means"))


def mix_standardised(df: DataFrame, level: str, levels: tuple[str, str], state: str, measure: str) -> DataFrame:
    """Two levels compared as they are, and on one shared weighting of states.

    Only states that both levels have are weighed, each by its rows in both.
    """
    cells = df.where(F.col(level).isin(*levels)).groupBy(F.col(level).alias("level"), F.col(state).alias("state")).agg(F.count("*").alias("n"), F.sum(measure).alias("s"))
    by_state = Window.partitionBy("state")
    common = cells.withColumn("w", F.sum("n").over(by_state)).withColumn("both", F.count("*").over(by_state) == 2)
    mean = F.when(F.col("both"), F.col("s") / F.col("n"))
    raw, weights = F.sum("s") / F.sum("n"), F.sum(F.when(F.col("both"), F.col("w")))
    return common.groupBy("level").agg(F.sum("n").alias("n"), half_up(raw).alias("raw_mean"), half_up(F.sum(mean * F.col("w")) / weights).alias("standardised_mean"))


def _wide(measures: list[str]) -> list[Column]:
    """Moments of every measure in one aggregation, by place."""
    found = []
    for i in range(len(measures)):
        v = F.col(f"_m{i}")
        found += [F.count(v).alias(f"_n{i}"), F.avg(v).alias(f"_mean{i}"), F.var_pop(v).alias(f"_var{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    return found


def _pooled(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A row a cell and measure: what is held out and what is not, at most two rows of the
    wide aggregation, put together."""
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), *(F.col(f"_{x}{i}").alias(x) for x in ("n", "mean", "var", "lo", "hi"))) for i, m in enumerate(measures)))
    long = wide.select(*keys, "_q", F.inline(parts)).where("n > 0")
    of = lambda x, q: F.max(F.when(F.col("_q") == q, F.col(x)))
    none = F.lit(0).cast("long")
    both = long.groupBy(*keys, "measure").agg(F.coalesce(of("n", False), none).alias("_n"), F.coalesce(of("n", True), none).alias("ex_n"), of("mean", False).alias("clean"), of("mean", True).alias("_ex"), F.sum(F.col("n") * F.col("var")).alias("_m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n, ex_sum = F.col("_n") + F.col("ex_n"), F.coalesce(F.col("ex_n") * F.col("_ex"), F.lit(0.0))
    apart = F.coalesce(F.pow(F.col("clean") - F.col("_ex"), 2) * F.col("_n") * F.col("ex_n") / n, F.lit(0.0))
    return both.select(*keys, "measure", n.alias("n"), F.coalesce(F.when(F.col("ex_n") == 0, F.col("clean")), (F.coalesce(F.col("_n") * F.col("clean"), F.lit(0.0)) + ex_sum) / n).alias("mean"), ((F.col("_m2") + apart) / n).alias("var"), "lo", "hi", "ex_n", ex_sum.alias("ex_sum"), "clean")


def _typed(df: DataFrame, categories: list[str], measures: list[str], quarantined: Column | None) -> DataFrame:
    q = F.lit(False) if quarantined is None else F.coalesce(quarantined, F.lit(False))
    return df.select(*(F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(categories)), *(F.col(f"`{m}`").cast("double").alias(f"_m{i}") for i, m in enumerate(measures)), q.alias("_q"))


def _set_of(categories: int, *grouped: int) -> int:
    """The number of the grouping set of these categories: a bit for each that is absent,
    the last one (held out or not) being always there."""
    return sum(1 << (categories - i) for i in range(categories) if i not in grouped)


def moments(df: DataFrame, categories: list[str], measures: list[str], quarantined: Column | None = None) -> DataFrame:
    """Cells (category, value, measure: n, mean, var, lo, hi, ex_n, ex_sum, clean) of all
    categories by all measures.

    One scan, one aggregation by grouping sets with all measures side by side: a row is
    copied once a category, not once a category and measure, and cells are few before
    anything is shuffled. A null value of a category is no value; nulls of a measure do
    not count; a table without rows has no cells. Names of columns may be any.
    """
    rows = _typed(df, categories, measures, quarantined)
    keys = [F.col(f"_c{i}") for i in range(len(categories))]
    wide = rows.groupingSets([[k, F.col("_q")] for k in keys], *keys, F.col("_q")).agg(F.grouping_id().alias("_set"), *_wide(measures))
    which = {_set_of(len(categories), i): i for i in range(len(categories))}
    pick = lambda of: F.coalesce(*(F.when(F.col("_set") == g, of(i)) for g, i in which.items()))
    named = wide.withColumn("category", pick(lambda i: F.lit(categories[i]))).withColumn("value", pick(lambda i: F.col(f"_c{i}")))
    return _pooled(named.where("value IS NOT NULL"), ["category", "value"], measures)


def with_effects(cells: DataFrame, min_rows: int = 500) -> DataFrame:
    """`moments` with the baseline of each cell and eta2 of its category over its measure:
    null with fewer than `min_rows` rows or two values. Nothing is read again: the cells'
    moments are pooled."""
    over = Window.partitionBy("category", "measure")
    n = F.sum("n").over(over)
    placed = cells.withColumns({"_rows": n, "_cells": F.count("*").over(over), "_grand": F.sum(F.col("n") * F.col("mean")).over(over) / n, "_within": F.sum(F.col("n") * F.col("var")).over(over)})
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).over(over)
    scored = placed.withColumn("_between", between).withColumn("eta2", F.when((F.col("_rows") >= min_rows) & (F.col("_cells") >= 2), half_up(F.col("_between") / F.nullif(F.col("_between") + F.col("_within"), F.lit(0.0)), 6)))
    return _pooled_baseline(scored, ["category", "value"], ["eta2"])


def _pooled_baseline(cells: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("var") * F.col("n") / (F.col("n") - 1))).otherwise(0.0)
    return cells.select(*keys, "measure", "n", half_up("mean").alias("mean"), half_up(sd).alias("sd"), half_up("lo").alias("lo"), half_up("hi").alias("hi"), "ex_n", half_up("ex_sum").alias("ex_sum"), (F.col("n") - F.col("ex_n")).alias("baseline_n"), half_up(F.when(F.col("ex_n") > 0, F.col("clean")).otherwise(F.col("mean"))).alias("baseline_mean"), *more)


def oriented_moments(df: DataFrame, states: list[str], scheduled: list[str], measures: list[str], quarantined: Column | None = None) -> DataFrame:
    """Cells (state_column, state, dimension, value, measure, ...) of every state column by
    every dimension that the clock schedules, in one scan as `moments`.

    A column that is both is a state only, so no pair is of one column with itself.
    """
    dimensions = [d for d in scheduled if d not in states]
    if not states or not dimensions:
        raise ValueError("an oriented cross-tab needs a state column and a scheduled dimension")
    categories = [*states, *dimensions]
    rows = _typed(df, categories, measures, quarantined)
    pairs = [(i, len(states) + j) for i in range(len(states)) for j in range(len(dimensions))]
    key = [F.col(f"_c{i}") for i in range(len(categories))]
    wide = rows.groupingSets([[key[i], key[j], F.col("_q")] for i, j in pairs], *key, F.col("_q")).agg(F.grouping_id().alias("_set"), *_wide(measures))
    which = {_set_of(len(categories), i, j): (i, j) for i, j in pairs}
    pick = lambda of: F.coalesce(*(F.when(F.col("_set") == g, of(*p)) for g, p in which.items()))
    named = wide.withColumns({"state_column": pick(lambda i, j: F.lit(categories[i])), "state": pick(lambda i, j: F.col(f"_c{i}")), "dimension": pick(lambda i, j: F.lit(categories[j])), "value": pick(lambda i, j: F.col(f"_c{j}"))})
    return _pooled(named.where("state IS NOT NULL AND value IS NOT NULL"), ["state_column", "state", "dimension", "value"], measures)


def oriented_joint(cells: DataFrame) -> DataFrame:
    """`oriented_moments` as a cross-tab with baselines; a cell whose rows are all held out
    has none and says so by a baseline of 0 rows."""
    return _pooled_baseline(cells, ["state_column", "state", "dimension", "value"])


def confound_notes(cells: DataFrame) -> DataFrame:
    """What the mix of states explains of the margin between a dimension's two values.

    Of `oriented_moments`: the second value by name against the first, in percent, as it is
    and on one weighting of states (a state's rows under both values; a value is weighed over
    the states it has), and the difference in points. Dimensions of more or fewer values
    have no note, nor where the first value's mean is zero either way.
    """
    keys = ["state_column", "dimension", "measure"]
    weighed = cells.withColumn("_w", F.sum("n").over(Window.partitionBy(*keys, "state")))
    per = weighed.groupBy(*keys, "value").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_raw"), (F.sum(F.col("mean") * F.col("_w")) / F.sum("_w")).alias("_mix"))
    both = per.groupBy(*keys).agg(F.count("*").alias("_k"), *(f(x, "value").alias(a) for f, x, a in ((F.min_by, "_raw", "_ra"), (F.max_by, "_raw", "_rb"), (F.min_by, "_mix", "_ma"), (F.max_by, "_mix", "_mb"))), F.min("value").alias("first_value"), F.max("value").alias("second_value"))
    raw, mix = F.col("_rb") / F.col("_ra"), F.col("_mb") / F.col("_ma")
    return both.where("_k = 2 AND _ra <> 0 AND _ma <> 0").select(*keys, "first_value", "second_value", half_up((raw - 1) * 100).alias("marginal_pct"), half_up((mix - 1) * 100).alias("standardised_pct"), half_up((mix - raw) * 100).alias("confound_points"))
