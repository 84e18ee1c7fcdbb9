"""What a board shows over many results: health, findings, causes, anomalies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up


def health(results: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Live breaches of every result and their tone; results without any count 0."""
    counted = live.groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    tone = F.when(n == 0, "ok").when(n > 2, "critical").otherwise("warning")
    return results.select(key).distinct().join(counted, key, "left").select(key, n.alias("live"), tone.alias("tone"))


def findings(events: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Keys that flap: over four recoveries, and more than twice the live breaches."""
    recovered = events.groupBy(key).agg(F.count_if(F.col("kind") == "recovered").alias("recoveries"))
    now = live.groupBy(key).agg(F.count("*").alias("_live"))
    joined = recovered.join(now, key, "left").withColumn("live", F.coalesce("_live", F.lit(0)))
    return joined.where("recoveries > 4 AND recoveries > 2 * live").select(key, "recoveries", "live", F.lit("flapping").alias("finding"))


def root_cause(df: DataFrame, family: Column, excess: str) -> DataFrame:
    """The family with the greatest summed excess, and its share of all excess."""
    summed = df.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.sum(excess).alias("excess"))
    total = summed.agg(F.sum("excess").alias("total"))
    top = summed.orderBy(F.desc(half_up("excess")), "family").limit(1)
    return top.crossJoin(F.broadcast(total)).select("family", "n", half_up("excess").alias("excess"), half_up(F.col("excess") / F.nullif(F.col("total"), F.lit(0.0)), 6).alias("share"))


def anomalies(detections: DataFrame, label: str, entity: str, scope: str, excess: str, critical: float = 0.06) -> DataFrame:
    """One row a (label, entity) over all scopes: how many, the greatest excess, and
    how grave that is; detections without excess are left out."""
    out = detections.where((F.col(excess) != 0) & F.col(excess).isNotNull()).groupBy(label, entity).agg(F.count_distinct(scope).alias("scopes"), F.max(excess).alias("excess"))
    return out.withColumn("severity", F.when(F.col("excess") >= critical, "critical").otherwise("warning"))


def contains_rule(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text holds the pattern, without regard to case."""
    return df.where(F.contains(F.lower(text), F.lit(pattern.lower())))


def frequency_rule(df: DataFrame, key: str, seconds: Column, order: list[str], more_than: int, within: int) -> DataFrame:
    """Rows at which a key has occurred more than so many times in the last seconds.

    `order` breaks ties of time; the frame is a range of time, itself included.
    """
    recent = Window.partitionBy(key).orderBy("_sec").rangeBetween(-within, 0)
    return df.withColumn("_sec", seconds).withColumn("occurrences", F.count("*").over(recent)).where(F.col("occurrences") > more_than).drop("_sec")


def pace(df: DataFrame, hour: Column, measure: str, target: float) -> DataFrame:
    """Hour by hour: what has accrued, what the usual rhythm would have by now for
    the target, and the gap."""
    hours = df.groupBy(hour.cast("long").alias("hour")).agg(F.sum(measure).alias("s"))
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    return hours.select("hour", half_up(F.sum("s").over(upto)).alias("accrued"), half_up(target * F.sum("s").over(upto) / F.sum("s").over(everything)).alias("expected"), half_up(F.sum("s").over(upto) - target * F.sum("s").over(upto) / F.sum("s").over(everything)).alias("gap"))


def projections(df: DataFrame, scope: str, ts: str, measure: str, until: str, spreads: float = 1.0) -> DataFrame:
    """One row a scope: where its running day is heading at the second `until`.

    The days before tell how much usually has come by this second of a day and how much
    is still to come. The rest of the running day is that usual rest, scaled by how the day
    goes so far; its spread is the deviation of the rests over the days, so hours that go
    together are not taken for independent ones. Days without rows up to the scope's first
    one do not count; later ones count as nothing. A scope without earlier days has no
    projection; one of which usually nothing has come yet is not scaled.
    """
    now = F.lit(until).cast("timestamp_ntz")
    day, today = F.to_date(ts), F.to_date(now)
    so_far = F.date_format(ts, "HH:mm:ss") <= F.date_format(now, "HH:mm:ss")
    rows = df.where(F.col(scope).isNotNull() & F.col(ts).isNotNull() & (day <= today))
    days = rows.groupBy(F.col(scope).alias("scope"), day.alias("day")).agg(*(F.coalesce(F.sum(F.when(c, F.col(measure))), F.lit(0.0)).cast("double").alias(a) for c, a in ((so_far, "come"), (~so_far, "rest"))))
    past, k = F.col("day") < today, F.datediff(today, F.min(F.when(F.col("day") < today, F.col("day"))))
    per = days.groupBy("scope").agg(k.alias("days"), F.coalesce(F.sum(F.when(~past, F.col("come"))), F.lit(0.0)).alias("accrued"), *(F.sum(F.when(past, x)).alias(a) for x, a in ((F.col("come"), "s_come"), (F.col("rest"), "s_rest"), (F.col("rest") * F.col("rest"), "q_rest"))))
    mean_come, mean_rest = F.col("s_come") / F.col("days"), F.col("s_rest") / F.col("days")
    sd_rest = F.when(F.col("days") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q_rest") - F.col("days") * mean_rest * mean_rest) / (F.col("days") - 1)))).otherwise(0.0)
    pace = F.when(mean_come > 0, F.col("accrued") / mean_come).otherwise(1.0)
    projected = F.col("accrued") + pace * mean_rest
    return per.select("scope", "days", "accrued", (mean_come / F.nullif(mean_come + mean_rest, F.lit(0.0))).alias("usual_share"), projected.alias("projected"), (projected - spreads * pace * sd_rest).alias("low"), (projected + spreads * pace * sd_rest).alias("high"))


def pace_conditions(found: DataFrame, targets: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """Rows (scope, condition, value, threshold, fires, sure) of `projections` against
    `targets` (scope, target).

    attainment_gap: what has come, against the share of the target that usually has;
    projected_miss: the projection against the target. `sure`: so do both ends of the
    spread (a gap has none). A scope without a target, or with a null one, has no
    conditions; one without a projection has them with nulls.
    """
    joined = targets.where("target IS NOT NULL").select("scope", F.col("target").cast("double").alias("target")).join(found, "scope", "left")
    misses = lambda x, y: x > y if lower_is_better else x < y
    due = F.col("target") * F.col("usual_share")
    best = F.col("low") if lower_is_better else F.col("high")
    row = lambda name, value, threshold, sure: F.struct(F.lit(name).alias("condition"), half_up(value).alias("value"), half_up(threshold).alias("threshold"), misses(half_up(value), half_up(threshold)).alias("fires"), sure.alias("sure"))
    gap = row("attainment_gap", F.col("accrued"), due, misses(half_up("accrued"), half_up(due)))
    miss = row("projected_miss", F.col("projected"), F.col("target"), misses(half_up(best), half_up("target")))
    return joined.select("scope", F.inline(F.array(gap, miss)))


def relevance(items: DataFrame, name: str, unit: str, want_name: str, want_unit: str) -> DataFrame:
    """Items by unit and shared words: 100 for the same unit, 40 for the same unit up
    to the slash, 25 for each shared word of over three letters."""
    words = F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) > 3))
    wanted = F.array(*map(F.lit, sorted({w for w in re.split("[^a-z0-9]+", want_name.lower()) if len(w) > 3}))).cast("array<string>")
    stem = lambda c: F.substring_index(F.lower(c), "/", 1)
    same = F.coalesce(F.lower(unit) == want_unit.lower(), F.lit(False))
    score = F.when(same, 100).when(F.coalesce(stem(F.col(unit)) == want_unit.lower().split("/")[0], F.lit(False)), 40).otherwise(0) + 25 * F.size(F.array_intersect(words, wanted))
    return items.withColumn("relevance", score.cast("long"))
