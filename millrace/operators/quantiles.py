"""Exact quantiles of any number of values in bounded memory.

A quantile is an order statistic, or a mix of two neighbouring ones. A histogram of a
fixed number of bins between the least and the greatest value tells in which bin a rank
lies; histograms of tasks merge by adding up. That bin is then divided again, from its
own least to its own greatest value, until it holds one value only, or until all bins
that are still open hold so few rows that their values can be counted one by one. A pass
divides the rows of a bin by about the number of bins, so a billion distinct values take
three passes and no task holds more than bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
#: Rows of open bins that are counted value by value.
DIRECT = 100_000
#: Groups that are taken at a time; more are taken in turns.
GROUPS = 2_000


def _scaled(ranges: DataFrame, bins: int) -> DataFrame:
    """Adds what divides each range (lo, hi) into bins.

    Within a factor of two bins are of equal width; else of equal ratio, down to 2^-40 of
    the greatest size, so that values of any magnitudes are told apart in a few passes.
    """
    lo, hi = F.col("lo"), F.col("hi")
    least, most = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    apart = F.signum(lo) * F.signum(hi) <= 0
    unit = F.greatest(F.when(apart, 0.0).otherwise(least), most * 2.0**-40, F.lit(5e-324))
    named = ranges.withColumns({"_linear": ~apart & (most / 2 <= least), "_unit": unit, "_endless": most == float("inf")})
    width = F.when(F.col("_linear"), hi - lo).otherwise(_ratio(hi) - _ratio(lo))
    return named.withColumns({"_base": F.when(F.col("_linear"), lo).otherwise(_ratio(lo)), "_scale": F.when((width > 0) & ~F.col("_endless"), bins / F.when(width > 0, width)).otherwise(0.0)})


def _ratio(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x) / F.col("_unit"))


def _bin(bins: int) -> Column:
    """0 to bins - 1, growing with `v`, with `lo` in the first and `hi` in the last."""
    v = F.col("v")
    place = (F.when(F.col("_linear"), v).otherwise(_ratio(v)) - F.col("_base")) * F.col("_scale")
    inside = F.least(F.lit(bins - 1.0), F.greatest(F.lit(0.0), place)).cast("int")
    between = F.when(v == F.col("lo"), 0).otherwise(1)
    return F.when(v == F.col("hi"), bins - 1).when(F.col("_endless"), between).otherwise(inside)


def order_statistics(values: DataFrame, keys: list[str], ranks: list[tuple], bins: int = BINS, direct: int = DIRECT) -> dict[tuple, float]:
    """(keys..., rank) to the value at it, for `ranks` of (keys..., rank, lo, hi, below, n):
    ranks from 0, the least and greatest value of a range that has the rank, how many
    values lie below the range and how many in it. A pass is one job; what it gives is a
    row a rank."""
    spark, k = values.sparkSession, len(keys)
    kinds = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in keys)
    found: dict[tuple, float] = {}
    while True:
        found |= {r[: k + 1]: r[k + 1] for r in ranks if r[k + 1] == r[k + 2]}
        ranks = [r for r in ranks if r[k + 1] < r[k + 2]]
        if not ranks:
            return found
        ranges = {(*r[:k], *r[k + 1 :]) for r in ranks}
        sent = spark.createDataFrame(sorted(ranges, key=repr), f"{kinds}, lo double, hi double, below long, n long").coalesce(1)
        small = sum(r[-1] for r in ranges) <= direct
        inside = values.join(F.broadcast(_scaled(sent, bins).drop("n")), keys).where("v BETWEEN lo AND hi")
        counted = inside.withColumn("_part", F.col("v") if small else _bin(bins)).groupBy(*keys, "lo", "below", "_part").agg(F.count("*").alias("n"), F.min("v").alias("_least"), F.max("v").alias("_most"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "lo").orderBy("_part"))
        placed = counted.withColumn("_until", upto).withColumn("_from", F.col("_until") - F.col("n"))
        wanted = spark.createDataFrame([r[: k + 2] for r in ranks], f"{kinds}, rank long, lo double").coalesce(1)
        hit = placed.join(F.broadcast(wanted), [*keys, "lo"]).where("rank >= _from AND rank < _until")
        ranks = [tuple(r) for r in hit.select(*keys, "rank", "_least", "_most", "_from", "n").collect()]


def quantiles(values: DataFrame, keys: list[str], at: list[float], bins: int = BINS, direct: int = DIRECT, sizes: list[tuple] | None = None) -> DataFrame:
    """Rows (keys, q): an array of the quantiles of `v` by `keys`, interpolated between the
    values about rank (n - 1) p. Nulls and NaN do not count; keys are never null.

    `sizes` are rows (keys..., n, lo, hi) if they are known. Runs its passes when called.
    """
    spark, k = values.sparkSession, len(keys)
    live = values.where("v IS NOT NULL AND NOT isnan(v)").select(*keys, F.col("v").cast("double").alias("v"))
    sized = live.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    turns = 1
    if sizes is None:
        sizes = [tuple(r) for r in sized.limit(GROUPS + 1).collect()]
        turns = 1 if len(sizes) <= GROUPS else -(-2 * sized.count() // GROUPS)
    parts = []
    for turn in range(turns):
        some, rows = live, sizes
        if turns > 1:
            mine = F.pmod(F.xxhash64(*keys), F.lit(turns)) == turn
            some, rows = live.where(mine), [tuple(r) for r in sized.where(mine).collect()]
        wanted = {(*r[:k], i): (int((r[k] - 1) * p), (r[k] - 1) * p % 1, *r[k:]) for r in rows for i, p in enumerate(at)}
        ranks = {(*key[:k], rank, lo, hi, 0, n) for key, (first, _, n, lo, hi) in wanted.items() for rank in (first, min(first + 1, n - 1))}
        found = order_statistics(some, keys, list(ranks), bins, direct)

        def mixed(key: tuple, first: int, share: float, n: int) -> float:
            a = found[*key, first]
            return a if share == 0 else (1 - share) * a + share * found[*key, min(first + 1, n - 1)]

        parts += [(*r[:k], [mixed(r[:k], *wanted[*r[:k], i][:3]) for i in range(len(at))]) for r in rows]
    kinds = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in keys)
    return spark.createDataFrame(parts, f"{kinds}, q array<double>").coalesce(1)


def medians(values: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """Rows (keys, median) of `v` by `keys`. Groups of up to `most` values are counted in
    one task each; if there is a larger one, all are found by histograms."""
    largest = values.groupBy(*keys).agg(F.count("v").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= most:
        return values.groupBy(*keys).agg(F.median("v").alias("median"))
    found = quantiles(values, keys, [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return values.select(*keys).distinct().join(found, keys, "left")
