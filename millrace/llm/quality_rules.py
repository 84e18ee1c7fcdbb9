"""Operator 4: quality rules by robust multivariate outliers.

Every document becomes a vector of transformed statistics. For each language
and source, a minimum-covariance-determinant estimate is found by concentration
steps that run as Spark aggregations over all different vectors: from each of
three starts about the medians, keep the half of the vectors that lie nearest,
take their mean and covariance, and repeat until the determinant stops falling;
the start of the least determinant counts. Documents at a large Mahalanobis
distance from that estimate are rejected, beside those that fail the fixed base
rules. Up to half of a group's different vectors may be junk, and copies of one
text have one vector, however many they are.

Defined cases: a null text has no words and fails the base rules; null languages
and sources form groups of their own; groups below `min_group` different vectors
are pooled by language, then all together; if that is still too small, they are
held to the estimate over all documents, and if those are too few only the base
rules decide; an empty table gives an empty table; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.statistics import COUNTS, text_counts
from millrace.llm.text import WordHashes, each, texts
from millrace.llm.work import Scratch, lean, stored

#: The transformed statistics, each with the least deviation that it is given:
#: most documents have none of some of these, so their covariance vanishes.
FEATURES = {"x_words": 0.30, "x_word_length": 0.08, "x_symbols": 0.02, "x_upper": 0.03, "x_repeats": 0.06, "x_lines": 0.15, "x_distinct": 0.03}
#: Median of chi squared with as many degrees of freedom as there are features.
CHI2_MEDIAN = 6.345811
#: Its 0.975 quantile.
CHI2_975 = 16.012764
SALTS = 32


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = [text_counts(raw, hashes) for raw in each(batch, "raw")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[:-1], *COUNTS])


def document_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the counts of each whole text."""
    source = texts(docs, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "raw")
    return source.mapInArrow(lean(_counts), ", ".join([kept, *(f"{c} long" for c in COUNTS)]))


def _features(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counted.withColumns(
        {
            "x_words": F.log1p("n_words"),
            "x_word_length": F.log(chars / n),
            "x_symbols": F.col("n_symbols") / chars,
            "x_upper": F.col("n_upper") / chars,
            "x_repeats": F.col("n_repeat_words") / n,
            "x_lines": F.col("n_dup_lines") / F.col("n_lines"),
            "x_distinct": F.when(F.col("n_words") > 1, F.log(F.col("n_distinct").cast("double")) / F.log(n.cast("double"))).otherwise(1.0),
        }
    )


#: Groups (languages by sources) up to which a table of a few rows a group is sent to
#: the rows: 3 estimates of 57 numbers a group, 14 MB.
SENT_GROUPS = 10_000


def _beside(rows: DataFrame, small: DataFrame, send: bool, *keys: str) -> DataFrame:
    """Join a few rows a group to all rows of the group.

    With few groups, which the caller has counted, the small table is sent. Otherwise,
    as a group may hold a third of all rows, its few are repeated for every salt and
    its rows are dealt out by group and salt.
    """
    if send:
        return rows.join(F.broadcast(small), list(keys))
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, [*keys, "salt"])


def _distinct(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Each vector once in a group, however many documents have it."""
    return rows.select(*keys, *names).distinct().withColumn("salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))


def _grouped(rows: DataFrame, names: list[str], min_group: int, scratch: Scratch, sent_groups: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows with `grp`, whose estimate a document is held to, the vectors of each, and
    whether groups are few."""
    vectors = scratch.stored(_distinct(rows, ["narrow", "wide"], names), "quality-vectors")
    sizes = vectors.groupBy("narrow", "wide").agg(F.count("*").alias("n"))
    n_groups = sizes.count()
    send = n_groups <= sent_groups
    small = _beside(vectors, sizes.where(F.col("n") < min_group).select("narrow"), send, "narrow")
    pooled = small.select("wide", *names).distinct().groupBy("wide").agg(F.count("*").alias("pooled"))
    grp = F.when(F.col("n") >= min_group, F.col("narrow")).when(F.col("pooled") >= min_group, F.concat(F.lit("pooled"), F.col("wide"))).otherwise("rest")
    groups = scratch.stored(sizes.join(pooled, "wide", "left").select("narrow", grp.alias("grp")), "quality-groups", rows=n_groups)
    own = _distinct(_beside(vectors, groups, send, "narrow"), ["grp"], names)
    rest = own.where("grp = 'rest'").count()
    if 0 < rest < min_group:  # Too few for an estimate of their own.
        own = own.where("grp <> 'rest'").unionByName(_distinct(vectors.withColumn("grp", F.lit("rest")), ["grp"], names))
    return _beside(rows, groups, send, "narrow").drop("narrow", "wide"), own, send


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by the group's `centre` and `precision`."""
    p = len(names)
    off = [F.col(x) - F.col("centre")[i] for i, x in enumerate(names)]
    return reduce(add, [(1.0 if i == j else 2.0) * F.col("precision")[i * p + j] * off[i] * off[j] for i in range(p) for j in range(i, p)])


def _upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _square(products, n: float, p: int) -> np.ndarray:
    upper = np.zeros((p, p))
    upper[np.triu_indices(p)] = np.asarray(products, float) / n
    return np.triu(upper) + np.triu(upper, 1).T


ESTIMATE = "centre array<double>, precision array<double>, logdet double"


def _estimates(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"grp": pa.string(), "start": pa.int32(), "centre": pa.list_(pa.float64()), "precision": pa.list_(pa.float64()), "logdet": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _start(vectors: DataFrame, names: list[str], floors: list[float], send: bool) -> DataFrame:
    """Three first estimates of each group, all about its medians.

    Their deviations are those about the medians; their correlations are none,
    those of tanh(z) and those of the directions z / |z|.
    """
    p = len(names)
    centres = vectors.groupBy("grp").agg(F.array(*(F.percentile_approx(x, 0.5, 10_000) for x in names)).alias("centre"))
    off = _beside(vectors, centres, send, "grp")
    spread = off.groupBy("grp").agg(F.first("centre").alias("centre"), F.array(*(F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col("centre")[i]), 0.5, 10_000), F.lit(floors[i])) for i, x in enumerate(names))).alias("s"))
    scaled = _beside(vectors, spread, send, "grp").select("grp", "centre", "s", *(((F.col(x) - F.col("centre")[i]) / F.col("s")[i]).alias(x) for i, x in enumerate(names)))
    norm = F.greatest(reduce(add, [F.col(x) * F.col(x) for x in names]), F.lit(1e-12))
    sums = scaled.withColumn("norm", norm).groupBy("grp").agg(
        F.first("centre").alias("centre"),
        F.first("s").alias("s"),
        F.count("*").alias("n"),
        F.array(*(F.sum(F.tanh(x)) for x in names)).alias("sums"),
        F.array(*(F.sum(F.tanh(names[i]) * F.tanh(names[j])) for i, j in _upper(p))).alias("tanhs"),
        F.array(*(F.sum(F.col(names[i]) * F.col(names[j]) / F.col("norm")) for i, j in _upper(p))).alias("signs"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, centre, s, n, total, tanhs, signs in zip(*(batch.column(c).to_pylist() for c in ("grp", "centre", "s", "n", "sums", "tanhs", "signs")), strict=True):
                mean = np.asarray(total, float) / n
                for start, cov in enumerate((np.eye(p), _square(tanhs, n, p) - np.outer(mean, mean), _square(signs, n, p))):
                    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                    r = 0.99 * cov / np.outer(sd, sd)
                    np.fill_diagonal(r, 1.0)
                    rows.append((g, start, list(centre), (np.linalg.inv(r) / np.outer(s, s)).ravel().tolist(), float("inf")))
            yield _estimates(rows)

    return sums.mapInArrow(build, f"grp string, start int, {ESTIMATE}")


def _estimated(inner: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Mean and covariance of the rows of each group and start."""
    p = len(names)
    sums = inner.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(x) for x in names)).alias("sums"),
        F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in _upper(p))).alias("products"),
    )

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, start, n, total, products in zip(*(batch.column(c).to_pylist() for c in ("grp", "start", "n", "sums", "products")), strict=True):
                mean = np.asarray(total, float) / n
                cov = _square(products, n, p) - np.outer(mean, mean)
                lift = np.maximum(np.square(floors) - np.diag(cov), 0.0)
                cov = cov + np.diag(lift + 1e-3 * np.square(floors))
                rows.append((g, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield _estimates(rows)

    return sums.mapInArrow(invert, f"grp string, start int, {ESTIMATE}")


def _measured(vectors: DataFrame, estimates: DataFrame, names: list[str], send: bool) -> DataFrame:
    return _beside(vectors, estimates.select("grp", "start", "centre", "precision"), send, "grp").select("grp", "start", "salt", *names, _distance(names).alias("d2"))


def _concentrate(vectors: DataFrame, estimates: DataFrame, names: list[str], floors: list[float], share: float, send: bool) -> DataFrame:
    """One step: the estimates from the `share` of each group nearest to `estimates`."""
    measured = _measured(vectors, estimates, names, send)
    reach = measured.groupBy("grp", "start").agg(F.percentile_approx("d2", share, 10_000).alias("reach"))
    return _estimated(_beside(measured, reach, send, "grp", "start").where(F.col("d2") <= F.col("reach")), names, floors)


def _scales(measured: DataFrame) -> DataFrame:
    return measured.groupBy("grp", "start").agg(F.greatest(F.percentile_approx("d2", 0.5, 10_000) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"), F.count("*").alias("members"))


def _robust(vectors: DataFrame, names: list[str], floors: list[float], share: float, send: bool, scratch: Scratch) -> DataFrame:
    """(grp, centre, precision, scale, members): the reweighted estimate of each group.

    Every start is concentrated until its determinant falls by less than a
    hundredth, the least determinant is kept, and mean and covariance are taken
    once more from all vectors within the 0.975 quantile of its scaled distances.
    """
    few = vectors.select("grp").distinct().count() * 3
    best = scratch.stored(_start(vectors, names, floors, send).withColumn("done", F.lit(False)), "quality-start", rows=few)
    while best.where("NOT done").take(1):
        moved = _concentrate(vectors, best.where("NOT done"), names, floors, share, send)
        moved = moved.select("grp", "start", F.struct("centre", "precision", "logdet").alias("moved"))
        better = F.coalesce(F.col("moved.logdet") < F.col("logdet"), F.lit(False))
        estimate = [F.when(better, F.col(f"moved.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "precision", "logdet")]
        done = ~F.coalesce(F.col("moved.logdet") < F.col("logdet") - 0.01, F.lit(False))
        best = scratch.stored(best.join(moved, ["grp", "start"], "left").select("grp", "start", *estimate, done.alias("done")), "quality-step", rows=few)
    least = best.groupBy("grp").agg(F.min_by(F.struct("start", "centre", "precision"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    measured = _measured(vectors, least, names, send)
    near = _beside(measured, _scales(measured), send, "grp", "start").where(F.col("d2") <= CHI2_975 * F.col("scale"))
    final = scratch.stored(_estimated(near, names, floors), "quality-final", rows=few)
    return scratch.stored(final.join(_scales(_measured(vectors, final, names, send)), ["grp", "start"]).drop("start", "logdet"), "quality-estimate", rows=few)


def mark_outliers(counted: DataFrame, cutoff: float = 29.88, share: float = 0.5, min_group: int = 100, sent_groups: int = SENT_GROUPS) -> DataFrame:
    """Adds base_failed, distance (scaled, squared) and kept to document_counts().

    Distances are scaled so that their median in a group is that of chi squared;
    `cutoff` is the 0.9999 quantile of chi squared with seven degrees of freedom.
    """
    names, floors = list(FEATURES), list(FEATURES.values())
    salt = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)).cast("int")
    keys = {"narrow": F.to_json(F.struct("lang", "source")), "wide": F.to_json(F.struct("lang")), "salt": salt}
    scratch = Scratch()
    rows, vectors, send = _grouped(scratch.stored(_features(counted).withColumns(keys), "quality-counts"), names, min_group, scratch, sent_groups)
    estimate = _robust(scratch.stored(vectors, "quality-features"), names, floors, share, send, scratch)
    distance = F.when(F.col("members") >= min_group, _distance(names) / F.col("scale")).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = _beside(rows, estimate, send, "grp").withColumn("distance", distance).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~failed & (F.col("distance") <= cutoff)).drop("grp", "salt", "centre", "precision", "scale", "members", *names)
    judged = stored(judged, "quality-judged")
    scratch.clear()
    return judged


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = mark_outliers(document_counts(docs, "doc_id", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
