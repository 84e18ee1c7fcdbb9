"""Operator 10: a quality classifier by positive-unlabelled learning.

A logistic model over statistics of the whole text minimises the non-negative
unbiased risk: trusted positives stand for one class, unlabelled web text for
the mixture, and the class prior says how much of the mixture is positive. The
negative part of the risk, mixture minus positives, is held at zero or above.

Labels, language, source and doc_id are never inputs of a score; doc_id only
decides which rows may teach.

Defined cases: a null text is empty and gets a score like any text; a document
with several labels counts as positive if one of them is 1; a row without doc_id is
not held out and may teach as unlabelled text; a label without doc_id teaches
nothing; without any trusted
positive every score is 0.5; repeated rows get equal scores; an empty table
gives an empty table; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.quality_rules import document_counts
from millrace.llm.statistics import COUNTS, text_counts
from millrace.llm.text import WordHashes, each, texts
from millrace.llm.work import discard, stored


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of COUNTS to rows of features."""
    c = dict(zip(COUNTS, counts.astype(float).T, strict=True))
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    share = {k: c[k] / chars for k in ("n_symbols", "n_upper", "n_digits", "n_punctuation", "n_marks")}
    distinct = np.where(n > 1, np.log(np.maximum(c["n_distinct"], 1)) / np.log(np.maximum(n, 2)), 1.0)
    columns = [
        np.log1p(c["n_words"]),
        np.log(chars / n),
        *share.values(),
        *(np.sqrt(v) for v in share.values()),
        c["n_repeat_words"] / n,
        np.sqrt(c["n_repeat_words"] / n),
        c["n_dup_lines"] / c["n_lines"],
        distinct,
        c["n_distinct"] / n,
        np.log(n / c["n_lines"]),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        x = np.clip((features(counts) - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk prior E_p[l(+)] + max(0, E_u[l(-)] - prior E_p[l(-)]), its
    negative part before it is held at zero, and the direction to go down: its gradient,
    or, where the negative part is below zero, that part's gradient reversed."""
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    to_positive = -prior * (_sigmoid(-zp) @ p) / len(p)
    to_negative = (_sigmoid(zu) @ u) / len(u) - prior * (_sigmoid(zp) @ p) / len(p)
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    return value, negative, to_positive + to_negative if negative >= 0 else -to_negative


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> QualityModel:
    """Minimise the risk with Adam."""
    p, u = features(positive), features(unlabelled)
    centre, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-3)
    ones = lambda x: np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = ones(p), ones(u)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = risk(w, p, u, prior)[2] + decay * np.append(w[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return QualityModel(centre, scale, w[:-1], float(w[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled texts, from both alone.

    A model is fitted on half of each. Among the other halves' best scores nearly all
    unlabelled texts are positives, so there the share of unlabelled texts over that
    of positives is the class prior; the line is drawn where this ratio and its
    margin of error are least. It lies between 0.05 and 0.98.
    """
    model = fit_positive_unlabelled(positive[::2], unlabelled[::2], 0.5, steps=200)
    p, u = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    lines = np.unique(p)
    above_p = 1 - np.searchsorted(p, lines) / len(p)
    above_u = 1 - np.searchsorted(u, lines) / len(u)
    margin = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    best = np.argmin((above_u + (1 + slack) * margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def held_out(folds: int = 5) -> Column:
    """Rows of no doc_id are not held out: no label is theirs."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, max_positive: int = 20_000, max_unlabelled: int = 20_000, seed: int = 10) -> QualityModel | None:
    """Fit on texts of rows outside the held-out fold.

    At most `max_positive` trusted positives and `max_unlabelled` other texts teach, those of
    the least hashes of the text. Equal texts teach once, whatever their ids (null too), and
    an id's texts each: so both bounds hold at every size of the tables, and no repeated id or
    text takes the place of others. Trusted are the texts of up to `max_positive` positive
    ids. Negative labels are not used, the class prior is estimated without them too, among
    different texts.
    """
    taught = labels.where(~held_out(folds)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    trusted = taught.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_positive).select(F.col("doc_id").alias("trusted_id"))
    order = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed))
    drawn = docs.where(~held_out(folds)).select("doc_id", "text", order.alias("hash")).join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull())

    def sample(parts: int) -> DataFrame:
        """A row a text: of trusted ids, and one of `parts` texts."""
        chosen = drawn.withColumn("other", F.pmod("hash", F.lit(parts)) == 0).where("trusted OR other")
        counted = document_counts(chosen, "hash", "trusted", "other")
        once = counted.groupBy("hash").agg(F.bool_or("trusted").alias("trusted"), F.bool_or("other").alias("other"), *(F.max(c).alias(c) for c in COUNTS))
        return stored(once, "quality-sample")

    # Twice the texts that are needed; if many are equal, more parts of them are looked at.
    parts = max(1, docs.count() // (2 * max_unlabelled))
    found = sample(parts)
    while parts > 1 and found.where("other").count() < max_unlabelled:
        discard(found)
        parts //= 4
        found = sample(max(1, parts))

    def least(side: str, most: int) -> np.ndarray:
        return found.where(side).orderBy("hash").limit(most).select(*COUNTS).toPandas().to_numpy()

    # In the order of hashes, so that reruns fit the same model.
    positive, unlabelled = least("trusted", max_positive), least("other", max_unlabelled)
    discard(found)
    if not len(positive) or not len(unlabelled):
        return None
    return fit_positive_unlabelled(positive, unlabelled, estimate_prior(positive, unlabelled))


def score_quality(docs: DataFrame, model: QualityModel | None, *keep: str) -> DataFrame:
    """The kept columns and score."""
    source = texts(docs, *keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            scores = model.score(np.array([text_counts(r, hashes) for r in each(batch, "raw")])) if model and len(batch) else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "raw")
    return source.mapInArrow(score, fields + ", score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, train_quality(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
