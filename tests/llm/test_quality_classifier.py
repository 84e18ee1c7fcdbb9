import math
import zlib

import numpy as np
import pytest

from millrace.llm import quality_classifier as q


@pytest.fixture
def tables(spark, documents, prose, tmp_path):
    clean = [(i, prose(i, 30 + i % 100)) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "***" for w in prose(i).split())) for i in range(80)]
    labels = [(i, 1) for i, _ in clean if i % 2] + [(i, 0) for i, _ in junk if i % 2]
    sf = documents([*clean, *junk, (5000, None), (5001, ""), clean[3]])
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 AS toxic", "'x' AS text").write.parquet(f"{sf}/labels.parquet")
    return sf, dict(labels)


def test_held_out_accuracy_and_columns(spark, tables):
    sf, labels = tables
    rows = q.op10_quality_classifier(spark, sf).collect()
    assert len(rows) == 400 + 80 + 3
    got = {r["doc_id"]: r for r in rows}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_teach_nothing(spark, tables):
    sf, labels = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = table.withColumn("quality", q.F.when(q.held_out(), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    a, b = q.train_quality(docs, table), q.train_quality(docs, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_without_positives_and_empty(spark, documents):
    sf = documents([(1, "a b"), (2, None)])
    spark.createDataFrame([(1, 0)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert {r["score"] for r in q.op10_quality_classifier(spark, sf).collect()} == {0.5}
    sf = documents([], "none")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert q.op10_quality_classifier(spark, sf).count() == 0


def test_risk_and_its_gradient_by_hand():
    draw = np.random.default_rng(4)
    p, u = draw.normal(1, 1, (40, 3)), draw.normal(0, 1, (60, 3))
    loss = lambda z: math.log(1 + math.exp(-z))
    seen = set()
    for prior in (0.2, 0.5, 0.9):
        for k in range(20):
            w = draw.normal(0, 1 + k % 4, 3)
            positive = sum(loss(w @ x) for x in p) / len(p)
            negative = sum(loss(-w @ x) for x in u) / len(u) - prior * sum(loss(-w @ x) for x in p) / len(p)
            value, part, down = q.risk(w, p, u, prior)
            assert value == pytest.approx(prior * positive + max(0, negative)) and part == pytest.approx(negative)
            f = (lambda v: q.risk(v, p, u, prior)[0]) if negative >= 0 else (lambda v: -q.risk(v, p, u, prior)[1])
            slope = [(f(w + e) - f(w - e)) / 2e-6 for e in 1e-6 * np.eye(3)]
            assert down == pytest.approx(slope, abs=1e-4)
            seen.add(negative >= 0)
    assert seen == {True, False}


def test_prior_is_found_without_negatives(prose):
    hashes = q.WordHashes()
    good = lambda i: q.text_counts(prose(i, 30 + i % 100).encode(), hashes)
    bad = lambda i: q.text_counts(" ".join(w + "***" for w in prose(i, 60).split()).encode(), hashes)
    positive = np.array([good(i) for i in range(600)])
    for share in (0.9, 0.6, 0.3):
        n = int(800 * share)
        mixed = np.array([good(5000 + i) for i in range(n)] + [bad(i) for i in range(800 - n)])
        np.random.default_rng(1).shuffle(mixed)
        assert abs(q.estimate_prior(positive, mixed) - share) < 0.08


def test_rows_without_id_and_long_texts(spark, documents, prose):
    sf = documents([(None, prose(1)), (None, None), (3, "word " * 100_000), *((i, prose(i)) for i in range(10, 60))])
    spark.createDataFrame([(i, 1) for i in range(10, 40)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    rows = q.op10_quality_classifier(spark, sf).collect()
    assert len(rows) == 53 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    again = {(r["doc_id"], r["score"]) for r in q.op10_quality_classifier(spark, sf).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}


def test_bounds_are_of_texts_and_repeats_take_no_place(spark, monkeypatch):
    shapes = []
    monkeypatch.setattr(q, "estimate_prior", lambda p, u: 0.5)
    monkeypatch.setattr(q, "fit_positive_unlabelled", lambda p, u, prior: shapes.append((len(p), len(u))))
    free = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5][:1_200]
    # One trusted id on 3 000 rows of as many texts; a third of all ids null; one text 3 000 times.
    rows = [(free[0], f"hot {i}") for i in range(3_000)] + [(None, f"none {i}") for i in range(3_000)] + [(i, "the same") for i in free[:100] * 30] + [(i, f"text {i}") for i in free[1:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in free[:21]], "doc_id long, quality int")
    for most in ((10, 1_000), (10_000, 100_000), (5_000, 300)):
        q.train_quality(docs, labels, max_positive=most[0], max_unlabelled=most[1])
    # Of 21 trusted ids: 3 000 texts, 20 texts of their own and the one they share.
    assert shapes == [(10, 1_000), (3_021, 7_200), (3_021, 300)]
