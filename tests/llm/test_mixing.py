import random
import re
from collections import defaultdict

import pytest

from millrace.llm import mixing as m


def targets_by_hand(sizes):
    """Reshare the excess by weight until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_mix(spark, documents, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(900):
        source = draw.choice(["a", "b", "é", None, "big", "big", "big", "z"])
        rows.append((i, draw.choice([None, ""]) if i % 90 == 0 else " ".join("w" * draw.randrange(1, 60)), "en", source))
    rows += [rows[5]] * 3
    sf = documents(rows)
    got = m.op6_mixing(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, m.op6_mixing(spark, sf).collect()), key=repr)
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sizes, largest = defaultdict(int), defaultdict(int)
    for i, _, _, s in rows:
        sizes[s] += size[i]
        largest[s] = max(largest[s], size[i])
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in got:
        s = r["source"]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_many_levels_and_one_hot_source(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 17 AS int)) AS text", "if(id % 50 = 0, 'b', 'a') AS source")
    got = m.mix_sources(docs, weights=(1.0, 3.0), fan=4).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1e-6


def test_expectation_is_kept(spark):
    """Over many seeds each document is taken about as often as its share says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    taken = defaultdict(int)
    for seed in range(12):
        for r in m.mix_sources(docs, seed=seed, fan=8).where("source = 'b'").collect():
            taken[r["doc_id"]] += r["copies"]
    mean = sum(taken.values()) / len(taken) / 12
    assert 0.2 < mean < 1.8
    assert all(0 < n < 24 for n in taken.values()) or len(set(taken.values())) > 2


def test_many_rows_without_id(spark):
    """Equal rows are numbered in blocks."""
    docs = spark.range(20_000).selectExpr("cast(null AS long) AS doc_id", "'w' AS text", "'a' AS source").unionByName(spark.createDataFrame([(1, "w w", "b")], "doc_id long, text string, source string"))
    got = m.mix_sources(docs, weights=(3.0, 1.0)).groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert {r["source"]: r["count(1)"] for r in got} == {"a": 20_000, "b": 1}
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)
    numbers = m._numbered(spark.createDataFrame([(1, 10), (2, 1)], "doc_id long, n long"), block=3)
    assert sorted((r["doc_id"], r["k"]) for r in numbers.collect()) == [(1, k) for k in range(1, 11)] + [(2, 1)]


def test_plain_expressions_only(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert not any(w in m.mix_sources(docs)._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


def test_empty(spark, documents):
    assert m.op6_mixing(spark, documents([])).count() == 0
    assert [r["taken"] for r in m.op6_mixing(spark, documents([(1, None), (2, "")])).collect()] == [0, 0]
