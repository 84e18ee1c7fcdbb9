import random

import numpy as np
import pytest

from millrace.llm import jaccard_join as j
from millrace.llm.components import components


def shingles(text, size=3):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes_by_hand(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for k, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= 90 * (len(x) + len(y) - both):
                u, v = sorted((find(i), find(k)))
                root[v] = u
    return {i: (len(s), find(i)) for i, s in sets}


def near(text, changes, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def docs(prose):
    out = [(i, prose(i, 20 + i)) for i in range(120)]
    base, long_base = prose(500, 150), prose(501, 900)
    out += [(1000 + i, near(base, i % 9, i)) for i in range(150)]  # one large group of near copies, no base
    out += [(2000 + i, near(long_base, i % 40, i)) for i in range(60)]
    out += [(3000 + i, prose(600 + i, 40) + "\n" + prose(502, 50)) for i in range(80)]  # a shared passage
    out += [(4000 + i, base) for i in range(30)]
    out += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "one two three"), (5007, "a b c d e f g h i j k"), (5008, "a b c d e f g h i j k l"), (5009, "the the the the the the"), (5010, "word " * 30000)]
    return out


def test_against_brute_force(spark, documents, docs, monkeypatch):
    rows = [*docs, docs[5], docs[1001 - 880]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.op5_ngram_jaccard(spark, documents(rows)).collect()}
    assert got == classes_by_hand(docs)


def test_small_blocks_and_frequent_classes_give_the_same(spark, documents, docs, monkeypatch):
    """Every shingle of several sets is of the frequent class; blocks hold three sets."""
    monkeypatch.setattr(j, "_threshold", lambda counters: 1)
    df = spark.read.parquet(documents(docs) + "/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.link_similar(df, block=3).collect()}
    assert got == classes_by_hand(docs)


def test_row_without_id_stays_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "x")], "doc_id long, text string")
    got = sorted(map(tuple, j.link_similar(df).collect()), key=repr)
    assert got == sorted([(None, 3, None), (1, 3, 1), (2, 3, 1), (None, 1, None)], key=repr)
    kept = j.keep_one_of_each(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([None, None, 1], key=repr)


def test_keep_one_of_each(spark, documents, docs):
    rows = [*docs, docs[3], docs[3]]
    df = spark.read.parquet(documents(rows) + "/documents.parquet")
    kept = j.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in classes_by_hand(docs).items() if c == i)


def test_empty(spark, documents):
    assert j.op5_ngram_jaccard(spark, documents([])).count() == 0
    got = j.op5_ngram_jaccard(spark, documents([(1, None), (2, "")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(40)] + [(7, 7), (500, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for _ in range(200):
        for u, v in edges:
            m = min(root.get(u, u), root.get(v, v))
            root[u] = root[v] = m
    assert all(got.get(x, x) == r for x, r in root.items())


def test_bitmap_bound():
    draw = np.random.default_rng(2)
    for _ in range(50):
        x = np.unique(draw.integers(0, 2**64, 300, np.uint64))
        y = np.unique(np.concatenate([x[draw.random(len(x)) < 0.9], draw.integers(0, 2**64, 20, np.uint64)]))
        differ = sum(int(a ^ b).bit_count() for a, b in zip(j._bitmap(x).view(np.uint64), j._bitmap(y).view(np.uint64), strict=True))
        assert differ <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("percent", [75, 80, 90])
def test_sets_that_link_share_a_signature(percent):
    """At any line between rare and frequent, and any counts."""
    draw, linked = np.random.default_rng(percent), 0
    for round_ in range(1500):
        n = int(draw.integers(1, 30 if round_ % 2 else 400))
        x = np.unique(draw.integers(0, 2**64, n, np.uint64))
        lose = draw.random(len(x)) < draw.uniform(0, 1 - percent / 100)
        y = np.unique(np.concatenate([x[~lose], draw.integers(0, 2**64, int(draw.integers(0, len(x) // 8 + 2)), np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not common or 100 * common < percent * (len(x) + len(y) - common) or len(x) == len(y) == common:
            continue
        linked += 1
        count = lambda s: (s >> np.uint64(7)).astype(np.int64) % 50
        for frequent in (-1, 10, 25, 60):
            a, b = (j.prefix_signatures(s, count(s), frequent, percent) for s in (x, y))
            shared, at_a, at_b = np.intersect1d(a[0], b[0], return_indices=True)
            assert len(shared)
            # Some shared signature leaves both the overlap that they have.
            assert ((a[1][at_a] >= common) & (b[1][at_b] >= common)).any()
            assert len(a[0]) <= 4 * len(x) * (100 - percent) / 100 + 6
    assert linked > 300


def test_partners_of_a_signature():
    draw, pa = np.random.default_rng(3), j.pa
    n = draw.integers(5, 60, 4000)
    rows = pa.table({"sig": draw.integers(0, 900, 4000), "fp": draw.integers(0, 3000, 4000), "n": n.astype(np.int32), "room": (n - draw.integers(0, 4, 4000)).astype(np.int32)})
    rows = rows.set_column(2, "n", pa.array((rows["fp"].to_numpy() % 50 + 10).astype(np.int32))).set_column(3, "room", pa.array((rows["fp"].to_numpy() % 50 + 10 - rows["fp"].to_numpy() % 3).astype(np.int32)))
    kept = {(r["sig"], r["fp"]) for r in rows.take(j._with_partner(rows, 80)).to_pylist()}
    want = set()
    for sig in range(900):
        group = {r["fp"]: r for r in rows.to_pylist() if r["sig"] == sig} if sig < 60 else {}
        for x in group.values():
            if any(x["fp"] != y["fp"] and 100 * min(x["n"], y["n"]) >= 80 * max(x["n"], y["n"]) and 180 * min(x["room"], y["room"]) >= 80 * (x["n"] + y["n"]) for y in group.values()):
                want.add((sig, x["fp"]))
    assert want <= {k for k in kept if k[0] < 60}
    assert len(kept) == len(rows.take(j._with_partner(rows, 80)))


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError, match="75"):
        j.link_similar(spark.createDataFrame([], "doc_id long, text string"), percent=60)
