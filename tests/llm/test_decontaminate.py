import random

import pytest

from millrace.llm import decontaminate as d


def leaks_by_hand(docs, items):
    out = set()
    for i, text in docs:
        words = d.terms((text or "").encode())
        for item, t in items:
            parts = d.question_and_answer((t or "").encode())
            shares = []
            for part in parts:
                k = min(5, len(part))
                runs = {tuple(part[j : j + k]) for j in range(len(part) - k + 1)}
                have = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
                shares.append(len(runs & have) / len(runs))
            if shares and min(shares) >= 0.8:
                out.add((i, item))
    return out


@pytest.fixture
def tables(spark, documents, prose):
    items = [(i, prose(1000 + i, 12 + i % 50)) for i in range(40)] + [(90, None), (91, ""), (92, prose(2000, 10) + " why? " + prose(2001, 10)), (0, prose(1000, 12))]
    docs = [(i, prose(i, 400)) for i in range(60)]
    for i in range(0, 60, 2):
        item = items[i % 40][1]
        at = random.Random(i).randrange(2000)
        docs[i] = (i, docs[i][1][:at] + " " + (item.upper() if i % 4 else item.replace("\n", ", ")) + " " + docs[i][1][at:])
    words = items[30][1].split()
    docs += [(100, " ".join(words[: len(words) // 2])), (101, None), (102, ""), (103, items[92 - 50][1]), (104, prose(2000, 10) + " why? " + "else " * 10), docs[0]]
    docs.append((105, " ".join([*words[:20], "changed", *words[21:]])))
    docs.append((106, ("filler words here " * 8000) + items[7][1]))
    sf = documents(docs)
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS length").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, items


def test_against_brute_force(spark, tables):
    sf, docs, items = tables
    got = d.op7_decontaminate(spark, sf).collect()
    want = leaks_by_hand(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(want) >= 25
    assert all(0.6 <= r["score"] <= 1.000001 and r["overlap"] >= 0.8 for r in got)


def test_shards_give_the_same(spark, tables):
    sf, docs, items = tables
    df, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.find_leaks(df, bench).collect()}
    for max_items, max_sent in ((10, 20_000), (1, 25)):
        many = {(r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.find_leaks(df, bench, max_items=max_items, max_sent=max_sent).collect()}
        assert one == many


def test_a_long_item_changes_nothing_for_others(spark, prose):
    """Halves of an item far apart are no leak, beside a long item or not."""
    item, long = prose(1, 40), prose(2, 3000)
    words = item.split()
    apart = " ".join([*words[:20], prose(3, 300), *words[20:]])
    docs = spark.createDataFrame([(1, apart), (2, prose(4, 50) + " " + item), (3, long), (4, prose(5, 100))], "doc_id long, text string")
    alone = d.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    beside = d.find_leaks(docs, spark.createDataFrame([(7, item), (8, long)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in alone} == {(2, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in beside.collect()} == {(2, 7), (3, 8)}


def test_rows_without_ids(spark, prose):
    items = spark.createDataFrame([(None, prose(1, 30)), (None, prose(2, 30)), (3, prose(3, 30)), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, "so " + prose(1, 30)), (5, prose(2, 30)), (6, prose(3, 30)), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, items, max_items=1).collect()), key=repr)
    assert got == sorted([(None, None), (5, None), (6, 3)], key=repr)


def test_wand_against_all_scores(prose):
    rows = [(i, prose(i, 30)) for i in range(300)]
    df = d.Counter(t for _, x in rows for t in set(d.terms(x.encode())))
    index = d.build_index(rows, df, len(rows), 30.0, 32, block=8)
    for seed in range(40):
        query = set(d.terms(prose(seed, 30).encode())) | set(d.terms(prose(seed + 900, 60).encode()))
        for threshold in (0.05, 0.1, 0.3, 0.9):
            scores = d.defaultdict(float)
            for t in query & index.postings.keys():
                for item, v in zip(*index.postings[t], strict=True):
                    scores[int(item)] += float(v)
            want = {i for i, s in scores.items() if s >= threshold - 1e-9}
            got = d.wand(index, query, threshold)
            assert {i for i, _ in got} == want
            assert all(abs(s - scores[i]) < 1e-9 for i, s in got)


def test_empty(spark, tables, documents):
    sf, docs, items = tables
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert d.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert d.find_leaks(df.limit(0), spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
