import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_rules as q
from millrace.llm import work


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines, dup, known = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in known
            known.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_counts_against_brute_force(spark, documents, prose):
    texts = [None, "", "   \n\t ", "a b c d e f g h i j", "one two three four five " * 6, "é ü\u00a0x\u2003y \x1c z " * 3 + "##$ <b>|", "same line here\nsame line here\n\n \nother", "x " * 20000 + "end", prose(1), prose(1), prose(2) + "\n" + prose(2)]
    rows = [(i, t, ("en", None, "de")[i % 3], (None, "s")[i % 2]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in q.op4_quality_rules(spark, documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == by_hand(t), t and t[:40]
        assert not (r["base_failed"] and r["kept"])


def test_outliers_go_and_clean_documents_stay(spark, documents, prose):
    clean = [(i, prose(i, 40 + i % 200), ("en", "de")[i % 2], "s") for i in range(600)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i).split()), ("en", "de")[i % 2], "s") for i in range(40)]
    shout = [(2000 + i, prose(i).upper(), ("en", "de")[i % 2], "s") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in q.op4_quality_rules(spark, documents(clean + junk + shout)).collect()}
    assert sum(got[i] for i, *_ in clean) >= 0.99 * len(clean)
    assert not any(got[i] for i, *_ in junk + shout)


def test_large_shares_of_copies(spark, documents, prose):
    clean = [(i, prose(i, 40 + i % 200), "en", "s") for i in range(300)]
    mark = lambda t: " ".join(w + "###" for w in t.split())
    junk = [(1000 + i, mark(prose(7)), "en", "s") for i in range(140)]  # copies of one junk text: 30 %
    varied = [(2000 + i, prose(3000 + i, 40 + i % 200), "de", "s") for i in range(300)]
    noise = [(3000 + i, mark(prose(i)), "de", "s") for i in range(180)]  # junk texts: 37 %
    plain = [(4000 + i, prose(6000 + i, 80 + i % 40), "fr", "s") for i in range(200)]
    long = [(5000 + i, prose(9, 1000), "fr", "s") for i in range(800)]  # copies of one clean text: 80 %
    few = [(6000, mark(prose(8)), None, None), (6001, prose(5, 90), None, None)]  # too few for any pool
    rows = clean + junk + varied + noise + plain + long + few
    got = {r["doc_id"]: r["kept"] for r in q.op4_quality_rules(spark, documents(rows)).collect()}
    assert len(got) == len(rows)
    assert not any(got[i] for i, *_ in junk + noise) and not got[6000]
    for group in (clean, varied, plain):
        assert sum(got[i] for i, *_ in group) >= 0.97 * len(group)
    assert got[6001]


def test_empty(spark, documents):
    assert q.op4_quality_rules(spark, documents([])).count() == 0


def test_concentration_against_numpy(spark, prose):
    """From the same starts: determinants fall until they stop, and to the same values."""
    texts = [(i, prose(i, 40 + i % 160) if i % 4 else " ".join(w + "##" for w in prose(i).split())) for i in range(160)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string")
    names, floors = list(q.FEATURES), list(q.FEATURES.values())
    salt = F.pmod(F.xxhash64(*names), F.lit(q.SALTS)).cast("int")
    vectors = work.stored(q._features(q.document_counts(docs, "doc_id")).select(F.lit("g").alias("grp"), salt.alias("salt"), *names), "test-vectors")
    x = np.array([[r[c] for c in names] for r in vectors.collect()])
    current = work.stored(q._start(vectors, names, floors, True), "test-start")
    by_hand = {r["start"]: (np.array(r["centre"]), np.array(r["precision"]).reshape(7, 7)) for r in current.collect()}
    assert len(by_hand) == 3
    last = dict.fromkeys(by_hand, np.inf)
    for i in range(4):
        current = work.stored(q._concentrate(vectors, current, names, floors, 0.5, i % 2 == 0), "test-step", rows=3)
        for r in current.collect():
            centre, precision = by_hand[r["start"]]
            d2 = np.einsum("ij,jk,ik->i", x - centre, precision, x - centre)
            near = x[np.argsort(d2, kind="stable")[: len(x) // 2]]
            cov = np.cov(near.T, bias=True)
            cov = cov + np.diag(np.maximum(np.square(floors) - np.diag(cov), 0) + 1e-3 * np.square(floors))
            by_hand[r["start"]] = near.mean(axis=0), np.linalg.inv(cov)
            assert r["logdet"] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6)
            assert r["logdet"] <= last[r["start"]] + 0.05  # the floors of deviations may lift it a little
            last[r["start"]] = r["logdet"]


def test_many_groups_are_joined_by_salts(spark, documents, prose):
    rows = [(i, prose(i, 40 + i % 200) if i % 9 else " ".join(w + "##" for w in prose(i).split()), ("en", None)[i % 2], "s") for i in range(500)]
    counted = q.document_counts(spark.read.parquet(documents(rows) + "/documents.parquet"), "doc_id", "lang", "source")
    few, many = ({r["doc_id"]: r["kept"] for r in q.mark_outliers(counted, sent_groups=n).collect()} for n in (10_000, 0))
    assert few == many


def test_null_ids_and_very_long_texts(spark, documents, prose):
    rows = [(i, prose(i, 40 + i % 100), None, None) for i in range(150)] + [(None, prose(7), None, None), (None, None, None, None), (900, prose(1, 60_000), "en", None), (901, "a" * 300_000, "en", None)]
    got = q.op4_quality_rules(spark, documents(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] is not None for r in got)
