import re

import corpus_pipeline


def test_stages_take_effect(spark, documents, prose):
    clean = [(i, prose(i, 40 + i % 100), "en", "ab"[i % 2]) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i).split()), "en", "a") for i in range(20)] + [(1100, "too short", "en", "a")]
    copies = [(2000 + i, clean[i][1], "en", "b") for i in range(30)]
    leak = prose(9000, 30)
    leaks = [(3000 + i, prose(700 + i, 60) + " " + leak + " " + prose(800 + i, 60), "en", "a") for i in range(10)]
    secret = [(4000, prose(900, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(901, 60), "en", "b")]
    sf = documents([*clean, *junk, *copies, *leaks, *secret])
    spark.createDataFrame([(1, leak), (2, prose(9001, 30))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        after[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == "mixing"
    rules, join, decontaminated, scanned, mixed = after.values()
    assert not any(r[0] in rules for r in junk)
    assert len(rules) >= 0.98 * (len(clean) + len(copies) + len(leaks) + 1)
    assert not any(r[0] in join for r in copies if r[0] - 2000 in rules)
    assert all(r[0] in join for r in leaks if r[0] in rules)
    assert set(decontaminated) == set(join) - {r[0] for r in leaks}
    assert set(scanned) == set(decontaminated) == set(mixed)
    assert "24be64439e3e49" not in scanned[4000]["text"] and "[SECRET]" in scanned[4000]["text"]
    assert scanned[4000]["n_chars"] == len(scanned[4000]["text"])
    assert all(scanned[i]["text"] == decontaminated[i]["text"] for i in scanned if i != 4000)
    assert all(r["size"] == len(re.findall(r"\S+", scanned[i]["text"])) for i, r in mixed.items())
    assert {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, sf).collect()} == {(i, r["taken"]) for i, r in mixed.items()}


def test_near_copies_by_five_words(spark, documents, prose):
    words = prose(1, 200).split()
    changed = [w + "x" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]  # 176 of 216 five-word shingles, 186 of 210 three-word ones
    other = prose(2, 50).split()
    near = [*other[:25], "swapped", *other[26:]]  # 41 of 51, 45 of 51
    apart = [w + "x" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]  # 171 of 221 with the first
    sf = documents([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join(near)), (5, " ".join(apart))])
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]


def test_a_verdict_holds_for_its_row_only(spark, documents, prose):
    leak = prose(9000, 30)
    texts = [prose(1), prose(2), "too short", prose(3) + " " + leak]
    sf = documents([*((None, t, "en", "a") for t in texts), *((7, t + " more", "en", "a") for t in texts)])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = lambda stage: sorted((r["doc_id"] or 0, r["text"]) for r in stage(spark, docs, sf).collect())
    rows = lambda *left_out: sorted((i, texts[k] + more) for i, more in ((0, ""), (7, " more")) for k in range(4) if k not in left_out)
    assert kept(corpus_pipeline.quality_rules) == rows(2)
    assert kept(corpus_pipeline.benchmark_decontamination) == rows(3)
    assert kept(corpus_pipeline.ngram_jaccard_join) == rows()


def test_empty(spark, documents):
    sf = documents([])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
