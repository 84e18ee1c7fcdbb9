import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import tokens
from millrace.llm import window_packing as m

ODD = ["a", "B", " ", "'", "s", "'s", "'LL", "İ", "I", "̇", "J̌", "́", "<", ",", ".", "<|startoftext|>", "<|STARTOFTEXT|>", "<|endoftext|>", "\n", "\t", " ", "　", "é", "É", "ß", "σ", "Σ", "日", "1", "23", "½", "—", "\x1c", "\x85", "z!", "''", "ﬁ", "ǅ", "ſ", "K", "—,", "a,'s"]


@pytest.fixture(scope="module")
def direct():
    known = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: [*known.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, direct, window=2048):
    """Every id of every document lies in one piece, and windows have no gaps."""
    want = {doc: direct(text) for doc, text in rows}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            ids = want[doc][at : at + r["length"]]
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r["length"]
        assert at == len(want[doc])
    fills = []
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        fills.append(at)
    return fills


def test_all_documents(spark, documents, prose, direct):
    draw = random.Random(5)
    texts = [None, "", "x", prose(1, n=9000), *("".join(draw.choice(ODD) for _ in range(draw.randrange(14))) for _ in range(300)), *(prose(i, n=draw.randrange(1, 2500)) for i in range(120))]
    rows = list(enumerate(texts))
    sf = documents(rows)
    got = m.op13_ss_packing(spark, sf).collect()
    fills = check(rows, got, direct)
    tasks = spark.read.parquet(sf + "/documents.parquet").rdd.getNumPartitions()
    assert sum(f < 2048 for f in fills) <= tasks
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, m.op13_ss_packing(spark, sf).collect()), key=repr)


def test_null_ids_and_repeated_rows(spark, documents, prose):
    got = m.op13_ss_packing(spark, documents([(None, prose(1)), (None, None), (7, prose(2)), (7, prose(2))])).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == 2 * max(r["doc_tokens"] for r in got if r["doc_id"] == 7)
    assert any(r["doc_id"] is None and r["doc_tokens"] == 1 for r in got)
    assert m.op13_ss_packing(spark, documents([], "none")).count() == 0


def test_words_in_any_cut(direct, monkeypatch):
    """Ids do not depend on segments, blocks, or what is remembered."""
    draw = random.Random(6)
    monkeypatch.setattr(tokens, "SEGMENT", 9)
    monkeypatch.setattr(tokens, "BLOCK", 30)
    monkeypatch.setattr(tokens, "LIMIT", 4)
    texts = ["".join(draw.choice(ODD) for _ in range(draw.randrange(40))) for _ in range(400)]
    got = defaultdict(list)
    for key, ids, _ in tokens.WordTokens("word_bpe_49k.json").of((i, t.encode()) for i, t in enumerate(texts)):
        got[key] += ids.tolist()
    assert [[*got[i], 1] for i in range(400)] == [direct(t) for t in texts]


def test_level_is_the_least_sum_of_squares():
    draw = random.Random(7)
    packer = m.Packer(12)
    for k in range(3000):
        size = draw.randrange(1, 12)
        level, counts = packer.level_for(size), packer.levels.tolist()

        def after(h):
            n = list(counts)
            if h:
                n[h] -= 1
            if h + size < 12:
                n[h + size] += 1
            return sum(x * x for x in n)

        fits = [h for h in range(12 - size + 1) if h == 0 or counts[h]]
        assert level == max(fits, key=lambda h: (-after(h), h))
        packer.put([k, 0, np.zeros(size, "<u4")])
        assert all(len(packer.open[h]) == n for h, n in enumerate(packer.levels.tolist()) if h)


def test_open_windows_are_bounded():
    """Texts of one length that does not divide a window: nothing is lost, one stays open."""
    packer = m.Packer(100)
    pieces = [[k, 0, np.full(60, k, "<u4")] for k in range(500)]
    full = []
    for piece in pieces:
        full += [x for x in [packer.put(piece)] if x]
        if packer.n_open() > 40:
            full += packer.close(20)
            assert packer.n_open() <= 20
    full += packer.close(1)
    rest = list(packer.rest())
    assert len(rest) <= 1 and all(sum(len(p[2]) for p in x) == 100 for x in full)
    taken = defaultdict(list)
    for doc, start, ids in (p for x in full + rest for p in x):
        assert set(ids.tolist()) == {doc}
        taken[doc] += range(start, start + len(ids))
    assert {d: sorted(x) for d, x in taken.items()} == {k: list(range(60)) for k in range(500)}
