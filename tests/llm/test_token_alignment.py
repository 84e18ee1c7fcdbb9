import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import token_alignment as m
from millrace.llm import tokens

ODD = ["a", "B", " ", "  ", "\n", "\t", "'s", "<s>", "</s>", "<|endoftext|>", "<0x41>", "▁", "é", "é", "日本", "1234", "ﬁ", "　", "\xa0", "\x85", " ", "\x1c", "—", "“x”", "\x00", "\U0001f600", "﻿", "the", " of", "ing", "..."]


def strange(n, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(12))) for _ in range(n)]


@pytest.fixture(scope="module")
def by_hand():
    """Tokens of whole texts, and where they end, without cutting anything."""
    a = Tokenizer.from_file(P.path(m.A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path(m.B))
    spelt = {c: i for i, c in enumerate(bytes_as_shown())}

    def tokens_of(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(spelt[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        return ids_a, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()

    return tokens_of


def bytes_as_shown():
    """Printable characters stand for themselves, the others count up from 256."""
    shown, extra = [], 256
    for i in range(256):
        if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174:
            shown.append(chr(i))
        else:
            shown.append(chr(extra))
            extra += 1
    return shown


def results_by_hand(rows, tokens_of):
    links, found = {}, {}
    for doc, text in rows:
        t = tokens_of(text or "")
        if t is None:
            found[doc], links[doc] = (0, 0, 0, 0, ""), []
            continue
        ids_a, ends_a, ids_b, ends_b = t
        links[doc] = [(x, y) for x, i in zip(ids_a, ends_a) for y, j in zip(ids_b, ends_b) if i == j]
        groups, before = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(x) for x, i in zip(ids_a, ends_a) if before < i <= end) + "|" + ",".join(str(y) for y, j in zip(ids_b, ends_b) if before < j <= end))
            before = end
        found[doc] = len(ids_a), len(ids_b), len(groups), len(links[doc]), hashlib.sha256(";".join(groups).encode()).hexdigest()
    counts = Counter(p for some in links.values() for p in some)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return {d: (*found[d][:4], sum(counts[p] == best[p[1]] for p in links[d]), sum(counts[p] for p in links[d]), found[d][4]) for d in found}


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


def test_against_brute_force(spark, documents, by_hand, prose):
    texts = [None, "", " ", "x", prose(1), prose(1), prose(2) + " ▁ " + prose(3), *strange(300), *(prose(i, n=20) for i in range(40))]
    rows = list(enumerate(texts)) + [(9000, prose(7, n=400))]
    got = rows_of(m.op11_token_alignment(spark, documents(rows)))
    assert got == results_by_hand(rows, by_hand)


def test_long_texts_by_segments(spark, documents, by_hand, prose, monkeypatch):
    """Cut into segments and pieces of any size, a text gives the same."""
    aligner = m.Aligner(m.A, m.B)
    text = "  ".join([prose(5, n=300), *strange(40, 5), prose(6, n=300)]).replace("▁", "")
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    parts = list(aligner.of([("k", text.encode())]))
    assert len(parts) > 20 and [p[-1] for p in parts] == [False] * (len(parts) - 1) + [True]
    ids_a, _, ids_b, _ = by_hand(text)
    assert [int(x) for p in parts for x in p[1]] == ids_a and [int(x) for p in parts for x in p[2]] == ids_b
    want = results_by_hand([(1, text)], by_hand)[1]
    sha, written = hashlib.sha256(), b"".join(m.written_groups(*p[1:5], len(aligner.length_a), aligner.n_b) for p in parts)
    sha.update(written[:-1])
    assert sha.hexdigest() == want[-1] and sum(len(p[3]) for p in parts) == want[2]


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_merge_path(work):
    draw = random.Random(work)
    for _ in range(200):
        top = draw.randrange(1, 60)
        a, b = (np.array(sorted({*draw.sample(range(1, top + 1), draw.randrange(top)), top})) for _ in "ab")
        i, j = m.crossings(a, b, work)
        assert all(x + y == min(k * work, len(a) + len(b)) for k, (x, y) in enumerate(zip(i[:-1], j[:-1]))) and (i[-1], j[-1]) == (len(a), len(b))
        x, y = m.common_ends(a, b, work)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[x - 1].tolist() == b[y - 1].tolist() == both


def test_rounds_of_pairs(spark, documents, prose):
    """Pairs that are sent in many rounds give what one round gives."""
    docs = spark.read.parquet(documents([(i, prose(i % 7, n=30)) for i in range(30)]) + "/documents.parquet")
    aligned = m.stored(m.align_documents(docs), "t-aligned")
    counts = m.stored(m.count_pairs(aligned, len(m.piece_spellings(m.B))), "t-counts")
    one, many = (sorted(map(tuple, m.score_links(aligned, counts, at_once=n).collect())) for n in (10**6, 40))
    assert one == many and counts.count() > 80


def test_pairs_of_a_task_beyond_its_bound():
    """Counts given in parts are the same counts."""
    codes = [np.unique(np.random.default_rng(k).integers(0, 500, 80).astype(np.uint64)) for k in range(20)]
    batch = pa.record_batch([pa.array([m.pack_sorted(c) for c in codes]), pa.array([m.pack(np.full(len(c), 2, np.uint32)) for c in codes])], ["pairs", "times"])
    total = Counter()
    for out in m._pair_counts(iter([batch]), most=100):
        for p, n in zip(out["pair"].to_pylist(), out["n"].to_pylist()):
            total[p] += n
    assert total == Counter({int(x): 2 * n for x, n in Counter(x for c in codes for x in c.tolist()).items()})


def test_real_output_and_odd_rows(spark, documents, by_hand):
    rows = [(None, "plain words here"), (None, None), (1, "plain words here"), (2, "a▁b")]
    sf = documents(rows)
    docs = spark.read.parquet(sf + "/documents.parquet")
    groups = {(r["doc_id"], r["segment"]): r for r in m.token_groups(docs).collect() if r["a_ids"]}
    ids_a, _, ids_b, _ = by_hand("plain words here")
    assert groups[1, 0]["a_ids"] == ids_a and groups[1, 0]["b_ids"] == ids_b
    assert groups[1, 0]["a_ends"][-1] == len(ids_a) and groups[1, 0]["b_ends"][-1] == len(ids_b)
    got = sorted((r["n_a"], r["count_sum"]) for r in m.op11_token_alignment(spark, sf).collect())
    assert [n for n, _ in got] == [0, 0, len(ids_a), len(ids_a)] and got[-1][1] == 2 * len(groups[1, 0]["a_ends"])
    assert m.op11_token_alignment(spark, documents([], "none")).count() == 0
