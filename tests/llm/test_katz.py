import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from millrace.llm import katz as k_
from millrace.llm.packing import pack, pack_sorted, unpack, unpack_sorted


def model_by_hand(texts, teach, order):
    """p(context, word) from counts of whole n-grams; contexts are tuples of order - 1 words."""
    tokens = {i: [*(t or "").encode().lower().split(), "</s>"] for i, t in texts}
    padded = lambda i: ["<s>"] * (order - 1) + tokens[i]
    grams = []
    for k in range(1, order + 1):
        grams.append(Counter(tuple(padded(i)[j - k + 1 : j + 1]) for i in teach for j in range(order - 1, len(padded(i)))))
    ratio = lambda c: dict(enumerate(k_.Discounts.of([c.total(), len(c), *(Counter(c.values())[r] for r in range(1, 7))]).ratios[1:].tolist(), 1))
    off = [ratio(c) for c in grams]
    kept1 = {w: off[0].get(n, 1) * n for (w,), n in grams[0].items()}
    total = grams[0].total()
    if total - sum(kept1.values()) <= 1e-12:
        total += 1
    p1 = {w: n / total for w, n in kept1.items()}
    unknown = 1 - sum(p1.values())
    after = [defaultdict(dict) for _ in grams]
    for k, c in enumerate(grams):
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    @cache
    def context(ctx):
        k = len(ctx)
        seen = after[k].get(ctx)
        if seen is None:
            return None
        count, kept = sum(seen.values()), sum(off[k].get(n, 1) * n for n in seen.values())
        whole = count + (count > 5)
        return seen, whole, (1 - kept / whole) / (1 - sum(p(ctx[1:], w) for w in seen))

    def p(ctx, w):
        if not ctx:
            return p1.get(w, unknown)
        found = context(ctx)
        if found is None:
            return p(ctx[1:], w)
        seen, whole, weight = found
        return off[len(ctx)].get(seen[w], 1) * seen[w] / whole if w in seen else weight * p(ctx[1:], w)

    return tokens, {w: n for (w,), n in grams[0].items()}, p, after


@pytest.mark.parametrize("order, chunk, fan", [(2, 400, 256), (3, 2_500_000, 256), (3, 250, 3)])
def test_scores_against_brute_force(spark, documents, prose, order, chunk, fan):
    texts = [(i, prose(i % 40, 30 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "zebra quagga"), (103, "THE the The"), (104, "one " * 500), (105, prose(3))]
    texts += [(60, texts[0][1])] + [(200 + i, f"a fixed phrase of words {i % 3} then on") for i in range(25)]
    sf = documents(texts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens, ones, p, after = model_by_hand(texts, [i for i, _ in texts if i not in held], order)
    got = {r["doc_id"]: r for r in k_.score_texts(docs, "crc32(cast(doc_id AS string)) % 7 = 2", order, chunk, fan).collect()}
    assert got.keys() == dict(texts).keys()
    total = sum(ones.values())
    for i, ws in tokens.items():
        r, padded = got[i], ["<s>"] * (order - 1) + ws
        want = sum(math.log10(p(tuple(padded[j : j + order - 1]), padded[j + order - 1])) for j in range(len(ws)))
        assert r["score"] == pytest.approx(want, rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((ones.get(w, 0) + 1) / (total + len(ones) + 1)) for w in ws), rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum(w in ones for w in ws), total)
    for ctx in [("<s>",) * (order - 1), *list(after[-1])[:20], ("never seen",) * (order - 1)]:  # exactly normalised, the unknown word included
        assert sum(p(ctx, w) for w in ones) + p(ctx, "never seen") == pytest.approx(1)


def test_messages_grow_with_chunks_not_their_square():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 100_000, np.uint64))
    for chunks in (10, 256, 257, 60_000, 10_000_000):
        levels = k_.Levels.of(chunks, 256)
        assert len(levels.messages(0, 7, 0, keys, np.ones(len(keys), int), None, np.zeros(len(keys), bool))) <= 256
        assert levels.width**levels.depth >= chunks


def test_no_training_rows_and_empty(spark, documents):
    docs = spark.read.parquet(documents([(1, "a b"), (2, None)]) + "/documents.parquet")
    assert [(r["score"], r["base_score"], r["train_tokens"]) for r in k_.score_texts(docs, "true").collect()] == [(0.0, 0.0, 0)] * 2
    assert k_.op9_katz_score(spark, documents([])).count() == 0


def test_packing():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 2**64, 1000, np.uint64))
    assert (unpack_sorted(pack_sorted(keys)) == keys).all()
    values = draw.random(999)
    assert (unpack(pack(values), np.float64) == values).all()
    assert len(unpack(pack(np.zeros(0, np.int32)), np.int32)) == 0
