import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from millrace.llm import divergence as m

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def by_hand(rows, least=10, top=10):
    """Every kept term in every group, in whole numbers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms_of(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(freq):
            total = sum(freq[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (freq[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            marks = [(t, f(own[s][t], whole[t])) for t in kept if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", marks, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_against_brute_force(spark, documents):
    draw = random.Random(4)
    vocabulary = ["the", "The", "été", "ÉTÉ", "日本", "x1y", "a_b", "c-d", "zz", "e\x00f", "q", "\x7f", "İ", *(f"w{c}{d}" for c in "abcde" for d in "abcdefgh")]
    rows = []
    for i in range(900):
        lang, source = draw.choice(["en", "fr", None, ""]), draw.choice(["a", "b", "hot", "hot", "hot", None, "ü", "Z"])
        some = vocabulary[: draw.randrange(3, len(vocabulary))]
        rows.append((i, draw.choice([None, "", "12 34 !"]) if i % 40 == 0 else " ".join(draw.choice(some) for _ in range(draw.randrange(1, 40))), lang, source))
    rows += [rows[3]] * 4 + [(2000, None, "de", "only"), (2001, "rare words", "it", "a"), (2002, "", "it", "b"), (2003, "rare words", "it", None)]
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in m.op12_source_divergence(spark, documents(rows)).collect())
    assert got == by_hand([r[1:] for r in rows])
    assert {r[2] for r in got if r[0] == "it"} == {"pair"} and not any(r[0] == "de" for r in got)


def test_long_texts_and_a_small_bound(spark, documents, prose, monkeypatch):
    """A text is counted in parts, a task gives its counts away in parts."""
    monkeypatch.setattr(m, "SPAN", 7)
    text = prose(1) + "x" * 50 + "é" * 30 + " end"
    assert m.count_terms(text.encode()) == Counter(t.encode() for t in terms_of(text))
    rows = [(prose(i % 9, n=30), "en", "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    one, many = (sorted(map(tuple, m.group_counts(docs, most=n).collect()), key=repr) for n in (10**6, 20))
    assert one == many


def test_many_sources_in_blocks():
    """Sources of a term in any number, over batches of any size, sum up by pair."""
    draw = random.Random(2)
    rows = [("en", f"t{k:03}".encode(), g, draw.randrange(1, 10**9), 5 + g) for k in range(120) for g in sorted(draw.sample(range(30), draw.randrange(1, 30)))]
    names = ["lang", "term", "g", "p", "p0"]
    batches = [pa.record_batch([pa.array([r[c] for r in rows[i : i + 37]]) for c in range(5)], names) for i in range(0, len(rows), 37)]
    got = Counter()
    for out in m._shared(iter(batches), most=500):
        for g, h, v in zip(*(out[c].to_pylist() for c in ("g", "h", "value"))):
            got[g, h] += v
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want, of_term = Counter(), defaultdict(list)
    for _, t, g, p, p0 in rows:
        for h, q, q0 in of_term[t]:
            want[h, g] += f(q, p) - f(q, p0) - f(q0, p) + f(q0, p0)
        of_term[t].append((g, p, p0))
    assert got == want


def test_empty(spark, documents):
    assert m.op12_source_divergence(spark, documents([])).count() == 0
