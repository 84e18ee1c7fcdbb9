"""Operator 2: secret scans by grammar inference.

Labelled credentials (what the base patterns catch in a bounded sample of the
corpus, and examples of published token formats) give one probabilistic
automaton a format; ordinary long tokens, made by kind and taken from the corpus,
give automata too. Every candidate token of every whole text is scored by its
likelihood under the best format against the best ordinary kind, and joins the base
spans when it is clearly a credential.

Defined cases: a null text is empty and has no spans; texts of any length are
scanned whole; repeated rows give equal results; an empty corpus trains on the
published formats alone; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.grammar import Automaton, symbols
from millrace.llm.text import each
from millrace.llm.work import discard, lean, stored

#: The base patterns, and the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "grammar")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTER = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,15}(?![A-Za-z0-9+/_.=-])")
EDGES = "./=-_+"
#: Longer values do not teach (the automata are fitted to a bounded sample); every
#: candidate is scored whole, whatever its length.
LONGEST = 512

#: Published token formats, as (prefix, characters, lengths).
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = {
    "hex": ("", "0123456789abcdef", (32, 40, 64)),
    "aws_access": ("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (16,)),
    "aws_secret": ("", ALNUM + "+/", (40,)),
    "github": ("ghp_", ALNUM, (36,)),
    "google": ("AIza", ALNUM + "_-", (35,)),
    "stripe": ("sk_live_", ALNUM, (24,)),
    "slack": ("xoxb-", ALNUM + "-", (36, 48)),
    "jwt": ("eyJ", ALNUM + "_-.", (80, 120)),
}

#: Ordinary long tokens.
ORDINARY = (
    "2024-01-01T00:00:00", "www.example.com/news/2023/11/05/story-about-rivers.html", "v1.2.3-release_candidate", "550e8400-e29b-41d4-a716-446655440000",
    "192.168.100.200", "src/main/java/com/example/App2.java", "chapter_12_section_4", "ISO-8859-1.ISO-10646", "node_modules/package-2.0.1/index.js", "figure-3.4-left.png",
    "10.1000/journal.pone.0012345", "first=1/second=2/third=3", "2017-2018-2019-2020", "archive-2019.tar.gz", "cdn.example.org/static/v3/style.min.css", "a1-b2-c3-d4-e5-f6-g7",
)


def ordinary_examples(each: int = 200, seed: int = 12) -> dict[str, list[str]]:
    """Ordinary long tokens by kind: words, words that are joined, capitals inside,
    numbers, dates and the like, rules drawn with one character."""
    draw = random.Random(seed)

    def word(least: int, most: int) -> str:
        return "".join(draw.choice("aeiou" if i % 2 else "bcdfghklmnprstvw") if draw.random() < 0.8 else draw.choice(ALNUM[26:52]) for i in range(draw.randint(least, most)))

    def joined(separators: str) -> str:
        parts = [word(2, 10) if draw.random() < 0.75 else str(draw.randrange(10 ** draw.randint(1, 4))) for _ in range(draw.randint(3, 8))]
        return "".join(x for p in parts for x in (p, draw.choice(separators)))[:-1]

    kinds = {
        "word": lambda: word(16, 44) if draw.random() < 0.7 else word(16, 44).capitalize(),
        "capitals": lambda: word(16, 30).upper(),
        "kebab": lambda: joined("-"),
        "snake": lambda: joined("_"),
        "path": lambda: joined("/././-_="),
        "camel": lambda: "".join(word(2, 9).capitalize() for _ in range(draw.randint(3, 6))),
        "number": lambda: str(draw.randrange(10**15, 10 ** draw.randint(16, 24))),
        "groups": lambda: draw.choice("-./:_").join(str(draw.randrange(10 ** draw.randint(1, 5))) for _ in range(draw.randint(4, 8))),
        "rule": lambda: draw.choice("=-_.+/ax0") * draw.randint(16, 80),
        "listed": lambda: draw.choice(ORDINARY),
    }
    return {name: [make() for _ in range(each)] for name, make in kinds.items()}


@dataclass(frozen=True)
class Span:
    start: int
    kind: int
    end: int
    #: Where the secret itself starts: after the keyword of an assignment.
    value: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and kind.

    Runs of the access and hex characters are maximal, so asking for their least
    length in the pattern finds the same spans as dropping short matches later;
    both lie inside candidate tokens.
    """
    spans = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for c in CANDIDATE.finditer(text):
        at, token = c.start(), c[0]
        if len(token) >= 20 and "AKIA" in token:
            spans += [Span(at + m.start(), 1, at + m.end(), at + m.start()) for m in ACCESS.finditer(token)]
        if len(token) >= 24:
            spans += [Span(at + m.start(), 2, at + m.end(), at + m.start()) for m in HEX.finditer(token)]
    return sorted(spans, key=lambda s: (s.start, s.kind))


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, str]]:
    """Tokens of 16 characters or more that touch no base span.

    `taken` is in the order of starts; what lies behind a token is not looked at
    again.
    """
    at, reach = 0, 0
    for c in CANDIDATE.finditer(text):
        token = c[0].strip(EDGES)
        if len(token) < 16:
            continue
        start = c.start() + c[0].index(token)
        while at < len(taken) and taken[at].start < start + len(token):
            reach = max(reach, taken[at].end)
            at += 1
        if reach <= start:
            yield start, token


@dataclass
class SecretGrammar:
    formats: dict[str, Automaton]
    ordinary: dict[str, Automaton]
    margin: float = 0.6

    def ratio(self, token: str) -> float:
        """Log likelihood a character, of the best format over the best ordinary kind."""
        path = symbols(token)
        return (max(a.score(path) for a in self.formats.values()) - max(a.score(path) for a in self.ordinary.values())) / len(path)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans; all spans."""
        base = base_spans(text)
        more = [Span(at, 3, at + len(t), at) for at, t in candidates(text, base) if self.ratio(t) >= self.margin]
        return base, sorted([*base, *more], key=lambda s: (s.start, s.kind))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each text, up to 20 labelled values and 20 ordinary tokens, by hash; none
    longer than LONGEST characters."""
    for batch in batches:
        kinds, values = [], []
        for text in each(batch, "text"):
            spans = base_spans(text)
            found = {(KINDS[s.kind], text[s.value : s.end]) for s in spans}
            plain = {("plain", t) for _, t in candidates(text, spans)} | {("plain", w) for w in SHORTER.findall(text)}
            for group in (found, plain):
                short = (x for x in group if len(x[1]) <= LONGEST)
                for kind, value in sorted(short, key=lambda x: hashlib.sha256(x[1].encode()).digest())[:20]:
                    kinds.append(kind)
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])


def published_examples(each: int = 150, seed: int = 11) -> dict[str, list[str]]:
    draw = random.Random(seed)
    return {name: [prefix + "".join(draw.choices(characters, k=draw.choice(lengths))) for _ in range(each)] for name, (prefix, characters, lengths) in FORMATS.items()}


def train_secret_grammar(docs: DataFrame, sample_docs: int = 4000, each: int = 400, seed: int = 11) -> SecretGrammar:
    """Infer the automata.

    At most about `sample_docs` different texts, taken by hash, give labelled
    values and ordinary tokens, and `each` values a kind are used: both bounds
    hold at every size of the corpus.
    """
    text = F.coalesce("text", F.lit(""))
    parts = max(1, docs.count() // sample_docs)
    # One text once: copies would fill the sample.
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(parts)) == 0).distinct()
    pairs = stored(chosen.mapInArrow(lean(_examples), "kind string, value string").distinct(), "secret-examples", rows=40 * sample_docs)
    ranked = []
    for kind in (*KINDS[:3], "plain"):
        ranked += pairs.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(each if kind != "plain" else 5 * each).collect()
    formats = published_examples(seed=seed)
    plain = []
    for row in ranked:
        (plain if row["kind"] == "plain" else formats.setdefault(row["kind"], [])).append(row["value"])
    discard(pairs)
    known = {k: Automaton(v) for k, v in formats.items() if len(v) >= 20}
    ordinary = {k: Automaton(v) for k, v in ordinary_examples(seed=seed).items()}
    first = SecretGrammar(known, ordinary)
    # The corpus's own tokens, but for those that are credentials themselves.
    plain = [t for t in plain if len(t) < 16 or first.ratio(t) < first.margin]
    return SecretGrammar(known, ordinary | ({"corpus": Automaton(plain)} if len(plain) >= 20 else {}))


def scan_secrets(docs: DataFrame, grammar: SecretGrammar) -> DataFrame:
    """Adds secret_spans (kind, start, end, start of the value) to `docs`."""
    docs = docs.drop("secret_spans")
    packed = pickle.dumps(grammar)
    kept = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SecretGrammar = pickle.loads(packed)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
        for batch in batches:
            spans = []
            for text in each(batch, "text"):
                _, every = model.spans(text or "")
                spans.append([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "value": s.value} for s in every])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*kept, "secret_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(scan), fields + ", secret_spans array<struct<kind string, start long, end long, value long>>")


def redact_secrets(docs: DataFrame, grammar: SecretGrammar, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret replaced by `mask` (overlapping ones by one mask)."""
    packed = pickle.dumps(grammar)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SecretGrammar = pickle.loads(packed)
        for batch in batches:
            out = []
            for text in each(batch, "text"):
                if text is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for start, end in sorted((s.value, s.end) for s in model.spans(text)[1]):
                    if start >= at:
                        parts += [text[at:start], mask]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]))
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(out, pa.string()))

    return docs.mapInArrow(lean(redact), docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = scan_secrets(docs, train_secret_grammar(docs)).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"] != KINDS[3])
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
