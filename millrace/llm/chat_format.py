"""Operator 8: chat formatting by schema fingerprints.

A record's nested field paths are hashed; the fingerprint selects a declarative
mapping that says where the turns lie and which fields are role and text. So
prompt/completion pairs, instructions with inputs, message lists and rows of one
turn all become canonical turns, which one template renders. Control strings
inside texts are escaped, so that the rendered form reads back exactly.

Defined cases: a null text is empty, a null role is an empty role; turns of a
conversation are ordered by turn, then role, then text, so ties and repeated
rows have one order; a record whose fingerprint has no mapping is returned with
`mapping` null and no turns; an empty table gives an empty table; extra fields
change the fingerprint only if `ignore` does not list them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import each


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves, `[]` for the elements of a list."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    Either `items` names a list (empty: the record itself is one turn) whose
    elements hold `role` and `text`, or `fixed` lists (role, fields) in order;
    the fields of one turn that are not empty are joined by a blank line.
    """

    name: str
    paths: tuple[str, ...]
    items: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.fixed:
            joined = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f) not in (None, ""))) for role, fields in self.fixed]
            return [(role, text) for role, text in joined if text or role != "system"]
        names = dict(self.roles)
        found = record.get(self.items) or [] if self.items else [record]
        return [(names.get(r := str(t.get(self.role) or ""), r), str(t.get(self.text) if t.get(self.text) is not None else "")) for t in found]


SHAREGPT = (("human", "user"), ("gpt", "assistant"), ("system", "system"))
#: The layouts known from the start; more are registered by passing a longer tuple.
MAPPINGS = (
    Mapping("turn", ("role", "text"), items="", role="role", text="text"),
    Mapping("messages", ("messages[].content", "messages[].role"), items="messages", role="role", text="content"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=SHAREGPT),
    Mapping("prompt-completion", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt-response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system-instruction", ("input", "instruction", "output", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question-answer", ("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class Template:
    """Marks each turn; `escape` guards every control string inside texts."""

    begin: str = "<s>"
    end: str = "</s>"
    user: tuple[str, str] = ("[INST]", "[/INST]")
    other: tuple[str, str] = ("[TURN]", "[/TURN]")
    escape: str = "\\"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, *self.user, *self.other)

    def guard(self, text: str) -> str:
        """Every escape doubled, then one put after the first character of each control."""
        text = text.replace(self.escape, self.escape * 2)
        for c in self.controls:
            text = text.replace(c, c[0] + self.escape + c[1:])
        return text

    def unguard(self, text: str) -> str:
        for c in self.controls:
            text = text.replace(c[0] + self.escape + c[1:], c)
        return text.replace(self.escape * 2, self.escape)

    def guard_role(self, role: str) -> str:
        """A role stands on the first line of its turn: its line breaks are escaped."""
        return self.guard(role).replace("\n", self.escape + "n")

    def unguard_role(self, role: str) -> str:
        pair = re.escape(self.escape) + r"(.)"
        return self.unguard(re.sub(pair, lambda m: "\n" if m[1] == "n" else m[0], role, flags=re.DOTALL))

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The segment of one turn, and the span in it that the loss covers."""
        body = self.guard(text)
        if role == "assistant":
            return f"{body}{self.end}", 0, len(body)
        if role == "user":
            return f"{self.begin}{self.user[0]}{body}{self.user[1]}", 0, 0
        return f"{self.other[0]}{self.guard_role(role)}\n{body}{self.other[1]}", 0, 0

    def read(self, text: str) -> tuple[tuple[str, str], int] | None:
        """The first turn of a formatted text as (role, text), and where it ends; None
        if its end mark is not there. A text that begins with no mark is an assistant's."""
        head = self.begin + self.user[0]
        start, mark = (head, self.user[1]) if text.startswith(head) else self.other if text.startswith(self.other[0]) else ("", self.end)
        at = text.find(mark, len(start))
        if at < 0:
            return None
        body = text[len(start) : at]
        if start == head:
            turn = "user", self.unguard(body)
        elif start:
            role, _, rest = body.partition("\n")
            turn = self.unguard_role(role), self.unguard(rest)
        else:
            turn = "assistant", self.unguard(body)
        return turn, at + len(mark)


class ConversationReader:
    """Reads turns back out of a formatted conversation that comes in pieces.

    Only the marks in the text tell where turns begin and end; no more than the
    turns that are not complete yet are held.
    """

    def __init__(self, template: Template):
        self.template, self.rest = template, ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        longest = len(self.template.begin + self.template.user[0])
        turns = []
        # A beginning that is too short may still become a mark.
        while len(self.rest) >= longest or self.rest and not any(m.startswith(self.rest) for m in (self.template.begin + self.template.user[0], self.template.other[0])):
            found = self.template.read(self.rest)
            if found is None:
                break
            turns.append(found[0])
            self.rest = self.rest[found[1] :]
        return turns

    def close(self) -> None:
        if self.rest:
            raise ValueError(f"a formatted conversation ends without an end mark: {self.rest[:40]!r}")


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows (conv_id, turn, record) of JSON records to (conv_id, turn, role, text).

    `turn` numbers the record; the turns inside a record follow as `part`.
    """
    known = {fingerprint(set(m.paths)): m for m in mappings}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    parsed = json.loads(record) if record is not None else None
                    paths = field_paths(parsed) - set(ignore) if isinstance(parsed, dict) else set()
                except (ValueError, RecursionError):  # No JSON, or too deeply nested for any layout.
                    parsed, paths = None, set()
                mapping = known.get(fingerprint(paths))
                turns = mapping.turns(parsed) if mapping else [(None, None)]
                for part, (role, text) in enumerate(turns):
                    for column, value in zip(out, (conv, turn, part, mapping and mapping.name, role, text), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "turn", "part", "mapping", "role", "text"])

    rows = records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("record").cast("string"))
    return rows.mapInArrow(convert, "conv_id long, turn long, part int, mapping string, role string, text string")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds segment, loss_start and loss_end: each turn is rendered on its own.

    A conversation's formatted text is its segments in order, so a conversation
    of any length is never gathered to be rendered.
    """
    names = turns.columns

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [template.render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            extra = [pa.array([d[i] for d in done], k) for i, k in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "segment", "loss_start", "loss_end"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema)
    return turns.mapInArrow(render, fields + ", segment string, loss_start long, loss_end long")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, read from its formatted text.

    Segments of a conversation are sorted into one partition and streamed, as one
    text, through a reader that finds the turns by their marks, so memory does not
    grow with the conversation. A missing mark is an error.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state: list | None = None

        def row(s: list) -> dict:
            s[6].close()
            return dict(zip(schema.names, (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]), strict=True))

        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(each(batch, c) for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ConversationReader(template)]
                for role, text in state[6].feed(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = template.unguard(segment[start:end])
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema=schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table.unionByName(extra)
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return read_back(format_turns(canonical_turns(rows.select("conv_id", "turn", record.alias("record")))))
