import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException

from millrace.llm import chat_format as c

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "\\", "<", "s>", "[", "INST]", "\n", "é", " ", "</"]


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "a\n[/TURN]", "\\n\n\\"]), st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_round_trip(role, text):
    t = c.Template()
    segment, start, end = t.render(role, text)
    assert t.read(segment) == ((role, text), len(segment))
    assert t.unguard(segment[start:end]) == (text if role == "assistant" else "")
    body = t.guard(text)
    assert not any(x in body for x in t.controls)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), max_size=6), st.randoms())
def test_turns_are_found_by_their_marks_alone(turns, draw):
    """The whole text of a conversation, cut anywhere."""
    t = c.Template()
    text, reader, got = "".join(t.render(*x)[0] for x in turns), c.ConversationReader(c.Template()), []
    while text:
        k = draw.randrange(1, len(text) + 1)
        got += reader.feed(text[:k])
        text = text[k:]
    reader.close()
    assert got == turns


def test_missing_mark_is_an_error(spark):
    reader = c.ConversationReader(c.Template())
    assert reader.feed("<s>[INST]q[/INST]a") == [("user", "q")]
    with pytest.raises(ValueError, match="end mark"):
        reader.close()
    broken = spark.createDataFrame([(1, 0, 0, "user", "q", "<s>[INST]q", 0, 0)], "conv_id long, turn long, part int, role string, text string, segment string, loss_start long, loss_end long")
    with pytest.raises(PythonException):
        c.read_back(broken).collect()


def test_deep_nesting_is_no_layout(spark):
    rows = [(1, 0, '{"a":' * 3000 + "1" + "}" * 3000), (2, 0, '{"a":' * 700 + "1" + "}" * 700), (3, 0, '{"role":"user","text":"x"}')]
    got = {r["conv_id"]: r["mapping"] for r in c.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()}
    assert got == {1: None, 2: None, 3: "turn"}


def test_query_against_brute_force(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i % 7, i, draw.choice(["user", "assistant", "system", "tool"]), draw.choice([None, "", *PIECES, "".join(draw.choices(PIECES, k=40)), "x" * 50000])) for i in range(120)]
    rows += [(7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, 0, None, "q"), (7, 0, None, "q"), (None, 0, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'z' AS record", "1 AS part").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in c.op8_chat_format(spark, str(tmp_path)).collect()}
    same = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", same), (-7, 1, "assistant", same)]
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for _, x, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(c.Template().render(x, t)[0]) for _, x, t in turns)


def test_layouts_become_the_same_turns(spark):
    records = [
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"question": "q", "answer": "a"},
    ]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(90, 0, '{"other": 1}'), (91, 0, "not json"), (92, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = {}
    for r in c.canonical_turns(df).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["mapping"], r["role"], r["text"]))
    for i in range(len(records)):
        assert [x[1:] for x in got[i]] == [("user", "q"), ("assistant", "a")]
    assert all(got[i] == [(None, None, None)] for i in (90, 91, 92))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in c.op8_chat_format(spark, str(tmp_path)).collect()] == [-7]
