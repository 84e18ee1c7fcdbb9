import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.patterns import Automaton, match_pattern

MEETS = {"a": "a", "b": "b", "c": "c", "vowel": "ae"}


def conditions():
    return {name: F.col("kind").isin(*kinds) for name, kinds in MEETS.items()}


def spans(pattern, kinds):
    """All (start, end) of runs of rows that have the pattern, tried one by one."""
    steps = [(p.rstrip("?*+"), p[-1] if p[-1] in "?*+" else "") for p in pattern.split()]

    def ends(step, at):
        if step == len(steps):
            return {at}
        name, how = steps[step]
        found = ends(step + 1, at) if how in ("?", "*") else set()
        upto = at
        while upto < len(kinds) and kinds[upto] and kinds[upto] in MEETS[name]:
            upto += 1
            found |= ends(step + 1, upto)
            if how in ("", "?"):
                break
        return found

    return {(i, e - 1) for i in range(len(kinds)) for e in ends(0, i) if e > i}


@pytest.mark.parametrize("pattern", ["a b a", "a b* a", "a+ c? b", "vowel a b", "vowel+ b", "a? b c*", "a c* a c* a"])
def test_matches_are_those_of_trying_all(spark, pattern):
    draw = random.Random(pattern)
    rows, expected = [], set()
    for key, n in (("hot", 400), ("x", 40), (None, 30), ("y", 1), ("z", 25)):
        sec, times, kinds = 0, [], []
        for i in range(n):
            sec += draw.choice([0, 1, 5, 30])
            kinds.append(draw.choice(["a", "a", "b", "c", "e", "", None]))
            times.append(sec)
            rows.append((key, sec, i, kinds[-1]))
        best = {}
        for i, e in spans(pattern, kinds):
            best[e] = max(best.get(e, -1), times[i])
        expected |= {(key, e, float(s)) for e, s in best.items() if times[e] - s <= 20}
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, sec long, i int, kind string")
    found = match_pattern(df, "key", ["sec", "i"], F.col("sec"), conditions(), pattern, 20, parts=9)
    assert {(r["key"], r["i"], r["began_sec"]) for r in found.collect()} == expected
    assert expected


def test_a_run_may_go_through_parts_that_end_nothing(spark):
    rows = [("k", 0, 0, "a")] + [("k", i, i, "c") for i in range(1, 300)] + [("k", 300, 300, "a")]
    df = spark.createDataFrame(rows, "key string, sec long, i int, kind string")
    found = match_pattern(df, "key", ["i"], F.col("sec"), conditions(), "a c* a", 1e9, parts=12).collect()
    assert [(r["i"], r["began_sec"]) for r in found] == [(300, 0.0)]


def test_tables_without_rows_and_bad_patterns(spark):
    empty = spark.createDataFrame([], "key string, sec long, i int, kind string")
    assert match_pattern(empty, "key", ["i"], F.col("sec"), conditions(), "a b", 1).count() == 0
    for bad in ("", "a? b*", "a (b)"):
        with pytest.raises(ValueError):
            Automaton.of(bad)
    with pytest.raises(ValueError):
        match_pattern(empty, "key", ["i"], F.col("sec"), conditions(), "a q", 1)
    with pytest.raises(ValueError):
        match_pattern(empty.withColumn("_sec", F.lit(1)), "key", ["i"], F.col("sec"), conditions(), "a b", 1)


def test_rows_without_a_time_break_a_run(spark):
    df = spark.createDataFrame([("k", 0, 0, "a"), ("k", None, 1, "b"), ("k", 2, 2, "b")], "key string, sec long, i int, kind string")
    assert match_pattern(df, "key", ["i"], F.col("sec"), conditions(), "a b", 9).count() == 0
