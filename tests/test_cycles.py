import random

import numpy as np
import pytest

from millrace.operators import cycles as m


def by_hand(values, arm=0.05, zero=0.02):
    """(cycle, completes, peak) row by row."""
    out, top, peak, armed, cycle, opened = [], float("-inf"), 0.0, False, 0, False
    for v in values:
        if v is None:
            out.append((cycle, False, peak))
            continue
        top, done = max(top, v), False
        if not opened:
            peak, armed, opened = v, False, True
        else:
            peak = max(peak, v)
            armed = armed or peak > 0 and peak >= top * arm
            done = armed and v <= peak * zero
        out.append((cycle, done, peak))
        if done:
            cycle, peak, armed = cycle + 1, v, False
    return out


def series(draw, n):
    kind = draw.randrange(5)
    if kind == 0:
        return [draw.choice([0.0, 0.1, 1.0, 5.0, 100.0, 3.0]) for _ in range(n)]
    if kind == 1:
        return [abs(draw.gauss(0, 1)) ** 4 for _ in range(n)]
    if kind == 2:
        return [draw.uniform(-2, 8) * 1.3 ** (i % 17) for i in range(n)]
    if kind == 3:
        return [100.0 / (1 + i % 41) ** 2 for i in range(n)]
    return [float(n - i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_parts_compose(seed):
    """A unit in any parts, each as a function, ends as it does row by row."""
    draw, rules = random.Random(seed), m.Rules(0.05, 0.02)
    for _ in range(150):
        v = np.array(series(draw, draw.randrange(1, 120)))
        want = by_hand(v.tolist())
        cuts = sorted({0, len(v), *(draw.randrange(len(v)) for _ in range(draw.randrange(6)))})
        state, whole = m.State(), rules.run(v, m.State())
        assert whole[0] == [i for i, w in enumerate(want) if w[1]]
        for a, b in zip(cuts, cuts[1:]):
            part = v[a:b]
            done, after = rules.run(part, state)
            if state.peak is not None:
                assert rules.apply(rules.function(part, state.top), state) == after
            assert [a + i for i in done] == [i for i in range(a, b) if want[i][1]]
            state = after
        assert state == whole[1]


def test_one_hot_unit_over_many_tasks(spark):
    draw = random.Random(9)
    units = {"hot": series(draw, 600) + [None, 4.0, 0.0] + [abs(draw.gauss(0, 1)) ** 4 for _ in range(2000)], "a": [5.0, None, 0.0], "b": [None, None], "c": [float("nan"), 7.0, 0.01, 3.0]}
    rows = [(u, i, v) for u, vs in units.items() for i, v in enumerate(vs)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, i long, v double")
    labelled = m.label_cycles(df, "u", "v", ["i"], parts=9)
    tasks = labelled.rdd.mapPartitionsWithIndex(lambda k, rows: [(k, sum(r["u"] == "hot" for r in rows))]).collect()
    assert sum(n > 0 for _, n in tasks) >= 6 and max(n for _, n in tasks) < 900
    got = {(r["u"], r["i"]): (r["cycle"], r["completes"], r["cycle_peak"]) for r in labelled.collect()}
    for u, vs in units.items():
        want = by_hand([None if v is None or v != v else v for v in vs])
        assert [got[u, i] for i in range(len(vs))] == want
    assert m.label_cycles(df.limit(0), "u", "v", ["i"]).count() == 0
    with pytest.raises(ValueError):
        m.Rules(0.02, 0.05)
