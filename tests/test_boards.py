import random
from statistics import fmean, pvariance, stdev

import pytest
from pyspark.sql import functions as F

from millrace.operators import board, config, crosstab, rollup


def test_projection_goes_by_the_usual_rest_and_todays_pace(spark):
    # Three days of 10 by noon and 10, 20 or 30 after it; today twice as fast so far.
    rows = [(f"2024-01-0{d} {h}:00:00", "x", v) for d, rest in ((1, 10.0), (2, 20.0), (3, 30.0)) for h, v in (("09", 10.0), ("15", rest))]
    rows += [("2024-01-04 08:00:00", "x", 20.0), ("2024-01-04 18:00:00", "x", 999.0), ("2024-01-04 10:00:00", "new", 5.0), ("2024-01-03 10:00:00", None, 5.0), (None, "x", 5.0), ("2024-01-05 10:00:00", "x", 7.0)]
    df = spark.createDataFrame(rows, "ts string, scope string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = {r["scope"]: r for r in board.projections(df.where("ts IS NULL OR ts < '2024-01-04 18:00:00' OR ts > '2024-01-05'"), "scope", "ts", "v", "2024-01-04 12:00:00").collect()}
    x = found["x"]
    assert (x["days"], x["accrued"], x["projected"]) == (3, 20.0, 20.0 + 2 * 20.0)
    assert x["usual_share"] == pytest.approx(10 / 30)
    assert (x["low"], x["high"]) == pytest.approx((60 - 2 * stdev([10, 20, 30]), 60 + 2 * stdev([10, 20, 30])))
    assert found["new"]["projected"] is None and found["new"]["accrued"] == 5.0
    assert set(found) == {"x", "new"}


def test_pace_conditions_need_a_target(spark):
    found = spark.createDataFrame([("a", 3, 10.0, 0.5, 25.0, 20.0, 30.0), ("b", 3, 10.0, 0.5, 25.0, 20.0, 30.0), ("c", 3, 10.0, 0.5, 25.0, 20.0, 30.0)], "scope string, days int, accrued double, usual_share double, projected double, low double, high double")
    targets = spark.createDataFrame([("a", 28.0), ("b", 40.0), ("c", None), ("d", 1.0)], "scope string, target double")
    rows = {(r["scope"], r["condition"]): (r["value"], r["threshold"], r["fires"], r["sure"]) for r in board.pace_conditions(found, targets).collect()}
    assert rows == {("a", "attainment_gap"): (10.0, 14.0, True, True), ("a", "projected_miss"): (25.0, 28.0, True, False), ("b", "attainment_gap"): (10.0, 20.0, True, True), ("b", "projected_miss"): (25.0, 40.0, True, True), ("d", "attainment_gap"): (None, None, None, None), ("d", "projected_miss"): (None, 1.0, None, None)}
    fewer = {(r["scope"], r["condition"]): (r["fires"], r["sure"]) for r in board.pace_conditions(found, targets, lower_is_better=True).collect()}
    assert fewer["a", "projected_miss"] == (False, False) and fewer["a", "attainment_gap"] == (False, False)


def _rows(n=900):
    draw = random.Random(7)
    return [(draw.choice(["p", "q", None]), draw.choice(["day", "night"]), draw.choice(["1", "2", "3"]), draw.choice([None, draw.gauss(5, 2)]), draw.gauss(0, 1), draw.random() < 0.2) for _ in range(n)]


def _table(spark, rows):
    return spark.createDataFrame(rows, "`a.b` string, measure string, category string, v double, n double, held boolean")


def test_one_scan_gives_the_cells_and_effects_of_all_categories(spark):
    rows = _rows()
    cells = crosstab.with_effects(crosstab.moments(_table(spark, rows), ["a.b", "measure", "category"], ["v", "n"], F.col("held")))
    found = {(r["category"], r["value"], r["measure"]): r for r in cells.collect()}
    near = lambda x: pytest.approx(x, abs=0.00051)
    seen = set()
    for i, category in enumerate(("a.b", "measure", "category")):
        for j, measure in ((3, "v"), (4, "n")):
            live = [(x[i], x[j], x[5]) for x in rows if x[i] is not None and x[j] is not None]
            grand, by = fmean(x[1] for x in live), {}
            for k, v, q in live:
                by.setdefault(k, []).append((v, q))
            between = sum(len(b) * (fmean(v for v, _ in b) - grand) ** 2 for b in by.values())
            within = sum(len(b) * pvariance([v for v, _ in b]) for b in by.values())
            for value, b in by.items():
                r = found[category, value, measure]
                seen.add((category, value, measure))
                values, held = [v for v, _ in b], [v for v, q in b if q]
                assert (r["n"], r["ex_n"], r["baseline_n"]) == (len(b), len(held), len(b) - len(held))
                assert (r["mean"], r["sd"], r["lo"], r["hi"], r["ex_sum"]) == near((fmean(values), stdev(values), min(values), max(values), sum(held)))
                assert r["baseline_mean"] == near(fmean(v for v, q in b if not q))
                assert r["eta2"] is None if len(live) < 500 else r["eta2"] == pytest.approx(between / (between + within), abs=1e-6)
    assert set(found) == seen


def test_no_rows_and_cells_of_held_out_rows_alone(spark):
    assert crosstab.moments(_table(spark, []), ["category"], ["v"]).count() == 0
    rows = [("p", "day", "1", 2.0, 1.0, True), ("p", "day", "2", 4.0, 1.0, False)]
    found = {r["value"]: r for r in crosstab.with_effects(crosstab.moments(_table(spark, rows), ["category"], ["v"], F.col("held"))).collect()}
    assert (found["1"]["baseline_n"], found["1"]["baseline_mean"], found["1"]["sd"]) == (0, None, 0.0)
    assert (found["2"]["baseline_n"], found["2"]["baseline_mean"], found["2"]["eta2"]) == (1, 4.0, None)


def test_a_margin_that_is_only_the_mix_of_states_goes(spark):
    # Both shifts have 10 in state p and 20 in q; the night is more often in q.
    rows = [("p", "day", "1", 10.0, 0.0, False)] * 3 + [("q", "day", "1", 20.0, 0.0, False)] + [("p", "night", "2", 10.0, 0.0, False)] + [("q", "night", "2", 20.0, 0.0, False)] * 3
    cells = crosstab.oriented_moments(_table(spark, rows), ["a.b"], ["measure", "a.b"], ["v"])
    note, = crosstab.confound_notes(cells).collect()
    assert (note["dimension"], note["first_value"], note["second_value"]) == ("measure", "day", "night")
    assert (note["marginal_pct"], note["standardised_pct"], note["confound_points"]) == (40.0, 0.0, -40.0)
    joint = crosstab.oriented_joint(cells)
    assert {(r["state"], r["value"], r["n"], r["mean"]) for r in joint.collect()} == {("p", "day", 3, 10.0), ("q", "day", 1, 20.0), ("p", "night", 1, 10.0), ("q", "night", 3, 20.0)}
    with pytest.raises(ValueError):
        crosstab.oriented_moments(_table(spark, rows), ["a.b"], ["a.b"], ["v"])


def test_equal_rosters_are_found_without_order_and_repeats(spark):
    draw = random.Random(3)
    sets = {"long name": "abc", "short": "abc", "other": "abd", "tiny": "a", "part": "ab", "short2": "abc"}
    rows = [(k, m) for k, ms in sets.items() for m in ms for _ in range(draw.randint(1, 3))] + [("short", None), ("empty", None), (None, "a")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "roster string, member string")
    found = {r["roster"]: (r["n"], r["kept_as"], "".join(r["members"])) for r in rollup.equal_rosters(df, 2).collect()}
    assert found == {"long name": (3, "short", "ab"), "short": (3, "short", "ab"), "short2": (3, "short", "ab"), "other": (3, "other", "ab"), "tiny": (1, "tiny", "a"), "part": (2, "part", "ab")}
    assert rollup.equal_rosters(df.limit(0)).count() == 0


def test_no_row_holds_a_large_roster(spark):
    both = spark.range(200_000).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("roster"), F.col("id").cast("string").alias("member")).where("NOT (roster = 'c' AND member = '77')")
    found = {r["roster"]: (r["n"], r["kept_as"], len(r["members"])) for r in rollup.equal_rosters(both).collect()}
    assert found == {"a": (200_000, "a", 120), "b": (200_000, "a", 120), "c": (199_999, "c", 120)}


def _bound(spoken, columns):
    """Every name against every column, one after the other."""
    import re
    import unicodedata

    plain = lambda x: " ".join(re.findall("[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))))
    found = {}
    for name in spoken:
        best = None
        for i, column in enumerate(columns):
            want, have, w, h = name.strip().lower(), column.strip().lower(), plain(name), plain(column)
            if not want:
                continue
            tier = 1 if want == have else 2 if have.startswith(want) else 3 if w and w == h else 4 if w and w in h else 5 if w and set(w.split()) <= set(h.split()) else None
            if tier:
                key = (tier, len(h.split()) - len(w.split()) if tier == 5 else 0, i)
                best = min(best, (key, column)) if best else (key, column)
        found[name] = (best[1], best[0][0]) if best else (None, None)
    return found


def test_names_meet_columns_as_if_all_pairs_were_tried(spark):
    draw = random.Random(11)
    words = ["pit", "position", "Fuel", "rate", "of", "Ton", "id", "Condición", "vía", "x", "#"]
    columns = list(dict.fromkeys(draw.choice([" ", "-", "_", "  "]).join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(60)))
    spoken = list(dict.fromkeys([*(" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(80)), *(c.upper() for c in columns[:9]), *(c[: draw.randint(1, 6)] for c in columns), *(c[draw.randint(0, 3) :] for c in columns), "condicion via", "#", "", " ", "--", "galaxy", "zz"]))
    df = config.bind_names(spark.createDataFrame([(n,) for n in spoken], "name string"), spark.createDataFrame([(c,) for c in columns], "column string").coalesce(1))
    assert {r["name"]: (r["column"], r["tier"]) for r in df.collect()} == _bound(spoken, columns)


def test_names_are_found_through_the_dictionary(spark):
    columns = spark.createDataFrame([("Shift ID",), ("Pit Position (zone)",), ("Operator ID",), (None,)], "column string").coalesce(1)
    entries = [("Shift ID", "shift_key", "Turno de trabajo"), ("Pit Position", "segment", "Segmento o ubicación en la vía"), ("Operator ID", None, None), ("Not there", "ghost", "Nada"), (None, "operator", "Persona que opera")]
    dictionary = spark.createDataFrame(entries, "column string, variable_key string, description string").coalesce(1)
    spoken = spark.createDataFrame([(n,) for n in ("segment", "ubicacion", "turno", "shift", "position", "ghost", "via segmento", "persona", None, "")], "name string")
    got = {r["name"]: (r["column"], r["tier"]) for r in config.bind_names(spoken, columns, dictionary).collect()}
    pit = "Pit Position (zone)"
    assert got == {"segment": (pit, 7), "ubicacion": (pit, 8), "turno": ("Shift ID", 8), "shift": ("Shift ID", 2), "position": (pit, 6), "ghost": (None, None), "via segmento": (pit, 9), "persona": ("Operator ID", 8), None: (None, None), "": (None, None)}
    assert config.bind_names(spoken.limit(0), columns, dictionary).count() == 0
    assert {r["tier"] for r in config.bind_names(spoken, columns.limit(0)).collect()} == {None}
