"""More of the catalogue: cells and names, conditions and boards, generated cycles.

QUERIES and ORACLE_SQL hold everything, those of catalogue.py too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators import answer, config, crosstab, generator, ordered, references, rhythm, risk, rollup, series, stats, surface
from millrace.plans import catalogue as c
from millrace.plans.catalogue import CYCLES, EPOCH, FIRST, FLEET, LAST, ORACLE_SQL, ORDER, QUARANTINED, QUERIES, RUNS, SALES, SEED, STEP, TICKS, WINDOWS, _uniform_sql, by_turn, query, r, table

__all__ = ["ORACLE_SQL", "QUERIES"]

# Cells and names


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS words, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS squashed,
substr(replace(trim(regexp_replace(lower(p_type || ' ' || p_brand || ' of the long names'), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 1, 40) AS slug, trim(regexp_replace(lower('  ' || p_type || '   ' || p_brand), '\\s+', ' ', 'g')) AS spaced,
trim(regexp_replace(lower('Límite ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS letters FROM part""")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, brand = F.col("p_type"), F.col("p_brand")
    long = F.concat_ws(" ", kind, brand, F.lit("of the long names"))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.words_only(F.concat(kind, F.lit(" / "), brand)).alias("words"), coerce.squash(brand).alias("squashed"), coerce.slug(long).alias("slug"), coerce.spaced(F.concat(F.lit("  "), kind, F.lit("   "), brand)).alias("spaced"), coerce.letters_only(F.concat(F.lit("Límite "), kind)).alias("letters"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS sec, CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS day_first FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as ISO text, and read back; and dates with the day first."""
    texts = table(spark, sf_dir, "events").select("event_id", coerce.iso_text(F.col("ts")).alias("iso"), F.date_format("ts", "dd/MM/yyyy").alias("d"))
    read = texts.withColumn("t", coerce.parse_time(F.col("iso"))).withColumn("u", coerce.parse_time(F.col("d")))
    return read.select("event_id", "iso", epoch_seconds("t").alias("sec"), epoch_seconds("u").alias("day_first"))


SHORT = lambda x: f"regexp_replace(CAST(floor(({x}) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS VARCHAR), '\\.0$', '')"


@query(f"""WITH s AS (SELECT o_orderkey, (o_orderkey * 37) % 400000 AS sec FROM orders) SELECT o_orderkey,
CASE WHEN sec = 0 THEN 'irregular' WHEN sec < 60 THEN {SHORT("sec")} || ' s' WHEN sec < 3600 THEN {SHORT("sec / 60.0::DOUBLE")} || ' min' WHEN sec < 86400 THEN {SHORT("sec / 3600.0::DOUBLE")} || ' h' ELSE {SHORT("sec / 86400.0::DOUBLE")} || ' d' END AS grain,
CASE WHEN sec < 5400 THEN CAST(CAST(greatest(1, floor(sec / 60.0::DOUBLE + 0.5)) AS BIGINT) AS VARCHAR) || ' minutes' WHEN sec < 172800 THEN {SHORT("floor(sec / 360.0::DOUBLE + 0.5) / 10")} || ' hours' ELSE {SHORT("floor(sec / 8640.0::DOUBLE + 0.5) / 10")} || ' days' END AS span FROM s""")
def time_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = (F.col("o_orderkey") * 37) % 400_000
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.grain_label(sec).alias("grain"), coerce.span_label(sec).alias("span"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey, c_nationkey FROM customer), d AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'slack' ELSE 'webhook' END AS kind,
CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'a@b.example' ELSE 'a b@c' END WHEN 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN '+1-555-' || (1000 + c_custkey % 1000) ELSE 'call me' END WHEN 2 THEN CASE WHEN c_nationkey % 2 = 0 THEN '#ops' ELSE 'not a channel!' END ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'https://x.example/h' ELSE 'ftp://x' END END AS destination, c_nationkey % 2 = 0 AS ok FROM n)
SELECT c_custkey, kind, destination, ok FROM d""")
def channel_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, good = F.col("c_custkey") % 4, F.col("c_nationkey") % 2 == 0
    kind = F.when(key == 0, "email").when(key == 1, "sms").when(key == 2, "slack").otherwise("webhook")
    either = lambda a, b: F.when(good, a).otherwise(b)
    phone = F.concat(F.lit("+1-555-"), (1000 + F.col("c_custkey") % 1000).cast("string"))
    destination = F.when(key == 0, either("a@b.example", "a b@c")).when(key == 1, either(phone, "call me")).when(key == 2, either("#ops", "not a channel!")).otherwise(either("https://x.example/h", "ftp://x"))
    made = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), destination.alias("destination"))
    return made.withColumn("ok", coerce.destination_ok(F.col("kind"), F.col("destination")))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, 'trucks' AS label, 2::BIGINT AS facts FROM part""")
def preamble_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("fleet of "), F.col("p_size"), F.lit(" trucks · 12 drivers · 99 Trucks · site: north"))
    found = table(spark, sf_dir, "part").withColumn("f", coerce.counted_facts(text))
    return found.select("p_partkey", F.get("f", F.lit(0))["n"].alias("n"), F.get("f", F.lit(0))["label"].alias("label"), F.size("f").cast("long").alias("facts"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN NULL WHEN 3 THEN p_size * 60 WHEN 4 THEN p_size * 3600 + 1800 ELSE p_size END::BIGINT AS sec, CASE p_partkey % 6 WHEN 0 THEN '>' || p_size || ' s' WHEN 2 THEN 'Por ciclo' WHEN 5 THEN '<' || p_size END AS note FROM part""")
def parse_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    raw = by_turn("p_partkey", [F.concat(F.lit(">"), n, F.lit(" s")), n, F.lit("Por ciclo"), F.concat(n, F.lit(" min")), F.concat(n, F.lit(".5 h")), F.concat(F.lit("<"), n)])
    return table(spark, sf_dir, "part").withColumn("p", coerce.parse_persistence(raw)).select("p_partkey", "p.sec", "p.note")


PAIRS = [("gal/h", "galh", True, 3600), ("t", "tonnes", True, None), ("Fahrenheit", "degC", False, None), ("", "km", True, None), ("kg/min", "kg/s", False, 60), ("m/sec", None, True, 1)]


def _turned(key: str, rows: list[tuple], columns: list[str]) -> str:
    """The row of a list that a key takes in turn, in SQL."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v + "'"
    return ", ".join(f"CASE {key} % {len(rows)} " + " ".join(f"WHEN {i} THEN {show(r[k])}" for i, r in enumerate(rows)) + f" END AS {c}" for k, c in enumerate(columns))


def _in_turn(key: str, rows: list[tuple], k: int) -> Column:
    return by_turn(key, [F.lit(r[k]).cast("string") for r in rows])


@query(f"""SELECT p_partkey, agree, seconds FROM (SELECT p_partkey, {_turned("p_partkey", PAIRS, ["a", "b", "agree", "seconds"])} FROM part)""")
def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that parts have in turn, against those of others."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _in_turn("p_partkey", PAIRS, 0).alias("a"), _in_turn("p_partkey", PAIRS, 1).alias("b"))
    return rows.select("p_partkey", coerce.units_agree(F.col("a"), F.col("b")).alias("agree"), coerce.rate_seconds(F.col("a")).cast("int").alias("seconds"))


NAMES = [("Shift ID", "", "cohort", "count", "count"), ("Operator name", "", "person", "count", "count"), ("Truck", "t", "item", "count", "count"), ("Idle hours", "h", "cohort", "duration", "time"), ("Net revenue", "usd", "cohort", "money", "currency"), ("Growth", "%", "cohort", "percentage", "percentage"), ("Tasa de desviación", None, "cohort", "count", "percentage")]


@query(f"""SELECT p_partkey, {_turned("p_partkey", [n[2:] for n in NAMES], ["column_kind", "measure_kind", "format"])} FROM part""")
def named_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that go before a part's brand."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", _in_turn("p_partkey", NAMES, 0), F.lower("p_brand")).alias("name"), _in_turn("p_partkey", NAMES, 1).alias("unit"))
    return rows.select("p_partkey", coerce.kind_of_column(F.col("name")).alias("column_kind"), coerce.kind_of_measure(F.col("unit")).alias("measure_kind"), config.suggest_format(F.col("name"), F.col("unit")).alias("format"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'currency' WHEN 1 THEN 'time' ELSE 'count' END AS format FROM part""")
def declared_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared format counts if there is one of that name; else the name suggests it."""
    declared = F.when(F.col("p_size") % 4 == 0, "currency").when(F.col("p_size") % 4 == 2, "pounds")
    name = F.when(F.col("p_size") % 4 == 1, "idle hours").otherwise("parts")
    return table(spark, sf_dir, "part").select("p_partkey", coerce.declared_format(declared, config.suggest_format(name, F.lit(""))).alias("format"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_type || ' ' || p_type), ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM w""")
def unique_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.split(F.lower(F.concat_ws(" ", "p_type", "p_type")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(twice), " ").alias("words"))


@query("""SELECT p_partkey, contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'brand#3') AS quarantined FROM part""")
def zone_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some value holds a zone term of an incident."""
    incidents = references.reference_rows(spark.createDataFrame([("A", None, "PROMO; Toda la mina"), ("B", None, "Brand#3"), ("C", "2024-01-01", "ECONOMY")], "caso string, inicio string, zona string"), references.RECOGNISERS[1])
    return references.in_zone([F.col("p_type"), F.col("p_brand")], incidents, table(spark, sf_dir, "part")).select("p_partkey", "quarantined")


@query("""SELECT event_id, CASE WHEN hour(ts) >= 22 THEN 'late' WHEN value BETWEEN 10 AND 20 THEN 'low' WHEN event_type IN ('error', 'signup') THEN 'odd' END AS reason FROM events""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = [{"name": "late", "dim": "hour", "start": 22, "end": 24}, {"name": "low", "dim": "value", "lo": 10.0, "hi": 20.0}, {"name": "odd", "dim": "kind", "values": ["Error", "SIGNUP"]}]
    return table(spark, sf_dir, "events").select("event_id", risk.in_context_window(windows, F.hour("ts"), {"value": F.col("value"), "kind": F.col("event_type")}).alias("reason"))


@query(f"""WITH {TICKS}, x AS (SELECT user_id, event_id, suppressed, CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM ev WHERE kind = 'breach') SELECT user_id, event_id, severity FROM x WHERE NOT suppressed AND severity = 'critical'""")
def surfaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a high tolerance lets through."""
    breaches = c._log(spark, sf_dir).where("kind = 'breach'").withColumn("severity", F.when(F.col("user_id") % 3 == 0, "critical").otherwise("warning"))
    return risk.surface(breaches, 80).select("user_id", "event_id", "severity")


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY p_type, p_brand) % 3 AS k FROM (SELECT DISTINCT p_type, p_brand FROM part))
SELECT CASE k WHEN 0 THEN lower(p_type || ' ' || p_brand) WHEN 1 THEN p_type || '-' || p_brand ELSE p_brand || ' ' || p_type END AS name, p_type || ' ' || p_brand AS "column", CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS tier FROM t""")
def bound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and brands of parts spoken in lower case, with a dash, and backwards."""
    names = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct().withColumn("k", F.row_number().over(Window.orderBy("p_type", "p_brand")) % 3)
    whole = F.concat_ws(" ", "p_type", "p_brand")
    said = F.when(F.col("k") == 0, F.lower(whole)).when(F.col("k") == 1, F.concat_ws("-", "p_type", "p_brand")).otherwise(F.concat_ws(" ", "p_brand", "p_type"))
    return config.bind_names(names.select(said.alias("name")), names.select(whole.alias("column")))


@query("""SELECT n_name AS parameter, 'mean ' || lower(n_name) AS measure FROM nation""")
def matched_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as parameters, matched by name to measures of another unit or of theirs."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_name").collect()]
    measures = [(f"{kind} {n.lower()}", unit) for n in names for kind, unit in (("mean", "t"), ("sum", "km"))]
    found = references.match_thresholds([(n, "tonnes") for n in names], measures)
    return spark.createDataFrame(sorted(found.items()), "parameter string, measure string")


@query("""SELECT name, CASE name WHEN 'when' THEN 'time' WHEN 'who: driver' THEN 'who' WHEN 'amount' THEN 'val' ELSE 'ctx' END AS role, CASE name WHEN 'when' THEN 'datetime' WHEN 'amount' THEN 'number' ELSE 'category' END AS type FROM (VALUES ('when'), ('who: driver'), ('amount'), ('event type')) t(name)""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and roles of a sheet of events, read as text."""
    from millrace.operators.roles import column_roles as roles

    named = {"when": coerce.iso_text(F.col("ts")), "who: driver": F.concat(F.lit("u"), "user_id"), "amount": F.col("value").cast("decimal(18,2)").cast("string"), "event type": F.col("event_type")}
    cells = table(spark, sf_dir, "events").select(F.col("event_id").alias("_row"), F.posexplode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("cell")) for n, v in named.items()))).alias("column", "x"))
    return roles(cells.select(F.lit("s").alias("sheet"), "_row", "column", "x.name", "x.cell")).select("name", "role", "type")


# Catalogues, records, answers


@query("""WITH c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS "value" FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'day', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders),
n AS (SELECT "column", "value", count(*) AS n FROM c GROUP BY 1, 2), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INTEGER) AS rank, count(*) OVER (PARTITION BY "column") AS distinct_values FROM n) SELECT * FROM w WHERE rank <= 30""")
def context_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return stats.top_values(orders, ["o_orderstatus", "o_orderpriority", "day"], 30)


@query(f"""WITH RECURSIVE {CYCLES}, {RUNS}, t AS (SELECT user_id, count(*) AS "rows", avg(value) AS m, sum(value) AS s FROM events GROUP BY 1), ep AS (SELECT user_id, count(*) AS episodes, count(DISTINCT state) AS states FROM runs GROUP BY 1),
y AS (SELECT user_id, count(*) AS cycles, sum(label_peak) AS q FROM c WHERE completes GROUP BY 1) SELECT t.user_id, "rows", {r("m")} AS mean, {r("s * 60 / 3600")} AS integrated, coalesce(episodes, 0) AS episodes, coalesce(states, 0) AS states, coalesce(cycles, 0) AS cycles, coalesce({r("q")}, 0) AS quantity FROM t LEFT JOIN ep USING (user_id) LEFT JOIN y USING (user_id)""")
def unit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = c._cycles(spark, sf_dir).where("completes").select("user_id", F.col("cycle_peak").alias("peak"))
    return surface.unit_record(table(spark, sf_dir, "events"), "user_id", "value", c._runs(spark, sf_dir), completed, 60, 3600)


GRAINS = f"""s AS (SELECT user_id, {EPOCH} - lag({EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), k AS (SELECT user_id, step, count(*) AS n FROM s WHERE step > 0 AND step < 31 * 86400 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, step) AS i, sum(n) OVER (PARTITION BY user_id) AS total FROM k), g AS (SELECT user_id, step AS grain_sec, CAST(total - n AS BIGINT) AS gaps FROM w WHERE i = 1)"""


@query(f"""WITH {GRAINS} SELECT (SELECT min({EPOCH}) FROM events) AS first_sec, (SELECT max({EPOCH}) FROM events) AS last_sec, (SELECT count(DISTINCT user_id) FROM events) AS series, (SELECT grain_sec FROM g GROUP BY 1 ORDER BY count(*) DESC, grain_sec LIMIT 1) AS grain_sec, (SELECT CAST(sum(gaps) AS BIGINT) FROM g) AS gaps""")
def time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return surface.time_span(events, "user_id", epoch_seconds("ts"), stats.grain(events, "user_id", "ts", ORDER))


@query(f"""SELECT 'l_returnflag' AS "first", l_returnflag AS first_value, 'l_linestatus' AS "second", l_linestatus AS second_value, count(*) AS n, {r("avg(l_quantity)")} AS mean FROM lineitem GROUP BY 2, 4
UNION ALL SELECT 'l_returnflag', l_returnflag, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), {r("avg(l_quantity)")} FROM lineitem GROUP BY 2, 4 UNION ALL SELECT 'l_linestatus', l_linestatus, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), {r("avg(l_quantity)")} FROM lineitem GROUP BY 2, 4""")
def every_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.pairs_of_categories(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity")


@query(f"""WITH {SALES} SELECT 'nation' AS dim, n_name AS member, {r("avg(l_extendedprice)")} AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'unit', CAST(l_suppkey AS VARCHAR), {r("avg(l_extendedprice)")}, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'incident', CASE WHEN regexp_matches(p_type, '^(SMALL|MEDIUM|LARGE)') THEN 'sized' ELSE p_type END, {r("sum(p_retailprice)")}, count(*) FROM part GROUP BY 2""")
def answer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema for the members of a context, of units and of incident families."""
    sales = c._sales(spark, sf_dir)
    family = F.when(F.col("p_type").rlike("^(SMALL|MEDIUM|LARGE)"), "sized").otherwise(F.col("p_type"))
    sources = {"nation": answer.members(sales, answer.Question("n_name", "l_extendedprice")), "unit": answer.members(sales, answer.Question("l_suppkey", "l_extendedprice")), "incident": answer.members(table(spark, sf_dir, "part").withColumn("family", family), answer.Question("family", "p_retailprice", "sum"))}
    return answer.cells(sources)


@query("""SELECT 'context:event_type' AS id, 'cohort' AS kind, count(DISTINCT event_type) AS members FROM events UNION ALL SELECT 'unit', 'item', count(DISTINCT user_id) FROM events UNION ALL SELECT 'roster', 'person', count(DISTINCT c_name) FROM customer UNION ALL SELECT 'incident', 'reason', count(DISTINCT p_type) FROM part""")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be ranked over, the kind of answer that each gives, and its members."""
    events = table(spark, sf_dir, "events")
    sources = {"context:event_type": (events, "event_type", None), "unit": (events, "user_id", "item"), "roster": (table(spark, sf_dir, "customer"), "c_name", "person"), "incident": (table(spark, sf_dir, "part"), "p_type", "reason")}
    return answer.dimensions(sources)


@query(f"""WITH l AS ({c.LONG_LINEITEM}), u AS (SELECT 'l_returnflag' AS category, l_returnflag AS member, measure, v FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, measure, v FROM l), e AS (SELECT category, measure, member, avg(v) AS m FROM u GROUP BY 1, 2, 3),
k AS (SELECT category, measure, count(*) AS members, {r("abs(stddev_samp(m) / avg(m))", 6)} AS cv, {r("max(m) - min(m)")} AS range FROM e GROUP BY 1, 2 HAVING count(*) >= 2) SELECT * FROM k WHERE NOT (category = 'l_returnflag' AND measure = 'l_tax') ORDER BY cv DESC, category, measure LIMIT 3""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = spark.createDataFrame([("l_returnflag", "l_tax")], "category string, measure string")
    return answer.shortlist(answer.question_candidates(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], c.MEASURES), taken, 3)


@query(f"""WITH o AS (SELECT user_id, value AS v, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events), k AS (SELECT CAST(user_id AS VARCHAR) AS name, {r("count(*) FILTER (top > 0 AND v <= top * 0.005)::DOUBLE / count(*)")} AS zero_share, {r("count(*) FILTER (top > 0 AND v > top * 0.005 AND v >= top * 0.9)::DOUBLE / count(*)")} AS plateau_share, count(*) AS "rows" FROM o GROUP BY 1)
SELECT * FROM k ORDER BY zero_share > 0 DESC, floor(plateau_share / 0.02) DESC, "rows" DESC, name LIMIT 6""")
def cycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shapes = ordered.cycle_shape(events, "user_id", "value", ORDER).join(events.groupBy("user_id").agg(F.count("*").alias("rows")), "user_id")
    return surface.rank_cycles(shapes.select(F.col("user_id").cast("string").alias("name"), "zero_share", "plateau_share", "rows"))


@query(f"""WITH RECURSIVE {RUNS}, d AS (SELECT state AS a, lead(state) OVER (PARTITION BY user_id ORDER BY run) AS b FROM runs), ed AS (SELECT a, b, count(*) AS n FROM d WHERE b IS NOT NULL GROUP BY 1, 2), f AS (SELECT a FROM ed GROUP BY 1 ORDER BY sum(n) DESC, a LIMIT 1),
walk AS (SELECT 1 AS position, a AS state, [a] AS seen FROM f UNION ALL SELECT position + 1, b, list_append(seen, b) FROM (SELECT w.position, w.seen, ed.b, row_number() OVER (ORDER BY ed.n DESC, ed.b) AS k FROM walk w JOIN ed ON ed.a = w.state WHERE NOT list_contains(w.seen, ed.b)) WHERE k = 1) SELECT CAST(position AS BIGINT) AS position, state FROM walk""")
def cycle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surface.walk_order(ordered.transitions(c._runs(spark, sf_dir), "user_id"))
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(found)], "position long, state string")


# Conditions and boards


@query("""SELECT c_custkey, c_custkey % 5 <> 0 AND CASE c_nationkey % 4 WHEN 0 THEN c_acctbal > 5000 WHEN 1 THEN c_acctbal >= 5000 WHEN 2 THEN c_acctbal < 5000 ELSE c_acctbal <= 5000 END AS flagged FROM customer""")
def answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("any", "gte", "lt", "lte"))), F.col("c_nationkey") % 4 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", surface.flagged(F.col("c_acctbal"), op, F.lit(5000.0), F.col("c_custkey") % 5 != 0).alias("flagged"))


@query(f"""WITH v AS (SELECT c_nationkey AS kbr, avg(c_acctbal) AS value FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN s_acctbal ELSE {r("value")} END AS observed FROM customer JOIN v ON kbr = c_nationkey LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey = c_custkey % 40""")
def observed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    conditions = customer.select("c_custkey", F.col("c_nationkey").alias("kbr"), F.when(F.col("c_custkey") % 2 == 0, "touchpoint").otherwise("kbr").alias("scope_kind"), (F.col("c_custkey") % 40).alias("scope_ref"))
    results = customer.groupBy(F.col("c_nationkey").alias("kbr")).agg(half_up(F.avg("c_acctbal")).alias("value"))
    touchpoints = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kbr"), F.col("s_suppkey").alias("tid"), F.col("s_acctbal").alias("health"))
    return surface.observed(conditions, results, touchpoints).select("c_custkey", "observed")


@query("""WITH i AS (SELECT p_partkey, p_type, p_brand, CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE 0.1 END AS excess FROM part WHERE p_size > 25) SELECT p_brand AS zone, arg_min(p_type, p_partkey) AS label, arg_min(p_type, p_partkey) AS note FROM i WHERE coalesce(excess, 0) = 0 GROUP BY 1""")
def learned_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    excess = F.when(F.col("p_size") % 3 == 0, 0.0).when(F.col("p_size") % 3 == 2, 0.1)
    start = F.when(F.col("p_size") <= 25, F.lit("2024-01-01"))
    return surface.learned_exceptions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("label"), start.alias("start"), F.col("p_brand").alias("zone"), excess.alias("excess"), F.lit(None).cast("string").alias("effect")))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conditions: open ones go to a channel, those of low priority are off."""
    channels = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("ops"), F.concat(F.lit("c"), F.col("o_custkey") % 3))).otherwise(F.array().cast("array<string>"))
    responses = F.array(F.struct(F.lit("alert").alias("type"), channels.alias("channels")), F.struct(F.lit("note").alias("type"), F.array().cast("array<string>").alias("channels")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderpriority") != "5-LOW").alias("enabled"), responses.alias("responses"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderpriority <> '5-LOW') AS configured, count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'O') AS routed FROM orders GROUP BY 1""")
def routed_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.routing(_conditions(spark, sf_dir), "o_orderpriority")


@query("""SELECT unnest(['ops', 'c' || o_custkey % 3]) AS channel, count(*) AS conditions FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def channel_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.channel_references(_conditions(spark, sf_dir), "o_orderkey")


@query(f"""WITH i AS (SELECT CASE WHEN p_size > 25 THEN 'window' WHEN p_size > 10 THEN 'zone' ELSE 'none' END AS q FROM part) SELECT count(*) AS incidents, count(*) FILTER (q = 'window') AS windows, count(*) FILTER (q = 'zone') AS zones, count(*) FILTER (q = 'none') AS unquarantinable, (SELECT count(*) FROM lineitem WHERE {QUARANTINED}) AS rows_excluded FROM i""")
def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") > 25, "window").when(F.col("p_size") > 10, "zone").otherwise("none")
    excluded = table(spark, sf_dir, "lineitem").where(crosstab.in_windows("l_shipdate", WINDOWS))
    return surface.incident_summary(table(spark, sf_dir, "part").select(kind.alias("quarantine")), excluded)


@query(f"""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS s, avg(o_totalprice) AS m, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS num, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS den FROM orders GROUP BY 1)
SELECT o_custkey, {r("s")} AS sum, {r("m")} AS mean, {r("num / nullif(den, 0)", 6)} AS ratio, CASE WHEN num IS NULL THEN 'no numerator' WHEN coalesce(den, 0) = 0 THEN 'no denominator' END AS warning FROM s""")
def role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "numerator").when(F.col("o_orderstatus") == "O", "denominator")
    return surface.role_rollup(table(spark, sf_dir, "orders"), "o_custkey", role, "o_totalprice")


@query("""SELECT o_orderkey AS id, o_orderpriority AS label, CASE WHEN o_custkey % 3 = 0 THEN 'touchpoint' ELSE 'kbr' END AS scope_kind, CASE WHEN o_custkey % 3 = 0 THEN 'm' || o_custkey END AS scope_ref, CASE WHEN o_orderstatus = 'F' THEN 'lt' ELSE 'any' END AS op, o_totalprice AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'alarm' ELSE 'alert' END AS response,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN o_orderstatus = 'O' THEN 'unknown' END AS family, o_orderstatus = 'P' AS missing, true AS enabled FROM orders""")
def migrated_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    legacy = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("aid"), priority.alias("name"), F.when(status == "F", "threshold").when(status == "O", "anomaly").otherwise("missing").alias("type"),
        F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high").otherwise("warning").alias("severity"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("m"), "o_custkey")).alias("metric"),
        F.lit(None).cast("string").alias("op"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("ops"))).otherwise(F.array().cast("array<string>")).alias("channels"), F.lit(None).cast("boolean").alias("enabled"),
    )
    return surface.migrated(legacy)


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'gt' ELSE 'lt' END || ',' || CASE WHEN p_size % 2 = 0 THEN 'lt' ELSE 'gt' END || ',' || CASE WHEN p_size % 3 = 0 THEN 'pp_change' ELSE 'pct_change' END AS ops, p_size % 5 <> 0 AND p_size % 7 <> 0 AS simple FROM part""")
def condition_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparisons that an item offers, and whether its condition is a simple one."""
    size = F.col("p_size")
    ops = surface.options_for(F.when(size % 3 == 0, "percentage").otherwise("pounds"), F.when(size % 2 == 0, "down").otherwise("up"))
    made = surface.condition(table(spark, sf_dir, "part").withColumn("persist_sec", F.when(size % 5 == 0, 60)).withColumn("scope_kind", F.when(size % 7 == 0, "source")))
    return made.select("p_partkey", F.array_join(ops, ",").alias("ops"), surface.is_simple(F.lit(None), F.lit(None)).alias("simple"))


_RESPONSES = [(s, t, n, a) for s, types in surface.VOCABULARY.items() for t, n, a in types]


@query(f"""SELECT p_partkey, {_turned("p_partkey", [(n, a) for _, _, n, a in _RESPONSES], ["can", "acts"])} FROM part""")
def response_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with responses in turn: which of them can notify, and which act."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _in_turn("p_partkey", _RESPONSES, 0).alias("surface"), _in_turn("p_partkey", _RESPONSES, 1).alias("type"))
    known = surface.vocabulary(spark)
    return rows.join(F.broadcast(known), ["surface", "type"]).select("p_partkey", surface.can_notify(F.col("surface"), F.col("type")).alias("can"), "acts")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND value <= 50 THEN NULL WHEN event_type = 'error' THEN 'hour ' || hour(ts) WHEN value <= 50 THEN 'kind ' || event_type ELSE 'kind ' || event_type || ' · hour ' || hour(ts) END AS context FROM events""")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, hour = F.when(F.col("event_type") != "error", F.col("event_type")), F.when(F.col("value") > 50, F.hour("ts"))
    return table(spark, sf_dir, "events").select("event_id", surface.context_text({"kind": kind, "hour": hour}).alias("context"))


@query("""SELECT (SELECT count(*) FROM events WHERE value > 1e9) + (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 AS empty""")
def board_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.board_is_empty(table(spark, sf_dir, "events").where("value > 1e9"), table(spark, sf_dir, "orders").where("o_totalprice < 0"))


@query("""SELECT 'touchpoint' AS kept_in, s_nationkey AS host, s_name AS name FROM supplier UNION ALL SELECT 'answer', c_nationkey, c_name FROM customer""")
def touchpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.touchpoints_of(("touchpoint", table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), F.col("s_name").alias("name"))), ("answer", table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("host"), F.col("c_name").alias("name"))))


@query("""SELECT n_name AS sheet, label FROM nation, (VALUES ('all', NULL), ('several', 'Nation_1'), ('exact', 'NATION_3'), ('none', 'Atlantis')) i(label, entity) WHERE entity IS NULL OR contains(lower(n_name), lower(entity))""")
def incident_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    incidents = spark.createDataFrame([("all", None), ("several", "Nation_1"), ("exact", "NATION_3"), ("none", "Atlantis")], "label string, entity string")
    return surface.incident_sheets(table(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet")), incidents, coerce.without_accents)


@query("""SELECT CASE WHEN EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = c_nationkey) THEN 'kept' ELSE 'skipped' END AS outcome, count(*) AS rules FROM customer GROUP BY 1""")
def rules_on_touchpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    kept, skipped = surface.rules_on_touchpoints(rules, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")
    counted = kept.agg(F.lit("kept").alias("outcome"), F.count("*").alias("rules")).unionByName(skipped.agg(F.lit("skipped").alias("outcome"), F.count("*").alias("rules")))
    return counted.where("rules > 0")


@query(f"""WITH {TICKS}, l AS (SELECT user_id, max("at") AS since FROM ev GROUP BY 1 HAVING arg_max(kind, event_id) = 'breach') SELECT user_id, since FROM l ORDER BY since DESC, user_id LIMIT 5""")
def most_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.most_urgent(risk.live_state(c._log(spark, sf_dir), ["user_id"], ["at", "event_id"]), [F.desc("since"), F.asc("user_id")])


@query(f"""WITH {TICKS} SELECT user_id, event_id, "at", held_ms FROM ev WHERE kind = 'recovered' ORDER BY "at" DESC, event_id LIMIT 50""")
def recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest recoveries of all results."""
    return c._log(spark, sf_dir).where("kind = 'recovered'").orderBy(F.desc("at"), "event_id").limit(50).select("user_id", "event_id", "at", "held_ms")


@query("""SELECT 3::BIGINT AS kbrs, 3::BIGINT AS answers, 1::BIGINT AS unresolved, 1::BIGINT AS unmatched""")
def applied_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document applied to the nations as results and the columns of line items."""
    text = "kind,kbr,name,dimension,measure\nkbr,,nation_1,,\nkbr,,Nation-2,,\nkbr,,NATION_3,,\nkbr,,Atlantis,,\nanswer,nation_1,a,l_returnflag,l_quantity\nanswer,nation_1,b,L Linestatus,l tax\nanswer,NATION_3,c,colour,l_tax\nanswer,Atlantis,d,l_returnflag,l_tax\n"
    parts = config.tables(config.config_frame(spark, text, "board.csv"))
    columns = spark.createDataFrame([(n,) for n in table(spark, sf_dir, "lineitem").columns], "column string")
    return surface.applied(parts["kbr"], table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), parts["answer"], columns, coerce.squash)


# Generated cycles

CYCLE_STATES = f"""{RUNS}, d0 AS (SELECT state, avg("end" - "start") + 60 AS m, coalesce(stddev_samp("end" - "start"), 0) AS s FROM runs GROUP BY 1), st AS (SELECT state, {r("m")} AS dwell, least(1.0, {r("s / m", 6)}) AS cv FROM d0), len AS (SELECT sum(dwell) AS cycle FROM st),
un AS (SELECT user_id AS unit, {r("avg(value)")} AS mean, {r("coalesce(stddev_samp(value), 0)")} AS sd FROM events GROUP BY 1),
cy AS (SELECT unit, mean, sd, cycle, {_uniform_sql(f"'{SEED}'", "'offset'", "CAST(unit AS VARCHAR)")} * cycle AS off FROM un, len),
kk AS (SELECT *, unnest(range(CAST(floor(({FIRST}.0::DOUBLE + off) / cycle) AS BIGINT), CAST(floor(({LAST}.0::DOUBLE + off) / cycle) AS BIGINT) + 1)) AS k FROM cy)"""


def _normal_sql(*parts: str) -> str:
    return "(2.0::DOUBLE * (" + " + ".join(_uniform_sql(*parts, f"'{i}'") for i in (0, 1, 2)) + " - 1.5::DOUBLE))"


PLACED = f"""{CYCLE_STATES}, dr AS (SELECT kk.*, st.state, greatest(0.15 * dwell, dwell * (1 + greatest(-2.0, least(2.0, {_normal_sql(f"'{SEED}'", "CAST(unit AS VARCHAR)", "CAST(k AS VARCHAR)", "state")})) * cv)) AS d FROM kk, st),
pl AS (SELECT unit, k, state, mean, sd, d, k * cycle - off + sum(d) OVER (PARTITION BY unit, k ORDER BY state) * cycle / sum(d) OVER (PARTITION BY unit, k) AS until, cycle / sum(d) OVER (PARTITION BY unit, k) AS scale FROM dr),
dn AS (SELECT unit, k, {r("until")} AS "at", {r(f"greatest(0.0, mean + greatest(-2.5, least(2.5, {_normal_sql(chr(39) + SEED + chr(39), chr(39) + 'quantity' + chr(39), 'CAST(unit AS VARCHAR)', 'CAST(k AS VARCHAR)')})) * sd)")} AS quantity FROM pl WHERE state = 'view' AND until BETWEEN {FIRST} AND {LAST})"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    length = F.col("end") - F.col("start")
    states = c._runs(spark, sf_dir).groupBy("state").agg((F.avg(length) + 60).alias("m"), F.coalesce(F.stddev_samp(length), F.lit(0.0)).alias("s")).select("state", half_up("m").alias("dwell"), F.least(F.lit(1.0), half_up(F.col("s") / F.col("m"), 6)).alias("cv"))
    states = states.crossJoin(F.broadcast(states.agg(F.sum("dwell").alias("cycle"))))
    units = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit")).agg(half_up(F.avg("value")).alias("mean"), half_up(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("sd"))
    return series.jittered_states(states, series.cycle_numbers(states, units.select("unit"), FIRST, LAST, SEED), SEED), units


@query(f"""WITH {PLACED} SELECT unit, k, state, {r("until - d * scale")} AS since, {r("until")} AS until FROM pl""")
def jittered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[0].select("unit", "k", "state", half_up("since").alias("since"), half_up("until").alias("until"))


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, units = _placed(spark, sf_dir)
    return series.completed_cycles(placed, "view", units, FIRST, LAST, SEED)


@query(f"""WITH {PLACED} SELECT unit, k, "at", quantity FROM dn""")
def completed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completed(spark, sf_dir)


@query(FLEET.replace("WITH ", "WITH f0 AS (WITH ", 1) + f""" SELECT unit, sum(value) * {STEP} / 3600 AS integrated FROM series GROUP BY 1), q0 AS (WITH {PLACED} SELECT unit, count(*) AS cycles, sum(quantity) AS quantity FROM dn GROUP BY 1)
SELECT f0.unit, {r(r("integrated", 6))} AS integrated, coalesce(cycles, 0) AS cycles, {r("coalesce(quantity, 0)")} AS quantity, {r("integrated / nullif(quantity, 0)", 6)} AS per_quantity FROM f0 LEFT JOIN q0 USING (unit)""")
def cycle_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio KPI: an integrated rate over what completed cycles carried."""
    return series.ratio_kpi(c._fleet(spark, sf_dir), _completed(spark, sf_dir), STEP, 3600)


_G = lambda i: _normal_sql(f"'{SEED}'", "'noise'", "CAST(user_id AS VARCHAR)", f"CAST({i} AS VARCHAR)")


@query(f"""WITH e AS (SELECT event_id, user_id, {EPOCH} // 3600 AS i, ({EPOCH} % 3600) / 3600.0::DOUBLE AS t FROM events), g AS (SELECT event_id, t, {_G("i")} AS a, {_G("i + 1")} AS b FROM e) SELECT event_id, {r("a + (b - a) * t * t * (3 - 2 * t)", 6)} AS noise FROM g""")
def smooth_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", half_up(series.smooth_noise(epoch_seconds("ts"), 3600, SEED, "noise", F.col("user_id")), 6).alias("noise"))


SHIFT = "CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END"
SCHEDULED = f"""fc AS (WITH w AS (SELECT {SHIFT} AS "window", count(value) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT "window", {r("greatest(0.5, least(2.0, (s / n) / ((SELECT sum(s) FROM w) / (SELECT sum(n) FROM w))))", 6)} AS factor FROM w),
sc AS (SELECT hour, v FROM (SELECT hour(ts) AS hour, {SHIFT} AS v, row_number() OVER (PARTITION BY hour(ts) ORDER BY count(*) DESC, {SHIFT}) AS k FROM events GROUP BY 1, 2) WHERE k = 1)"""


@query(FLEET + f""", {SCHEDULED} SELECT unit, "at", "window", {r("value * factor")} AS value FROM series JOIN sc ON ("at" // 3600) % 24 = hour JOIN fc ON v = "window" """)
def scheduled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated series with the factor of the shift that each hour is in."""
    events, shift = table(spark, sf_dir, "events"), F.when(F.hour("ts").between(6, 17), "day").otherwise("night")
    return series.apply_schedule(c._fleet(spark, sf_dir), series.scheduled_values(events, "ts", shift), generator.schedule_factors(events, shift, "value"))


@query("""SELECT 'Fuel Rate' AS measure, count(*) AS votes FROM part WHERE p_size % 3 <> 0""")
def incident_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    variable = F.when(F.col("p_size") % 3 == 0, "Payload").when(F.col("p_size") % 3 == 1, "fuel-rate").otherwise("rate of engine")
    return series.vote_for_measure(table(spark, sf_dir, "part").select(variable.alias("variable")), [("Payload", False), ("Fuel Rate", True), ("Speed", True)], coerce.letters_only)


@query("""SELECT p_partkey, p_size AS start, p_size + 10 AS "end" FROM part WHERE p_size + 10 >= 20 AND p_size <= 30""")
def overlapping_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.overlapping(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("start"), (F.col("p_size") + 10).alias("end")), 20, 30)


@query(f"""WITH k AS (SELECT o_orderstatus AS level, o_orderpriority AS state, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2), w AS (SELECT state, sum(n) AS w FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT level) FROM k)),
s AS (SELECT level, sum(w * m) / sum(w) AS std, sum(n) AS n, count(*) AS states FROM k JOIN w USING (state) GROUP BY 1) SELECT level, CAST(n AS BIGINT) AS n, {r("greatest(0.5, least(2.0, std / ((SELECT sum(std * n) FROM s) / (SELECT sum(n) FROM s))))", 6)} AS factor FROM s WHERE states >= 2""")
def standardised_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.standardised_factors(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")


@query(f"""WITH l AS (SELECT l_returnflag AS v, l_quantity AS x, {QUARANTINED} AS q FROM lineitem) SELECT v AS "value", CASE WHEN count(*) FILTER (NOT q) > 0 THEN {r("avg(x) FILTER (NOT q)")} ELSE {r("avg(x)")} END AS level, CASE WHEN count(*) FILTER (NOT q) > 0 THEN count(*) FILTER (NOT q) ELSE count(*) END AS n FROM l GROUP BY 1""")
def clean_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a series is generated from: clean levels, and dirty ones where none is clean."""
    cells = crosstab.marginal(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity"], crosstab.in_windows("l_shipdate", WINDOWS))
    clean = F.col("baseline_n") > 0
    return cells.select("value", F.when(clean, F.col("baseline_mean")).otherwise(F.col("mean")).alias("level"), F.when(clean, F.col("baseline_n")).otherwise(F.col("n")).alias("n"))
