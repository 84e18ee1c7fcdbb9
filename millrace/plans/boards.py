"""Queries of patterns, projections, cross-tabs from one scan and equal rosters; all
queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators import board, config, crosstab, patterns, rhythm, rollup
from millrace.plans import catalogue as c
from millrace.plans import facets
from millrace.plans.catalogue import CELL, EPOCH, LONG_LINEITEM, MEASURES, ORDER, QUARANTINED, TICKS, WINDOWS, query, r, table

QUERIES, ORACLE_SQL = facets.QUERIES, facets.ORACLE_SQL


# Patterns

@query(f"""WITH {TICKS}, l AS (SELECT *, lag(kind) OVER w AS k1, lag(kind, 2) OVER w AS k2, lag("at", 2) OVER w AS began FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY "at", event_id))
SELECT user_id, event_id, "at", began // 1000 AS began_sec FROM l WHERE kind = 'breach' AND k1 = 'recovered' AND k2 = 'breach' AND "at" - began <= 172800000""")
def relapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breach, recovered and breach again within two days of a user."""
    steps = {k: F.col("kind") == k for k in ("breach", "recovered")}
    found = patterns.match_pattern(c._log(spark, sf_dir), "user_id", ["at", "event_id"], F.col("at") / 1000, steps, "breach recovered breach", 2 * 86400)
    return found.select("user_id", "event_id", "at", F.floor("began_sec").alias("began_sec"))


@query(f"""WITH l AS (SELECT user_id, event_id, event_type, {EPOCH} AS sec, lag(event_type) OVER w AS before, lag({EPOCH}) OVER w AS began FROM events WHERE event_type <> 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, began AS began_sec FROM l WHERE event_type = 'error' AND before = 'error' AND sec - began <= 259200""")
def repeated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error after an error, with nothing but clicks between, within three days."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    steps = {k: F.col("event_type") == k for k in ("error", "click")}
    found = patterns.match_pattern(events, "user_id", ORDER, epoch_seconds("ts"), steps, "error click* error", 3 * 86400)
    return found.select("user_id", "event_id", F.floor("began_sec").alias("began_sec"))


# Projections

NOW = "date_trunc('day', max(ts)) + INTERVAL 14 HOUR"


@query(f"""WITH n AS (SELECT {NOW} AS now FROM events), d AS (SELECT event_type AS scope, date_trunc('day', ts) AS day, coalesce(sum(value) FILTER (date_trunc('second', ts)::TIME <= now::TIME), 0) AS come, coalesce(sum(value) FILTER (date_trunc('second', ts)::TIME > now::TIME), 0) AS rest, any_value(date_trunc('day', now)) AS today FROM events, n WHERE ts < date_trunc('day', now) + INTERVAL 1 DAY GROUP BY 1, 2),
a AS (SELECT scope, date_diff('day', min(day) FILTER (day < today), any_value(today)) AS k, coalesce(sum(come) FILTER (day = today), 0) AS accrued, sum(come) FILTER (day < today) AS c, sum(rest) FILTER (day < today) AS s, sum(rest * rest) FILTER (day < today) AS q FROM d GROUP BY 1),
p AS (SELECT scope, accrued, 1.1::DOUBLE * (c + s) / k AS target, c / (c + s) AS share, accrued / (c / k) AS pace, s / k AS rest, sqrt(greatest(0, (q - s * s / k) / (k - 1))) AS sd FROM a WHERE scope <> 'signup')
SELECT scope, 'attainment_gap' AS condition, {r("accrued")} AS "value", {r("target * share")} AS threshold, {r("accrued")} < {r("target * share")} AS fires, {r("accrued")} < {r("target * share")} AS sure FROM p
UNION ALL SELECT scope, 'projected_miss', {r("accrued + pace * rest")}, {r("target")}, {r("accrued + pace * rest")} < {r("target")}, {r("accrued + pace * rest + pace * sd")} < {r("target")} FROM p""")
def pace_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of events at two in the afternoon, against a tenth more than a usual
    day; signups have no target."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    now = events.agg(F.date_format(F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL 14 HOURS"), "yyyy-MM-dd HH:mm:ss").alias("now")).first()["now"]
    found = board.projections(events, "event_type", "ts", "value", now or "1970-01-01 00:00:00")
    day, today = F.to_date("ts"), F.to_date(F.lit(now))
    usual = events.where((day < today) & (F.col("event_type") != "signup")).groupBy(F.col("event_type").alias("scope")).agg((F.sum("value") * 1.1 / F.datediff(today, F.min(day))).alias("target"))
    return board.pace_conditions(found, usual)


# Cross-tabs from one scan

ETA = f"""l AS (SELECT *, {QUARANTINED} AS q FROM ({LONG_LINEITEM})), u AS (SELECT 'l_returnflag' AS category, l_returnflag AS "value", measure, v, q FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, measure, v, q FROM l)"""


@query(f"""WITH {ETA}, x AS (SELECT category, "value", measure, {CELL} FROM u GROUP BY 1, 2, 3), g AS (SELECT category, "value", measure, count(*) AS k, avg(v) AS m, var_pop(v) AS var FROM u GROUP BY 1, 2, 3),
t AS (SELECT category, measure, sum(k * m) / sum(k) AS grand FROM g GROUP BY 1, 2), e AS (SELECT category, measure, CASE WHEN sum(k) >= 500 AND count(*) >= 2 THEN {r("sum(k * (m - grand) * (m - grand)) / nullif(sum(k * (m - grand) * (m - grand)) + sum(k * var), 0)", 6)} END AS eta2 FROM g JOIN t USING (category, measure) GROUP BY 1, 2)
SELECT x.*, eta2 FROM x JOIN e USING (category, measure)""")
def xtab_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with baselines and effect sizes of two categories over four measures."""
    cells = crosstab.moments(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], MEASURES, crosstab.in_windows("l_shipdate", WINDOWS))
    return crosstab.with_effects(cells)


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their shift, the hour's third and the property k."""
    hour = F.hour("ts")
    return table(spark, sf_dir, "events").select("ts", "event_type", F.when(hour < 12, "day").otherwise("night").alias("shift"), F.floor(hour / 8).cast("string").alias("third"), (F.col("user_id") % 4).cast("string").alias("crew"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _scheduled(events: DataFrame) -> list[str]:
    """Columns that the clock schedules, found in the data: a few names."""
    found = rhythm.clock_schedule(events, "ts", {d: F.col(d) for d in ("shift", "third", "crew")})
    return sorted(x["category"] for x in found.where("scheduled").select("category").collect())


SHIFTED = """s AS (SELECT event_type, CASE WHEN hour(ts) < 12 THEN 'day' ELSE 'night' END AS shift, CAST(hour(ts) // 8 AS VARCHAR) AS third, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
o AS (SELECT event_type AS state, 'shift' AS dimension, shift AS "value", 'value' AS measure, value AS v, ts FROM s UNION ALL SELECT event_type, 'third', third, 'value', value, ts FROM s UNION ALL SELECT event_type, 'shift', shift, 'k', k, ts FROM s UNION ALL SELECT event_type, 'third', third, 'k', k, ts FROM s)"""
HELD = ("2024-01-05 00:00:00", "2024-01-07 12:00:00")


@query(f"""WITH {SHIFTED}, l AS (SELECT *, ts BETWEEN TIMESTAMP '{HELD[0]}' AND TIMESTAMP '{HELD[1]}' AS q FROM o WHERE v IS NOT NULL) SELECT 'event_type' AS state_column, state, dimension, "value", measure, {CELL} FROM l GROUP BY 2, 3, 4, 5""")
def oriented_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by those dimensions that turn out to be scheduled: crews do not."""
    events = _shifted(spark, sf_dir)
    return crosstab.oriented_joint(crosstab.oriented_moments(events, ["event_type"], _scheduled(events), ["value", "k"], crosstab.in_windows("ts", [HELD])))


@query(f"""WITH {SHIFTED}, c AS (SELECT state, dimension, "value", measure, count(v) AS n, avg(v) AS m FROM o WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4), w AS (SELECT *, sum(n) OVER (PARTITION BY dimension, measure, state) AS w FROM c),
p AS (SELECT dimension, measure, "value", sum(m * n) / sum(n) AS raw, sum(m * w) / sum(w) AS mix FROM w GROUP BY 1, 2, 3), b AS (SELECT dimension, measure, min("value") AS first_value, max("value") AS second_value, arg_max(raw, "value") / arg_min(raw, "value") AS raw, arg_max(mix, "value") / arg_min(mix, "value") AS mix FROM p GROUP BY 1, 2 HAVING count(*) = 2)
SELECT 'event_type' AS state_column, dimension, measure, first_value, second_value, {r("(raw - 1) * 100")} AS marginal_pct, {r("(mix - 1) * 100")} AS standardised_pct, {r("(mix - raw) * 100")} AS confound_points FROM b""")
def confound_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the margin between day and night is the mix of event types."""
    events = _shifted(spark, sf_dir)
    return crosstab.confound_notes(crosstab.oriented_moments(events, ["event_type"], _scheduled(events), ["value", "k"]))


# Rosters

@query("""WITH m AS (SELECT DISTINCT 'user ' || user_id AS roster, event_type AS member FROM events UNION SELECT DISTINCT 'month ' || o_orderpriority, strftime(o_orderdate, '%Y-%m') FROM orders UNION SELECT DISTINCT 'segments', c_mktsegment FROM customer),
l AS (SELECT roster, count(*) AS n, string_agg(member, ',' ORDER BY member) AS whole, array_to_string(list_sort(list(member))[:20], ',') AS members FROM m WHERE member IS NOT NULL GROUP BY 1)
SELECT roster, n, first_value(roster) OVER (PARTITION BY n, whole ORDER BY length(roster), roster) AS kept_as, members FROM l""")
def equal_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the kinds of their events, priorities by their months: which are the same."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id")).alias("roster"), F.col("event_type").alias("member"))
    months = table(spark, sf_dir, "orders").select(F.concat(F.lit("month "), F.col("o_orderpriority")).alias("roster"), F.date_format("o_orderdate", "yyyy-MM").alias("member"))
    segments = table(spark, sf_dir, "customer").select(F.lit("segments").alias("roster"), F.col("c_mktsegment").alias("member"))
    found = rollup.equal_rosters(events.unionByName(months).unionByName(segments), 20)
    return found.withColumn("members", F.array_join("members", ","))


# Names

@query("""WITH d AS (SELECT p_type, 'sold as ' || min(p_name) || ' and ' || max(p_name) AS t FROM part GROUP BY 1),
s AS (SELECT DISTINCT CASE WHEN length(p_name) % 2 = 0 THEN p_name ELSE array_to_string(list_reverse(string_split(p_name, ' ')), ' ') END AS name FROM part),
h AS (SELECT name, min(p_type) FILTER (contains(t, name)) AS held, min(p_type) FILTER (list_has_all(string_split(t, ' '), string_split(name, ' '))) AS worded FROM s, d GROUP BY 1)
SELECT name, coalesce(held, worded) AS "column", CASE WHEN held IS NOT NULL THEN 8 WHEN worded IS NOT NULL THEN 9 END AS tier FROM h""")
def dictionary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, every other one backwards, to types by what a dictionary says of them."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    spoken = part.select(F.when(F.length("p_name") % 2 == 0, F.col("p_name")).otherwise(F.array_join(F.reverse(words), " ")).alias("name")).distinct()
    entries = part.groupBy(F.col("p_type").alias("column")).agg(F.concat(F.lit("sold as "), F.min("p_name"), F.lit(" and "), F.max("p_name")).alias("description")).withColumn("variable_key", F.lit("type")).orderBy("column").coalesce(1)
    return config.bind_names(spoken, entries.select("column"), entries)
