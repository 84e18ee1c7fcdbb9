"""Queries over files that are made of the tables, and over facets that need several
passes; all queries by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators import cycles, risk, rollup
from millrace.plans import catalogue as c
from millrace.plans import intake, queries
from millrace.plans.catalogue import CELL, EPOCH, ORDER, query, r, table
from millrace.sources import workbook
from millrace.sources.export import export_workbooks
from millrace.sources.scratch import shared_folder
from millrace.streaming import eventlog

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL


# Workbooks

def _books(spark: SparkSession, sf_dir: str, incidents: bool = False) -> str:
    """Workbooks of a hundred users each, a sheet for ten, and one of incidents; their
    folder."""
    folder = f"{shared_folder(spark)}/books-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("w"), F.floor(F.col("user_id") / 100)).alias("book"), F.concat(F.lit("u"), F.floor(F.col("user_id") / 10)).alias("tab"), "ts", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("At"), F.col("event_type").alias("Kind"), F.col("value").alias("Value"))
    export_workbooks(events, "book", "tab", ORDER, ["At", "Kind", "Value"], folder).write.format("noop").mode("overwrite").save()
    if incidents:
        iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
        begin = table(spark, sf_dir, "events").agg(F.date_trunc("day", F.min("ts")).alias("t"))
        cases = begin.select(F.lit("refs").alias("book"), F.lit("Anomalies").alias("tab"), F.inline(F.array(*(F.struct(F.lit(n).alias("Caso"), iso(F.col("t") + F.expr(f"INTERVAL {a} DAYS")).alias("Inicio"), iso(F.col("t") + F.expr(f"INTERVAL {b} DAYS")).alias("Fin")) for n, a, b in (("leak", 2, 4), ("storm", 3, 6), ("stop", 9, 10))))))
        export_workbooks(cases, "book", "tab", ["Caso"], ["Caso", "Inicio", "Fin"], folder).write.format("noop").mode("overwrite").save()
    return folder


@query(f"""SELECT 'u' || (user_id // 10) AS sheet, count(*) AS "rows", {r("sum(value)")} AS total, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS latest FROM events GROUP BY 1""")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of workbooks, each read in ranges of its rows."""
    rows = workbook.read_sheets(spark, _books(spark, sf_dir), range_bytes=20_000)
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.where("_row > 0").groupBy("sheet").agg(F.count("*").alias("rows"), half_up(F.sum(cell(2).cast("double"))).alias("total"), F.max(cell(0)).alias("latest"))


@query(f"""WITH b AS (SELECT date_trunc('day', min(ts)) AS t FROM events), w AS (SELECT t + INTERVAL 2 DAY AS s, t + INTERVAL 4 DAY AS e FROM b UNION ALL SELECT t + INTERVAL 3 DAY, t + INTERVAL 6 DAY FROM b UNION ALL SELECT t + INTERVAL 9 DAY, t + INTERVAL 10 DAY FROM b),
l AS (SELECT event_type AS x, value AS v, EXISTS (SELECT 1 FROM w WHERE date_trunc('second', ts) BETWEEN s AND e) AS q FROM events) SELECT 'Kind' AS category, x AS "value", 'Value' AS measure, {CELL} FROM l GROUP BY 2""")
def file_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of workbooks to a stored profile: its cells, with incidents held out."""
    books = _books(spark, sf_dir, incidents=True)
    facets = intake.profile_file(spark, books, "events", f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}", kind="xlsx")
    return facets["cells"].drop("dataset_id", "updated_at")


@query("""WITH s AS (SELECT p_brand AS sheet, count(*) AS "rows", min(p_size) = 1 AND p_brand LIKE 'Brand#1%' AS is_reference, max(p_size) = 50 AS has_time FROM part GROUP BY 1),
f AS (SELECT *, NOT is_reference AND (has_time OR "rows" > 500) AS bulk FROM s) SELECT sheet, "rows", is_reference, has_time, CASE WHEN (SELECT bool_or(bulk) FROM f) THEN bulk ELSE NOT is_reference END AS contributes FROM f""")
def contributing_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sheets: which of them a profile is made of."""
    sheets = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sheet")).agg(F.count("*").alias("rows"), ((F.min("p_size") == 1) & F.first("p_brand").startswith("Brand#1")).alias("is_reference"), (F.max("p_size") == 50).alias("has_time"))
    return intake.contributing(sheets)


@query("""SELECT n_name AS variable, 'nation' AS origin, NULL AS description FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region""")
def reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows of two sheets that do not have the same columns, under each other."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("variable"), F.lit("nation").alias("origin"))
    return intake.union_references([nations, table(spark, sf_dir, "region").select(F.col("r_name").alias("variable"), F.lit("region").alias("description"))]).select("variable", "origin", "description")


def _dayparts():
    return F.when(F.hour("ts") < 12, "day").otherwise("night")


_THREE = "SELECT user_id, ts, event_id, value, event_type, CASE WHEN hour(ts) < 12 THEN 'day' ELSE 'night' END AS half, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'low' END AS level FROM events"


@query(f"""WITH x AS ({_THREE}), u AS (SELECT 'event_type' AS category, event_type AS s, * FROM x UNION ALL SELECT 'half', half, * FROM x UNION ALL SELECT 'level', level, * FROM x), k AS (SELECT * FROM u WHERE s IS NOT NULL),
g AS (SELECT category, s, count(*) AS n, avg(value) AS m, coalesce(var_pop(value), 0) AS var FROM k GROUP BY 1, 2), t AS (SELECT category, sum(n * m) / sum(n) AS grand FROM g GROUP BY 1),
e AS (SELECT category, {r("sum(n * (m - grand) * (m - grand)) / nullif(sum(n * (m - grand) * (m - grand)) + sum(n * var), 0)", 6)} AS eta2 FROM g JOIN t USING (category) GROUP BY 1),
f AS (SELECT category, CASE WHEN lag(s) OVER (PARTITION BY category, user_id ORDER BY ts, event_id) = s THEN 0 ELSE 1 END AS fresh FROM k), l AS (SELECT category, count(*)::DOUBLE / sum(fresh) AS len FROM f GROUP BY 1)
SELECT category, eta2, {r("len")} AS mean_run_rows, {r("eta2 * least(1.0, len / 60.0)", 6)} AS score FROM e JOIN l USING (category) ORDER BY score DESC, category LIMIT 2""")
def state_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns that could be the state, by how well they tell values apart and how
    long they last; the best two."""
    events = table(spark, sf_dir, "events").withColumns({"half": _dayparts(), "level": F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "low")})
    columns = ["event_type", "half", "level"]
    return rollup.state_scores(rollup.effect_sizes(events, columns, ["value"], min_rows=1), rollup.mean_runs(events, "user_id", ORDER, columns), keep=2)


# Cycles

def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return cycles.label_cycles(events, "user_id", "value", ORDER)


_EPOCH_E = EPOCH.replace("ts", "e.ts")
CYCLE_TABLE = f"""{c.CYCLES}, t AS (SELECT c.user_id, c.cycle, count(*) AS "rows", min({_EPOCH_E}) AS first_sec, max({_EPOCH_E}) AS end_sec, bool_or(completes) AS complete, max(label_peak) AS peak, max(CASE WHEN completes THEN c.value END) AS discharge, sum(c.value) AS sv, sum(CAST(json_extract_string(e.props, '$.k') AS DOUBLE)) AS sk FROM c JOIN events e USING (event_id) GROUP BY 1, 2),
u AS (SELECT *, coalesce(lag(end_sec) OVER (PARTITION BY user_id ORDER BY cycle), first_sec) AS begin_sec FROM t)"""


def _mean(x: str) -> str:
    return f"{r(f'sum({x}) FILTER (complete)')} / count(*) FILTER (complete)"


@query(f"""WITH RECURSIVE {CYCLE_TABLE}, d AS (SELECT *, (end_sec - begin_sec)::DOUBLE AS sec FROM u) SELECT user_id, count(*) FILTER (complete) AS cycles, {r(_mean('"rows"'))} AS rows_per_cycle, {r("sum(peak) FILTER (complete)")} AS quantity, {r(_mean('peak'))} AS peak_mean, {r("coalesce(stddev_samp(peak) FILTER (complete), 0)")} AS peak_sd,
{r(_mean('sec'))} AS mean_sec, {r("coalesce(stddev_samp(sec) FILTER (complete), 0)")} AS sd_sec, {r(_mean('discharge'))} AS discharge_mean, {r(_mean('discharge') + ' / nullif(' + _mean('peak') + ', 0)')} AS discharge_ratio, count(*) FILTER (NOT complete) AS unfinished,
{r("sum(sv) FILTER (complete)")} AS value_sum, {r(_mean('sv'))} AS value_mean, {r("coalesce(stddev_samp(sv) FILTER (complete), 0)")} AS value_sd, {r("sum(sk) FILTER (complete)")} AS k_sum, {r(_mean('sk'))} AS k_mean, {r("coalesce(stddev_samp(sk) FILTER (complete), 0)")} AS k_sd FROM d GROUP BY 1 HAVING count(*) FILTER (complete) > 0""")
def cycle_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures over the cycles of one of them."""
    found = cycles.cycle_table(_labelled(spark, sf_dir), "user_id", "ts", ["value", "k"], ORDER)
    return cycles.cycle_statistics(found, "user_id", ["value", "k"])


@query(f"""WITH RECURSIVE {c.CYCLES}, d AS (SELECT c.user_id, e.event_type, CASE WHEN hour(e.ts) < 12 THEN 'day' ELSE 'night' END AS half FROM c JOIN events e USING (event_id) WHERE completes), a AS (SELECT user_id, count(*) AS total FROM d GROUP BY 1),
l AS (SELECT user_id, 'event_type' AS "column", event_type AS "value" FROM d UNION ALL SELECT user_id, 'half', half FROM d), n AS (SELECT user_id, "column", "value", count(*) AS n FROM l GROUP BY 1, 2, 3) SELECT user_id, "column", "value", n, {r("n::DOUBLE / total")} AS share FROM n JOIN a USING (user_id) WHERE n::DOUBLE / total >= 0.5""")
def cycle_terminals_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where at least half of a user's cycles complete."""
    return cycles.cycle_terminals(_labelled(spark, sf_dir).withColumn("half", _dayparts()), "user_id", ["event_type", "half"])


# The event log, at once and as a stream

_MUTED = f"""m AS (SELECT user_id, event_id, {EPOCH} * 1000 AS "at", event_type <> 'signup' AS enabled, CASE WHEN event_type <> 'error' THEN value > 60.0 END AS fires FROM events),
a AS (SELECT *, enabled AND fires AS f FROM (SELECT *, CASE WHEN enabled THEN fires ELSE false END AS g FROM m) WHERE g IS NOT NULL), b AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY "at", event_id), false) AS before FROM a),
e AS (SELECT user_id, event_id, "at", CASE WHEN f THEN 'breach' WHEN enabled THEN 'recovered' ELSE 'silenced' END AS kind FROM b WHERE f <> before), h AS (SELECT *, CASE WHEN kind <> 'breach' THEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) END AS held_ms FROM e)
SELECT user_id, event_id, "at", kind, held_ms, kind = 'breach' AND coalesce("at" - lag("at") OVER (PARTITION BY user_id, kind ORDER BY "at", event_id) < 43200000, false) AS suppressed FROM h"""


def _muted(events: DataFrame) -> DataFrame:
    """Ticks of one condition a user, value > 60; errors are not armed, signups switch it off."""
    fires = F.when(F.col("event_type") != "error", F.col("value") > 60.0)
    return events.select("user_id", "event_id", (epoch_seconds("ts") * 1000).alias("at"), fires.alias("fires"), (F.col("event_type") != "signup").alias("enabled"))


@query("WITH " + _MUTED)
def silenced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.edge_events(_muted(table(spark, sf_dir, "events")), ["user_id"], "at", ["at", "event_id"], cooldown=43_200_000, enabled="enabled")


@query("WITH " + _MUTED)
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events from a stream of the table, with state by user."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = _muted(source).select(F.col("user_id").cast("string").alias("key"), "at", F.col("event_id").alias("seq"), "fires", "enabled")
    found = eventlog.replay(eventlog.edge_stream(ticks, cooldown=43_200_000), shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("seq").alias("event_id"), "at", "kind", "held_ms", "suppressed")
