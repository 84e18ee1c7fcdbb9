"""The operators applied to tables: queries by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions.rounding import epoch_seconds, half_up
from millrace.operators import cycles as fill_cycles
from millrace.operators import answer, board, crosstab, generator, ordered, rhythm, risk, rollup, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOWS = [("1996-03-01 00:00:00", "1996-05-31 00:00:00"), ("1999-11-15 00:00:00", None)]
ORDER = ["ts", "event_id"]


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: str, digits: int = 3) -> str:
    """half_up in SQL."""
    k = f"{10**digits}.0::DOUBLE"
    return f"floor(({x}) * {k} + 0.5) / {k}"


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG_LINEITEM = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, l_shipdate, '{m}' AS measure, {m} AS v FROM lineitem" for m in MEASURES)
QUARANTINED = "(l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31' OR l_shipdate >= TIMESTAMP '1999-11-15')"
CELL = f"""count(*) AS n, {r("avg(v)")} AS mean, {r("coalesce(stddev_samp(v), 0)")} AS sd, {r("min(v)")} AS lo, {r("max(v)")} AS hi,
count(*) FILTER (q) AS ex_n, {r("coalesce(sum(v) FILTER (q), 0)")} AS ex_sum, count(*) FILTER (NOT q) AS baseline_n, {r("avg(v) FILTER (NOT q)")} AS baseline_mean"""
EPOCH = "CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT)"


@query(f"""SELECT measure, count(*) AS n, {r("sum(v)")} AS sum, {r("avg(v)")} AS mean, {r("coalesce(stddev_samp(v), 0)")} AS sd, {r("min(v)")} AS lo, {r("max(v)")} AS hi,
{r("quantile_cont(v, 0.05)")} AS p05, {r("quantile_cont(v, 0.25)")} AS p25, {r("quantile_cont(v, 0.5)")} AS p50, {r("quantile_cont(v, 0.75)")} AS p75, {r("quantile_cont(v, 0.95)")} AS p95,
{r("coalesce(stddev_samp(v), 0) / abs(avg(v))")} AS cv FROM ({LONG_LINEITEM}) GROUP BY measure""")
def num_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.numeric_summary(table(spark, sf_dir, "lineitem"), MEASURES)


@query("""WITH c AS (SELECT "column", "value", count(*) AS n FROM (SELECT 'o_orderstatus' AS "column", o_orderstatus AS "value" FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) GROUP BY 1, 2),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INTEGER) AS rank, count(*) OVER (PARTITION BY "column") AS distinct_values FROM c) SELECT * FROM w WHERE rank <= 12""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


_NUMBER = r"^-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"


@query(f"""WITH c AS (SELECT 'user_id' AS "column", CAST(user_id AS VARCHAR) AS cell FROM events UNION ALL SELECT 'event_type', CASE WHEN event_type = 'error' THEN NULL ELSE event_type END FROM events
UNION ALL SELECT 'at', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events UNION ALL SELECT 'amount', CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) FROM events),
k AS (SELECT "column", count(*) AS n, count(*) FILTER (cell IS NULL OR trim(cell) = '') AS missing, count(*) FILTER (regexp_matches(cell, '{_NUMBER}')) AS numbers, count(*) FILTER (regexp_matches(cell, '{_ISO}')) AS times FROM c GROUP BY 1)
SELECT "column", n, missing, numbers, times, {r("(n - missing)::DOUBLE / n")} AS fill, CASE WHEN n = missing THEN 'empty' WHEN times > 0.8 * (n - missing) THEN 'datetime' WHEN numbers > 0.8 * (n - missing) THEN 'number' ELSE 'category' END AS type FROM k""")
def col_fill_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cells = events.select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("value").cast("decimal(18,2)").alias("amount"))
    return stats.fill_and_types(cells, cells.columns)


@query(f"""WITH s AS (SELECT user_id, {EPOCH} - lag({EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
c AS (SELECT user_id, step, count(*) AS n FROM s WHERE step > 0 AND step < 31 * 86400 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, step) AS k, sum(n) OVER (PARTITION BY user_id) AS total FROM c)
SELECT user_id, step AS grain_sec, {r("n::DOUBLE / total")} AS regularity, CAST(total - n AS BIGINT) AS gaps FROM w WHERE k = 1""")
def grain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grain(table(spark, sf_dir, "events"), "user_id", "ts", ORDER)


@query(f"""WITH l AS (SELECT *, {QUARANTINED} AS q FROM ({LONG_LINEITEM})), u AS (SELECT 'l_returnflag' AS category, l_returnflag AS "value", measure, v, q FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, measure, v, q FROM l)
SELECT category, "value", measure, {CELL} FROM u GROUP BY 1, 2, 3""")
def xtab_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.marginal(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], MEASURES, crosstab.in_windows("l_shipdate", WINDOWS))


@query(f"""WITH l AS (SELECT *, {QUARANTINED} AS q FROM ({LONG_LINEITEM})) SELECT l_returnflag AS first_value, l_linestatus AS second_value, measure, {CELL} FROM l GROUP BY 1, 2, 3""")
def joint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.joint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", MEASURES, crosstab.in_windows("l_shipdate", WINDOWS))


@query(f"""SELECT event_type AS "value", count(*) AS units, {r("median(m)")} AS median_of_unit_means FROM (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1""")
def unit_median_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.median_of_unit_means(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query(f"""WITH c AS (SELECT o_orderstatus AS level, o_orderpriority AS state, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY state) AS w, count(*) OVER (PARTITION BY state) = 2 AS both_levels FROM c)
SELECT level, CAST(sum(n) AS BIGINT) AS n, {r("sum(s) / sum(n)")} AS raw_mean, {r("sum(s / n * w) FILTER (both_levels) / sum(w) FILTER (both_levels)")} AS standardised_mean FROM w GROUP BY 1""")
def mix_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab.mix_standardised(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O"), "o_orderpriority", "o_totalprice")


@query(f"""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), a AS (SELECT avg(m) AS level, max(m) - min(m) AS spread, count(*) AS live FROM h)
SELECT CAST(hour AS BIGINT) AS hour, n, {r("m")} AS mean, {r("m / level")} AS hour_index, {r("spread / level")} AS amplitude FROM h, a WHERE live >= 4""")
def hour_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rhythm.hour_rhythm(table(spark, sf_dir, "events"), "ts", "value")


def _schedule_sql(name: str, value: str) -> str:
    counted = f"SELECT hour(ts) AS hour, {value} AS v, count(*) AS n FROM events GROUP BY 1, 2"
    best = f"SELECT hour, max(n)::DOUBLE / sum(n) AS share FROM ({counted}) GROUP BY 1"
    return f"""SELECT '{name}' AS category, count(*) AS hours, (SELECT count(DISTINCT {value}) FROM events) AS distinct_values, {r("min(share)")} AS least_share, min(share) >= 0.8 AND (SELECT count(DISTINCT {value}) FROM events) BETWEEN 2 AND 60 AS scheduled FROM ({best})"""


@query(_schedule_sql("shift", "CASE WHEN hour(ts) < 12 THEN 'day' ELSE 'night' END") + " UNION ALL " + _schedule_sql("event_type", "event_type"))
def clock_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.hour("ts") < 12, "day").otherwise("night")
    return rhythm.clock_schedule(table(spark, sf_dir, "events"), "ts", {"shift": shift, "event_type": F.col("event_type")})


@query(f"""WITH l AS ({LONG_LINEITEM}), u AS (SELECT 'l_returnflag' AS category, l_returnflag AS x, measure, v FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, measure, v FROM l),
c AS (SELECT category, measure, x, count(*) AS n, avg(v) AS m, coalesce(var_pop(v), 0) AS var FROM u GROUP BY 1, 2, 3),
g AS (SELECT category, measure, sum(n) AS total, count(*) AS cells, sum(n * m) / sum(n) AS grand FROM c GROUP BY 1, 2),
p AS (SELECT category, measure, CAST(any_value(total) AS BIGINT) AS n, any_value(cells) AS cells, sum(c.n * (m - grand) * (m - grand)) AS b, sum(c.n * var) AS w FROM c JOIN g USING (category, measure) GROUP BY 1, 2)
SELECT category, measure, n, cells, {r("b / nullif(b + w, 0)", 6)} AS eta2 FROM p WHERE n >= 500 AND cells >= 2""")
def state_eta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.effect_sizes(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], MEASURES)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.runs(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", ORDER, "value")


RUNS = f"""e AS (SELECT *, {EPOCH} AS sec, CASE WHEN lag(event_type) OVER o = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS state, count(*) AS "rows", min(sec) AS "start", max(sec) AS "end", sum(value) AS total, max(value) AS peak FROM i GROUP BY 1, 2)"""


@query(f"""WITH {RUNS} SELECT user_id, run, state, "rows", "start", "end", {r("total")} AS total, peak FROM runs""")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("total", half_up("total"))


@query(f"""WITH {RUNS}, d AS (SELECT *, (coalesce(lead("start") OVER (PARTITION BY user_id ORDER BY run), "end") - "start")::DOUBLE AS sec FROM runs)
SELECT state, count(*) AS runs, CAST(sum("rows") AS BIGINT) AS "rows", {r("sum(sec)")} AS total_sec, {r("avg(sec)")} AS mean_sec, {r("coalesce(stddev_samp(sec), 0)")} AS sd_sec, {r("avg(peak)")} AS mean_peak FROM d GROUP BY 1""")
def episode_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.durations(_runs(spark, sf_dir), "user_id")


@query(f"""WITH {RUNS}, d AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY user_id ORDER BY run) AS to_state FROM runs) SELECT from_state, to_state, count(*) AS n FROM d WHERE to_state IS NOT NULL GROUP BY 1, 2""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.transitions(_runs(spark, sf_dir), "user_id")


@query(f"""WITH {RUNS}, u AS (SELECT event_type AS x, value AS v FROM events), c AS (SELECT x, count(*) AS n, avg(v) AS m, coalesce(var_pop(v), 0) AS var FROM u GROUP BY 1),
g AS (SELECT sum(n * m) / sum(n) AS grand FROM c), t AS (SELECT {r("sum(n * (m - grand) * (m - grand)) / nullif(sum(n * (m - grand) * (m - grand)) + sum(n * var), 0)", 6)} AS eta2 FROM c, g), a AS (SELECT avg("rows") AS k FROM runs)
SELECT 'event_type' AS category, eta2, {r("k")} AS mean_run_rows, {r("eta2 * least(1.0, k / 60.0)", 6)} AS score FROM t, a""")
def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = rollup.effect_sizes(table(spark, sf_dir, "events"), ["event_type"], ["value"], min_rows=1)
    return rollup.state_scores(effects, rollup.mean_runs(table(spark, sf_dir, "events"), "user_id", ORDER, ["event_type"]))


CYCLES = """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events),
c AS (SELECT user_id, event_id, k, value, value AS peak, false AS armed, false AS completes, 0::BIGINT AS cycle, value AS label_peak FROM o WHERE k = 1
UNION ALL SELECT s.user_id, s.event_id, s.k, s.value, CASE WHEN done THEN s.value ELSE p END, CASE WHEN done THEN false ELSE a END, done, s.cycle, p FROM (
SELECT o.user_id, o.event_id, o.k, o.value, c.cycle + CASE WHEN c.completes THEN 1 ELSE 0 END AS cycle, greatest(c.peak, o.value) AS p, c.armed OR (greatest(c.peak, o.value) > 0 AND greatest(c.peak, o.value) >= o.top * 0.05) AS a,
(c.armed OR (greatest(c.peak, o.value) > 0 AND greatest(c.peak, o.value) >= o.top * 0.05)) AND o.value <= greatest(c.peak, o.value) * 0.02 AS done FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1) s)"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_cycles.label_cycles(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "value", ORDER)


@query(f"""WITH RECURSIVE {CYCLES} SELECT user_id, count(*) AS cycles, {r("sum(label_peak)")} AS peak_sum, {r("sum(value)")} AS discharge_sum FROM c WHERE completes GROUP BY 1""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _cycles(spark, sf_dir).where("completes")
    return done.groupBy("user_id").agg(F.count("*").alias("cycles"), half_up(F.sum("cycle_peak")).alias("peak_sum"), half_up(F.sum("value")).alias("discharge_sum"))


@query(f"""WITH RECURSIVE {CYCLES}, g AS (SELECT user_id, cycle, count(*) AS "rows", sum(value) AS total, max(CASE WHEN completes THEN 1 ELSE 0 END) AS complete FROM c GROUP BY 1, 2) SELECT user_id, cycle, "rows", {r("total")} AS total FROM g WHERE complete = 1""")
def cycle_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cycles(spark, sf_dir).groupBy("user_id", "cycle").agg(F.count("*").alias("rows"), half_up(F.sum("value")).alias("total"), F.max("completes").alias("complete"))
    return found.where("complete").drop("complete")


@query(f"""WITH RECURSIVE {CYCLES} SELECT e.event_type AS terminal, count(*) AS n, {r("count(*)::DOUBLE / (SELECT count(*) FROM c WHERE completes)")} AS share FROM c JOIN events e USING (event_id) WHERE completes GROUP BY 1""")
def cycle_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _cycles(spark, sf_dir).where("completes").groupBy(F.col("event_type").alias("terminal")).agg(F.count("*").alias("n"))
    total = done.agg(F.sum("n").alias("total"))
    return done.crossJoin(F.broadcast(total)).select("terminal", "n", half_up(F.col("n") / F.col("total")).alias("share"))


@query(f"""WITH o AS (SELECT user_id, value AS v, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS top FROM events)
SELECT user_id, {r("count(*) FILTER (top > 0 AND v <= top * 0.005)::DOUBLE / count(*)")} AS zero_share, {r("count(*) FILTER (top > 0 AND v > top * 0.005 AND v >= top * 0.9)::DOUBLE / count(*)")} AS plateau_share FROM o GROUP BY 1""")
def cycle_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.cycle_shape(table(spark, sf_dir, "events"), "user_id", "value", ORDER)


@query(f"""SELECT user_id, count(value) AS n, {r("sum(value) * 60 / 3600")} AS integrated FROM events GROUP BY 1""")
def rate_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.integrate_rate(table(spark, sf_dir, "events"), "user_id", "value", 60, 3600)


@query("""WITH w(s, e) AS (VALUES (TIMESTAMP '1995-06-01', TIMESTAMP '1995-07-15'), (TIMESTAMP '1995-07-01', TIMESTAMP '1995-09-01'), (TIMESTAMP '1997-02-01', TIMESTAMP '1997-02-28'), (TIMESTAMP '2000-06-01', TIMESTAMP '9999-12-31'))
SELECT o_orderstatus, o_orderkey, EXISTS (SELECT 1 FROM w WHERE o_orderdate BETWEEN s AND e) AS quarantined FROM orders""")
def quarantine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1995-06-01", "1995-07-15"), ("1995-07-01", "1995-09-01"), ("1997-02-01", "1997-02-28"), ("2000-06-01", None)]
    windows = spark.createDataFrame(rows, "s string, e string").select(F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))
    return crosstab.quarantined_by(table(spark, sf_dir, "orders"), "o_orderdate", windows).select("o_orderstatus", "o_orderkey", "quarantined")


@query("""WITH m AS (SELECT 'nations' AS roster, n_name AS member FROM nation UNION SELECT 'regions', r_name FROM region UNION SELECT 'customer segments', c_mktsegment FROM customer UNION SELECT 'segments', c_mktsegment FROM customer),
l AS (SELECT roster, string_agg(member, ',' ORDER BY member) AS members, count(*) AS n FROM m GROUP BY 1) SELECT arg_min(roster, length(roster)) AS roster, n, members FROM l GROUP BY n, members""")
def entity_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return rollup.rosters({"nations": (table(spark, sf_dir, "nation"), "n_name"), "regions": (table(spark, sf_dir, "region"), "r_name"), "customer segments": (customer, "c_mktsegment"), "segments": (customer, "c_mktsegment")})


@query(f"""WITH l AS (SELECT user_id, 'value' AS measure, value AS v FROM events UNION ALL SELECT user_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events),
u AS (SELECT measure, user_id, count(*) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT measure, CAST(sum(n) AS BIGINT) AS n, count(*) AS units, {r("sum(s)")} AS sum, {r("sum(s) / sum(n)")} AS mean, {r("min(lo)")} AS lo, {r("max(hi)")} AS hi, {r("median(s / n)")} AS median_of_unit_means, {r("stddev_samp(s / n)")} AS sd_of_unit_means FROM u GROUP BY 1""")
def measure_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rollup.measure_catalogue(events, "user_id", ["value", "k"])


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's nation. Nations are 25 rows; suppliers are
    left to the optimizer, which looks at their size."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("rebate", F.col("l_extendedprice") * F.col("l_discount"))


SALES = "s AS (SELECT l.*, n_name, l_extendedprice * l_discount AS rebate FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _answer_sql(members: str, size: str = "value", way: str = "DESC") -> str:
    order = f"{r(size, 6)} {way}"
    return f"""WITH {SALES}, m AS ({members}), a AS (SELECT CAST(row_number() OVER o AS INTEGER) AS position, member, value, n, value - lead(value) OVER o AS gap FROM m WINDOW o AS (ORDER BY {order}, member))
SELECT position, member, {r("value")} AS value, n, {r("gap")} AS gap FROM a WHERE position <= 10"""


@query(_answer_sql("SELECT n_name AS member, sum(l_extendedprice) AS value, count(*) AS n FROM s GROUP BY 1"))
def answer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer(_sales(spark, sf_dir), answer.Question("n_name", "l_extendedprice", "sum"))


@query(_answer_sql("SELECT n_name AS member, sum(rebate) / sum(l_quantity) AS value, count(*) AS n FROM s GROUP BY 1 HAVING sum(l_quantity) <> 0", way="ASC"))
def answer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer(_sales(spark, sf_dir), answer.Question("n_name", "rebate", "ratio", denominator="l_quantity", rank="min"))


@query(_answer_sql("SELECT member, (v - (SELECT median(v) FROM (SELECT avg(l_extendedprice) AS v FROM s GROUP BY n_name))) / (SELECT median(v) FROM (SELECT avg(l_extendedprice) AS v FROM s GROUP BY n_name)) AS value, n FROM (SELECT n_name AS member, avg(l_extendedprice) AS v, count(*) AS n FROM s GROUP BY 1)", "abs(value)"))
def answer_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.answer(_sales(spark, sf_dir), answer.Question("n_name", "l_extendedprice", "deviation", by_magnitude=True))


@query(f"WITH {SALES} SELECT {r('count(l_extendedprice)')} AS total, count(DISTINCT n_name) AS members FROM s")
def answer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.count_answer(_sales(spark, sf_dir), answer.Question("n_name", "l_extendedprice", "count"))


@query(f"""WITH l AS ({LONG_LINEITEM}), u AS (SELECT 'l_returnflag' AS category, l_returnflag AS member, measure, v FROM l UNION ALL SELECT 'l_linestatus', l_linestatus, measure, v FROM l UNION ALL SELECT 'one', 'same', measure, v FROM l),
e AS (SELECT category, measure, member, avg(v) AS m FROM u GROUP BY 1, 2, 3) SELECT category, measure, count(*) AS members, {r("abs(stddev_samp(m) / avg(m))", 6)} AS cv, {r("max(m) - min(m)")} AS range FROM e GROUP BY 1, 2 HAVING count(*) >= 2""")
def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").withColumn("one", F.lit("same"))
    return answer.question_candidates(lineitem, ["l_returnflag", "l_linestatus", "one"], MEASURES)


@query(f"""SELECT CASE WHEN regexp_matches(p_type, '^(SMALL|MEDIUM|LARGE)') THEN 'sized' ELSE p_type END AS family, count(*) AS n, {r("sum(p_size)")} AS sum_p_size, {r("sum(p_retailprice)")} AS sum_p_retailprice FROM part GROUP BY 1""")
def cause_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("p_type").rlike("^(SMALL|MEDIUM|LARGE)"), "sized").otherwise(F.col("p_type"))
    return answer.families(table(spark, sf_dir, "part"), family, ["p_size", "p_retailprice"])


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks of one condition a user, value > 60; errors are not armed."""
    fires = F.when(F.col("event_type") != "error", risk.fires("gt", F.col("value"), F.lit(60.0)))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (epoch_seconds("ts") * 1000).alias("at"), "value", fires.alias("fires"))


TICKS = f"""t AS (SELECT user_id, event_id, {EPOCH} * 1000 AS "at", CASE WHEN event_type <> 'error' THEN value > 60.0 END AS fires FROM events),
a AS (SELECT *, coalesce(lag(fires) OVER (PARTITION BY user_id ORDER BY "at", event_id), false) AS before FROM t WHERE fires IS NOT NULL),
g AS (SELECT user_id, event_id, "at", CASE WHEN fires THEN 'breach' ELSE 'recovered' END AS kind FROM a WHERE fires <> before),
h AS (SELECT *, CASE WHEN kind = 'recovered' THEN "at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at", event_id) END AS held_ms FROM g),
ev AS (SELECT *, kind = 'breach' AND coalesce("at" - lag("at") OVER (PARTITION BY user_id, kind ORDER BY "at", event_id) < 43200000, false) AS suppressed FROM h)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.edge_events(_ticks(spark, sf_dir), ["user_id"], "at", ["at", "event_id"], cooldown=43_200_000)


@query(f"""WITH {TICKS} SELECT user_id, event_id, "at", kind, held_ms, suppressed FROM ev""")
def threshold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


@query(f"""WITH {TICKS} SELECT user_id, max("at") AS since FROM ev GROUP BY 1 HAVING arg_max(kind, event_id) = 'breach'""")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.live_state(_log(spark, sf_dir), ["user_id"], ["at", "event_id"])


@query(f"""WITH {TICKS} SELECT user_id, count(*) FILTER (kind = 'breach') AS times_fired, coalesce(max(held_ms), 0) AS longest_ms, count(*) FILTER (kind = 'breach') >= 3 AS flapping FROM ev GROUP BY 1""")
def flapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.flapping(_log(spark, sf_dir), ["user_id"])


@query(f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, event_id DESC) AS k FROM ev) SELECT user_id, event_id, "at", kind FROM n WHERE k <= 5""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.newest(_log(spark, sf_dir), ["user_id"], ["at", "event_id"], 5).select("user_id", "event_id", "at", "kind")


@query(f"""WITH b AS (SELECT event_id, user_id, ts, value, value > 60 AS out FROM events), i AS (SELECT *, sum(CASE WHEN out THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b),
k AS (SELECT *, sum(CASE WHEN out THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS ticks FROM i)
SELECT event_id, CAST(ticks AS BIGINT) AS ticks, CASE WHEN out THEN CASE WHEN ticks > 20 OR (value - 60) / 60 >= 0.2 THEN 'critical' ELSE 'warning' END END AS severity,
CASE WHEN out THEN 'breach' WHEN (60 - value) / 60 <= 0.1 THEN 'urgent' WHEN (60 - value) / 60 <= 0.2 THEN 'warning' ELSE 'clear' END AS state, {r("CASE WHEN out THEN 0 ELSE least(1, (60 - value) / 60) END", 6)} AS proximity FROM k""")
def severity_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit(60.0)
    events = table(spark, sf_dir, "events").withColumn("out", F.col("value") > limit)
    counted = risk.consecutive(events, ["user_id"], ORDER, "out")
    near = risk.proximity(F.col("value"), upper=limit)
    graded = F.when(F.col("out"), risk.severity(F.col("value"), limit, F.col("ticks")))
    return counted.select("event_id", F.col("ticks").cast("long").alias("ticks"), graded.alias("severity"), near["state"].alias("state"), half_up(near["proximity"], 6).alias("proximity"))


@query(f"""WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT median(m) AS p FROM m)
SELECT user_id, {r("m")} AS mean, {r("p")} AS peer_median, {r("(m - p) / nullif(p, 0)", 6)} AS deviation, (m - p) / nullif(p, 0) >= 0.1 AS breached FROM m, p""")
def peer_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.peer_deviation(table(spark, sf_dir, "events"), "user_id", "value", 0.1)


@query(f"""WITH t AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 8.0 WHEN 'O' THEN 55.0 ELSE 100.0 END AS r, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3.0 WHEN '2' THEN 2.0 WHEN '3' THEN 1.0 ELSE 2.0 END AS w FROM orders),
k AS (SELECT o_custkey, count(*) AS n, sum(r * w) / sum(w) AS risk FROM t GROUP BY 1), c AS (SELECT c_custkey, n, risk, CASE WHEN c_acctbal < 0 THEN -c_acctbal / 10 END AS debt FROM customer LEFT JOIN k ON c_custkey = o_custkey),
z AS (SELECT *, greatest(0, least(100, floor(debt + 0.5))) AS d, greatest(0, least(100, floor(risk + 0.5))) AS t FROM c)
SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN debt IS NULL AND risk IS NULL THEN NULL ELSE greatest(CASE WHEN debt IS NOT NULL THEN d::DOUBLE END, CASE WHEN risk IS NOT NULL THEN t::DOUBLE END) END AS pct,
CASE WHEN debt IS NULL AND risk IS NULL THEN NULL WHEN risk IS NULL OR (debt IS NOT NULL AND d >= t) THEN 'performance' ELSE 'touchpoints' END AS driver FROM z""")
def composite_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "O", "amber").otherwise("red")
    first = F.substring("o_orderpriority", 1, 1)
    weight = F.when(first == "1", "HVY").when(first == "2", "MED").when(first == "3", "LGT").otherwise("none")
    by_customer = rollup.touchpoint_risk(orders, "o_custkey", status, weight)
    joined = table(spark, sf_dir, "customer").join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    worst = rollup.worst_of({"performance": F.when(F.col("c_acctbal") < 0, -F.col("c_acctbal") / 10), "touchpoints": F.col("risk")})
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), worst["pct"].alias("pct"), worst["driver"].alias("driver"))


def by_turn(key: str, values: list) -> Column:
    """A value by what is left of `key` when divided by how many there are."""
    return F.element_at(F.array(*values), (F.col(key) % len(values) + 1).cast("int"))


#: Three digits of a part's key, to write numbers in groups.
_X = "lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0')"


@query(f"""SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN p_size || {_X} WHEN 1 THEN p_size || '.' || {_X} WHEN 2 THEN p_size || {_X} || {_X} WHEN 3 THEN p_size || '.5' WHEN 4 THEN p_size || {_X} || '.5' WHEN 5 THEN '-' || p_size || '.25' WHEN 6 THEN CAST(p_size AS VARCHAR) END AS DOUBLE) AS number FROM part""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and keys of parts, written with points and commas of either use; every eighth
    is no number."""
    size, x = F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    raw = by_turn("p_partkey", [F.concat(size, F.lit(","), x), F.concat(size, F.lit("."), x), F.concat(size, F.lit("."), x, F.lit("."), x), F.concat(size, F.lit(",5")), F.concat(size, F.lit("."), x, F.lit(",5")), F.concat(F.lit("-"), size, F.lit(".25")), F.concat(F.lit(" "), size, F.lit(" ")), F.concat(size, F.lit("e5"))])
    return table(spark, sf_dir, "part").select("p_partkey", coerce.parse_number(raw).alias("number"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size::DOUBLE AS n, (p_size + p_partkey % 7)::DOUBLE AS m FROM part) SELECT p_partkey, CASE WHEN k IN (0, 1, 2, 5) THEN n END AS lo, CASE k WHEN 0 THEN m WHEN 1 THEN m WHEN 3 THEN n WHEN 5 THEN n END AS hi,
CASE WHEN k < 4 OR k = 5 THEN k IN (1, 2) END AS ex_lo, CASE WHEN k < 4 OR k = 5 THEN k = 3 END AS ex_hi, CASE k WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS n_ranges, CASE WHEN k = 4 THEN 2 ELSE 0 END AS n_labels FROM p""")
def parse_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as ends of bands."""
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + F.col("p_partkey") % 7).cast("string")
    raw = by_turn("p_partkey", [F.concat(n, F.lit("-"), m), F.concat(F.lit(">"), n, F.lit("-"), m), F.concat(F.lit(">"), n), F.concat(F.lit("<"), n, F.lit(" o >"), m), F.lit("Good / Fair"), n])
    found = table(spark, sf_dir, "part").withColumn("b", coerce.parse_bands(raw)).withColumn("first", F.get("b.ranges", F.lit(0)))
    return found.select("p_partkey", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), F.col("first.exLo").alias("ex_lo"), F.col("first.exHi").alias("ex_hi"), F.size("b.ranges").alias("n_ranges"), F.size("b.labels").alias("n_labels"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '(' || p_size || ')' ELSE p_type END AS label, CASE p_partkey % 5 WHEN 0 THEN 'gal/h' WHEN 1 THEN 'm' || p_size WHEN 3 THEN 'ton' END AS unit FROM part""")
def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts with a unit behind them, in either kind of brackets."""
    name = F.col("p_type")
    raw = by_turn("p_partkey", [F.concat(name, F.lit(" (gal/h)")), F.concat(name, F.lit(" [m"), "p_size", F.lit("]")), name, F.concat(name, F.lit(" ▲ (ton)")), F.concat(F.lit("("), "p_size", F.lit(")"))])
    return table(spark, sf_dir, "part").withColumn("u", coerce.split_unit(raw)).select("p_partkey", "u.label", "u.unit")


FIRST, LAST, STEP, SEED = 1_704_067_200, 1_704_153_600, 600, "profile-1"


def _uniform_sql(*parts: str) -> str:
    joined = " || '|' || ".join(parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SERIES = f"""WITH {RUNS}, d AS (SELECT state, {r('avg("end" - "start")')} + 60 AS dwell FROM runs GROUP BY 1), l AS (SELECT event_type AS state, {r("avg(value)")} AS level, {r("min(value)")} AS lo, {r("max(value)")} AS hi FROM events GROUP BY 1),
st AS (SELECT *, sum(dwell) OVER (ORDER BY state) AS until, sum(dwell) OVER () AS cycle FROM d JOIN l USING (state)), f AS (SELECT avg(value) AS fleet FROM events),
un AS (SELECT user_id AS unit, {r("greatest(0.4, least(2.5, avg(value) / any_value(fleet)))", 6)} AS factor FROM events, f GROUP BY 1),
grid AS (SELECT unit, factor, unnest(range({FIRST}, {LAST} + 1, {STEP})) AS "at", {_uniform_sql(f"'{SEED}'", "'offset'", "CAST(unit AS VARCHAR)")} AS off FROM un),
series AS (SELECT unit, CAST("at" AS BIGINT) AS "at", state, {r(f"greatest(lo, least(hi, level * factor * (1 + 0.1 * (2 * {_uniform_sql(chr(39) + SEED + chr(39), 'CAST(unit AS VARCHAR)', 'CAST("at" AS VARCHAR)')} - 1))))")} AS value
FROM grid JOIN st ON ("at" + floor(off * cycle)) % cycle >= until - dwell AND ("at" + floor(off * cycle)) % cycle < until)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, units = generator.build_plan(table(spark, sf_dir, "events"), "user_id", "event_type", "value", _runs(spark, sf_dir))
    return generator.generate(states, units, FIRST, LAST, STEP, SEED)


def _kpi(series: DataFrame) -> DataFrame:
    integrated = F.sum("value") * STEP / 3600
    purchases = F.nullif(F.count_if(F.col("state") == "purchase"), F.lit(0))
    return series.groupBy("unit").agg(F.count("*").alias("n"), half_up(F.avg("value")).alias("mean"), half_up(integrated).alias("integrated"), half_up(integrated / purchases).alias("per_purchase"))


@query(SERIES + ' SELECT unit, "at", state, value FROM series')
def generated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)


@query(SERIES + f""" SELECT unit, count(*) AS n, {r("avg(value)")} AS mean, {r("sum(value) * 600 / 3600")} AS integrated, {r("sum(value) * 600 / 3600 / nullif(count(*) FILTER (state = 'purchase'), 0)")} AS per_purchase FROM series GROUP BY 1""")
def generated_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kpi(_series(spark, sf_dir))


#: The fleet_* queries are the generated_* ones by their older names.
_fleet, FLEET = _series, SERIES


@query(FLEET + ' SELECT unit, "at", state, value FROM series')
def fleet_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fleet(spark, sf_dir)


@query(ORACLE_SQL["generated_kpi"].replace(SERIES, FLEET))
def fleet_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kpi(_fleet(spark, sf_dir))


@query(f"""WITH {TICKS}, l AS (SELECT user_id, max("at") AS since FROM ev GROUP BY 1 HAVING arg_max(kind, event_id) = 'breach'), z AS (SELECT user_id % 25 AS cell, count(*) AS n FROM l GROUP BY 1), cells AS (SELECT DISTINCT user_id % 25 AS cell FROM events)
SELECT cell, coalesce(n, 0) AS live, CASE WHEN n IS NULL THEN 'ok' WHEN n > 2 THEN 'critical' ELSE 'warning' END AS tone FROM cells LEFT JOIN z USING (cell)""")
def health_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results are cells of users."""
    live = risk.live_state(_log(spark, sf_dir), ["user_id"], ["at", "event_id"]).withColumn("cell", F.col("user_id") % 25)
    return board.health(table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 25), live, "cell")


@query(f"""WITH {TICKS}, l AS (SELECT user_id FROM ev GROUP BY 1 HAVING arg_max(kind, event_id) = 'breach'), r AS (SELECT user_id, count(*) FILTER (kind = 'recovered') AS recoveries FROM ev GROUP BY 1)
SELECT user_id, recoveries, CASE WHEN user_id IN (SELECT user_id FROM l) THEN 1 ELSE 0 END::BIGINT AS live, 'flapping' AS finding FROM r WHERE recoveries > 4 AND recoveries > 2 * CASE WHEN user_id IN (SELECT user_id FROM l) THEN 1 ELSE 0 END""")
def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return board.findings(log, risk.live_state(log, ["user_id"], ["at", "event_id"]), "user_id")


@query(f"""WITH f AS (SELECT CASE WHEN regexp_matches(p_type, '^(SMALL|MEDIUM|LARGE)') THEN 'sized' ELSE p_type END AS family, l_extendedprice * l_discount AS x FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT family, count(*) AS n, sum(x) AS excess FROM f GROUP BY 1)
SELECT family, n, {r("excess")} AS excess, {r("excess / (SELECT sum(excess) FROM s)", 6)} AS share FROM s ORDER BY excess DESC LIMIT 1""")
def root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("p_type").rlike("^(SMALL|MEDIUM|LARGE)"), "sized").otherwise(F.col("p_type"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return board.root_cause(lines.withColumn("rebate", F.col("l_extendedprice") * F.col("l_discount")), family, "rebate")


@query("""SELECT l_returnflag, l_suppkey, count(DISTINCT l_linestatus) AS scopes, max(l_tax) AS excess, CASE WHEN max(l_tax) >= 0.06 THEN 'critical' ELSE 'warning' END AS severity FROM lineitem WHERE l_tax <> 0 GROUP BY 1, 2""")
def anomaly_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.anomalies(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_linestatus", "l_tax")


@query(f"""WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {EPOCH} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS occurrences FROM events WHERE event_type = 'error') SELECT * FROM w WHERE occurrences > 2""")
def frequency_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return board.frequency_rule(errors, "user_id", epoch_seconds("ts"), ORDER, 2, 86400).drop("ts")


@query("""SELECT event_id, props FROM events WHERE contains(lower(props), ': 7')""")
def contains_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.contains_rule(table(spark, sf_dir, "events").select("event_id", "props"), "props", ": 7")


@query(f"""WITH h AS (SELECT hour(ts) AS hour, sum(value) AS s FROM events GROUP BY 1), a AS (SELECT hour, sum(s) OVER (ORDER BY hour) AS accrued, sum(s) OVER () AS total FROM h)
SELECT CAST(hour AS BIGINT) AS hour, {r("accrued")} AS accrued, {r("250000.0 * accrued / total")} AS expected, {r("accrued - 250000.0 * accrued / total")} AS gap FROM a""")
def pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.pace(table(spark, sf_dir, "events"), F.hour("ts"), "value", 250_000.0)


@query(f"""WITH RECURSIVE {CYCLES}, g AS (SELECT c.user_id, cycle, count(*) AS n, sum(c.value) AS total, (max({EPOCH}) - min({EPOCH}))::DOUBLE AS sec, max(CASE WHEN completes THEN 1 ELSE 0 END) AS complete FROM c JOIN events e USING (event_id) GROUP BY 1, 2),
p AS (SELECT user_id, count(*) AS k, sum(n) AS r, sum(total) AS t, sum(sec) AS s FROM g WHERE complete = 1 GROUP BY 1 HAVING count(*) >= 2)
SELECT count(*) AS units, CAST(sum(k) AS BIGINT) AS cycles, {r("sum(r)::DOUBLE / sum(k)")} AS mean_rows, {r("sum(s) / sum(k)")} AS mean_sec, {r("sum(t) / sum(k)")} AS mean_total FROM p""")
def cycle_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = (F.max(epoch_seconds("ts")) - F.min(epoch_seconds("ts"))).cast("double")
    found = _cycles(spark, sf_dir).groupBy("user_id", "cycle").agg(F.count("*").alias("rows"), F.sum("value").alias("total"), sec.alias("sec"), F.max("completes").alias("complete"))
    return rollup.cycle_model(found.where("complete"), "user_id")


@query(f"""WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2), s AS (SELECT event_type, count(*) AS members, median(m) AS med, min(m) AS lo, max(m) AS hi FROM m GROUP BY 1)
SELECT event_type, members, {r("med")} AS median, {r("lo")} AS lo, {r("hi")} AS hi, {r("(med - (SELECT min(med) FROM s)) / (SELECT min(med) FROM s)", 6)} AS above_lowest FROM s""")
def shift_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.shift_medians(table(spark, sf_dir, "events"), "event_type", "user_id", "value")


@query(f"""SELECT count(*) AS rows, count(DISTINCT user_id) AS units, min({EPOCH}) AS first_sec, max({EPOCH}) AS last_sec, count(DISTINCT {EPOCH} // 86400) AS days FROM events""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.coverage(table(spark, sf_dir, "events"), "user_id", "ts")


@query(f"""WITH c AS (SELECT CASE WHEN hour(ts) < 12 THEN 'day' ELSE 'night' END AS "window", count(value) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT "window", n, {r("greatest(0.5, least(2.0, (s / n) / ((SELECT sum(s) FROM c) / (SELECT sum(n) FROM c))))", 6)} AS factor FROM c""")
def schedule_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.schedule_factors(table(spark, sf_dir, "events"), F.when(F.hour("ts") < 12, "day").otherwise("night"), "value")


def _with_incidents(spark: SparkSession, series: DataFrame) -> DataFrame:
    rows = [(None, FIRST + 7200, FIRST + 14400, 0.5, "step"), (10, FIRST + 10800, FIRST + 36000, 0.25, "ramp")]
    incidents = spark.createDataFrame(rows, "unit long, start long, end long, magnitude double, shape string")
    return generator.incident_factors(series.select("unit", "at", "value"), incidents)


@query(SERIES + f""", inc(u, s, e, m, shape) AS (VALUES (NULL, {FIRST + 7200}, {FIRST + 14400}, 0.5::DOUBLE, 'step'), (10, {FIRST + 10800}, {FIRST + 36000}, 0.25::DOUBLE, 'ramp')),
h AS (SELECT unit, "at", value, coalesce(1 + m * CASE WHEN shape = 'ramp' THEN 2 * (("at" - s)::DOUBLE / greatest(e - s, 1)) ELSE 1.0 END, 1.0) AS factor FROM series LEFT JOIN inc ON (u IS NULL OR u = unit) AND "at" BETWEEN s AND e)
SELECT unit, "at", {r("value * product(factor)")} AS value, {r("product(factor)", 6)} AS factor FROM h GROUP BY unit, "at", value""")
def incident_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_incidents(spark, _series(spark, sf_dir))


@query(ORACLE_SQL["incident_series"].replace(SERIES, FLEET))
def fleet_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_incidents(spark, _fleet(spark, sf_dir))


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 100 WHEN split_part(lower(p_brand), '/', 1) = 'brand#11' THEN 40 ELSE 0 END + 25 * CASE WHEN contains(' ' || regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g') || ' ', ' promo ') THEN 1 ELSE 0 END AS relevance FROM part) SELECT p_partkey, CAST(relevance AS BIGINT) AS relevance FROM w""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.relevance(table(spark, sf_dir, "part"), "p_type", "p_brand", "promo", "Brand#11").select("p_partkey", "relevance")
