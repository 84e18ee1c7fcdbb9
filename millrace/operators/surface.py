"""What stands around results: conditions, responses, rules, touchpoints, catalogues.

The tables here are declared by people and small; they are joined to data by keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounding import half_up
from millrace.operators.risk import fires

#: What each surface may answer with: type, whether it notifies, whether it acts.
VOCABULARY = {
    "risk": (("alert", False, False), ("alarm", True, False), ("action", True, True)),
    "kbr": (("note", False, False), ("report", False, False)),
    "answer": (("flag", False, False), ("note", False, False)),
}
#: Comparisons that each format offers.
OPTIONS = {"currency": ("gt", "lt", "pct_change"), "count": ("gt", "lt", "pct_change"), "percentage": ("gt", "lt", "pp_change"), "time": ("gt", "lt", "pct_change")}
#: The workspace's settings.
SETTINGS = {"prox_warning": 0.20, "prox_urgent": 0.10, "sustained_ticks": 20.0, "cooldown_ms": 22500.0}


def vocabulary(spark: SparkSession) -> DataFrame:
    """(surface, type, notifies, acts): only the risk surface has any that notify."""
    rows = [(s, *r) for s, types in VOCABULARY.items() for r in types]
    return spark.createDataFrame(rows, "surface string, type string, notifies boolean, acts boolean")


def can_notify(surface: Column, kind: Column) -> Column:
    notifying = [s + "/" + t for s, types in VOCABULARY.items() for t, notifies, _ in types if notifies]
    return F.coalesce(F.concat_ws("/", surface, kind).isin(*notifying), F.lit(False))


def new_response(surface: str, kind: Column) -> Column:
    """An empty response of a type that the surface has, else null."""
    blank = [F.lit("").alias(c) for c in ("name", "subject", "message", "url", "payload")]
    known = kind.isin(*(t for t, *_ in VOCABULARY[surface]))
    return F.when(known, F.struct(kind.alias("type"), F.array().cast("array<string>").alias("channels"), *blank))


def options_for(format_: Column, direction: Column) -> Column:
    """The comparisons of a format, the one that tells of harm first."""
    named = F.create_map(*(x for k, v in OPTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    known = F.coalesce(named[format_], named[F.lit("count")])
    lead = F.when(direction == "down", "gt").otherwise("lt")
    return F.concat(F.filter(known, lambda o: o == lead), F.filter(known, lambda o: o != lead))


def checked_setting(key: str, value: str) -> dict[str, float]:
    """The settings with one changed; ValueError says why it may not be."""
    if key not in SETTINGS:
        raise ValueError("unknown setting")
    number = float(value)
    if not 0 <= number < float("inf"):
        raise ValueError("not a number from zero on")
    if key.startswith("prox") and not 0 < number <= 1:
        raise ValueError("proximity is a fraction between 0 and 1")
    return {**SETTINGS, key: number}


def cooldown_for(override: Column) -> Column:
    """A result's own cooldown, else the workspace's."""
    return F.coalesce(override.cast("double"), F.lit(SETTINGS["cooldown_ms"]))


def condition(known: DataFrame) -> DataFrame:
    """Conditions with the defaults of whatever columns they lack or leave null."""
    defaults = {"label": "", "scope_kind": "kbr", "mode": "absolute", "op": "lt", "response": "alert", "severity": "warning", "persist_sec": 0, "enabled": True, "origin": "user"}
    return known.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in known.columns else F.lit(v) for c, v in defaults.items()})


def is_simple(reference: Column, anomaly: Column) -> Column:
    """Four fields are all that a simple condition has."""
    return (F.col("scope_kind") == "kbr") & (F.col("mode") == "absolute") & reference.isNull() & (F.col("persist_sec") == 0) & anomaly.isNull()


def migrated(legacy: DataFrame) -> DataFrame:
    """Alerts (aid, name, type, severity, metric, op, value, channels, enabled) of the
    older shape as scoped conditions; an alert with channels was an alarm."""
    scoped = F.col("metric").isNotNull()
    return legacy.select(
        F.col("aid").alias("id"),
        F.coalesce("name", F.lit("Condition")).alias("label"),
        F.when(scoped, "touchpoint").otherwise("kbr").alias("scope_kind"),
        F.col("metric").alias("scope_ref"),
        F.coalesce("op", F.when(F.col("type") == "threshold", "lt").otherwise("any")).alias("op"),
        "value",
        F.when(F.size("channels") > 0, "alarm").otherwise("alert").alias("response"),
        F.when(F.col("severity").isin("critical", "high"), "critical").otherwise("warning").alias("severity"),
        F.when(F.col("type") == "anomaly", "unknown").alias("family"),
        (F.col("type") == "missing").alias("missing"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


def observed(conditions: DataFrame, results: DataFrame, touchpoints: DataFrame) -> DataFrame:
    """Adds `observed` to conditions (kbr, scope_kind, scope_ref): the health of the
    touchpoint (kbr, tid, health) that they name, else the result's value (kbr, value).
    A touchpoint that is not there is no value."""
    seen = conditions.join(results.select(F.col("kbr").alias("_k"), "value"), F.col("kbr") == F.col("_k"), "left")
    health = touchpoints.select(F.col("kbr").alias("_t"), "tid", "health")
    of_touchpoint = (F.col("scope_kind") == "touchpoint") & F.col("scope_ref").isNotNull()
    joined = seen.join(health, of_touchpoint & (F.col("kbr") == F.col("_t")) & (F.col("scope_ref") == F.col("tid")), "left")
    return joined.withColumn("observed", F.when(of_touchpoint, F.col("health")).otherwise(F.col("value"))).select(*conditions.columns, "observed")


def flagged(value: Column, op: Column, threshold: Column, enabled: Column) -> Column:
    """A mark on an answer where it stands (gt by default); it never notifies."""
    known = F.when(op.isin("lt", "lte", "gte"), op).otherwise("gt")
    return F.coalesce(enabled & fires(known, value, threshold), F.lit(False))


def learned_exceptions(incidents: DataFrame) -> DataFrame:
    """Zones of incidents (ordinal, label, start, zone, excess, effect) without a clock
    and without excess: operational context, not a fault. A zone's first counts."""
    usual = incidents.where("start IS NULL AND zone IS NOT NULL AND coalesce(excess, 0) = 0")
    note = F.coalesce("effect", "label", F.lit("operational context"))
    return usual.groupBy("zone").agg(F.min_by(F.struct("label", note.alias("note")), "ordinal").alias("f")).select("zone", "f.label", "f.note")


def routing(conditions: DataFrame, key: str) -> DataFrame:
    """By `key`: conditions that are enabled, and those of them that go to a channel."""
    routed = F.exists("responses", lambda r: F.size(r["channels"]) > 0)
    return conditions.groupBy(key).agg(F.count_if("enabled").alias("configured"), F.count_if(F.col("enabled") & F.coalesce(routed, F.lit(False))).alias("routed"))


def channel_references(conditions: DataFrame, id_: str) -> DataFrame:
    """Conditions that each channel is named in, through all their responses."""
    named = conditions.select(id_, F.explode("responses").alias("r")).select(id_, F.explode("r.channels").alias("channel"))
    return named.groupBy("channel").agg(F.count_distinct(id_).alias("conditions"))


def rules_on_touchpoints(rules: DataFrame, touchpoints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rules whose touchpoint is declared, and those that are skipped."""
    declared = touchpoints.select(key).distinct()
    return rules.join(declared, key, "left_semi"), rules.join(declared, key, "left_anti")


def touchpoints_of(*sources: tuple[str, DataFrame]) -> DataFrame:
    """All touchpoints of a host (host, name), whatever list they are kept in."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kept_in"), "host", "name") for kind, df in sources])


def incident_sheets(sheets: DataFrame, incidents: DataFrame, norm) -> DataFrame:
    """Incidents of each sheet: those of no entity, and those whose entity its name is
    or holds. Incidents are a reference table of at most a few hundred rows."""
    entity, name = norm(F.col("entity")), norm(F.col("sheet"))
    return sheets.join(F.broadcast(incidents), F.col("entity").isNull() | F.contains(name, entity)).select("sheet", "label")


def board_is_empty(*parts: DataFrame) -> DataFrame:
    """One row: whether no part has a row. Each is looked at until its first row."""
    counts = reduce(DataFrame.unionByName, [p.limit(1).select(F.lit(1).alias("one")) for p in parts])
    return counts.agg((F.count("*") == 0).alias("empty"))


def most_urgent(live: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    return live.orderBy(*order).limit(n)


def context_text(parts: dict[str, Column]) -> Column:
    """`name value` of the parts that have one, in one line; null if none has."""
    said = F.concat_ws(" · ", *(F.when(v.isNotNull(), F.concat(F.lit(k + " "), v.cast("string"))) for k, v in parts.items()))
    return F.nullif(said, F.lit(""))


def role_rollup(df: DataFrame, key: str, role: Column, value: str) -> DataFrame:
    """Sum, average and ratio of roles, with a warning where a ratio has no denominator."""
    num, den = (F.sum(F.when(role == r, F.col(value))) for r in ("numerator", "denominator"))
    summed = df.groupBy(key).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), num.alias("num"), den.alias("den"))
    warning = F.when(F.col("num").isNull(), "no numerator").when(F.coalesce("den", F.lit(0.0)) == 0, "no denominator")
    return summed.select(key, half_up("sum").alias("sum"), half_up("mean").alias("mean"), half_up(F.col("num") / F.nullif(F.col("den"), F.lit(0.0)), 6).alias("ratio"), warning.alias("warning"))


def incident_summary(incidents: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: incidents by how they are held out, and the rows that are."""
    of = lambda kind: F.count_if(F.col("quarantine") == kind)
    counts = incidents.agg(F.count("*").alias("incidents"), of("window").alias("windows"), of("zone").alias("zones"), of("none").alias("unquarantinable"))
    return counts.crossJoin(F.broadcast(excluded.agg(F.count("*").alias("rows_excluded"))))


def rank_cycles(candidates: DataFrame, n: int = 6) -> DataFrame:
    """Candidates (name, zero_share, plateau_share, rows) for the fleet's cycle: those
    that discharge to zero first, then the flatter at the top by steps of 0.02, then
    the longer; ties by name."""
    step = F.floor(F.col("plateau_share") / 0.02)
    return candidates.orderBy((F.col("zero_share") > 0).desc(), step.desc(), F.desc("rows"), "name").limit(n)


def walk_order(transitions: DataFrame) -> list[str]:
    """States along the strongest edges, from the most travelled one on; those that are
    not reached follow by name. The table has one row a pair of states."""
    edges: dict[str, dict[str, int]] = {}
    for r in transitions.collect():
        edges.setdefault(r["from_state"], {})[r["to_state"]] = r["n"]
    states = sorted(set(edges) | {t for row in edges.values() for t in row})
    if not states:
        return []
    order = [min(states, key=lambda s: (-sum(edges.get(s, {}).values()), s))]
    while ahead := {t: n for t, n in edges.get(order[-1], {}).items() if t not in order}:
        order.append(min(ahead, key=lambda t: (-ahead[t], t)))
    return order + [s for s in states if s not in order]


def unit_record(df: DataFrame, unit: str, measure: str, found_runs: DataFrame, completed: DataFrame, grain_sec: float, unit_sec: float) -> DataFrame:
    """Each unit's record: totals, the integrated rate, its runs and its cycles
    (`completed` has a row a completed cycle and its peak)."""
    totals = df.groupBy(unit).agg(F.count("*").alias("rows"), half_up(F.avg(measure)).alias("mean"), half_up(F.sum(measure) * grain_sec / unit_sec).alias("integrated"))
    episodes = found_runs.groupBy(unit).agg(F.count("*").alias("episodes"), F.count_distinct("state").alias("states"))
    cycles = completed.groupBy(unit).agg(F.count("*").alias("cycles"), half_up(F.sum("peak")).alias("quantity"))
    joined = totals.join(episodes, unit, "left").join(cycles, unit, "left")
    return joined.select(unit, "rows", "mean", "integrated", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("episodes", "states", "cycles")), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def time_span(df: DataFrame, unit: str, sec: Column, grains: DataFrame) -> DataFrame:
    """One row: the whole span, the step that most units have, gaps, series."""
    step = grains.groupBy("grain_sec").count().orderBy(F.desc("count"), "grain_sec").limit(1).select("grain_sec")
    span = df.agg(F.min(sec).alias("first_sec"), F.max(sec).alias("last_sec"), F.count_distinct(unit).alias("series"))
    return span.crossJoin(F.broadcast(step)).crossJoin(F.broadcast(grains.agg(F.sum("gaps").alias("gaps"))))


def applied(declared: DataFrame, live: DataFrame, answers: DataFrame, columns: DataFrame, norm) -> DataFrame:
    """One row: what applying a configuration does. Declared results (name) meet live
    ones by name; answers (kbr, dimension, measure) of a result that is met count, and
    are resolved if their dimension and measure name columns."""
    met = declared.join(live.select(norm(F.col("name")).alias("_n")).distinct(), norm(F.col("name")) == F.col("_n"), "left_semi")
    asked = answers.join(met.select(F.col("name").alias("kbr")), "kbr", "left_semi")
    names = columns.select(norm(F.col("column")).alias("_c")).distinct()
    resolved = asked.join(names.withColumnRenamed("_c", "_d"), norm(F.col("dimension")) == F.col("_d"), "left_semi").join(names.withColumnRenamed("_c", "_m"), norm(F.col("measure")) == F.col("_m"), "left_semi")
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((met, "kbrs"), (asked, "answers"), (resolved, "resolved"), (declared, "_declared"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts).select("kbrs", "answers", (F.col("answers") - F.col("resolved")).alias("unresolved"), (F.col("_declared") - F.col("kbrs")).alias("unmatched"))


def pairs_of_categories(df: DataFrame, categories: list[str], measure: str) -> DataFrame:
    """Cells of every unordered pair of categories, from one pass over the rows."""
    pairs = [F.struct(F.lit(a).alias("first"), F.col(a).cast("string").alias("first_value"), F.lit(b).alias("second"), F.col(b).cast("string").alias("second_value")) for i, a in enumerate(categories) for b in categories[i + 1 :]]
    long = df.select(F.explode(F.array(*pairs)).alias("p"), F.col(measure).cast("double").alias("v")).where("p.first_value IS NOT NULL AND p.second_value IS NOT NULL AND v IS NOT NULL")
    keys = ["first", "first_value", "second", "second_value"]
    return long.select("p.*", "v").groupBy(*keys).agg(F.count("*").alias("n"), half_up(F.avg("v")).alias("mean"))

