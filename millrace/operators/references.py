"""Reference tables that a workbook carries: recognised by their headers.

Headers are small and are matched on the driver; rows become typed DataFrames.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce

BULK_ROWS = 500


def plain(text: str | None) -> str:
    spread = unicodedata.normalize("NFD", (text or "").lower().strip())
    return "".join(c for c in spread if not unicodedata.combining(c))


def pick(header: list[str], words: tuple[str, ...]) -> int | None:
    """The first column whose name holds the first word that any name holds."""
    names = [plain(h) for h in header]
    return next((i for w in words for i, n in enumerate(names) if w in n), None)


@dataclass(frozen=True)
class Recogniser:
    """`needs`: each group of words must be met by some column; `or_needs`, if given,
    is another set of groups that will do."""

    kind: str
    needs: tuple[tuple[str, ...], ...]
    columns: dict[str, tuple[str, ...]]
    or_needs: tuple[tuple[str, ...], ...] = ()

    def knows(self, header: list[str]) -> bool:
        met = lambda needs: bool(needs) and all(pick(header, words) is not None for words in needs)
        return met(self.needs) or met(self.or_needs)


#: In order, the words that tell reference tables and their columns.
RECOGNISERS = (
    Recogniser(
        "thresholds",
        (("parametro", "parameter", "variable"), ("correcto", "correct", "normal"), ("critico", "critical", "falla", "fail", "fuera", "out of")),
        {"group": ("grupo", "group"), "param": ("parametro", "parameter", "variable"), "unit": ("unidad", "unit"), "context": ("contexto", "context"), "correct": ("correcto", "correct", "ok"), "out": ("fuera", "out of", "warning"), "critical": ("critico", "critical", "falla", "fail"), "ceiling": ("tolerancia", "tolerance", "ceiling"), "persistence": ("persistencia", "persistence", "duration")},
    ),
    Recogniser(
        "incidents",
        (("caso",), ("inicio", "exceso")),
        {"entity": ("camion", "unidad", "entity", "asset", "unit", "truck"), "label": ("caso", "case", "anomaly", "incident"), "start": ("inicio", "start"), "end": ("fin", "end"), "window_type": ("tipo de ventana", "window", "tipo"), "variables": ("variables", "signals", "pattern"), "effect": ("efecto", "effect", "physical"), "rows_affected": ("filas", "rows", "records"), "expected_excess": ("exceso", "excess", "impact"), "zone": ("ruta", "zona", "zone", "route", "segment"), "use": ("uso", "use", "purpose", "notes")},
        (("case",), ("start", "excess")),
    ),
    Recogniser("roster", (("operador", "operator", "driver", "conductor"), ("turno", "shift")), {"who": ("operador", "operator", "driver", "conductor"), "entity": ("camion", "unidad", "truck", "unit", "asset"), "shift": ("turno", "shift"), "schedule": ("horario", "schedule", "hours"), "value": ("valor", "value", "promedio", "mean"), "baseline": ("base", "baseline", "linea"), "deviation": ("desviacion", "deviation", "variacion"), "flag": ("estado", "flag", "status")}),
    Recogniser("map", (("ruta", "route"), ("segmento", "segment")), {"route": ("ruta", "route"), "order": ("orden", "order", "sequence"), "segment": ("segmento", "segment"), "length_m": ("longitud", "length", "metros"), "grade": ("pendiente", "grade", "slope"), "condition": ("condicion", "condition")}),
    Recogniser("dictionary", (("variable", "field", "campo"), ("descripcion", "description", "significado")), {"group": ("grupo", "group"), "variable": ("variable", "field", "campo"), "description": ("descripcion", "description", "significado"), "unit": ("unidad", "unit"), "role": ("rol", "role", "tipo"), "origin": ("origen", "origin", "source")}),
)


def recognise(header: list[str], rows: int) -> Recogniser | None:
    """The first that knows the header; a table of many rows is data, not reference."""
    return None if rows > BULK_ROWS else next((r for r in RECOGNISERS if r.knows(header)), None)


def _named(table: DataFrame, recogniser: Recogniser) -> DataFrame:
    """Columns by their names in the recogniser; those not found are null."""
    header = table.columns
    at = {name: pick(header, words) for name, words in recogniser.columns.items()}
    return table.select(*((F.col(f"`{header[i]}`") if i is not None else F.lit(None)).cast("string").alias(name) for name, i in at.items()))


def graded(correct: Column, out: Column, critical: Column) -> Column:
    """struct(dir, glo, ghi, ylo, yhi, g, y, r) of three parsed bands.

    Two ends in the correct band mean `within`, and the out band widens them to
    the yellow ends; one end means lte or gte, whose yellow and red are the first
    ends of the other bands.
    """
    first = lambda b: F.get(b["ranges"], F.lit(0))
    lo, hi = first(correct)["lo"], first(correct)["hi"]
    within = lo.isNotNull() & hi.isNotNull()
    way = F.when(within, "within").when(hi.isNotNull(), "lte").when(lo.isNotNull(), "gte")
    outs = F.coalesce(out["ranges"], F.array())
    lows = F.filter(F.transform(outs, lambda x: x["lo"]), lambda x: x.isNotNull())
    highs = F.filter(F.transform(outs, lambda x: F.coalesce(x["hi"], F.when(x["lo"] >= hi, x["lo"]))), lambda x: x.isNotNull())
    yellow = F.when(way == "lte", F.coalesce(first(out)["hi"], hi)).when(way == "gte", F.coalesce(first(out)["lo"], lo))
    red = F.when(way == "lte", F.coalesce(first(critical)["lo"], yellow)).when(way == "gte", F.coalesce(first(critical)["hi"], yellow))
    return F.struct(way.alias("dir"), F.when(within, lo).alias("glo"), F.when(within, hi).alias("ghi"), F.when(within, F.least(lo, F.array_min(lows))).alias("ylo"), F.when(within, F.greatest(hi, F.array_max(highs))).alias("yhi"), F.when(way == "lte", hi).when(way == "gte", lo).alias("g"), yellow.alias("y"), red.alias("r"))


def reference_rows(table: DataFrame, recogniser: Recogniser) -> DataFrame:
    """The typed rows of a recognised table."""
    named = _named(table, recogniser)
    number, time = lambda c: coerce.parse_number(F.col(c)), lambda c: coerce.parse_time(F.col(c))
    if recogniser.kind == "thresholds":
        bands = {c: coerce.parse_bands(F.col(c)) for c in ("correct", "out", "critical")}
        held = coerce.parse_persistence(F.col("persistence"))
        typed = named.where("param IS NOT NULL").withColumns(bands).withColumn("ceiling", number("ceiling")).withColumn("persist_sec", held["sec"]).withColumn("persist_note", held["note"])
        return typed.withColumn("param_key", coerce.squash(F.col("param"))).withColumn("thresholds", graded(F.col("correct"), F.col("out"), F.col("critical"))).drop("persistence")
    if recogniser.kind == "incidents":
        terms = F.filter(F.split(coerce.without_accents(F.col("zone")), r"\s*[,;/]\s*"), lambda t: (F.length(t) > 4) & ~t.rlike("^(toda|todo|all)"))
        typed = named.where("label IS NOT NULL").withColumns({"start": time("start"), "end": time("end"), "rows_affected": number("rows_affected"), "expected_excess": number("expected_excess"), "zone_terms": F.coalesce(terms, F.array().cast("array<string>")), "variables": F.split("variables", r"\s*[,;+]\s*")})
        return typed.withColumn("quarantine", F.when(F.col("start").isNotNull(), "window").when(F.size("zone_terms") > 0, "zone").otherwise("none"))
    if recogniser.kind == "roster":
        return named.where("who IS NOT NULL").withColumns({c: number(c) for c in ("value", "baseline", "deviation")})
    if recogniser.kind == "map":
        return named.where("segment IS NOT NULL").withColumns({c: number(c) for c in ("order", "length_m", "grade")})
    return named.where("variable IS NOT NULL").withColumn("variable_key", coerce.squash(F.col("variable")))


def in_zone(values: list[Column], incidents: DataFrame, df: DataFrame) -> DataFrame:
    """Adds `quarantined`: some value holds a zone term of an incident.

    Terms come from a recognised reference table, which has at most BULK_ROWS
    rows; they are gathered into one array.
    """
    terms = incidents.where("quarantine = 'zone'").agg(F.array_distinct(F.flatten(F.collect_list("zone_terms"))).alias("_terms"))
    any_value = F.concat_ws("\n", *(coerce.without_accents(v.cast("string")) for v in values))
    return df.crossJoin(F.broadcast(terms)).withColumn("quarantined", F.exists("_terms", lambda t: F.contains(any_value, t))).drop("_terms")


def match_thresholds(parameters: list[tuple[str, str | None]], measures: list[tuple[str, str | None]]) -> dict[str, str]:
    """Parameter to measure (name, unit): the best by name among those whose units
    agree, in the parameters' order. Equal names win; else one name must hold the
    other, and the closer in length the better; a measure taken before is worth a
    little less. Both lists are column names, tens at most.
    """
    squash = lambda t: "".join(c for c in plain(t) if c.isalnum())
    key = lambda u: coerce.UNIT_ALIASES.get("".join(c for c in plain(u) if c.isalnum() or c in "/%"), "".join(c for c in plain(u) if c.isalnum() or c in "/%"))
    taken: set[str] = set()
    out: dict[str, str] = {}
    for name, unit in parameters:
        best, best_score = None, 0.0
        for measure, measure_unit in measures:
            a, b = squash(name), squash(measure)
            if key(unit) and key(measure_unit) and key(unit) != key(measure_unit) or not a or not b:
                continue
            score = 1000.0 if a == b else 100.0 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
            score -= 0.5 if score and measure in taken else 0.0
            if score > best_score:
                best, best_score = measure, score
        if best:
            out[name] = best
            taken.add(best)
    return out
