"""Declarative configuration: documents to tables, and names bound to columns."""

from __future__ import annotations

import csv
import json
from functools import reduce
from io import StringIO
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators.answer import Question

#: The columns of a configuration row.
COLUMNS = "kind kbr name unit format direction target notes dimension measure denominator aggregation rank op value response channels dna weight rollup persistencesec".split()
KINDS = ("channel", "kbr", "answer", "risk", "condition", "anomrule")


def parse_config(text: str, name: str) -> list[dict[str, str | None]]:
    """Rows of a csv, tsv, json or yaml document; lines that begin with # are dropped."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("json", "yaml", "yml"):
        if kind == "json":
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text)
        rows = found if isinstance(found, list) else [{"kind": k.removesuffix("s"), **row} for k, rows in (found or {}).items() if isinstance(rows, list) for row in rows]
    else:
        lines = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#"))
        rows = list(csv.DictReader(StringIO(lines), delimiter="\t" if kind == "tsv" else ","))
    clean = lambda v: None if v is None or str(v).strip() == "" else str(v).strip()
    lower = [{str(k).strip().lower(): clean(v) for k, v in row.items() if k is not None} for row in rows]
    return [{c: row.get(c) for c in COLUMNS} for row in lower if row.get("kind") in KINDS]


def config_frame(spark: SparkSession, text: str, name: str) -> DataFrame:
    """The rows of a configuration document, numbered; one document is small."""
    rows = [(i, *(row[c] for c in COLUMNS)) for i, row in enumerate(parse_config(text, name))]
    return spark.createDataFrame(rows, "ordinal long, " + ", ".join(f"`{c}` string" for c in COLUMNS))


def tables(config: DataFrame) -> dict[str, DataFrame]:
    """One typed table a kind. Defaults: conditions fire below (lt), answers are a
    mean ranked from the greatest."""
    of = lambda kind: config.where(F.col("kind") == kind)
    threshold = coerce.parse_number(F.col("value")).alias("threshold")
    response = F.col("response")
    channels = F.filter(F.split(F.coalesce("channels", F.lit("")), r"\s*[;|]\s*"), lambda c: c != "").alias("channels")
    condition = of("condition").select("ordinal", "kbr", "name", F.coalesce("op", F.lit("lt")).alias("op"), threshold, response, channels, coerce.parse_number(F.col("persistencesec")).alias("persist_sec"))
    return {
        "channel": of("channel").select("ordinal", "name", F.col("response").alias("destination"), F.col("channels").alias("type")),
        "kbr": of("kbr").select("ordinal", "name", "unit", F.coalesce("format", F.lit("count")).alias("format"), F.coalesce("direction", F.lit("up")).alias("direction"), coerce.parse_number(F.col("target")).alias("target"), "notes"),
        "answer": of("answer").select("ordinal", "kbr", "name", "unit", "format", "dimension", "measure", "denominator", F.coalesce("aggregation", F.lit("mean")).alias("aggregation"), F.coalesce("rank", F.lit("max")).alias("rank")),
        "risk": of("risk").select("ordinal", "kbr", "name", F.coalesce("weight", F.lit("MED")).alias("weight"), "dna"),
        "condition": condition,
        "anomrule": of("anomrule").select("ordinal", "kbr", "name", "op", "value", "response"),
    }


def _grams(words: Column) -> Column:
    """All runs of one to three letters of words, blanks left out."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(words) - n + 1)), lambda i: F.substring(words, i, n))
    return F.filter(F.array_distinct(F.concat(at(1), at(2), at(3))), lambda g: (g != "") & ~F.contains(g, F.lit(" ")))


def _own_grams(words: Column) -> Column:
    """The longest grams inside each word: runs of three letters, or a shorter word."""
    inside = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substring(w, i, 3))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(words, " "), lambda w: w != ""), inside)))


#: How a name reached a column, from the strongest tier on. 6 to 8 are fields of the
#: dictionary that hold the name; 9 is a description with all of its words.
TIERS = (1, 2, 3, 6, 7, 8, 4, 5, 9)


def bind_names(spoken: DataFrame, columns: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(name) to (column): by the first tier that matches, the earliest column first.

    Tiers: the same, without regard to case (1); beginning with (2); by words without
    accents and punctuation (3); a variable (6), key (7) or description (8) of the
    `dictionary` (column, variable_key, description: `column` may be a beginning) that
    holds the name; a column that holds it (4); all words shared, with the fewest others,
    in a column (5) or a description (9). A name that meets nothing has a null column. A
    null or blank name meets nothing; repeated names keep their rows; the order of columns
    is that of the table.

    Names meet only texts with which they share a gram of letters, the rarest of their own
    ones: a join on grams, whose sides may both be large.
    """
    ordered = columns.select("column", F.monotonically_increasing_id().alias("_at")).where("column IS NOT NULL")
    words, lower = coerce.words_only, lambda c: F.lower(F.trim(c))
    texts = ordered.select("column", "_at", F.lit("column").alias("_field"), lower(F.col("column")).alias("_have"), words(F.col("column")).alias("_h"))
    if dictionary is not None:
        entries = dictionary.select(words(F.coalesce(F.col("column"), F.col("variable_key"))).alias("_v"), F.col("column").alias("variable"), "variable_key", "description", F.monotonically_increasing_id().alias("_entry")).where("_v <> ''")
        heads = ordered.withColumn("_w", words(F.col("column"))).withColumn("_head", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_w"))), lambda i: F.left(F.col("_w"), i))))
        first = Window.partitionBy("_entry").orderBy("_at")
        bound = entries.join(heads, F.col("_v") == F.col("_head")).withColumn("_k", F.row_number().over(first)).where("_k = 1")
        fields = F.array(*(F.struct(F.lit(f).alias("_field"), F.col(f).alias("_text")) for f in ("variable", "variable_key", "description")))
        more = bound.select("column", F.col("_entry").alias("_at"), F.inline(fields)).where("_text IS NOT NULL")
        texts = texts.unionByName(more.select("column", "_at", "_field", lower(F.col("_text")).alias("_have"), words(F.col("_text")).alias("_h")))
    # A name without letters is known by its first character alone.
    mark = lambda c: F.concat(F.lit("^"), F.left(c, F.lit(1)))
    indexed = texts.withColumn("_gram", F.explode(F.array_append(_grams(F.col("_h")), mark(F.col("_have")))))
    said = spoken.select("name").distinct().withColumns({"_want": lower(F.col("name")), "_w": words(F.col("name"))}).where("_want <> ''")
    common = indexed.groupBy("_gram").agg(F.count("*").alias("_texts"))
    own = said.withColumn("_gram", F.explode(F.when(F.col("_w") == "", F.array(mark(F.col("_want")))).otherwise(_own_grams(F.col("_w")))))
    # A gram that no text has rules all texts out.
    rarest = own.join(common, "_gram", "left").groupBy("name", "_want", "_w").agg(F.min_by("_gram", F.struct(F.coalesce("_texts", F.lit(0)), "_gram")).alias("_gram"))
    want, have, w, h, field = (F.col(x) for x in ("_want", "_have", "_w", "_h", "_field"))
    is_column, split = field == "column", lambda x: F.split(x, " ")
    shared = (w != "") & (F.size(F.array_except(split(w), split(h))) == 0)
    holds = (w != "") & F.contains(h, w)
    extra = F.size(split(h)) - F.size(split(w))
    tier = F.when(is_column, F.when(want == have, 1).when(F.startswith(have, want), 2).when((w != "") & (w == h), 3).when(holds, 4).when(shared, 5)).when(holds, F.when(field == "variable", 6).when(field == "variable_key", 7).otherwise(8)).when((field == "description") & shared & (F.size(split(w)) > 1), 9)
    scored = rarest.join(indexed, "_gram").withColumn("tier", tier).where("tier IS NOT NULL")
    strength = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    best = F.struct(strength.alias("_s"), F.when(F.col("tier") == 5, extra).otherwise(0).alias("_x"), "_at")
    found = scored.groupBy("name").agg(F.min_by(F.struct("column", "tier"), best).alias("_b")).select("name", "_b.column", "_b.tier")
    return spoken.join(found, "name", "left")


def match_results(declared: DataFrame, live: DataFrame) -> DataFrame:
    """Declared to live results by name: exact, then without case, accents and
    punctuation; if no name matches at all and there are as many, by position."""
    d = declared.select("ordinal", "name", coerce.squash(F.col("name")).alias("_d"))
    v = live.select(F.col("name").alias("live"), F.col("ordinal").alias("_o"), coerce.squash(F.col("name")).alias("_v"))
    pairs = d.join(v, F.col("_d") == F.col("_v")).withColumn("_k", F.row_number().over(Window.partitionBy("ordinal").orderBy((F.col("name") != F.col("live")).cast("int"), (F.lower("name") != F.lower("live")).cast("int"), "_o")))
    named = d.select("ordinal", "name").join(pairs.where("_k = 1").select("ordinal", "live"), "ordinal", "left")
    counts = named.agg(F.count("live").alias("_hits"), F.count("*").alias("_declared")).crossJoin(live.agg(F.count("*").alias("_live")))
    place = lambda df, name: df.select(F.col("name").alias(name), F.row_number().over(Window.orderBy("ordinal")).alias("_place"))
    by_place = place(declared, "name").join(place(live, "_positional"), "_place").select("name", "_positional")
    fallback = F.when((F.col("_hits") == 0) & (F.col("_declared") == F.col("_live")), F.col("_positional"))
    return named.join(by_place, "name", "left").crossJoin(F.broadcast(counts)).select("ordinal", "name", F.coalesce("live", fallback).alias("live"))


def resolve_channels(conditions: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions with the channels that exist, and the references that dangle."""
    known = channels.select(F.lower(F.trim("name")).alias("_c"), F.col("name").alias("channel"))
    refs = conditions.select("ordinal", F.explode("channels").alias("label")).withColumn("_c", F.lower(F.trim("label")))
    kept = refs.join(known, "_c").groupBy("ordinal").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    return conditions.drop("channels").join(kept, "ordinal", "left").withColumn("channels", F.coalesce("channels", F.array().cast("array<string>"))), refs.join(known, "_c", "left_anti").select("ordinal", "label")


def merge_registry(document: DataFrame, registry: DataFrame, key: str = "name") -> DataFrame:
    """All entries of both; the document's win."""
    return document.unionByName(registry.join(document.select(key), key, "left_anti").select(*document.columns))


def questions(answers: DataFrame, bound: dict[str, str]) -> list[Question]:
    """Runnable questions of the answers whose names are bound to columns."""
    out = []
    for r in answers.orderBy("ordinal").collect():
        names = [r["dimension"], r["measure"], r["denominator"]]
        if all(n is None or n in bound for n in names) and r["dimension"] and r["measure"]:
            out.append(Question(bound[r["dimension"]], bound[r["measure"]], r["aggregation"] if r["aggregation"] in ("mean", "sum", "count", "ratio", "deviation") else "mean", denominator=bound.get(r["denominator"] or ""), rank="min" if r["rank"] == "min" else "max"))
    return out


#: Words of four languages that tell a format.
TIME_WORDS = ("day", "days", "hour", "hours", "min", "mins", "minute", "minutes", "second", "seconds", "duration", "turnaround", "uptime", "downtime", "idle", "ralenti", "dia", "dias", "hora", "horas", "minuto", "minutos", "segundo", "segundos", "duracion", "tiempo", "plazo", "espera", "jour", "jours", "heure", "heures", "duree", "temps", "delai", "tempo", "prazo", "ociosidade")
MONEY_WORDS = ("revenue", "sales", "cost", "spend", "profit", "margin", "price", "budget", "cash", "gmv", "mrr", "ingreso", "ingresos", "ingresa", "ingresas", "venta", "ventas", "costo", "costos", "coste", "gasto", "precio", "presupuesto", "beneficio", "recette", "cout", "couts", "depense", "depenses", "prix", "receita", "venda", "vendas", "custo", "custos", "despesa", "despesas", "preco", "orcamento", "lucro")
SHARE_WORDS = ("percent", "percentage", "rate", "share", "ratio", "conversion", "utilisation", "utilization", "variacion", "desviacion", "porcentaje", "tasa", "cuota", "pourcentage", "taux", "ecart", "percentual", "percentagem", "taxa", "variacao")
MONEY_SIGNS = ("$", "€", "£", "¥")


def suggest_format(name: Column, unit: Column) -> Column:
    """percentage, time, currency or count, from a name and its unit: a per cent sign
    first, then the first group of which either holds a word."""
    text = F.concat_ws(" ", name, unit)
    sign = reduce(or_, (F.contains(text, F.lit(x)) for x in MONEY_SIGNS))
    has = lambda words: coerce.has_word(words, text)
    return F.when(F.contains(F.coalesce(unit, F.lit("")), F.lit("%")), "percentage").when(has(TIME_WORDS), "time").when(has(MONEY_WORDS) | sign, "currency").when(has(SHARE_WORDS), "percentage").otherwise("count")
