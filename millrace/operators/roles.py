"""Types and roles of a sheet's columns, and what an analysis of it works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce

#: Words in a header that hint at who, or in which context.
WHO_WORDS = ("operator", "operador", "driver", "conductor", "employee", "empleado", "user", "usuario", "customer", "cliente", "agent", "agente", "truck", "camion", "unit", "unidad", "vehicle", "vehiculo", "asset", "equipo", "store", "tienda", "technician", "tecnico", "staff", "person", "persona", "crew", "id")
CONTEXT_WORDS = ("shift", "turno", "route", "ruta", "zone", "zona", "segment", "segmento", "region", "state", "estado", "status", "condition", "condicion", "category", "categoria", "type", "tipo", "channel", "canal", "location", "ubicacion", "position", "posicion", "site", "area", "grade", "class", "clase", "group", "grupo", "reason", "motivo", "causa", "weather", "clima")


def column_roles(cells: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row a column of (sheet, _row, column, name, cell): type and role.

    A type is what over 80 % of live cells are. A declared prefix gives the role;
    then time and numbers by type; then hints in the name, context before who.
    `sample_rows` looks at the first rows of a sheet only, as a preview does.
    """
    seen = cells if sample_rows is None else cells.where(F.col("_row") <= sample_rows)
    kind = coerce.cell_kind(F.col("cell"))
    counted = seen.withColumn("kind", kind).groupBy("sheet", "column", "name").agg(F.count_if(F.col("kind") != "blank").alias("live"), F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(F.col("kind") == "time").alias("times"), F.count_distinct(F.when(F.col("kind") != "blank", F.col("cell"))).alias("distinct_values"))
    of = F.when(F.col("live") == 0, "empty").when(F.col("times") > 0.8 * F.col("live"), "datetime").when(F.col("numbers") > 0.8 * F.col("live"), "number").otherwise("category")
    inferred = F.when(F.col("type") == "datetime", "time").when(coerce.has_word(CONTEXT_WORDS, F.col("name")) & (F.col("type") == "category"), "ctx").when(coerce.has_word(WHO_WORDS, F.col("name")), "who").when(F.col("type") == "number", "val").otherwise("ctx")
    named = counted.withColumn("type", of).withColumn("role", F.coalesce(coerce.declared_role(F.col("name")), inferred))
    plain = F.regexp_replace("name", r"(?i)^\s*(time|who|ctx|val)\s*:\s*", "")
    unit = coerce.split_unit(plain)
    return named.withColumn("label", unit["label"]).withColumn("unit", unit["unit"])


@dataclass(frozen=True)
class Plan:
    time: str | None
    measures: list[str]
    categories: list[str]
    joint: list[str]


def plan_of(roles: DataFrame, sheet: str, most: int = 60, joint_most: int = 12) -> Plan:
    """What to cross: the first time column, numeric values, and categories of few
    values. The table of columns is small; it drives which query is built."""
    rows = roles.where(F.col("sheet") == sheet).orderBy("column").collect()
    categories = [r for r in rows if r["type"] == "category" and 1 <= r["distinct_values"] <= most]
    time = next((r["name"] for r in rows if r["type"] == "datetime"), None)
    return Plan(time, [r["name"] for r in rows if r["type"] == "number" and r["role"] == "val"], [r["name"] for r in categories], [r["name"] for r in categories if r["distinct_values"] <= joint_most])


def typed_table(cells: DataFrame, roles: DataFrame, sheet: str) -> DataFrame:
    """A sheet's cells as a table of typed columns, ordered by `_row`."""
    columns = roles.where(F.col("sheet") == sheet).orderBy("column").collect()
    picked = [F.max(F.when(F.col("column") == r["column"], F.col("cell"))).alias(f"c{r['column']}") for r in columns]
    wide = cells.where(F.col("sheet") == sheet).groupBy("_row").agg(*picked)
    cast = {"number": coerce.parse_number, "datetime": coerce.parse_time}
    return wide.select("_row", *(cast.get(r["type"], lambda c: c)(F.col(f"c{r['column']}")).alias(r["name"]) for r in columns))
