"""From a file to a stored profile, in one call.

The file is read once, into a table of untyped rows; a workbook's reference sheets
(limits, incidents, rosters, maps, dictionaries) are then taken first, so that the
windows of incidents are known before any row counts towards a baseline. Sheets and
their columns are tables that rows are joined with, however many there are; only names of
columns and headers of small tables, each once, steer the plan from the driver. Rows are
typed once, and all facets read them typed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators import crosstab, references, roles, rollup
from millrace.plans import profile
from millrace.sources import readers
from millrace.sources.scratch import discard, written

BULK_ROWS = references.BULK_ROWS


@dataclass
class Sheet:
    name: str
    at: int
    names: list[str]
    rows: int
    columns: list = field(default_factory=list)


def contributing(sheets: DataFrame, bulk_rows: int = BULK_ROWS) -> DataFrame:
    """Adds `contributes` to (sheet, rows, is_reference, has_time): data sheets with a time
    or more than `bulk_rows` rows; where no sheet is like that, every data sheet."""
    bulk = ~F.col("is_reference") & (F.col("has_time") | (F.col("rows") > bulk_rows))
    some = sheets.agg(F.coalesce(F.bool_or(bulk), F.lit(False)).alias("_some"))
    return sheets.crossJoin(F.broadcast(some)).withColumn("contributes", F.when(F.col("_some"), bulk).otherwise(~F.col("is_reference"))).drop("_some")


def union_references(tables: list[DataFrame]) -> DataFrame:
    """Rows of all reference tables of one kind, as they are (a bag)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _heads(rows: DataFrame) -> DataFrame:
    """Rows (sheet, at, names, n): headers, each column named, and how many rows are below."""
    found = readers.headers(rows)
    below = rows.join(found, "sheet").where(F.col("_row") > F.col("at")).groupBy("sheet").agg(F.count("*").alias("n"))
    names = F.transform("names", lambda n, i: F.coalesce(n, F.concat(F.lit("col"), (i + 1).cast("string"))))
    return found.join(below, "sheet").select("sheet", "at", names.alias("names"), "n")


def sheets_of(rows: DataFrame) -> list[Sheet]:
    """What each sheet of (sheet, _row, cells) looks like, for a look at a few: its header,
    rows below, types and roles of its columns. Sheets without a header are left out."""
    sheets = {r["sheet"]: Sheet(r["sheet"], r["at"], r["names"], r["n"]) for r in _heads(rows).collect()}
    for r in roles.column_roles(readers.with_header(rows)).orderBy("sheet", "column").collect():
        sheets[r["sheet"]].columns.append(r)
    return sorted(sheets.values(), key=lambda s: s.name)


def _recognised(heads: DataFrame) -> dict[tuple[str, ...], references.Recogniser]:
    """Headers of reference sheets, each once, and what knows them."""
    small = heads.where(F.col("n") <= BULK_ROWS).select("names").distinct().collect()
    found = {tuple(r["names"]): references.recognise(r["names"], 0) for r in small}
    return {names: known for names, known in sorted(found.items()) if known}


def sheet_facet(heads: DataFrame, columns: DataFrame, known: dict[tuple[str, ...], references.Recogniser]) -> DataFrame:
    """Rows (sheet, rows, reference, is_reference, has_time, contributes)."""
    spark = heads.sparkSession
    kinds = spark.createDataFrame([(list(names), k.kind) for names, k in known.items()], "names array<string>, reference string")
    timed = columns.groupBy("sheet").agg(F.bool_or(F.col("type") == "datetime").alias("has_time"))
    told = heads.join(F.broadcast(kinds), "names", "left").withColumn("reference", F.when(F.col("n") <= BULK_ROWS, F.col("reference"))).join(timed, "sheet", "left")
    return contributing(told.select("sheet", F.col("n").alias("rows"), "reference", F.col("reference").isNotNull().alias("is_reference"), F.coalesce("has_time", F.lit(False)).alias("has_time")))


def reference_table(rows: DataFrame, heads: DataFrame, kind: str, known: dict[tuple[str, ...], references.Recogniser]) -> DataFrame:
    """Typed rows of all sheets of one kind; sheets of one header are read together. Of
    columns of one name the first counts."""
    tables = []
    for names, recogniser in known.items():
        if recogniser.kind != kind:
            continue
        own = heads.where((F.col("n") <= BULK_ROWS) & (F.col("names") == F.array(*map(F.lit, names)))).select("sheet", "at")
        below = rows.join(own, "sheet").where(F.col("_row") > F.col("at"))
        cells = {n: F.get("cells", F.lit(names.index(n))).alias(n) for n in names}
        tables.append(references.reference_rows(below.select(*cells.values()), recogniser))
    return union_references(tables)


def data_table(rows: DataFrame, heads: DataFrame, columns: DataFrame, sheets: DataFrame) -> tuple[DataFrame, list[str], list[str], bool]:
    """All data `sheets` under each other, with their time as `_time`; its measures, its
    categories and whether any sheet has a time. A column of one name has the type of the
    first sheet that has it, and a sheet's columns of one name are the first of them.

    Rows meet where their sheet has each column, in one join, whatever the sheets look like.
    """
    own = columns.join(sheets, "sheet")
    first = F.min(F.struct("sheet", "column", "type", "role", "distinct_values")).alias("k")
    kinds = own.groupBy("name").agg(first).orderBy("k.sheet", "k.column").select("name", "k.*").collect()
    timed = F.min(F.when(F.col("type") == "datetime", F.col("column"))).alias("_at_time")
    at = own.groupBy("sheet").agg(timed, *(F.min(F.when(F.col("name") == k["name"], F.col("column"))).alias(f"_at{i}") for i, k in enumerate(kinds)))
    below = rows.join(heads.select("sheet", "at").join(at, "sheet"), "sheet").where(F.col("_row") > F.col("at"))
    cast = {"number": coerce.parse_number, "datetime": coerce.parse_time}
    time = coerce.parse_time(F.get("cells", F.col("_at_time")))
    typed = [cast.get(k["type"], lambda x: x)(F.get("cells", F.col(f"_at{i}"))).alias(f"_c{i}") for i, k in enumerate(kinds)]
    for i, k in enumerate(kinds):  # A time that is parsed as a column is not parsed again.
        if k["type"] == "datetime":
            time = F.when(F.col("_at_time") == F.col(f"_at{i}"), F.col(f"_c{i}")).otherwise(time)
    table = below.select("*", *typed).select("sheet", "_row", *(F.col(f"_c{i}").alias(k["name"]) for i, k in enumerate(kinds)), time.alias("_time"))
    measures = [k["name"] for k in kinds if k["type"] == "number" and k["role"] == "val"]
    categories = [k["name"] for k in kinds if k["type"] == "category" and 1 <= k["distinct_values"] <= 60]
    return table, measures, categories, not at.where("_at_time IS NOT NULL").isEmpty()


def profile_file(spark: SparkSession, path: str, dataset_id: str, store: str, kind: str | None = None) -> dict[str, DataFrame]:
    """Reads the csv, tsv, json or xlsx file at `path` (of a folder, say which `kind`) once,
    profiles it and stores the facets under `dataset_id` in `store`; returns them as stored.

    Units are sheets. `sheets` tells which sheet is what; a facet that needs a time, a
    measure or a category that the file has not is left out.
    """
    profile.check_dataset_id(dataset_id)
    rows = written(readers.read_rows(spark, path, kind=kind), "intake")
    heads = written(_heads(rows), "intake-heads")
    columns = written(roles.column_roles(readers.with_header(rows, found=heads.select("sheet", "at", "names"))), "intake-columns")
    known = _recognised(heads)
    listed = written(sheet_facet(heads, columns, known), "intake-sheets")
    made = [rows, heads, columns, listed]
    facets = {"sheets": listed}
    for found in dict.fromkeys(k.kind for k in known.values()):
        facets[found] = reference_table(rows, heads, found, known)

    def kept(table: DataFrame) -> DataFrame:
        """Written by places of columns: names may be any."""
        made.append(written(table.toDF(*(f"c{i}" for i in range(len(table.columns)))), "intake-table"))
        return made[-1].toDF(*table.columns)

    data = listed.where("contributes").select("sheet")
    if not data.isEmpty():
        table, measures, categories, timed = data_table(rows, heads, columns, data)
        typed = kept(table)
        if "incidents" in facets and timed:
            windows = facets["incidents"].where("quarantine = 'window'").select("start", "end")
            held = kept(crosstab.quarantined_by(typed, "_time", windows))
        else:
            held = typed.withColumn("quarantined", F.lit(False))
        state = rollup.choose_state(held, "sheet", ["_row"], categories, measures)
        facets |= profile.profile(held, "sheet", "_time" if timed else None, ["_row"], state, categories, measures, F.col("quarantined"))
    profile.store_profile(facets, dataset_id, store)
    discard(*made)
    return {name: profile.load_profile(spark, dataset_id, store, name, df.schema) for name, df in facets.items()}
