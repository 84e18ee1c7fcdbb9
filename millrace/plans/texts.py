"""What a profile says in words, and the template of a configuration document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.config import COLUMNS


def magnitude(value: Column, unit: Column, kind: Column) -> Column:
    """A number as it is shown: whole counts without decimals, others with at most
    two, percentages of a share, a dash where there is no number."""
    whole = (kind == "count") & (F.coalesce(unit, F.lit("")) == "") & (value == F.floor(value))
    shown = F.when(kind == "percentage", F.concat(F.format_number(value * 100, 1), F.lit(" %"))).when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    with_unit = F.when((kind != "percentage") & (F.coalesce(unit, F.lit("")) != ""), F.concat(shown, F.lit(" "), unit)).otherwise(shown)
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(with_unit)


def member_label(name: Column) -> Column:
    """A member's name without a date in front of it."""
    return F.regexp_replace(name, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:.Z]*)?\s*[-–—:·|]+\s*", "")


def brief(facets: dict[str, DataFrame]) -> DataFrame:
    """Lines (section, line) about measures, effects and transitions, a few each."""
    n = lambda c: F.format_number(c, 2)
    measures = facets["measures"].select(F.lit("measures").alias("section"), F.concat_ws(" ", "measure", F.lit("averages"), n("mean"), F.lit("from"), n("lo"), F.lit("to"), n("hi"), F.lit("over"), F.format_number("n", 0), F.lit("rows")).alias("line"))
    effects = facets["effects"].orderBy(F.desc("eta2"), "category", "measure").limit(5).select(F.lit("effects").alias("section"), F.concat_ws(" ", "category", F.lit("explains"), F.format_number(F.col("eta2") * 100, 1), F.lit("% of"), "measure").alias("line"))
    moves = facets["transitions"].orderBy(F.desc("n"), "from_state", "to_state").limit(5).select(F.lit("transitions").alias("section"), F.concat_ws(" ", "from_state", F.lit("is followed by"), "to_state", F.format_number("n", 0), F.lit("times")).alias("line"))
    return measures.unionByName(effects).unionByName(moves)


def config_template(spark: SparkSession, results: DataFrame, candidates: DataFrame, each: int = 3) -> DataFrame:
    """A configuration to start from, one row a line: a channel, every result, and
    the questions that tell most apart. Writing it as csv with a header gives a
    document that reads back."""
    blank = {c: F.lit(None).cast("string") for c in COLUMNS}
    row = lambda **known: [known.get(c, blank[c]).cast("string").alias(c) for c in COLUMNS]
    channel = spark.range(1).select(*row(kind=F.lit("channel"), name=F.lit("Operations"), response=F.lit("ops@example.com"), channels=F.lit("email")))
    declared = results.select(*row(kind=F.lit("kbr"), name=F.col("name"), unit=F.col("unit"), format=F.lit("count"), direction=F.lit("up")))
    asked = candidates.orderBy(F.desc("cv"), "category", "measure").limit(each)
    answers = results.select("name").crossJoin(F.broadcast(asked)).select(*row(kind=F.lit("answer"), kbr=F.col("name"), name=F.concat(F.col("measure"), F.lit(" by "), F.col("category")), dimension=F.col("category"), measure=F.col("measure"), aggregation=F.lit("mean"), rank=F.lit("max")))
    return channel.unionByName(declared).unionByName(answers)
